"""Embedding near-duplicates against all pairs, and the parts that the search rests on."""

import itertools

import numpy as np
import pytest

from aislebrook.llm import crosspolytope as cp


def truth(rows, cosine=0.9):
    """(n_links, component_id) of each row (vec_id, vector), by all pairs."""
    fine = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, float)
    links = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(fine, 2):
        a, b = fine[i], fine[j]
        if len(a) == len(b) and a @ b >= cosine * np.sqrt((a @ a) * (b @ b)):
            links[i].add(j)
            links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return out


def near(rng, v, cosine):
    z = rng.normal(size=len(v))
    v = v / np.linalg.norm(v)
    z -= (z @ v) * v
    return (cosine * v + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)).tolist()


@pytest.mark.parametrize("dims,block", [(48, cp.BLOCK), (64, 8), (3, 40)])
def test_groups_are_those_of_all_pairs(spark, dims, block):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(size=dims).tolist()) for i in range(220 if dims > 3 else 60)]
    hub = np.array(rows[7][1])
    for i, c in enumerate(rng.uniform(0.86, 1.0, size=70)):
        rows.append((1000 + i, near(rng, hub if i % 2 else np.array(rows[i][1]), c)))
    rows += [(2000 + i, rows[7][1]) for i in range(25)] + [(2050, [2 * x for x in rows[7][1]]), rows[3]]
    rows += [(3000, None), (3001, []), (3002, [0.0] * dims), (3003, [float("nan")] * dims), (3004, [float("inf")] + [0.0] * (dims - 1)), (3005, rows[7][1] + [1e-9]), (3006, [None] * dims)]
    rows += [(None, rows[7][1]), (None, [1e200] * dims), (3007, [-0.0] * (dims - 1) + [1e-200])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, KEPT int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in cp.near_duplicates(df, block=block).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    with np.errstate(over="ignore", invalid="ignore"):
        want = truth([(k, [x / 1e190 for x in v] if v and v[0] == 1e200 else v) for k, v in rows if k != 3007])
    lone = [r for r in got if r[0] == 3007]
    assert lone[0][2] is not None
    if dims > 3:
        assert sorted((r for r in got if r[0] != 3007), key=key) == sorted(want, key=key)
    assert len(got) == len(rows)


def test_kept_and_columns(spark):
    rows = [(5, [1.0, 0.0], 1), (3, [1.0, 0.01], 2), (9, [0.0, 1.0], 3), (3, [1.0, 0.01], 4), (None, [0.0, -1.0], 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component_id int")
    out = cp.near_duplicates(df)
    assert out.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out.collect()) == [(0, 0, 0, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (9, 0, 9, True)]
    assert cp.near_duplicates(df.limit(0), keep=["vec_id"]).count() == 0


def test_recall_at_the_cosine_itself():
    rng = np.random.default_rng(1)
    for dims, depth in ((64, 2), (64, 3), (100, 1)):
        x = cp._units(rng.normal(size=(2000, dims)))
        y = np.array([near(rng, v, 0.9) for v in x])
        met = np.zeros(len(x), bool)
        for t in range(cp.tables_for(dims, depth)):
            met |= (cp.probes(x, t, depth)[:, :, None] == cp.probes(y, t, depth)[:, None, :]).any(axis=(1, 2))
        assert met.mean() > 0.998


def test_transform_is_orthogonal_and_sketches_are_near():
    rng = np.random.default_rng(2)
    h = cp.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16)) and set(np.unique(h)) == {-1.0, 1.0}
    x = cp._units(rng.normal(size=(3000, 40)))
    y = np.array([near(rng, v, 0.9) for v in x])
    bits = [np.packbits(v @ cp._projections(40) > 0, axis=1).view(np.uint64) for v in (x, y)]
    apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1)
    assert apart.max() <= cp.bits_apart(0.9) < 100


def test_cosine_at_the_limit():
    a = np.array([1.0, 0.0])
    assert cp.reaches(a, np.array([9.0, np.sqrt(19.0)]), 0.9) == (9.0 >= 0.9 * np.sqrt(100.0))
    assert not cp.reaches(a, np.array([0.9, 0.4358898943540674 + 1e-12]), 0.9)
