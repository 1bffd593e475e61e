"""The robust estimate against brute force, and groups that are bad to nearly a half."""

import random

import numpy as np
import pytest

from aislebrook.llm import outliers as o


def raw_mcd(x, share, starts, rng):
    """Least determinant over concentration from many random subsets, with exact halves."""
    n, h, best = len(x), int(np.ceil(share * len(x))), None
    for _ in range(starts):
        near = rng.choice(n, o.DIMENSIONS + 1, replace=False)
        for step in range(100):
            mean, cov = x[near].mean(axis=0), np.cov(x[near].T, ddof=0) + 1e-9 * np.eye(o.DIMENSIONS)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.sort(np.argsort(d, kind="stable")[:h])
            if step and np.array_equal(new, near):
                break
            near = new
        det = np.linalg.slogdet(np.cov(x[near].T, ddof=0))[1]
        if best is None or det < best[0]:
            best = (det, near)
    return best[1]


def brute(x, share=o.SHARE, starts=60):
    near = raw_mcd(x, share, starts, np.random.default_rng(1))
    mean, cov = x[near].mean(axis=0), o._consistency(share) * np.cov(x[near].T, ddof=0)
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    inner = x[distance(mean, cov) <= o.chi_square_quantile(0.975, o.DIMENSIONS)]
    return distance(inner.mean(axis=0), o._consistency(0.975) * np.cov(inner.T, ddof=0))


@pytest.mark.parametrize("share,bad", [(0.5, 0.4), (0.75, 0.2)])
def test_estimate_is_near_that_of_brute_force(spark, share, bad):
    groups, rows = {}, []
    for g in range(2):
        rng = np.random.default_rng(10 * g + int(100 * bad))
        mix = rng.normal(size=(5, 5)) + 2 * np.eye(5)
        x = rng.normal(size=(400, 5)) @ mix
        k = int(bad * len(x))
        x[:k] = rng.normal(size=(k, 5)) + 25 * (1 if g else -1)
        groups[f"={g}"] = x
        rows += [("=l", f"={g}", v.tolist()) for v in x]
    df = spark.createDataFrame(rows, "g_lang string, g_source string, x array<double>")
    cut = o.chi_square_quantile(1 - o.TAIL, 5)
    for r in o.estimate(df, share).collect():
        x, want = groups[r.g_source], brute(groups[r.g_source], share)
        inverse = np.empty((5, 5))
        for (i, j), v in zip(o._PAIRS, r.inverse):
            inverse[i, j] = inverse[j, i] = v
        got = np.einsum("ij,jk,ik->i", x - np.array(r.center), inverse, x - np.array(r.center))
        assert ((got <= cut) == (want <= cut)).mean() >= 0.995
        k = int(bad * len(x))
        assert (got[:k] > cut).all() and (got[k:] <= cut).mean() >= 0.99
        np.testing.assert_allclose(np.median(got[k:]), np.median(want[k:]), rtol=0.1)


def texts(rng, n, bad):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 260))]
        if i < bad * n:
            words = [w + rng.choice(["##", "$%", "<>"]) if rng.random() < 0.5 else w for w in words]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("bad", [0.3, 0.4])
def test_a_group_may_be_bad_to_nearly_a_half(spark, bad):
    rng = random.Random(int(100 * bad))
    rows = [(i, t, "xx", "s") for i, t in enumerate(texts(rng, 400, bad))]
    rows += [(1000 + i, t, "xx", "clean") for i, t in enumerate(texts(rng, 200, 0))]
    got = {r.doc_id: r for r in o.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), keep=["doc_id"]).collect()}
    k = int(bad * 400)
    assert not any(got[i].kept for i in range(k))
    assert sum(got[i].kept for i in [*range(k, 400), *range(1000, 1200)]) >= 0.99 * (600 - k)
    assert {r.judged_with for r in got.values()} == {"source"}


def test_small_groups_are_pooled_and_say_so(spark):
    rng = random.Random(3)
    rows = [(i, t, "xx" if i < 90 else "yy" if i < 120 else None, f"s{i % 3}" if i < 120 else None) for i, t in enumerate(texts(rng, 130, 0))]
    rows += [(500, "w " * 200_000, "xx", "s0"), (501, texts(rng, 1, 0)[0], None, "s0")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    by = lambda least: {r.doc_id: r.judged_with for r in o.judge(df, keep=["doc_id"], least_rows=least).collect()}
    assert set(by(20).values()) == {"source", "language", None} and by(20)[500] == "source"
    pooled = by(50)
    assert pooled[0] == "language" and pooled[95] == "all" and pooled[125] == "all" and pooled[501] == "all"
    few = o.judge(df.limit(8), keep=["doc_id"]).collect()
    assert all(r.judged_with is None and r.kept for r in few) and len(few) == 8


def test_a_concentration_step_is_planned_in_few_calls(spark, monkeypatch):
    """The driver plans up to sixty of them: built operator by operator, one took over a thousand calls."""
    rows = spark.createDataFrame([("=l", "=s", [0.0] * 5)], "g_lang string, g_source string, x array<double>")
    fit = spark.createDataFrame([], o._FIT)
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    # What only frees objects (m, d) comes whenever Python collects them.
    monkeypatch.setattr(client, "send_command", lambda c, *a, **k: (c.startswith("m") or calls.append(c), send(c, *a, **k))[1])
    assert o._concentrated(rows, fit, o.SHARE, 1.0).columns[:3] == ["g_lang", "g_source", "start"]
    assert 0 < len(calls) < 600, len(calls)
