"""Embedding near-duplicates by cross-polytope hashing.

A hash rotates a vector three times (random signs, then a fast Hadamard transform each)
and takes the nearest of the 2d corners of the cross-polytope: the place and sign of the
largest coordinate. `depth` such corners make a bucket of a table. Multiprobe: a vector
lies in its own bucket of every table and in those of the next corners, by what they lose
against the nearest. How many tables there are follows from a simulation of pairs at the
cosine: as many as leave a share of `miss` of them without a common bucket.

Equal vectors are one class from the start. Members of a bucket first meet as sketches,
the signs of 256 random projections, whose differing bits exceed a limit for a pair at the
cosine with a probability below 1e-9; only members with a partner there bring their
vectors, and pairs are verified in double precision. A pair counts in the first of its
common buckets only. A bucket too large for one task is cut into blocks, and each two
blocks meet in a cell of their own: no pair is given up, and no pair leaves its cell. A cell gives each member's
number of links and the smallest member it is tied to.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislebrook.sources.scratch import materialize

from .common import fresh, named, slices, without
from .simhash import components

COSINE = 0.9
# Buckets that a vector lies in, in each table.
PROBES = 8
# Corners that each hash may fall back to.
CORNERS = 4
# Share of pairs at the cosine itself that may have no common bucket.
MISS = 1e-4
# Members of a bucket that one task compares with each other.
BLOCK = 1024
SKETCH_WORDS = 4
SEED = 11
_PAIRS_AT_ONCE = 1 << 14


def padded(dims: int) -> int:
    """Length that the transform works on: a power of two, 16 at least, so that few
    dimensions have many rotations as well."""
    return max(16, 1 << (dims - 1).bit_length())


def hadamard(y: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform over the last axis, in place, in n log n steps."""
    n, h = y.shape[-1], 1
    while h < n:
        v = y.reshape(*y.shape[:-1], n // (2 * h), 2, h)
        low, high = v[..., 0, :] + v[..., 1, :], v[..., 0, :] - v[..., 1, :]
        v[..., 0, :], v[..., 1, :] = low, high
        h *= 2
    return y


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x under each rotation of signs (rotations x 3 x length)."""
    y = np.repeat(np.pad(x, ((0, 0), (0, signs.shape[2] - x.shape[1])))[:, None, :], len(signs), axis=1)
    for k in range(3):
        y = hadamard(y * signs[:, k]) / np.sqrt(signs.shape[2])
    return y


def _signs(dims: int, table: int, depth: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims, table]).choice([-1.0, 1.0], size=(depth, 3, padded(dims)))


def probes(x: np.ndarray, table: int, depth: int, most: int = PROBES) -> np.ndarray:
    """Codes of the buckets of one table that unit vectors lie in, the own one first."""
    y = rotated(x, _signs(x.shape[1], table, depth))
    size = np.abs(y)
    corner = np.argsort(-size, axis=2, kind="stable")[:, :, :CORNERS]
    value = np.take_along_axis(size, corner, 2)
    code = 2 * corner + (np.take_along_axis(y, corner, 2) < 0)
    lost = (value[:, :, :1] - value) ** 2
    choice = np.array(list(itertools.product(range(CORNERS), repeat=depth)))
    total = sum(lost[:, j, choice[:, j]] for j in range(depth))
    best = np.argsort(total, axis=1, kind="stable")[:, :most]
    made = np.zeros(best.shape, np.uint64)
    for j in range(depth):
        made = made * np.uint64(2 * y.shape[2]) + np.take_along_axis(code[:, j], choice[best, j], 1).astype(np.uint64)
    return made


def _mixed(code: np.ndarray, table: int, dims: int) -> np.ndarray:
    """64-bit names of buckets, spread by a finaliser."""
    x = code + np.uint64((table * 0x9E3779B97F4A7C15 + dims * 0xC2B2AE3D27D4EB4F) & (2**64 - 1))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


@lru_cache(maxsize=64)
def tables_for(dims: int, depth: int, cosine: float = COSINE, miss: float = MISS, pairs: int = 1500) -> int:
    """Tables after which a share of `miss` of the pairs at this cosine is still apart,
    from simulated pairs."""
    if dims < 2 or cosine >= 1:
        return 1
    rng = np.random.default_rng([SEED, dims, depth])
    x, z = _units(rng.normal(size=(pairs, dims))), rng.normal(size=(pairs, dims))
    z = _units(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    a, b = probes(x, 0, depth), probes(y, 0, depth)
    met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean()
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(max(met, 1e-3), 1 - 1e-9))))


@lru_cache(maxsize=16)
def bits_apart(cosine: float, bits: int = 64 * SKETCH_WORDS, miss: float = 1e-9) -> int:
    """Differing sign bits that a pair at this cosine exceeds with probability `miss` at most."""
    p, rest = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 1.0
    for k in range(bits + 1):
        rest -= math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if rest <= miss:
            return k
    return bits


def _units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are scaled by powers of two first, so that no square overflows."""
    most = np.abs(x).max(axis=1, keepdims=True)
    x = np.ldexp(x, -np.frexp(most)[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=16)
def _projections(dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).normal(size=(dims, 64 * SKETCH_WORDS))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of a column of arrays, for each length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[first[rows][:, None] + np.arange(d)]


def signed(classes: DataFrame, depth: int, cosine: float, miss: float) -> DataFrame:
    """classes (cls, copies, v) with dims, sketch and the names of their buckets (`keys`)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1 << 20):
                made: list = [None] * part.num_rows
                for rows, x in _vectors(part.column(2)):
                    unit, d = _units(x), x.shape[1]
                    keys = np.concatenate([_mixed(probes(unit, t, depth), t, d) for t in range(tables_for(d, depth, cosine, miss))], axis=1)
                    sketch = np.packbits(unit @ _projections(d) > 0, axis=1)
                    for i, k, s in zip(rows.tolist(), keys, sketch):
                        made[i] = (d, k, s.tobytes())
                dims, keys, sketch = zip(*made) if made else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(dims, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["cls", "copies", "v", "dims", "keys", "sketch"],
                )

    return classes.mapInArrow(run, "cls bigint, copies bigint, v array<double>, dims bigint, keys array<bigint>, sketch binary")


CELL = ["dims", "key", "low", "high"]


def _by_cell(rows: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """solve(rows of some whole cells, starts and ends of the cells) for all cells; rows
    come ordered by cell and class, and a cell holds two blocks at most."""

    def cells(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            change = _changes(held)
            if len(change):
                yield from done(held.slice(0, int(change[-1])))
                held = held.slice(int(change[-1]))
        if held is not None:
            yield from done(held)

    def _changes(table):
        differs = np.zeros(max(0, table.num_rows - 1), bool)
        for name in CELL:
            x = table.column(name).to_numpy()
            differs |= x[1:] != x[:-1]
        return np.flatnonzero(differs) + 1

    def done(table):
        table = table.combine_chunks()
        edges = np.concatenate([[0], _changes(table), [table.num_rows]])
        yield from solve(table, edges[:-1], edges[1:])

    ordered = rows.repartition(*CELL).sortWithinPartitions(*CELL, "cls")
    return ordered.mapInArrow(cells, schema)


def _facing(low: int, high: int, side: np.ndarray, some: slice) -> np.ndarray:
    """Which members of a cell the rows `some` are compared with: all in a block's own
    cell, else those of the other block."""
    return np.ones((len(side[some]), len(side)), bool) if low == high else side[some][:, None] != side[None, :]


def _partnered(entries: DataFrame, limit: int) -> DataFrame:
    """The entries (cell, side, cls) whose sketch is near another one's in their cell."""

    def solve(table, starts, ends):
        words = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(-1, SKETCH_WORDS)
        low, high, side = (table.column(c).to_numpy() for c in ("low", "high", "side"))
        keep = np.zeros(len(words), bool)
        size = ends - starts
        for s in np.unique(size[(size > 1) & (size <= 8)]):  # small cells of one size at once
            rows = starts[size == s][:, None] + np.arange(s)
            for part in range(0, len(rows), 4096):
                r = rows[part : part + 4096]
                apart = np.bitwise_count(words[r][:, :, None, :] ^ words[r][:, None, :, :]).sum(axis=3, dtype=np.int64)
                fits = (apart <= limit) & ~np.eye(s, dtype=bool) & ((low[r] == high[r])[:, :, None] | (side[r][:, :, None] != side[r][:, None, :]))
                keep[r] |= fits.any(axis=2)
        for a, b in zip(starts[size > 8].tolist(), ends[size > 8].tolist()):
            w, m = words[a:b], b - a
            for i in range(0, m, 128):
                some = slice(i, min(m, i + 128))
                apart = np.bitwise_count(w[some, None, :] ^ w[None, :, :]).sum(axis=2, dtype=np.int64)
                fits = (apart <= limit) & _facing(low[a], high[a], side[a:b], some)
                fits[np.arange(some.stop - i), np.arange(i, some.stop)] = False
                keep[a + i : a + some.stop] |= fits.any(axis=1)
        yield from table.filter(pa.array(keep)).select([*CELL, "side", "cls"]).to_batches()

    return _by_cell(entries, solve, "dims bigint, key bigint, low bigint, high bigint, side bigint, cls bigint")


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each is tied to by pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def reaches(x: np.ndarray, y: np.ndarray, cosine: float) -> bool:
    """Whether two vectors have this cosine, by sums that are rounded once."""
    return math.fsum(x * y) >= cosine * math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _verified(members: DataFrame, cosine: float) -> DataFrame:
    """(cls, links, low) for members of cells with links that count there: their number,
    copies included, and the smallest class tied to them."""

    def solve(table, starts, ends):
        cls, copies, key, low, high, side = (table.column(c).to_numpy() for c in ("cls", "copies", "key", "low", "high", "side"))
        made = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            m = b - a
            if m < 2:
                continue
            part = table.slice(a, m)
            x = np.array(part.column("v").to_pylist(), np.float64)
            unit = _units(x)
            keys = np.array(part.column("keys").to_pylist(), np.int64)
            links, left, right = np.zeros(m, np.int64), [], []
            for i in range(0, m, 256):
                some = slice(i, min(m, i + 256))
                near = unit[some] @ unit.T
                fits = (near >= cosine - 1e-9) & _facing(low[a], high[a], side[a:b], some)
                u, v = np.nonzero(fits)
                near, u = near[u, v], u + i
                once = u < v
                u, v, near = u[once], v[once], near[once]
                tight = np.flatnonzero(near < cosine + 1e-9)
                if len(tight):
                    good = np.ones(len(u), bool)
                    good[tight] = [reaches(x[p], x[q], cosine) for p, q in zip(u[tight], v[tight])]
                    u, v = u[good], v[good]
                first = np.ones(len(u), bool)
                for j in range(0, len(u), _PAIRS_AT_ONCE):
                    first[j : j + _PAIRS_AT_ONCE] = _first_common(keys[u[j : j + _PAIRS_AT_ONCE]], keys[v[j : j + _PAIRS_AT_ONCE]]) == key[a]
                left.append(u[first])
                right.append(v[first])
            u, v = np.concatenate(left), np.concatenate(right)
            if len(u):
                np.add.at(links, u, copies[a:b][v])
                np.add.at(links, v, copies[a:b][u])
                tied = _lowest(m, u, v)
                at = np.flatnonzero(links)
                made.append((cls[a:b][at], links[at], cls[a:b][tied[at]]))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=["cls", "links", "low"])

    return _by_cell(members, solve, "cls bigint, links bigint, low bigint")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bucket, by table and place in a's list, that both rows of each pair lie in."""
    found = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for i in range(0, a.shape[1], PROBES):
        x, y = a[open_, i : i + PROBES], b[open_, i : i + PROBES]
        met = (x[:, :, None] == y[:, None, :]).any(axis=2)
        # The smallest name, so that the order of the two does not matter.
        name = np.where(met, x, np.iinfo(np.int64).max).min(axis=1)
        hit = met.any(axis=1)
        found[open_[hit]] = name[hit]
        open_ = open_[~hit]
    return found


def _fine(vector):
    """The vector as doubles, null where it takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return F.when(finite & F.exists(x, lambda v: v != 0), x)


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, miss: float = MISS, block: int = BLOCK, keep: list[str] | None = None
) -> DataFrame:
    """df (or its columns `keep`) with n_links, component_id and kept, one row per row of df.

    n_links: other rows whose vector has this cosine to the row's, copies included;
    component_id: the smallest key reachable over such links, the row's own included;
    kept: whether that is the row's own key. Every link that is found is verified; of the
    pairs at the cosine itself a share of `miss` is not found, of nearer ones fewer.

    Vectors that are null, empty or all zero, or hold a null or non-finite component,
    link with nothing and are kept. Vectors of different lengths don't link. Rows that
    repeat are copies of each other: they link, and those with the smallest key all stay.
    Null keys are passed over as long as the component has another; with null keys alone
    component_id is null and the rows stay. Empty tables give no rows; columns of df with
    the new names give way, unless they are the key or the vector: those are read first."""
    new = ["n_links", "component_id", "kept"]
    carried = without(df.select(*[named(c) for c in (df.columns if keep is None else keep)]), new).columns
    k, v = fresh(df, "own_key"), fresh(df, "own_vector")
    rows = df.select(*[named(c) for c in carried], named(key).alias(k), _fine(named(vector)).alias(v))
    classes = rows.where(F.col(v).isNotNull()).groupBy(F.col(v).alias("v")).agg(F.count(F.lit(1)).alias("copies"), F.min(k).alias("least"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "copies", "v", "least"), "classes")
    n, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    # Buckets of a table as many as classes, to the nearest power: what shares a bucket by chance stays bounded.
    depth = max(1, round(math.log(max(2, n)) / math.log(2 * padded(dims or 1))))
    hashed = materialize(signed(classes.select("cls", "copies", "v"), depth, cosine, miss), "hashed")

    entries = hashed.select("cls", "dims", "sketch", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = entries.groupBy("dims", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks")).where("blocks > 1")
    entries = entries.join(materialize(crowded, "crowded"), ["dims", "key"], "left")
    side = F.pmod(F.xxhash64("cls"), F.coalesce("blocks", F.lit(1).cast("long")))
    entries = entries.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)))
    entries = entries.select("dims", "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "cls", "sketch")
    partnered = materialize(_partnered(entries, bits_apart(cosine)), "partnered")
    found = materialize(_verified(partnered.join(hashed.select("cls", "copies", "v", "keys"), "cls"), cosine), "links")

    tied = components(found.where("cls != low").select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct())
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    whole = classes.select("cls", "copies", "least").join(links, "cls", "left").join(tied, F.col("cls") == F.col("node"), "left")
    whole = materialize(whole.select("cls", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")), "tied")
    smallest = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = whole.join(smallest, "root").select("cls", "n_links", "component_id").join(classes.select("cls", "v"), "cls").drop("cls")
    out = rows.join(whole, rows[v] == whole["v"], "left")
    component = F.when(F.col(v).isNull(), F.col(k)).otherwise(F.col("component_id"))
    return out.select(
        *[rows[f"`{c.replace('`', '``')}`"] for c in carried],
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(k) == component, component.isNull()).alias("kept"),
    )
