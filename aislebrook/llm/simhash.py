"""SimHash near-duplicates by covering locality-sensitive hashing.

A random word of radius + 1 bits is drawn for each of the 64 bit positions. Every
non-zero word v of that length is a table, whose mask holds the positions with an odd
inner product with v. Up to `radius` positions span less than all words, so some v is
orthogonal to all of them: that table's mask avoids every bit in which two fingerprints
within the radius differ, and both fall in one bucket. No pair is missed.

Equal fingerprints are one from the start. A bucket that holds more than one task should
compare is hashed again by a second family of masks on top of the first, and again by a
third; three masks leave so few free bits that distinct fingerprints cannot crowd a
bucket. A bucket's fingerprints that link are joined to the smallest of their component
there, so a bucket gives fewer links than members. Components of the links follow by
alternating star contraction.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislebrook.sources.scratch import materialize

from .common import annotate, field, fresh, named, utf8

SEED = 42
# Families of masks laid over each other; with three, a bucket has few free bits.
LEVELS = 3
# Fingerprints of one bucket that a task compares with each other.
BUCKET = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: bytes, shingle: int) -> int:
    """The SimHash of a text in UTF-8, as unsigned 64-bit integer; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """df with `simhash` (long: the 64 bits, signed) of every whole text. Texts without
    words, null or empty ones included, have fingerprint 0."""

    def compute(texts):
        found = np.array([fingerprint_of(x, shingle) for x in utf8(texts)], np.uint64)
        return [pa.array(found.view(np.int64), pa.int64())]

    return annotate(df, [text], [field("simhash", T.LongType())], compute)


def masks(radius: int, seed: int, bits: int = 64) -> list[int]:
    """The masks of one covering family, as signed 64-bit integers. Positions share the
    non-zero words evenly, in shuffled order, so every mask has about half of the bits."""
    words = 1 << (radius + 1)
    word = 1 + np.random.default_rng(seed).permutation(bits) % (words - 1)
    made = []
    for v in range(1, words):
        odd = np.array([bin(v & int(w)).count("1") & 1 for w in word])
        value = sum(1 << i for i in np.flatnonzero(odd).tolist())
        made.append(value - (1 << 64) if value >> 63 else value)
    return made


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of signed numbers, numpy would count those of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _local_links(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) of distinct fingerprints that link."""
    n = len(codes)
    label = np.arange(n)
    near = []
    for i in range(0, n, 256):
        some = _apart(codes[i : i + 256, None], codes[None, :]) <= radius
        a, b = np.nonzero(some)
        a = a + i
        keep = b < a
        near.append(np.stack([a[keep], b[keep]]))
    a, b = np.concatenate(near, axis=1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


def links(codes: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a != b for distinct fingerprints `simhash`: links within the radius,
    fewer than all, whose components are those of all links."""
    found = []
    now = codes.select("simhash", F.lit(0).cast("long").alias("masked"), F.lit(0).cast("long").alias("key"))
    for level in range(LEVELS):
        family = F.array(*[F.lit(m) for m in masks(radius, seed=level + 1)])
        each = now.select("simhash", "masked", "key", F.posexplode(family).alias("v", "mask"))
        mask = F.col("mask").bitwiseOR(F.col("masked"))
        each = each.select("simhash", mask.alias("masked"), F.xxhash64("key", "v", F.col("simhash").bitwiseAND(mask)).alias("key"))
        sizes = materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
        each = each.join(sizes, "key")
        last = level == LEVELS - 1 or sizes.where(F.col("members") > bucket).isEmpty()
        found.append(_solved(each if last else each.where(F.col("members") <= bucket), radius))
        if last:
            break
        now = each.where(F.col("members") > bucket).select("simhash", "masked", "key")
    return reduce(DataFrame.union, found).distinct()


def _solved(members: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets; a bucket's rows are bounded in number."""

    def run(batches):
        key, codes = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            codes = np.concatenate([codes, batch.column(1).to_numpy()])
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            yield from solve(key[:done], codes[:done])
            key, codes = key[done:], codes[done:]
        yield from solve(key, codes)

    def solve(key, codes):
        if not len(key):
            return
        cuts = np.flatnonzero(np.diff(key)) + 1
        first = np.concatenate([[0], cuts])
        size = np.diff(np.append(first, len(key)))
        left, right = [], []
        for s in np.unique(size[size <= 8]):  # buckets of one small size at once
            rows = first[size == s][:, None] + np.arange(s)
            near = _apart(codes[rows][:, :, None], codes[rows][:, None, :]) <= radius
            k, i, j = np.nonzero(near)
            keep = j < i
            left.append(codes[rows[k[keep], i[keep]]])
            right.append(codes[rows[k[keep], j[keep]]])
        for a, n in zip(first[size > 8], size[size > 8]):
            some = codes[a : a + n]
            i, j = _local_links(some, radius)
            left.append(some[i])
            right.append(some[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], names=["a", "b"])

    ordered = members.select("key", "simhash").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that is
    reachable. Alternating star contraction: each round ties a node's larger neighbours,
    then its smaller ones, to its smallest; rounds grow with the logarithm of a
    component's size. A hub's edges are summed before they are shuffled, and the joins
    back on it are split where they are skewed. Each round is a written table."""
    edges, before = edges.where("a != b"), None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        near = large.join(low, "a")
        small = near.select("a", "low").union(near.where("b != low").select("b", "low")).toDF("a", "b")
        edges = materialize(small.distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"links still change after {most_rounds} rounds")


def _roots(rows: DataFrame, radius: int) -> DataFrame:
    """(simhash, root) for every fingerprint of rows."""
    codes = materialize(rows.select("simhash").distinct(), "codes")
    tied = components(materialize(links(codes, radius), "links"))
    return codes.join(tied, codes.simhash == tied.node, "left").select("simhash", F.coalesce("root", "simhash").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint, component_id), one row per row of df. fingerprint: 16 lower-case
    hex digits. component_id: the smallest key reachable over links of at most `radius`
    differing bits, the row's own key included.

    Null and empty texts have fingerprint zero and link with each other and with what is
    near. Null keys are passed over as long as the component has another; a component of
    null keys alone has component_id null. Repeated rows and repeated keys each keep a
    row. An empty table gives none. Other columns are ignored, whatever their names."""
    docs = materialize(fingerprints(df.select(named(key).alias("k"), named(text).alias("t")), "t", shingle).select("k", "simhash"), "simhash")
    roots = materialize(_roots(docs, radius), "roots")
    least = docs.groupBy("simhash").agg(F.min("k").alias("k")).join(roots, "simhash")
    least = least.groupBy("root").agg(F.min("k").alias("component_id"))
    of = roots.join(least, "root").select("simhash", "component_id")
    return docs.join(of, "simhash").select(F.col("k").alias(key), hex16(F.col("simhash")).alias("fingerprint"), "component_id")


def hex16(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """df with one row of each component: the one with the smallest key, the first read of
    those that share it. A row with a null key stays only where its component has no
    other. df is read once, and its rows are written with their numbers."""
    row = fresh(df, "row")
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(named(row).alias("r"), named(key).alias("k"), named(text).alias("t"))
    rows = materialize(fingerprints(rows, "t", shingle).select("r", "k", "simhash"), "simhash")
    order = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "r")).alias("best")
    least = rows.groupBy("simhash").agg(order).join(_roots(rows, radius), "simhash")
    kept = least.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.r").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
