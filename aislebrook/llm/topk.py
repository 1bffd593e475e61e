"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets of similar lengths and bounded size. Queries
come in blocks. A first pass over the longest bucket gives every query k real products,
and so a threshold that its answers cannot lie below. For each bucket the threshold,
divided by the query's and the bucket's longest length, is a cosine: above 1 the bucket
holds nothing and the pair is never formed; where it is high, coordinate pruning keeps
the vectors whose largest-weight coordinates lie in the range that such a cosine leaves;
else length pruning keeps the vectors long enough to reach it. What is kept is verified
by its exact product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislebrook.sources.scratch import materialize

from .common import named

# Vectors of a bucket, queries of a block.
BUCKET = 4096
BLOCK = 512
# Blocks that a copy of the longest bucket serves in the first pass.
FIRST_BLOCKS = 4
# Lengths within one bucket class differ by this factor at most.
RATIO = 1.1
# From this cosine on, coordinates prune.
COORDINATE_COSINE = 0.8
FOCUS = 4


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, as doubles; null for a null or empty vector
    and for one with a null or non-finite component."""
    x = F.transform(vector, lambda v: factor * v.cast("double"))
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)
    # A double beyond 2^52 has no fraction; floor() as bigint would saturate there.
    return F.when(fine, F.transform(x, lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)))


def _candidates(q: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray:
    """Vectors of a bucket (as units) whose coordinates leave a cosine this high possible."""
    focus = np.argsort(-np.abs(q))[:FOCUS]
    keep = np.ones(len(unit), bool)
    for f in focus:
        away = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - q[f] * q[f]))) + 1e-9
        keep &= np.abs(unit[:, f] - q[f] * cosine) <= away if abs(q[f]) <= cosine else unit[:, f] * np.sign(q[f]) >= q[f] * np.sign(q[f]) * cosine - away
    return np.flatnonzero(keep)


def _best(ids: np.ndarray, scores: np.ndarray, own, k: int):
    """The k highest scores, ties to smaller ids, the query's own id left out."""
    keep = ids != own
    ids, scores = ids[keep], scores[keep]
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        ids, scores = ids[some], scores[some]
    by = np.lexsort((ids, -scores))[:k]
    return ids[by], scores[by]


def _matched(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of the bucket it is paired with."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                d = r["dims"]
                ids = np.frombuffer(r["ids"], "<i8")
                vectors = np.frombuffer(r["vectors"], "<f8").reshape(len(ids), d)
                length = np.sqrt((vectors * vectors).sum(axis=1))
                by = np.argsort(-length, kind="stable")
                ids, vectors, length = ids[by], vectors[by], length[by]
                unit = vectors / np.maximum(length, 1e-300)[:, None]
                qids = np.frombuffer(r["qids"], "<i8")
                queries = np.frombuffer(r["queries"], "<f8").reshape(len(qids), d)
                least = np.frombuffer(r["least"], "<f8")
                norms = np.sqrt((queries * queries).sum(axis=1))
                reach = norms * (length[0] if len(length) else 0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = np.where(reach > 0, least / reach, np.where(least > 0, 2.0, -1.0))
                cosine = np.where(np.isneginf(least), -1.0, cosine) - 1e-9
                plain = np.flatnonzero(cosine < COORDINATE_COSINE)
                if len(plain):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        needed = np.where((least[plain] > 0) & (norms[plain] > 0), least[plain] / norms[plain] * (1 - 1e-9), -1.0)
                    # Lengths fall: the vectors that are long enough come first.
                    enough = np.searchsorted(-length, -needed, side="right")
                    most = int(enough.max())
                    found = queries[plain] @ vectors[:most].T
                    for i, n in zip(range(len(plain)), enough.tolist()):
                        a, s = _best(ids[:n], found[i, :n], qids[plain[i]], k)
                        rows += [(int(qids[plain[i]]), int(x), int(y)) for x, y in zip(a, s)]
                for i in np.flatnonzero((cosine >= COORDINATE_COSINE) & (cosine <= 1.0)):
                    some = _candidates(queries[i] / norms[i], unit, float(cosine[i]))
                    if len(some):
                        a, s = _best(ids[some], vectors[some] @ queries[i], qids[i], k)
                        rows += [(int(qids[i]), int(x), int(y)) for x, y in zip(a, s)]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return pairs.select("dims", "ids", "vectors", "qids", "queries", "least").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _packed(rows: DataFrame, group: list[str], names: tuple[str, str], extra: tuple = ()) -> DataFrame:
    """Rows (id, v, ...) of each group, a bounded number, packed into binaries."""
    kinds = ", ".join([*(f"{g} long" for g in group), f"{names[0]} binary, {names[1]} binary", *(f"{e} binary" for e in extra)])

    def pack(batches):
        for b in batches:
            n = len(group)
            columns = [b.column(i) for i in range(n)]
            ids = pa.array([np.array(x, "<i8").tobytes() for x in b.column(n).to_pylist()], pa.binary())
            rest = [
                pa.array([np.array(x, "<f8").tobytes() for x in b.column(n + 1 + i).to_pylist()], pa.binary()) for i in range(1 + len(extra))
            ]
            yield pa.RecordBatch.from_arrays([*columns, ids, *rest], names=[*group, *names, *extra])

    listed = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("id", "v", *extra))).alias("all"))
    flat = listed.select(*group, F.col("all.id").alias("ids"), F.flatten("all.v").alias("v"), *[F.col(f"all.{e}").alias(e) for e in extra])
    return flat.mapInArrow(pack, kinds)


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of quantised
    vectors among all rows whose id is another, all of them if there are fewer; ties to
    smaller ids.

    Vectors that are null, empty, or hold a null or non-finite component take no part,
    nor do rows with a null id. Vectors of another length than the query's are no
    candidates for it. Repeated rows are candidates each and one query. Products are
    exact as long as lengths multiply to less than 2^53. An empty table gives no rows."""
    rows = df.select(named(key).cast("long").alias("id"), quantised(named(vector), factor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    rows = rows.where("id is not null and v is not null").withColumn("dims", F.size("v").cast("long"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # Classes of length, 0 for the longest.
    rows = rows.withColumn("norm", norm).withColumn("class", -F.floor(F.log(F.greatest("norm", F.lit(1e-6))) / float(np.log(RATIO))).cast("long"))
    sizes = rows.groupBy("dims", "class").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    sizes = materialize(sizes.withColumn("shares", F.ceil(F.col("n") / BUCKET).cast("long")), "classes")
    first = sizes.groupBy("dims").agg(F.min("class").alias("class")).withColumn("first", F.lit(True))
    dealt = rows.join(sizes.select("dims", "class", "shares"), ["dims", "class"])
    share = F.pmod(F.xxhash64("row"), F.col("shares"))
    buckets = materialize(_packed(dealt.withColumn("share", share), ["dims", "class", "share"], ("ids", "vectors")), "buckets")

    asked = rows.where("asks").dropDuplicates(["id", "v"])
    blocks = asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    asked = materialize(asked.join(blocks, "dims").select("dims", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "v", "norm"), "queries")
    none = asked.withColumn("least", F.lit(float("-inf")))
    longest = first.join(sizes, ["dims", "class"]).select("dims", "class", "shares")
    start = buckets.where("share = 0").join(longest.select("dims", "class"), ["dims", "class"])
    # The longest bucket goes to some blocks at a time: one vector length may be the whole table.
    some = blocks.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / FIRST_BLOCKS))).alias("salt"))
    first_blocks = _packed(none, ["dims", "block"], ("qids", "queries"), ("least",)).withColumn("salt", F.floor(F.col("block") / FIRST_BLOCKS))
    seeds = _matched(first_blocks.join(start.join(some, "dims"), ["dims", "salt"]), k)
    least = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    known = asked.join(least, asked.id == least.query_id, "left")
    known = known.select("dims", "block", "id", "v", "norm", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"))
    known = materialize(known, "thresholds")
    # A block meets a class only if one of its queries can reach its threshold there.
    need = known.groupBy("dims", "block").agg(F.min(F.when(F.col("norm") > 0, F.col("least") / F.col("norm")).otherwise(F.when(F.col("least") > 0, float("inf")).otherwise(float("-inf")))).alias("need"))
    packed = materialize(_packed(known, ["dims", "block"], ("qids", "queries"), ("least",)).join(need, ["dims", "block"]), "blocks")
    places = packed.select("dims", "block", "need").join(sizes, "dims").where(F.col("longest") * (1 + 1e-9) >= F.col("need"))
    places = places.select("dims", "block", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    pairs = places.join(packed.drop("need"), ["dims", "block"])
    found = _matched(pairs.join(buckets, ["dims", "class", "share"]), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
