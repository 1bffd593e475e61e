"""Ranked lexical search by hashed max-sketches.

Queries come in blocks of bounded size. A document's impacts, the score that each of a
block's terms would earn there, fold into a sketch: terms share its coordinates by hash,
and a coordinate holds the largest impact that falls on it. The sum of a query's
coordinates bounds its score from above, and all documents of a batch are looked up at
once. Documents are then scored exactly by descending bound until the bound falls below
the score of the last answer; a task carries its answers from batch to batch, and the
tasks' answers are ranked together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aislebrook.sources.scratch import materialize, scratch_path

from .common import annotate, field, forget, named, utf8

# Coordinates of a sketch.
WIDTH = 1024
# Queries of a block, and bytes of their distinct terms (one query may have more).
BLOCK_QUERIES = 4096
BLOCK_BYTES = 4 << 20
# Documents whose sketches are looked up together, and that are scored together.
DOCUMENTS = 1024
STEP = 16
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, digits and all that is not ASCII,
    A to Z in lower case."""
    return text.translate(_TABLE).split()


class Block:
    """Some queries: their terms by number, in order of their bytes."""

    def __init__(self, keys: list, terms: list[set[bytes]]):
        self.keys = keys
        self.number = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
        self.terms = [np.array(sorted(self.number[t] for t in some), np.int64) for some in terms]

    def slots(self, width: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(t) % width for t in self.number), np.int64, len(self.number))


def blocks(items: DataFrame, key: str, text: str, queries: int = BLOCK_QUERIES, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The queries with a term, in blocks; the driver holds one block at a time."""
    keys, terms, size = [], [], 0
    for r in items.select(named(key).alias("key"), named(text).alias("text")).distinct().toLocalIterator():
        some = set(terms_of((r["text"] or "").encode()))
        if not some:
            continue
        more = sum(map(len, some))
        if keys and (len(keys) == queries or size + more > most):
            yield Block(keys, terms)
            keys, terms, size = [], [], 0
        keys.append(r["key"])
        terms.append(some)
        size += more
    if keys:
        yield Block(keys, terms)


def indexed(rows: DataFrame, block: Block) -> DataFrame:
    """(key, n, terms, times): the length of each text and its terms that the block has, by
    number, with their occurrences."""
    shared = rows.sparkSession.sparkContext.broadcast(block.number)

    def compute(texts):
        forget()
        number = shared.value
        n, cuts, terms, times = [], [0], [], []
        for x in utf8(texts):
            words = terms_of(x)
            found = sorted(Counter(number[w] for w in words if w in number).items())
            n.append(len(words))
            terms += [t for t, _ in found]
            times += [c for _, c in found]
            cuts.append(len(terms))
        cuts = pa.array(cuts, pa.int32())
        return [pa.array(n, pa.int64()), *[pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (terms, times)]]

    new = [field("n", T.LongType()), field("terms", T.ArrayType(T.LongType())), field("times", T.ArrayType(T.LongType()))]
    return annotate(rows, ["text"], new, compute, keep=["key"])


def weights(index: DataFrame, total: int, block: Block) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) of every term of the block; N and df count documents."""
    held = np.zeros(len(block.number), np.int64)
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    held[counted["term"].to_numpy()] = counted["df"].to_numpy()
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)


class Ranking:
    """The k best documents of each query of a block, over batches of documents."""

    def __init__(self, block: Block, weight: np.ndarray, slots: np.ndarray, width: int, total: int, tokens: int, k: int):
        self.block, self.weight, self.slots, self.width, self.total, self.tokens, self.k = block, weight, slots, width, total, tokens, k
        self.best: list[list[tuple]] = [[] for _ in block.keys]  # (-score, no key, key), the best first
        self.scored = 0
        self.looked = [np.unique(slots[t], return_counts=True) for t in block.terms]

    def add(self, keys: list, n: np.ndarray, cuts: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        count = len(keys)
        row = np.repeat(np.arange(count), np.diff(cuts))
        # Python's integers: N times the length may pass 64 bits before it is divided.
        m = np.array([10 + 90 * x * self.total // self.tokens if self.tokens else 10 for x in n.tolist()], np.int64)
        impact = self.weight[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))
        sketch = np.zeros((self.width, count), np.int64)
        np.maximum.at(sketch, (self.slots[terms], row), impact)
        place = row * len(self.weight) + terms  # rises: rows in order, terms of each in order
        for q, (slot, often) in enumerate(self.looked):
            bound = often @ sketch[slot]
            self._scored(q, keys, bound, place, impact)

    def _scored(self, q: int, keys: list, bound: np.ndarray, place: np.ndarray, impact: np.ndarray) -> None:
        best = self.best[q]
        least = -best[-1][0] if len(best) == self.k else 1
        some = np.flatnonzero(bound >= least)
        some = some[np.argsort(-bound[some], kind="stable")]
        for i in range(0, len(some), STEP):
            least = -best[-1][0] if len(best) == self.k else 1
            now = some[i : i + STEP]
            now = now[bound[now] >= least]
            if not len(now):
                break
            want = now[:, None] * len(self.weight) + self.block.terms[q]
            at = np.minimum(np.searchsorted(place, want), len(place) - 1)
            score = np.where(place[at] == want, impact[at], 0).sum(axis=1)
            self.scored += len(now)
            best += [(-s, keys[d] is None, keys[d]) for d, s in zip(now.tolist(), score.tolist()) if s >= least]
            best.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
            del best[self.k :]

    def rows(self) -> list[tuple]:
        return [(q, key, -low) for q, best in enumerate(self.best) for low, _, key in best]


def _answers(index: DataFrame, ranking: tuple) -> DataFrame:
    """(query, key, score): each task's k best documents of every query."""
    shared = index.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        found = Ranking(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(i, DOCUMENTS)
                terms, times = part.column(2), part.column(3)
                cuts = terms.offsets.to_numpy()
                flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (terms, times)]
                if len(flat[0]):
                    found.add(part.column(0).to_pylist(), part.column(1).to_numpy(), cuts - cuts[0], *flat)
        rows = found.rows()
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "key", "score"])

    return index.select("key", "n", "terms", "times").mapInArrow(run, "query bigint, key bigint, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(item_key, rank, key, score): each item's k documents with the highest score above
    0, all of them if there are fewer; equal scores by ascending key, null keys last.

    Keys of documents are integers. Documents without terms (null and empty texts
    included) count for nothing; items without terms have no answers. Documents that repeat are
    ranked each. Items that repeat with one key and text are one, those with one key and
    several texts are ranked each. An empty table gives no rows; other columns are
    ignored, whatever their names, but the two keys' names have to differ. Sums of a query's impacts have to fit 64 bits."""
    if item_key.lower() in (key.lower(), "rank", "score") or key.lower() in ("rank", "score"):
        raise ValueError(f"the answers need other names than {item_key} and {key}")
    spark = docs.sparkSession
    rows = docs.select(named(key).cast("long").alias("key"), named(text).alias("text"))
    kind = items.schema[item_key].dataType
    schema = T.StructType([field(item_key, kind), field("rank", T.IntegerType()), field(key, T.LongType()), field("score", T.LongType())])
    path = scratch_path(spark, "ranked")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in blocks(items, item_key, item_text, queries):
        index = materialize(indexed(rows, block), "index")
        total, tokens = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = weights(index, total, block)
        found = _answers(index, (block, weight, block.slots(width), width, total, tokens, k))
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.keys)), T.StructType([field("query", T.LongType()), field("item", kind)]))
        ranked = ranked.join(F.broadcast(names), "query")
        ranked.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
