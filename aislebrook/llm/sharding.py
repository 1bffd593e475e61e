"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Under a uniform shuffle, how many rows go from each partition to each shard follows a
multivariate hypergeometric law. That matrix is drawn first: partitions are halved again
and again, and each half's rows among the shards are drawn one shard after the other, by
inversion of the exact probabilities. Every partition then orders its rows at random and
deals them out by its row of the matrix; rows are exchanged; every shard orders what it
got at random. Only built-in functions are used.

A row's place in its partition's order comes with the local sort, so the one exchange of
whole rows is by shard and, inside a shard, by the leading part of a row's second random
number. Slots count the smaller leading parts first, so a shard is as many tasks as its
rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aislebrook.sources.scratch import materialize

from .common import fresh, named

# Rows that one task orders inside a shard.
TASK_ROWS = 1000
# Standard deviations around the mode beyond which probabilities are nil in doubles.
WIDTH = 12
# Levels of the tree of partitions that a node takes at a time.
LEVELS = 5
_PLACE = (1 << 33) - 1  # of a row in its partition, in monotonically_increasing_id


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that follows from the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` rows out of `total` are among `good` ones, by inversion at u:
    probabilities follow from each other by their ratios, within WIDTH deviations of the
    mode, where everything that a double can tell from nil lies."""
    given = F.struct(total.cast("double").alias("t"), good.cast("double").alias("g"), drawn.cast("double").alias("d"), u.alias("u"))

    def around(p: Column) -> Column:
        share = p["g"] / F.greatest(p["t"], F.lit(1.0))
        spread = F.sqrt(p["d"] * share * (1 - share) * (p["t"] - p["d"]) / F.greatest(p["t"] - 1, F.lit(1.0)))
        return F.struct(
            F.floor((p["d"] + 1) * (p["g"] + 1) / (p["t"] + 2)).alias("mode"), F.ceil(WIDTH * spread + 10).alias("reach"), (p["t"] - p["g"] - p["d"]).alias("c")
        )

    def drawn_at(p: Column, m: Column, ks: Column) -> Column:
        def after(w: Column, k: Column) -> Column:
            """The weight of k + 1 from that of k."""
            return w * (p["g"] - k) * (p["d"] - k) / ((k + 1.0) * (m["c"] + k + 1.0))

        sums = F.aggregate(
            ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), lambda a, k: F.struct(after(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum"))
        )["sum"]
        return F.aggregate(
            ks,
            F.struct(F.lit(1.0).alias("w"), (p["u"] * sums).alias("left"), ks[0].alias("k")),
            lambda a, k: F.struct(after(a["w"], k).alias("w"), (a["left"] - a["w"]).alias("left"), F.when(a["left"] > 0, k).otherwise(a["k"]).alias("k")),
        )["k"]

    def by_inversion(p: Column, m: Column) -> Column:
        low = F.greatest(F.lit(0.0), -m["c"], m["mode"] - m["reach"]).cast("long")
        high = F.least(p["d"], p["g"], m["mode"] + m["reach"]).cast("long")
        # Where there is one outcome, nothing is drawn.
        return F.when(low == high, low).otherwise(_let(F.transform(F.sequence(low, high), lambda k: k.cast("double")), lambda ks: drawn_at(p, m, ks)).cast("long"))

    return _let(given, lambda p: _let(around(p), lambda m: by_inversion(p, m)))


def _first_half(room: Column, rows: Column, seed: int, node: Column) -> Column:
    """Of `rows` rows, how many go to each shard, where room[s] is left in shard s."""
    start = F.struct(F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), rows.cast("long").alias("rows"), F.array().cast("array<bigint>").alias("out"))

    def draw(a: Column, s: Column) -> Column:
        x = hypergeometric(a["total"], s["room"], a["rows"], uniform(F.lit(seed), node, s["shard"]))
        return _let(x, lambda n: F.struct((a["total"] - s["room"]).alias("total"), (a["rows"] - n).alias("rows"), F.concat(a["out"], F.array(n)).alias("out")))

    each = F.transform(room, lambda x, i: F.struct(x.alias("room"), i.alias("shard")))
    return F.aggregate(each, start, draw)["out"]


def matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, ends array<bigint>): ends[s] is how many rows of the partition go to shards
    up to s. counts is (part, n), one row per partition; shards differ by one row at most.

    A node of the tree is a row: what is left in each shard for the partitions below it.
    Nodes take LEVELS levels at a time, with the rows of the 2^LEVELS nodes that far below
    in an array; between these steps they are dealt out anew, so that nothing is wider than
    the shards or those nodes, however many partitions there are."""
    spark = counts.sparkSession
    held = counts.agg(F.max("part").alias("last"), F.sum("n").alias("rows")).first()
    if held["rows"] is None:
        return counts.select("part", F.array().cast("array<bigint>").alias("ends"))
    levels = int(held["last"]).bit_length()
    room = F.array(*[F.lit(held["rows"] // shards + (s < held["rows"] % shards)).cast("long") for s in range(shards)])
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), room.alias("room"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for top in range(0, levels, LEVELS):
        depth = min(LEVELS, levels - top)
        child = F.shiftright("part", levels - top - depth)
        below = counts.groupBy(child.alias("child")).agg(F.sum("n").cast("long").alias("n"))
        below = below.groupBy(F.shiftright("child", depth).alias("node")).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("child").bitwiseAND(F.lit((1 << depth) - 1)).cast("int"), F.col("n")))).alias("at")
        )
        n = F.transform(F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda i: F.coalesce(F.try_element_at("at", i.cast("int")), F.lit(0).cast("long")))
        # Nodes without rows end here. The draws are the work, not the bytes: no merging of small tasks.
        nodes = nodes.join(below, "node").repartition(tasks, "node").select("node", n.alias("n"), "room")
        for level in range(top, top + depth):
            half = 1 << (top + depth - level - 1)
            rows = F.aggregate(F.slice("n", 1, half), F.lit(0).cast("long"), lambda a, x: a + x)
            nodes = nodes.withColumn("first", _first_half(F.col("room"), rows, seed, F.col("node") + (1 << level)))
            left = F.struct((2 * F.col("node")).alias("node"), F.slice("n", 1, half).alias("n"), F.col("first").alias("room"))
            right = F.struct((2 * F.col("node") + 1).alias("node"), F.slice("n", half + 1, half).alias("n"), F.zip_with("room", "first", lambda a, b: a - b).alias("room"))
            nodes = nodes.select(F.explode(F.array(left, right)).alias("x")).select("x.*").where(F.exists("n", lambda x: x > 0))
        nodes = materialize(nodes.select("node", "room"), "nodes")
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("room", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    return nodes.select(F.col("node").alias("part"), ends.alias("ends"))


def shuffle(df: DataFrame, shards: int, seed: int = 0, task_rows: int = TASK_ROWS) -> DataFrame:
    """df with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in its shard),
    every order of all rows equally likely for a random seed. Shards differ by one row at
    most; with fewer rows than shards the first ones have a row each.

    Any columns, null or repeated rows, texts of any length: rows are only moved. An empty
    table gives no rows; columns of df with the two new names are replaced. df is read
    once: its rows are written in their partitions' random orders, with partition and
    place, and every pass takes these from there. A row without a shard makes the job fail."""
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    df = df.select(*[named(c) for c in own])
    names = {}
    for n in ("order", "place", "part", "ends", "bucket", "before", "task", "mix"):
        names[n] = fresh(df, f"{n}_")
    order, place, part, ends, bucket, before, task, mix = (names[n] for n in names)

    # How a table is split can differ from one read to the next, so numbers are stored.
    numbered = df.withColumn(order, F.rand(seed)).sortWithinPartitions(order).drop(order)
    numbered = numbered.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33))
    numbered = materialize(numbered, "numbered")
    counts = numbered.groupBy(named(part).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "partitions")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    dealt = materialize(matrix(counts, shards, seed), "matrix").select(F.col("part").alias(part), F.col("ends").alias(ends))
    buckets = max(1, -(-rows // (shards * task_rows)))

    def placed(source: DataFrame) -> DataFrame:
        at = F.col(place).bitwiseAND(F.lit(_PLACE))
        to = F.size(F.filter(F.col(ends), lambda e: e <= at))
        to = F.when(to < shards, to).otherwise(F.raise_error(F.lit("a row has no place in the matrix")).cast("int"))
        second = uniform(F.lit(seed + 1), F.col(place))
        found = source.join(dealt, part, "left").withColumn("shard", to).withColumn(mix, second)
        return found.withColumn(bucket, F.floor(F.col(mix) * buckets).cast("long")).drop(ends, part)

    # The light pass: rows by shard and bucket, without the table's columns.
    sizes = placed(numbered.select(place, part)).groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket here; a shard has as many as it needs tasks.
    begins = materialize(sizes.select("shard", bucket, F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias(before)), "buckets")
    inside = Window.partitionBy("shard", bucket).orderBy(mix, place)
    ranked = placed(numbered).withColumn(task, F.row_number().over(inside))
    out = ranked.join(begins, ["shard", bucket])
    return out.select(*[named(c) for c in own], "shard", (F.col(before) + F.col(task) - 1).alias("slot"))
