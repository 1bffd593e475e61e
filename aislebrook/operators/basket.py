"""Baskets: frequent itemsets, association rules, item pairs and basket sizes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import stable
from ..sources.scratch import materialize


def basket_items(df: DataFrame, item: str = "STYLE", bill: str = "BILL_NO") -> DataFrame:
    """The basket matrix in sparse form: distinct (bill, item), items as text. Shuffled
    by both columns, so a huge bill or a very common item is spread."""
    return (
        df.where(F.col(bill).isNotNull() & F.col(item).isNotNull())
        .select(F.col(bill).alias("bill"), F.col(item).cast("string").alias("item"))
        .distinct()
    )


def baskets(items: DataFrame) -> DataFrame:
    """Bill -> sorted array of its items. Pass items limited to a bounded vocabulary
    (as frequent_itemsets does) so that the arrays are bounded too."""
    return items.groupBy("bill").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _least(n: int, min_support: float) -> int:
    return max(1, math.ceil(n * min_support - 1e-9))


def frequent_itemsets(
    df: DataFrame, item: str = "STYLE", bill: str = "BILL_NO", min_support: float = 0.01
) -> DataFrame:
    """Itemsets in at least min_support of the bills: items, freq, support, bills.

    Items that are rare alone cannot be part of a frequent set and are dropped
    first.  At most (mean basket size / min_support) items remain, which bounds
    every basket array however long a bill is.
    """
    items = materialize(basket_items(df, item, bill), "basket_items")
    n = items.select("bill").distinct().count()
    least = _least(n, min_support)
    common = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("item")
    rows = materialize(baskets(items.join(common, "item", "left_semi")), "baskets")
    m = rows.count()
    schema = "items array<string>, freq bigint, support double, bills bigint"
    if m == 0:
        return df.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=max((least - 0.5) / m, 0.0), minConfidence=1.0).fit(rows)
    return model.freqItemsets.select(
        F.sort_array("items").alias("items"),
        F.col("freq").cast("long").alias("freq"),
        (F.col("freq") / F.lit(float(n))).alias("support"),
        F.lit(n).cast("long").alias("bills"),
    )


def association_rules(itemsets: DataFrame, min_confidence: float = 0.1, min_lift: float = 1.0) -> DataFrame:
    """Every split of every itemset into antecedents and consequents, with support,
    confidence, lift, leverage and conviction. itemsets should be a written table.

    Consequents grow by one item at a time: moving an item to them only lowers the
    confidence, so a split that falls short is not grown, and no itemset is expanded into
    all its subsets at once."""
    size = F.size("items")
    frequent = itemsets.select(F.col("items").alias("antecedents"), F.col("freq").alias("fa"))
    largest = itemsets.agg(F.max(size)).first()[0] or 0
    grown = itemsets.where(size >= 2).select("items", "freq", "bills", F.array().cast("array<int>").alias("moved"))
    levels = []
    for level in range(1, largest):
        last = F.coalesce(F.try_element_at("moved", F.lit(-1)), F.lit(-1))
        more = F.when(last + 1 < size, F.sequence(last + 1, size - 1)).otherwise(F.array().cast("array<int>"))
        grown = grown.where(size > level).select("items", "freq", "bills", "moved", F.explode(more).alias("next"))
        grown = grown.withColumn("moved", F.array_append("moved", F.col("next"))).drop("next")
        rest = F.filter("items", lambda _, i: ~F.array_contains("moved", i))
        grown = grown.withColumn("antecedents", rest).join(frequent, "antecedents")
        grown = materialize(grown.where(F.col("freq") / F.col("fa") >= min_confidence).drop("antecedents", "fa"), "rules")
        if grown.isEmpty():
            break
        levels.append(grown)
    none = itemsets.where(F.lit(False)).select("items", "freq", "bills", F.array().cast("array<int>").alias("moved"))
    splits = reduce(DataFrame.union, levels, none)
    splits = splits.withColumn("antecedents", F.filter("items", lambda _, i: ~F.array_contains("moved", i)))
    splits = splits.withColumn("consequents", F.filter("items", lambda _, i: F.array_contains("moved", i)))
    known = itemsets.select(F.col("items").alias("k"), F.col("freq").alias("f"))
    a = known.toDF("antecedents", "fa")
    c = known.toDF("consequents", "fc")
    rules = splits.join(a, "antecedents").join(c, "consequents")
    n = F.col("bills").cast("double")
    conf = F.col("freq") / F.col("fa")
    lift = F.col("freq") * n / (F.col("fa") * F.col("fc"))
    rules = rules.withColumn("confidence", conf).withColumn("lift", lift)
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    conviction = F.when(F.col("freq") == F.col("fa"), F.lit(float("inf"))).otherwise(
        F.try_divide(1 - F.col("fc") / n, 1 - F.col("confidence"))
    )
    return rules.select(
        "antecedents",
        "consequents",
        (F.col("fa") / n).alias("antecedent_support"),
        (F.col("fc") / n).alias("consequent_support"),
        (F.col("freq") / n).alias("support"),
        "confidence",
        "lift",
        (F.col("freq") / n - (F.col("fa") / n) * (F.col("fc") / n)).alias("leverage"),
        conviction.alias("conviction"),
    ).orderBy(F.desc("lift"), "antecedents", "consequents")


def with_rule_metadata(rules: DataFrame, df: DataFrame, item: str, meta_cols: list[str]) -> DataFrame:
    """antecedent_<col> and consequent_<col>: the items' attributes joined by ' + ',
    'Unknown' where an item has none. rules should be a written table."""
    meta = df.groupBy(F.col(item).cast("string").alias("item")).agg(
        *[F.min(F.col(c).cast("string")).alias(c) for c in meta_cols]
    )
    sides = [("antecedents", "antecedent"), ("consequents", "consequent")]
    out = rules
    for side, prefix in sides:
        sets = rules.select(side).distinct()
        text = [
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("pos", F.coalesce(c, F.lit("Unknown")).alias("v")))),
                    lambda s: s["v"],
                ),
                " + ",
            ).alias(f"{prefix}_{c}")
            for c in meta_cols
        ]
        labels = (
            sets.select(side, F.posexplode(side).alias("pos", "item"))
            .join(meta, "item", "left")
            .groupBy(side)
            .agg(*text)
        )
        out = out.join(labels, side, "left")
    return out


# Pair hashes that are counted before pairs are; the hashes that reach a support are
# broadcast, so this bounds them as well.
PAIR_HASHES = 1 << 20


def common_pairs(
    df: DataFrame, item: str = "SKU", bill: str = "BILL_NO", min_count: int = 1, block_items: int = 256, pair_hashes: int = PAIR_HASHES
) -> DataFrame:
    """Bills that hold both items, for every unordered item pair seen in at least
    min_count bills.

    Bills with the same items are counted as one basket with a weight, so the pairs of a
    common basket are formed once. Without a support every pair is the result: baskets of
    more than block_items items are cut into blocks, and blocks meet on (bill, block,
    block), so the pairs of one huge bill come from many small joins.

    With min_count > 1 items seen in fewer bills are dropped, and pairs are counted twice:
    first by hash, then only those whose hash reaches the support are shuffled. Baskets of
    more than block_items items are not expanded for the pairs of the others: these look
    themselves up there, and only items that long baskets hold often enough among
    themselves form pairs in them.
    """
    items = materialize(basket_items(df, item, bill), "basket_items")
    if min_count > 1:
        common = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
        items = materialize(items.join(common.select("item"), "item", "left_semi"), "common_items")
    # A 128-bit fingerprint of the item set, from aggregates that need no array.
    marks = items.groupBy("bill").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("item")).alias("h1"),
        F.bit_xor(F.xxhash64("item", F.lit(1))).alias("h2"),
    )
    kinds = (
        marks.where(F.col("n") >= 2)
        .groupBy("n", "h1", "h2")
        .agg(F.min("bill").alias("bill"), F.count(F.lit(1)).alias("weight"))
        .select("bill", "weight", F.ceil(F.col("n") / block_items).cast("int").alias("blocks"))
    )
    if min_count > 1:
        found = _supported_pairs(items, materialize(kinds, "kinds"), min_count, block_items, pair_hashes)
    else:
        found = _pairs_in(items.join(kinds, "bill")).groupBy("item1", "item2").agg(F.sum("weight").alias("frequency"))
    return found.orderBy(F.desc("frequency"), "item1", "item2")


def _pairs_in(baskets: DataFrame, *carried: str) -> DataFrame:
    """item1 < item2 with the weight and `carried` (as name1, name2) of all pairs within
    (bill, item, weight, blocks)."""
    placed = baskets.withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("bill", "weight", F.col("item").alias("item1"), *[F.col(c).alias(f"{c}1") for c in carried], F.col("block").alias("b1"), every.alias("b2"))
    right = placed.select("bill", F.col("item").alias("item2"), *[F.col(c).alias(f"{c}2") for c in carried], F.col("block").alias("b2"), every.alias("b1"))
    return left.join(right, ["bill", "b1", "b2"]).where(F.col("item1") < F.col("item2"))


def _reaching(pairs: DataFrame, least: int, pair_hashes: int) -> DataFrame:
    """pairs with `reaches`: true unless all pairs of their hash together are too few.
    The counts of the hashes are the only thing that is shuffled for it."""
    of = F.pmod(F.xxhash64("item1", "item2"), F.lit(pair_hashes)).cast("int")
    often = pairs.groupBy(of.alias("hash")).agg(F.sum("weight").alias("n")).where(F.col("n") >= least)
    often = materialize(often.select("hash", F.lit(True).alias("reaches")), "pair_hashes")
    return pairs.withColumn("hash", of).join(F.broadcast(often), "hash", "left").withColumn("reaches", F.coalesce("reaches", F.lit(False))).drop("hash")


def _supported_pairs(items: DataFrame, kinds: DataFrame, least: int, block_items: int, pair_hashes: int) -> DataFrame:
    """(item1, item2, frequency) of the pairs in at least `least` of the weighted baskets."""
    long = materialize(items.join(kinds.where("blocks > 1"), "bill"), "long_baskets")
    # What long baskets can add to a pair of this item.
    weight = long.groupBy("item").agg(F.sum("weight").alias("long"))
    short = items.join(kinds.where("blocks = 1"), "bill").join(weight, "item", "left").withColumn("long", F.coalesce("long", F.lit(0)))
    pairs = _reaching(_pairs_in(short, "long"), least, pair_hashes).withColumn("more", F.least("long1", "long2"))
    known = pairs.where(F.col("reaches") | (F.col("more") > 0)).groupBy("item1", "item2").agg(F.sum("weight").alias("short"), F.max("more").alias("more"))
    known = materialize(known.where(F.col("short") + F.col("more") >= least), "pairs")
    one, two = (long.select("bill", "weight", F.col("item").alias(n)) for n in ("item1", "item2"))
    looked = known.where("more > 0").select("item1", "item2").join(one, "item1").join(two.drop("weight"), ["bill", "item2"])
    looked = looked.groupBy("item1", "item2").agg(F.sum("weight").alias("extra"))
    both = known.join(looked, ["item1", "item2"], "left").select("item1", "item2", (F.col("short") + F.coalesce("extra", F.lit(0))).alias("frequency"))
    # Pairs of long baskets alone.
    often = long.join(weight.where(F.col("long") >= least).select("item"), "item", "left_semi")
    alone = _reaching(_pairs_in(often), least, pair_hashes).where("reaches").groupBy("item1", "item2").agg(F.sum("weight").alias("frequency"))
    return both.unionByName(alone.join(known, ["item1", "item2"], "left_anti")).where(F.col("frequency") >= least)


def basket_sizes(df: DataFrame, bill: str = "BILL_NO") -> DataFrame:
    """Mean, median, most common and largest number of lines per bill, and the share of
    one-line bills. Worked out on the histogram of sizes."""
    hist = materialize(
        df.where(F.col(bill).isNotNull())
        .groupBy(bill)
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("size")
        .agg(F.count(F.lit(1)).alias("n")),
        "sizes",
    )
    stats = hist.agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("size", 0.5, F.col("n")).alias("median"),
        F.min_by("size", F.struct((-F.col("n")).alias("k"), F.col("size").alias("s"))).cast("double").alias("mode"),
        F.max("size").cast("double").alias("largest"),
        (F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("n"))), F.lit(0)) / F.sum("n") * 100).alias("single"),
    )
    names = [
        ("Average items per basket", "mean"),
        ("Median items per basket", "median"),
        ("Most common basket size", "mode"),
        ("Max items in a basket", "largest"),
        ("% single-item baskets", "single"),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), stable(F.col(c).cast("double")).alias("value")) for n, c in names])
    return stats.select(F.explode(rows).alias("r")).select("r.*")

