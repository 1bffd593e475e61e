"""Demand velocity per (STORE, SKU), trend, variability and similar products.

Sales are first summed per (STORE, SKU, DATE) or (STORE, SKU) on the map side,
so a hot SKU never reaches one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, scalars, stable, stable_ceil
from .windows import latest, recent

PAIR = ["STORE", "SKU"]


def _keyed(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("STORE").isNotNull() & F.col("SKU").isNotNull())


def velocity_simple(sales: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """Units in the window divided by its length."""
    return (
        _keyed(recent(sales, days, as_of=as_of))
        .groupBy(*PAIR)
        .agg((F.sum("QUANTITY") / F.lit(float(days))).alias("DAILY_SALES"))
    )


def _decayed(sales: DataFrame, days: int, scale: float, as_of=None) -> DataFrame:
    """Per pair: sum of w*q, sum of w, rows; w = exp(-age / scale)."""
    age = F.datediff(latest(sales, as_of=as_of), F.col("DATE"))
    w = F.exp(-age / F.lit(float(scale)))
    return (
        _keyed(recent(sales, days, as_of=as_of))
        .groupBy(*PAIR)
        .agg(
            F.sum(F.col("QUANTITY") * w).alias("wq"),
            F.sum(w).alias("w"),
            F.count("QUANTITY").alias("n"),
        )
    )


def weighted_demand(sales: DataFrame, days: int = 90, method: str = "weighted", as_of=None) -> DataFrame:
    """Decayed mean quantity per sale line over the window length (no row count factor)."""
    if method != "weighted":
        return velocity_simple(sales, days, as_of)
    return _decayed(sales, days, days / 3, as_of).select(
        *PAIR, stable(ratio(F.col("wq"), F.col("w"), 0) / days, 12).alias("DAILY_SALES")
    )


def weighted_daily_sales(sales: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """Decayed mean quantity times sale lines per day, never below 0.

    Ages are counted from the planning date: shifting the origin of an
    exponential weight cancels in the ratio, so ages counted from the newest sale
    of each pair give the same value without a second pass.
    """
    v = ratio(F.col("wq"), F.col("w"), 0) / days * F.col("n")
    return _decayed(sales, days, days * 0.3, as_of).select(
        *PAIR, stable(F.greatest(F.lit(0.0), v), 12).alias("DAILY_SALES")
    )


def simple_trend(sales: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """0.7 + 0.3 * recent/older units per pair, split at the pair's newest sale
    minus half the window; 1 with under four lines or nothing older."""
    daily = (
        _keyed(recent(sales, days, as_of=as_of))
        .groupBy(*PAIR, "DATE")
        .agg(F.sum("QUANTITY").alias("q"), F.count(F.lit(1)).alias("n"))
    )
    newest = F.max("DATE").over(Window.partitionBy(*PAIR))
    split = daily.withColumn("late", F.col("DATE") > F.date_sub(newest, days // 2))
    sums = split.groupBy(*PAIR).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("q"))), F.lit(0.0)).alias("new"),
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("q"))), F.lit(0.0)).alias("old"),
    )
    trend = F.when((F.col("n") >= 4) & (F.col("old") > 0), 0.7 + 0.3 * ratio(F.col("new"), F.col("old")))
    return sums.select(*PAIR, F.coalesce(trend, F.lit(1.0)).alias("TREND_FACTOR"))


def velocity_trended(sales: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """Weighted daily sales times the trend, the trend held within [0.5, 1.5]."""
    clipped = F.least(F.greatest(F.col("TREND_FACTOR"), F.lit(0.5)), F.lit(1.5))
    return (
        weighted_daily_sales(sales, days, as_of)
        .join(simple_trend(sales, days, as_of), PAIR)
        .select(*PAIR, stable(F.col("DAILY_SALES") * clipped, 12).alias("DAILY_SALES"), "TREND_FACTOR")
    )


def _daily(sales: DataFrame, days: int, as_of=None) -> DataFrame:
    return (
        _keyed(recent(sales, days, as_of=as_of)).groupBy(*PAIR, "DATE").agg(F.sum("QUANTITY").alias("QUANTITY"))
    )


def weekday_factors(sales: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """Mean daily pair sales by weekday (Monday 0) over the overall mean."""
    daily = _daily(sales, days, as_of)
    overall = scalars(daily.agg(F.avg("QUANTITY").alias("m")))["m"]
    return (
        daily.groupBy(F.weekday("DATE").alias("DOW"))
        .agg(F.avg("QUANTITY").alias("m"))
        .select("DOW", ratio(F.col("m"), overall).alias("DOW_FACTOR"))
    )


def variability_safety(sales: DataFrame, days: int = 90, z: float = 1.645, cover: int = 14, as_of=None) -> DataFrame:
    """Coefficient of variation of daily sales, safety stock and desired stock."""
    spread = F.coalesce(ratio(F.stddev_samp("QUANTITY"), F.avg("QUANTITY")), F.lit(0.0))
    out = (
        _daily(sales, days, as_of)
        .groupBy(*PAIR)
        .agg((F.sum("QUANTITY") / F.lit(float(days))).alias("DAILY_SALES"), stable(spread, 12).alias("CV"))
    )
    safety = stable_ceil(F.lit(z) * F.col("DAILY_SALES") * F.col("CV") * F.sqrt(F.lit(float(cover))))
    return out.withColumn("SAFETY_STOCK", safety).withColumn(
        "DESIRED_STOCK", stable_ceil(F.col("DAILY_SALES") * cover + F.col("SAFETY_STOCK"))
    )


_MATCHES = [
    # attributes that agree, and what that is worth
    (("STYLE", "GENDER", "CATEGORY"), 6),
    (("STYLE", "GENDER"), 5),
    (("STYLE", "CATEGORY"), 4),
    (("STYLE",), 3),
    (("GENDER", "CATEGORY"), 3),
    (("GENDER",), 2),
    (("CATEGORY",), 1),
]


def similar_products(items: DataFrame, sales: DataFrame, top_n: int = 3) -> DataFrame:
    """For every SKU without sales, the `top_n` selling SKUs closest by STYLE (3),
    GENDER (2) and CATEGORY (1).

    A candidate among the best `top_n` is also among the first `top_n` SKUs of the
    group that shares exactly its matching attributes, so those short lists are
    enough and no group is ever paired with itself.  Targets are handled once per
    attribute combination and expanded to SKUs at the end.
    """
    attrs = ["STYLE", "GENDER", "CATEGORY"]
    sold = sales.select("SKU").distinct()
    items = items.select("SKU", *attrs)
    targets = items.join(sold, "SKU", "left_anti")
    candidates = items.join(sold, "SKU", "left_semi")
    combos = targets.select(*attrs).distinct()

    found: DataFrame | None = None
    for keys, _ in _MATCHES:
        first = Window.partitionBy(*keys).orderBy("SKU")
        short = (
            candidates.where(~F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNotNull())
            .withColumn("rn", F.row_number().over(first))
            .where(F.col("rn") <= top_n)
            .select(
                *[F.col(k).alias(f"k_{k}") for k in keys],
                F.struct("SKU", *attrs).alias("cand"),
            )
        )
        on = [combos[k] == short[f"k_{k}"] for k in keys]
        part = combos.join(short, on).select(*attrs, "cand")
        found = part if found is None else found.unionByName(part)

    def points(attr: str, worth: int) -> Column:
        return F.when(F.col(attr) == F.col(f"cand.{attr}"), worth).otherwise(0)

    score = points("STYLE", 3) + points("GENDER", 2) + points("CATEGORY", 1)
    best = Window.partitionBy(*attrs).orderBy(F.desc("SIMILARITY_SCORE"), F.asc("SIMILAR_SKU"))
    ranked = (
        found.distinct()
        .select(*attrs, F.col("cand.SKU").alias("SIMILAR_SKU"), score.alias("SIMILARITY_SCORE"))
        .withColumn("RANK", F.row_number().over(best))
        .where(F.col("RANK") <= top_n)
    )
    same = [targets[a].eqNullSafe(ranked[a]) for a in attrs]
    return targets.join(ranked, same).select(targets["SKU"], "SIMILAR_SKU", "SIMILARITY_SCORE", "RANK")
