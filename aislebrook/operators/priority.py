"""Store priority scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, scalars, stable, with_percent_ranks
from ..sources.scratch import materialize, spread
from .windows import recent


def _store_facts(sales: DataFrame, stock: DataFrame, days: int, as_of=None) -> DataFrame:
    """One row per stock store: total_sales (NULL without sales), stock, SKUs, empty rows."""
    sold = recent(sales, days, as_of=as_of).groupBy("STORE").agg(F.sum("QUANTITY").alias("total_sales"))
    empty = (F.col("STOCK") == 0) & F.col("SKU").isNotNull()
    lines = stock.where(F.col("STORE").isNotNull()).select("STORE", "SKU", "STOCK")
    # Pairs first, in pieces that fit a task: distinct SKUs of few stores are most rows.
    held = (
        spread(lines, "SKU")
        .groupBy("STORE", "SKU")
        .agg(F.sum("STOCK").alias("STOCK"), F.count_if(empty).alias("empty"))
        .groupBy("STORE")
        .agg(
            F.sum("STOCK").alias("total_stock"),
            F.count("SKU").alias("sku_count"),
            F.sum("empty").alias("oos_count"),
        )
    )
    return materialize(held.join(sold, "STORE", "left"), "stores")


def store_priority(sales: DataFrame, stock: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """0.4 sales + 0.3 stock turn + 0.3 out-of-stock share, scaled to [0, 1]."""
    facts = _store_facts(sales, stock, days, as_of)
    turn = F.when(F.col("total_stock") > 0, ratio(F.col("total_sales"), F.col("total_stock"))).otherwise(0.0)
    facts = facts.withColumn("total_sales", F.coalesce("total_sales", F.lit(0.0))).withColumn("STOCK_TURN", turn)
    top = scalars(facts.agg(F.max("total_sales").alias("sales"), F.max("STOCK_TURN").alias("turn")))
    scored = facts.withColumn("top", top).select(
        "STORE",
        "total_sales",
        "total_stock",
        "sku_count",
        "oos_count",
        "STOCK_TURN",
        ratio(F.col("total_sales"), F.col("top.sales"), 0).alias("SALES_SCORE"),
        ratio(F.col("STOCK_TURN"), F.col("top.turn"), 0).alias("STOCK_TURN_SCORE"),
        ratio(F.col("oos_count"), F.col("sku_count"), 0).alias("OOS_SCORE"),
    )
    raw = 0.4 * F.col("SALES_SCORE") + 0.3 * F.col("STOCK_TURN_SCORE") + 0.3 * F.col("OOS_SCORE")
    scored = scored.withColumn("RAW_SCORE", raw)
    ends = scalars(scored.agg(F.min("RAW_SCORE").alias("lo"), F.max("RAW_SCORE").alias("hi")))
    lo, hi = F.col("ends.lo"), F.col("ends.hi")
    spread = F.when(hi > lo, F.try_divide(F.col("RAW_SCORE") - lo, hi - lo)).otherwise(1.0)
    return (
        scored.withColumn("ends", ends).withColumn("PRIORITY_SCORE", stable(spread, 12)).drop("ends", "RAW_SCORE")
    )


def store_priority_rank(sales: DataFrame, stock: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """Percent-rank variant: 0.4 sales + 0.3 turn + 0.3 (1 - rank of empty rows),
    min-max scaled with a tiny constant in the divisor."""
    facts = _store_facts(sales, stock, days, as_of).withColumn(
        "STOCK_TURN", ratio(F.col("total_sales"), F.col("total_stock"))
    )
    ranks = {"total_sales": "SALES_RANK", "STOCK_TURN": "STOCK_TURN_RANK", "oos_count": "ZERO_RANK"}
    facts = with_percent_ranks(facts, ranks)
    zero = F.lit(0.0)
    raw = (
        0.4 * F.coalesce("SALES_RANK", zero)
        + 0.3 * F.coalesce("STOCK_TURN_RANK", zero)
        + 0.3 * (1 - F.col("ZERO_RANK"))
    )
    facts = facts.withColumn("RAW_SCORE", raw)
    ends = scalars(facts.agg(F.min("RAW_SCORE").alias("lo"), F.max("RAW_SCORE").alias("hi")))
    score = (F.col("RAW_SCORE") - F.col("ends.lo")) / (F.col("ends.hi") - F.col("ends.lo") + 1e-10)
    return facts.withColumn("ends", ends).select(
        "STORE",
        F.coalesce("SALES_RANK", zero).alias("SALES_RANK"),
        F.coalesce("STOCK_TURN_RANK", zero).alias("STOCK_TURN_RANK"),
        (1 - F.col("ZERO_RANK")).alias("OOS_RANK"),
        score.alias("PRIORITY_SCORE"),
    )
