"""The min-max and the percent-rank style analyses with their store plans.

Both read sales that carry STYLE and NET_AMOUNT, and count the first day of the
window in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import minmax_score, ratio, scalars, stable, with_percent_ranks
from ..sources.scratch import materialize
from .windows import recent

KEYS = ["STORE", "STORE_NAME", "STYLE"]


def _style_sales(sales: DataFrame, days: int, as_of=None) -> DataFrame:
    """Quantity, lines, revenue and days with sales per store style. Lines are first
    summed per day, which also counts the days without a distinct aggregate."""
    daily = (
        recent(sales, days, inclusive=True, as_of=as_of)
        .groupBy(*KEYS, "DATE")
        .agg(
            F.sum("QUANTITY").alias("q"),
            F.count("QUANTITY").alias("n"),
            F.sum(F.col("NET_AMOUNT").cast("decimal(18,4)")).alias("amount"),
        )
    )
    return daily.groupBy(*KEYS).agg(
        F.sum("q").alias("TOTAL_QTY"),
        F.sum("n").alias("TRANSACTION_COUNT"),
        F.sum("amount").cast("double").alias("TOTAL_REVENUE"),
        F.count("DATE").alias("SALES_DAYS"),
    )


def _with_stock(df: DataFrame, stock: DataFrame) -> DataFrame:
    held = stock.groupBy("STORE", "STYLE").agg(F.sum("STOCK").alias("STOCK"))
    return df.join(held, ["STORE", "STYLE"], "left").withColumn("STOCK", F.coalesce("STOCK", F.lit(0.0)))


def minmax_efficiency(sales: DataFrame, stock: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """Min-max scores of velocity, revenue, frequency and stock days, weighted
    .30/.25/.25/.20. stock carries STYLE."""
    df = _with_stock(_style_sales(sales, days, as_of), stock).drop("TRANSACTION_COUNT")
    df = df.withColumns(
        {
            "DAILY_AVG_QTY": F.col("TOTAL_QTY") / days,
            "REVENUE_PER_QTY": ratio(F.col("TOTAL_REVENUE"), F.col("TOTAL_QTY")),
            "SALES_FREQUENCY": F.col("SALES_DAYS") / days,
        }
    ).withColumn("STOCK_DAYS", F.col("STOCK") / (F.col("DAILY_AVG_QTY") + 0.1))
    df = minmax_score(
        materialize(df, "styles"),
        {
            "SALES_VELOCITY_SCORE": ("DAILY_AVG_QTY", True),
            "REVENUE_SCORE": ("TOTAL_REVENUE", True),
            "FREQUENCY_SCORE": ("SALES_FREQUENCY", True),
            "STOCK_EFFICIENCY_SCORE": ("STOCK_DAYS", False),
        },
    )
    score = (
        F.col("SALES_VELOCITY_SCORE") * 0.30
        + F.col("REVENUE_SCORE") * 0.25
        + F.col("FREQUENCY_SCORE") * 0.25
        + F.col("STOCK_EFFICIENCY_SCORE") * 0.20
    )
    return df.withColumn("EFFICIENCY_SCORE", stable(score, 12))


def minmax_store_plan(styles: DataFrame) -> DataFrame:
    """Per store: performers by level, recommended style count, change and strategy."""
    s = F.col("EFFICIENCY_SCORE")
    per = styles.groupBy("STORE", "STORE_NAME").agg(
        F.count("STYLE").alias("CURRENT_STYLES"),
        stable(F.avg(s), 12).alias("EFFICIENCY_SCORE"),
        F.sum("TOTAL_QTY").alias("TOTAL_SALES_QTY"),
        F.sum(F.col("TOTAL_REVENUE").cast("decimal(24,4)")).cast("double").alias("TOTAL_REVENUE"),
        F.count_if(s >= 70).alias("HIGH_PERFORMERS"),
        F.count_if((s >= 50) & (s < 70)).alias("MEDIUM_PERFORMERS"),
        F.count_if(s < 50).alias("LOW_PERFORMERS"),
    )
    high, medium, now = F.col("HIGH_PERFORMERS"), F.col("MEDIUM_PERFORMERS"), F.col("CURRENT_STYLES")
    avg = F.col("EFFICIENCY_SCORE")

    def part(c, share):
        return F.floor(stable(c * share, 12))

    wish = (
        F.when(avg >= 70, F.greatest(high + part(medium, 0.5), now))
        .when(avg >= 50, high + part(medium, 0.7))
        .otherwise(F.greatest(high + part(medium, 0.3), part(now, 0.5)))
    )
    return (
        per.withColumn("RECOMMENDED_STYLES", wish)
        .withColumn("CHANGE", F.col("RECOMMENDED_STYLES") - now)
        .withColumn("CHANGE_PCT", ratio(F.col("CHANGE"), now) * 100)
        .withColumn(
            "CATEGORY",
            F.when(avg >= 70, "High Performer").when(avg >= 50, "Medium Performer").otherwise("Needs Improvement"),
        )
        .withColumn(
            "STRATEGY",
            F.when(avg >= 70, "Maintain high performers, selective expansion")
            .when(avg >= 50, "Focus on proven styles, reduce underperformers")
            .otherwise("Major optimization needed, focus on top performers"),
        )
    )


def minmax_summary(stores: DataFrame, styles: DataFrame) -> DataFrame:
    """The analysis in eleven figures, one row."""
    n_styles = scalars(styles.agg(F.count_distinct("STYLE").alias("n")))["n"]
    return stores.agg(
        F.count(F.lit(1)).alias("total_stores"),
        stable(F.avg("CURRENT_STYLES")).alias("avg_styles_per_store"),
        stable(F.avg("EFFICIENCY_SCORE")).alias("avg_efficiency_score"),
        F.count_if(F.col("CATEGORY") == "High Performer").alias("high_stores"),
        F.count_if(F.col("CATEGORY") == "Medium Performer").alias("medium_stores"),
        F.count_if(F.col("CATEGORY") == "Needs Improvement").alias("low_stores"),
        F.sum("TOTAL_SALES_QTY").alias("total_sales_qty"),
        F.sum(F.col("TOTAL_REVENUE").cast("decimal(24,4)")).cast("double").alias("total_revenue"),
        F.sum("CHANGE").alias("style_change"),
        F.count_if(F.col("CHANGE") < 0).alias("stores_needing_reduction"),
    ).withColumn("total_styles", n_styles)


def attention_list(stores: DataFrame, below: int = -5) -> DataFrame:
    return stores.where(F.col("CHANGE") < below).orderBy("CHANGE", "STORE")


def rank_efficiency(
    sales: DataFrame, stock: DataFrame, warehouse: DataFrame, days: int = 90, as_of=None
) -> DataFrame:
    """Percent-rank scores of velocity, frequency, revenue, turnover and availability,
    weighted .30/.25/.20/.15/.10, and the performance tier. stock and warehouse carry STYLE."""
    df = _with_stock(_style_sales(sales, days, as_of), stock)
    central = warehouse.groupBy("STYLE").agg(F.sum("WAREHOUSE_STOCK").alias("WAREHOUSE_STOCK"))
    df = df.join(central, "STYLE", "left").withColumn("WAREHOUSE_STOCK", F.coalesce("WAREHOUSE_STOCK", F.lit(0.0)))
    daily = F.col("TOTAL_QTY") / days
    df = df.withColumns(
        {
            "DAILY_AVG_QTY": daily,
            "SALES_FREQUENCY": F.col("SALES_DAYS") / days,
            "AVG_TRANSACTION_SIZE": ratio(F.col("TOTAL_QTY"), F.col("TRANSACTION_COUNT")),
            "REVENUE_PER_UNIT": ratio(F.col("TOTAL_REVENUE"), F.col("TOTAL_QTY")),
            "DAYS_OF_STOCK": F.col("STOCK") / (daily + 0.01),
            "STOCK_TURNOVER": F.col("TOTAL_QTY") / (F.col("STOCK") + 1),
            "TOTAL_AVAILABLE": F.col("STOCK") + F.col("WAREHOUSE_STOCK"),
            "WAREHOUSE_COVERAGE_DAYS": F.col("WAREHOUSE_STOCK") / (daily + 0.01),
        }
    )
    ranked = {
        "DAILY_AVG_QTY": "SALES_VELOCITY_SCORE",
        "SALES_FREQUENCY": "FREQUENCY_SCORE",
        "TOTAL_REVENUE": "REVENUE_SCORE",
        "STOCK_TURNOVER": "TURNOVER_SCORE",
        "TOTAL_AVAILABLE": "AVAILABILITY_SCORE",
    }
    df = with_percent_ranks(materialize(df, "styles"), ranked, constant=0.5)
    df = df.withColumns({c: F.col(c) * 100 for c in ranked.values()})
    score = (
        F.col("SALES_VELOCITY_SCORE") * 0.30
        + F.col("FREQUENCY_SCORE") * 0.25
        + F.col("REVENUE_SCORE") * 0.20
        + F.col("TURNOVER_SCORE") * 0.15
        + F.col("AVAILABILITY_SCORE") * 0.10
    )
    s = F.col("EFFICIENCY_SCORE")
    tier = (
        F.when(s >= 80, "Star Performer")
        .when(s >= 60, "Strong Performer")
        .when(s >= 40, "Average Performer")
        .when(s >= 20, "Weak Performer")
        .otherwise("Poor Performer")
    )
    return df.withColumn("EFFICIENCY_SCORE", stable(score, 12)).withColumn("PERFORMANCE_TIER", tier)


TIERS = ["Star Performer", "Strong Performer", "Average Performer", "Weak Performer", "Poor Performer"]
# Fewest and most styles of a store, for `bounds`.
STYLE_BOUNDS = (20, 150)


def _best() -> "Window":
    return Window.partitionBy("STORE").orderBy(F.desc("EFFICIENCY_SCORE"), F.asc("STYLE"))


def optimal_style_count(styles: DataFrame, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Per store: stars + strong + a share of the average ones, and the revenue the best
    that many keep. `bounds` (STYLE_BOUNDS, say) are the fewest and most styles; without
    them the count is as it comes. styles should be a written table."""
    tier = F.col("PERFORMANCE_TIER")
    per = styles.groupBy("STORE").agg(
        F.min("STORE_NAME").alias("STORE_NAME"),
        F.count(F.lit(1)).alias("CURRENT_STYLES"),
        F.sum(F.col("TOTAL_REVENUE").cast("decimal(24,4)")).cast("double").alias("TOTAL_REVENUE"),
        stable(F.avg("EFFICIENCY_SCORE"), 12).alias("EFFICIENCY_SCORE"),
        *[F.count_if(tier == t).alias(t.split()[0].upper() + "_PERFORMERS") for t in TIERS],
    )
    avg = F.col("EFFICIENCY_SCORE")
    share = F.when(avg >= 50, 0.7).when(avg >= 30, 0.5).otherwise(0.3)
    kept = F.col("STAR_PERFORMERS") + F.col("STRONG_PERFORMERS") + F.floor(
        stable(F.col("AVERAGE_PERFORMERS") * share, 12)
    )
    optimal = kept
    if bounds is not None:
        optimal = F.greatest(F.lit(bounds[0]).cast("long"), F.least(F.lit(bounds[1]).cast("long"), kept))
    per = materialize(
        per.withColumn("OPTIMAL_STYLES", optimal)
        .withColumn("STYLE_REDUCTION", F.col("CURRENT_STYLES") - F.col("OPTIMAL_STYLES"))
        .withColumn("REDUCTION_PERCENTAGE", ratio(F.col("STYLE_REDUCTION"), F.col("CURRENT_STYLES"), 0) * 100)
        .withColumn(
            "STRATEGY_CATEGORY",
            F.when(avg >= 50, "Optimize & Expand").when(avg >= 30, "Focus & Improve").otherwise("Radical Optimization"),
        ),
        "stores",
    )
    kept_revenue = (
        recommended_portfolio(styles, per)
        .groupBy("STORE")
        .agg(F.sum(F.col("TOTAL_REVENUE").cast("decimal(24,4)")).cast("double").alias("kept"))
    )
    return (
        per.join(kept_revenue, "STORE", "left")
        .withColumn("ESTIMATED_REVENUE_RETENTION", ratio(F.col("kept"), F.col("TOTAL_REVENUE"), 0) * 100)
        .drop("kept")
    )


def recommended_portfolio(styles: DataFrame, stores: DataFrame) -> DataFrame:
    """The best OPTIMAL_STYLES styles of every store."""
    return (
        styles.withColumn("RANK", F.row_number().over(_best()))
        .join(stores.select("STORE", "OPTIMAL_STYLES"), "STORE")
        .where(F.col("RANK") <= F.col("OPTIMAL_STYLES"))
        .drop("OPTIMAL_STYLES")
    )


def tier_table(styles: DataFrame) -> DataFrame:
    """Styles per store and tier, one column per tier."""
    return styles.groupBy("STORE", "STORE_NAME").pivot("PERFORMANCE_TIER", TIERS).count().na.fill(0, TIERS)


def optimal_summary(stores: DataFrame) -> DataFrame:
    avg = F.col("EFFICIENCY_SCORE")
    return stores.agg(
        F.count(F.lit(1)).alias("total_stores"),
        F.sum("CURRENT_STYLES").alias("current_styles"),
        F.sum("OPTIMAL_STYLES").alias("optimal_styles"),
        F.sum("STYLE_REDUCTION").alias("style_reduction"),
        stable(F.avg("REDUCTION_PERCENTAGE")).alias("avg_reduction_pct"),
        stable(F.avg("ESTIMATED_REVENUE_RETENTION")).alias("avg_revenue_retention_pct"),
        F.count_if(F.col("STYLE_REDUCTION") > 0).alias("stores_needing_reduction"),
        F.count_if(F.col("STYLE_REDUCTION") < 0).alias("stores_ready_for_expansion"),
        F.count_if(avg >= 50).alias("high_stores"),
        F.count_if((avg >= 30) & (avg < 50)).alias("medium_stores"),
        F.count_if(avg < 30).alias("low_stores"),
    )
