"""Style efficiency per store: metrics, score, store recommendations and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantiles, ratio, scalars, stable
from ..sources.scratch import materialize
from . import plan_steps as ps
from .windows import recent

# The most styles for a high, good, average and weak store, for `caps`.
STYLE_CAPS = (20, 15, 10, 8)


def style_metrics(
    sales: DataFrame,
    stock: DataFrame,
    sku_master: DataFrame,
    warehouse: DataFrame | None = None,
    style_master: DataFrame | None = None,
    days: int = 90,
    as_of=None,
) -> DataFrame:
    """Per (STORE, STYLE): sales, stock, turnover, cover, consistency and the 0-100 score.

    Sales are summed per (STORE, SKU) before the master is joined, so a hot SKU is
    one row per store by then.
    """
    styles = ps.one_per_key(sku_master.select("SKU", "STYLE"), "SKU")
    by_sku = (
        recent(sales, days, as_of=as_of)
        .groupBy("STORE", "SKU")
        .agg(
            F.sum("QUANTITY").alias("q"),
            F.count("QUANTITY").alias("n"),
            F.min("DATE").alias("first"),
            F.max("DATE").alias("last"),
        )
    )
    keyed = F.col("STORE").isNotNull() & F.col("STYLE").isNotNull()
    sold = (
        by_sku.join(styles, "SKU")
        .where(keyed)
        .groupBy("STORE", "STYLE")
        .agg(
            F.sum("q").alias("TOTAL_SALES"),
            F.sum("n").alias("SALES_TRANSACTIONS"),
            F.min("first").alias("FIRST_SALE_DATE"),
            F.max("last").alias("LAST_SALE_DATE"),
        )
    )
    held = (
        ps.stock_by_pair(stock).join(styles, "SKU").where(keyed).groupBy("STORE", "STYLE").agg(F.sum("STOCK").alias("STOCK"))
    )
    df = sold.join(held, ["STORE", "STYLE"], "full")
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "TOTAL_SALES": F.coalesce("TOTAL_SALES", zero),
            "SALES_TRANSACTIONS": F.coalesce("SALES_TRANSACTIONS", F.lit(0)),
            "STOCK": F.coalesce("STOCK", zero),
        }
    )
    df = df.withColumns(
        {
            "AVG_SALES_PER_TXN": ratio(F.col("TOTAL_SALES"), F.col("SALES_TRANSACTIONS"), 0),
            "SALES_VELOCITY": F.col("TOTAL_SALES") / days,
            "SALES_FREQUENCY": F.col("SALES_TRANSACTIONS") / days,
            "STOCK_TURNOVER": F.when(F.col("STOCK") > 0, ratio(F.col("TOTAL_SALES"), F.col("STOCK")))
            .when(F.col("TOTAL_SALES") > 0, 999.0)
            .otherwise(0.0),
        }
    ).withColumn(
        "DAYS_STOCK_COVER",
        F.when(F.col("SALES_VELOCITY") > 0, ratio(F.col("STOCK"), F.col("SALES_VELOCITY")))
        .when(F.col("STOCK") > 0, 999.0)
        .otherwise(0.0),
    )
    if warehouse is not None:
        central = (
            ps.warehouse_by_sku(warehouse)
            .join(styles, "SKU")
            .groupBy("STYLE")
            .agg(F.sum("WAREHOUSE_STOCK").alias("WAREHOUSE_STOCK"))
        )
        df = df.join(central, "STYLE", "left").withColumn("WAREHOUSE_STOCK", F.coalesce("WAREHOUSE_STOCK", zero))
    if style_master is not None:
        genders = ps.one_per_key(style_master.select("STYLE", "GENDER"), "STYLE")
        df = df.join(genders, "STYLE", "left").withColumn("GENDER", F.coalesce("GENDER", F.lit("UNISEX")))
    return _scored(materialize(df, "styles"))


def _scored(df: DataFrame) -> DataFrame:
    """30 velocity + 25 turnover (held to 10) + 20 consistency + 15 revenue + 10 low
    cover, one decimal, x 0.7 for styles the warehouse cannot supply."""
    top = scalars(
        df.agg(
            F.max("SALES_TRANSACTIONS").alias("n"),
            F.max("SALES_VELOCITY").alias("v"),
            F.max("TOTAL_SALES").alias("q"),
        )
    )
    cover = F.when(
        F.col("DAYS_STOCK_COVER") > 0, F.greatest(F.lit(0.0), 10 - F.col("DAYS_STOCK_COVER") / 30 * 10)
    ).otherwise(10.0)
    turnover = F.least(F.greatest(F.col("STOCK_TURNOVER"), F.lit(0.0)), F.lit(10.0))
    score = (
        ratio(F.col("SALES_VELOCITY"), F.col("top.v"), 0) * 30
        + turnover / 10 * 25
        + F.col("CONSISTENCY_SCORE") / 100 * 20
        + ratio(F.col("REVENUE_CONTRIBUTION"), F.col("top.q"), 0) * 15
        + cover
    )
    score = F.round(stable(score, 12), 1)
    if "WAREHOUSE_STOCK" in df.columns:
        score = F.round(score * F.when(F.col("WAREHOUSE_STOCK") > 0, 1.0).otherwise(0.7), 9)
    return (
        df.withColumn("top", top)
        .withColumn("REVENUE_CONTRIBUTION", F.col("TOTAL_SALES"))
        .withColumn("CONSISTENCY_SCORE", ratio(F.col("SALES_TRANSACTIONS"), F.col("top.n"), 0) * 100)
        .withColumn("STYLE_EFFICIENCY_SCORE", score)
        .drop("top")
    )


def _best_first() -> "Window":
    return Window.partitionBy("STORE").orderBy(F.desc("STYLE_EFFICIENCY_SCORE"), F.asc("STYLE"))


def store_recommendations(
    metrics: DataFrame,
    names: DataFrame | None = None,
    threshold: float = 60.0,
    caps: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Per store: efficient styles, category, recommended style count and sales focus.
    `caps` bounds the count for high, good, average and weak stores (STYLE_CAPS, say);
    without it a store may be recommended all its styles. metrics should be a written table."""
    good = F.col("STYLE_EFFICIENCY_SCORE") >= threshold

    def mean_good(c: str):
        return F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0))

    per = metrics.groupBy("STORE").agg(
        F.count(F.lit(1)).alias("CURRENT_TOTAL_STYLES"),
        F.count_if(good).alias("CURRENT_EFFICIENT_STYLES"),
        F.sum("TOTAL_SALES").alias("TOTAL_SALES"),
        F.coalesce(F.sum(F.when(good, F.col("TOTAL_SALES"))), F.lit(0.0)).alias("efficient_sales"),
        F.sum("STOCK").alias("TOTAL_STOCK"),
        F.coalesce(F.sum(F.when(good, F.col("STOCK"))), F.lit(0.0)).alias("EFFICIENT_STOCK"),
        F.round(stable(mean_good("STYLE_EFFICIENCY_SCORE")), 1).alias("AVG_EFFICIENCY_SCORE"),
        F.round(stable(mean_good("SALES_VELOCITY")), 2).alias("AVG_SALES_VELOCITY"),
        F.round(stable(mean_good("STOCK_TURNOVER")), 2).alias("AVG_STOCK_TURNOVER"),
        stable(F.avg("STYLE_EFFICIENCY_SCORE"), 12).alias("all_avg"),
    )
    cuts = quantiles(metrics, {"q50": ("TOTAL_SALES", 0.5), "q75": ("TOTAL_SALES", 0.75)}, ["STORE"])
    per = per.join(cuts, "STORE", "left")
    n, eff, total = F.col("CURRENT_TOTAL_STYLES"), F.col("CURRENT_EFFICIENT_STYLES"), F.col("TOTAL_SALES")
    high = (F.col("all_avg") >= 70) & (total >= F.col("q75"))
    fair = (F.col("all_avg") >= 50) & (total >= F.col("q50"))
    middling = F.col("all_avg") >= 30
    category = (
        F.when(high, "High Performer")
        .when(fair, "Good Performer")
        .when(middling, "Average Performer")
        .otherwise("Needs Improvement")
    )
    one = F.lit(1).cast("long")
    wish = (
        F.when(high, F.least(eff + 2, n))
        .when(fair, eff)
        .when(middling, F.greatest(eff - 1, one))
        .otherwise(F.greatest(F.floor(eff / 2), one))
    )
    most = n
    if caps is not None:
        cap = F.when(high, caps[0]).when(fair, caps[1]).when(middling, caps[2]).otherwise(caps[3])
        most = F.least(cap.cast("long"), n)
    per = per.withColumn("STORE_CATEGORY", category).withColumn("RECOMMENDED_STYLES", F.greatest(one, F.least(wish, most)))
    per = materialize(per, "stores")

    best = metrics.where(good).withColumn("place", F.row_number().over(_best_first()))
    focus = (
        best.join(per.select("STORE", "RECOMMENDED_STYLES"), "STORE")
        .where(F.col("place") <= F.col("RECOMMENDED_STYLES"))
        .groupBy("STORE")
        .agg(F.sum("TOTAL_SALES").alias("focus"))
    )

    def percent(x):
        return F.round(stable(F.when(total > 0, ratio(x, total) * 100).otherwise(0.0)), 1)

    out = per.join(focus, "STORE", "left").select(
        "STORE",
        "STORE_CATEGORY",
        "CURRENT_TOTAL_STYLES",
        "CURRENT_EFFICIENT_STYLES",
        "RECOMMENDED_STYLES",
        (F.col("RECOMMENDED_STYLES") - eff).alias("EFFICIENCY_IMPROVEMENT"),
        "TOTAL_SALES",
        percent(F.col("efficient_sales")).alias("EFFICIENT_SALES_PCT"),
        "AVG_EFFICIENCY_SCORE",
        "AVG_SALES_VELOCITY",
        "AVG_STOCK_TURNOVER",
        percent(F.coalesce("focus", F.lit(0.0))).alias("PROJECTED_SALES_FOCUS_PCT"),
        "TOTAL_STOCK",
        "EFFICIENT_STOCK",
    )
    if names is not None:
        out = out.join(names, "STORE", "left")
    return out.orderBy(F.desc("AVG_EFFICIENCY_SCORE"), "STORE")


def style_recommendations(metrics: DataFrame, stores: DataFrame) -> DataFrame:
    """The recommended number of best styles for every store, one row per style."""
    return (
        metrics.withColumn("RANK", F.row_number().over(_best_first()))
        .join(stores.select("STORE", "STORE_CATEGORY", "RECOMMENDED_STYLES"), "STORE")
        .where(F.col("RANK") <= F.col("RECOMMENDED_STYLES"))
        .select(
            "STORE",
            "STORE_CATEGORY",
            F.col("STYLE").alias("RECOMMENDED_STYLE"),
            "RANK",
            F.round("STYLE_EFFICIENCY_SCORE", 2).alias("EFFICIENCY_SCORE"),
            F.round(stable(F.col("SALES_VELOCITY")), 2).alias("SALES_VELOCITY"),
            F.round(stable(F.col("STOCK_TURNOVER")), 2).alias("STOCK_TURNOVER"),
            "TOTAL_SALES",
            F.col("STOCK").alias("CURRENT_STOCK"),
        )
    )


def nested_style_recommendations(metrics: DataFrame, stores: DataFrame) -> DataFrame:
    """One row per store with its recommended styles as an array, best first."""
    flat = style_recommendations(metrics, stores)
    detail = F.struct("RANK", "RECOMMENDED_STYLE", "EFFICIENCY_SCORE", "SALES_VELOCITY", "STOCK_TURNOVER", "TOTAL_SALES", "CURRENT_STOCK")
    return flat.groupBy("STORE", "STORE_CATEGORY").agg(
        F.count(F.lit(1)).alias("RECOMMENDED_COUNT"), F.sort_array(F.collect_list(detail)).alias("STYLES")
    )


def category_analysis(stores: DataFrame) -> DataFrame:
    def mean(c):
        return F.round(stable(F.avg(c)), 2)

    return stores.groupBy("STORE_CATEGORY").agg(
        F.count("CURRENT_TOTAL_STYLES").alias("Store_Count"),
        mean("CURRENT_TOTAL_STYLES").alias("Avg_Current_Styles"),
        F.sum("CURRENT_TOTAL_STYLES").alias("Total_Current_Styles"),
        mean("RECOMMENDED_STYLES").alias("Avg_Recommended_Styles"),
        F.sum("RECOMMENDED_STYLES").alias("Total_Recommended_Styles"),
        mean("AVG_EFFICIENCY_SCORE").alias("Avg_Efficiency_Score"),
        mean("TOTAL_SALES").alias("Avg_Total_Sales"),
    )


CATEGORIES = ["High Performer", "Good Performer", "Average Performer", "Needs Improvement"]


def summary_stats(stores: DataFrame) -> DataFrame:
    """One row: store count, means, sums, style reduction and stores per category."""
    counts = [
        F.count_if(F.col("STORE_CATEGORY") == c).alias(c.split()[0].lower() + "_stores") for c in CATEGORIES
    ]
    current, wanted = F.sum("CURRENT_TOTAL_STYLES"), F.sum("RECOMMENDED_STYLES")
    return stores.agg(
        F.count(F.lit(1)).alias("total_stores"),
        stable(F.avg("CURRENT_TOTAL_STYLES")).alias("avg_current_styles"),
        stable(F.avg("RECOMMENDED_STYLES")).alias("avg_recommended_styles"),
        stable(F.avg("AVG_EFFICIENCY_SCORE")).alias("avg_efficiency_score"),
        current.alias("total_current_styles"),
        wanted.alias("total_recommended_styles"),
        (current - wanted).alias("style_reduction"),
        *counts,
    )


def top_store_styles(metrics: DataFrame, n: int = 50) -> DataFrame:
    return (
        metrics.orderBy(F.desc("STYLE_EFFICIENCY_SCORE"), "STORE", "STYLE")
        .limit(n)
        .select(
            "STORE",
            "STYLE",
            F.round("STYLE_EFFICIENCY_SCORE", 2).alias("STYLE_EFFICIENCY_SCORE"),
            F.round(stable(F.col("SALES_VELOCITY")), 2).alias("SALES_VELOCITY"),
            F.round(stable(F.col("STOCK_TURNOVER")), 2).alias("STOCK_TURNOVER"),
            "TOTAL_SALES",
            "STOCK",
        )
    )


def top_styles(metrics: DataFrame, n: int = 20) -> DataFrame:
    """Styles by their mean score over all stores."""
    return (
        metrics.groupBy("STYLE")
        .agg(
            stable(F.avg("STYLE_EFFICIENCY_SCORE")).alias("STYLE_EFFICIENCY_SCORE"),
            F.sum("TOTAL_SALES").alias("TOTAL_SALES"),
            stable(F.avg("SALES_VELOCITY")).alias("SALES_VELOCITY"),
            stable(F.avg("STOCK_TURNOVER")).alias("STOCK_TURNOVER"),
        )
        .orderBy(F.desc("STYLE_EFFICIENCY_SCORE"), "STYLE")
        .limit(n)
    )


def style_changes(stores: DataFrame) -> DataFrame:
    """Recommended against current style count per store."""
    change = F.col("RECOMMENDED_STYLES") - F.col("CURRENT_TOTAL_STYLES")
    return stores.withColumn("STYLE_CHANGE", change).withColumn(
        "CHANGE_PCT", F.round(stable(ratio(F.col("STYLE_CHANGE"), F.col("CURRENT_TOTAL_STYLES")) * 100), 1)
    )


def insights(stores: DataFrame) -> DataFrame:
    """Size, mean score and mean recommendation of the best and worst groups, and the
    overall style reduction."""
    cols = []
    for category, tag in (("High Performer", "high"), ("Needs Improvement", "needs")):
        mine = F.col("STORE_CATEGORY") == category
        cols += [
            F.count_if(mine).alias(f"{tag}_stores"),
            stable(F.avg(F.when(mine, F.col("AVG_EFFICIENCY_SCORE")))).alias(f"{tag}_avg_score"),
            stable(F.avg(F.when(mine, F.col("RECOMMENDED_STYLES")))).alias(f"{tag}_avg_recommended"),
        ]
    return stores.agg(
        *cols, (F.sum("CURRENT_TOTAL_STYLES") - F.sum("RECOMMENDED_STYLES")).alias("total_reduction")
    )


def score_histogram(stores: DataFrame, column: str = "AVG_EFFICIENCY_SCORE", bins: int = 20) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, empty ones included."""
    ends = scalars(stores.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    x = stores.select(F.col(column).cast("double").alias("x")).withColumn("ends", ends)
    lo, width = F.col("ends.lo"), (F.col("ends.hi") - F.col("ends.lo")) / bins
    place = F.when(width > 0, F.least(F.floor(stable((F.col("x") - lo) / width, 12)), F.lit(bins - 1))).otherwise(0)
    counts = x.where(F.col("x").isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = stores.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("ends", ends)
    return frame.join(counts, "bin", "left").select(
        "bin",
        stable(lo + F.col("bin") * width).alias("bin_start"),
        stable(lo + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("stores"),
    )


def category_shares(stores: DataFrame) -> DataFrame:
    total = scalars(stores.agg(F.count(F.lit(1)).alias("n")))["n"]
    return stores.groupBy("STORE_CATEGORY").agg(F.count(F.lit(1)).alias("stores")).withColumn(
        "share_pct", stable(ratio(F.col("stores"), total) * 100)
    )
