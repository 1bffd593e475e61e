"""What is read off a finished replenishment plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantiles, scalars, stable

# Column order of the plan file.
PLAN_COLUMNS = [
    "STORE", "STORE_NAME", "SKU", "STYLE", "COLOR", "SIZE", "GENDER",
    "STOCK", "WAREHOUSE_STOCK", "DAILY_SALES", "STOCK_COVER_DAYS",
    "TARGET_STOCK", "REPLEN_QTY", "FINAL_REPLEN_QTY",
    "SIZE_SET_ALLOCATION", "PRIORITY_SCORE", "REMARKS", "IS_NEW_ITEM",
]


def overview(plan: DataFrame) -> DataFrame:
    """One row: total quantity, stores and SKUs that get stock, median cover, new items."""
    gets = F.col("FINAL_REPLEN_QTY") > 0
    median = scalars(quantiles(plan.where(F.col("STOCK_COVER_DAYS") < 999), {"m": ("STOCK_COVER_DAYS", 0.5)}))["m"]
    return plan.agg(
        F.sum("FINAL_REPLEN_QTY").alias("total_replen_qty"),
        F.count_distinct(F.when(gets, F.col("STORE"))).alias("stores_needing_stock"),
        F.count_distinct(F.when(gets, F.col("SKU"))).alias("skus_to_replenish"),
        F.count_if("IS_NEW_ITEM").alias("new_items"),
    ).withColumn("median_stock_cover", stable(median))


def recommendations(plan: DataFrame, lead_days: int = 8) -> DataFrame:
    """Rows that get stock, most urgent first, with stock-out and critical flags."""
    critical = (F.col("STOCK_COVER_DAYS") < lead_days) & (F.col("DAILY_SALES") > 0)
    return (
        plan.where(F.col("FINAL_REPLEN_QTY") > 0)
        .withColumn("STOCK_OUT", F.col("STOCK") == 0)
        .withColumn("CRITICAL_STOCK", critical)
        .orderBy(F.asc("STOCK_COVER_DAYS"), F.desc("DAILY_SALES"), "STORE", "SKU")
    )


def display(recs: DataFrame) -> DataFrame:
    """Recommendations as shown: store label, rounded velocity and cover."""
    return recs.select(
        F.concat("STORE", F.lit(" - "), F.coalesce("STORE_NAME", F.lit(""))).alias("STORE_DISPLAY"),
        *["SKU", "STYLE", "COLOR", "SIZE", "GENDER", "STOCK"],
        F.round("DAILY_SALES", 2).alias("DAILY_SALES"),
        F.round("STOCK_COVER_DAYS", 1).alias("STOCK_COVER_DAYS"),
        *["TARGET_STOCK", "FINAL_REPLEN_QTY", "STOCK_OUT", "CRITICAL_STOCK"],
    )


def new_items(plan: DataFrame) -> DataFrame:
    """Pairs without sales and stock, for review."""
    return plan.where("IS_NEW_ITEM").select(
        F.concat("STORE", F.lit(" - "), F.coalesce("STORE_NAME", F.lit(""))).alias("STORE_DISPLAY"),
        *["SKU", "STYLE", "COLOR", "SIZE", "GENDER"],
    )


def shortage_summary(plan: DataFrame) -> DataFrame:
    """SKUs whose warehouse stock does not meet the demand, among rows that get stock."""
    return (
        plan.where((F.col("FINAL_REPLEN_QTY") > 0) & F.col("REMARKS").contains("insufficient"))
        .select("SKU", "STYLE", "WAREHOUSE_STOCK", "REMARKS")
        .distinct()
    )


def quantity_by_store(plan: DataFrame) -> DataFrame:
    return (
        plan.where(F.col("FINAL_REPLEN_QTY") > 0)
        .groupBy("STORE", "STORE_NAME")
        .agg(F.sum("FINAL_REPLEN_QTY").alias("replen_qty"))
        .orderBy("replen_qty", "STORE")
    )


def cover_summary(plan: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of the stock cover per store."""
    names = {"cover_min": 0.0, "cover_q1": 0.25, "cover_median": 0.5, "cover_q3": 0.75, "cover_max": 1.0}
    return quantiles(plan, {n: ("STOCK_COVER_DAYS", q) for n, q in names.items()}, ["STORE"])


def factor_summary(plan: DataFrame) -> DataFrame:
    """Average forecast factors and class sizes of a final-edition plan."""
    return plan.agg(
        F.max("SEASONAL_FACTOR").alias("seasonal"),
        stable(F.avg("FORECAST_MULTIPLIER")).alias("avg_multiplier"),
        stable(F.avg("TREND_FACTOR")).alias("avg_trend"),
        stable(F.avg("CATEGORY_FACTOR")).alias("avg_category"),
        F.count_if(F.col("ABC_CLASS") == "A").alias("a_items"),
        F.count_if(F.col("ABC_CLASS") == "B").alias("b_items"),
        F.count_if(F.col("ABC_CLASS") == "C").alias("c_items"),
        F.count_if(F.col("VELOCITY_CLASS") == "Fast").alias("fast_movers"),
        F.count_if(F.col("VELOCITY_CLASS") == "Medium").alias("medium_movers"),
        F.count_if(F.col("VELOCITY_CLASS") == "Slow").alias("slow_movers"),
    )


def records(plan: DataFrame) -> DataFrame:
    """Plan rows as run details, missing figures 0."""

    def number(name: str):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in plan.columns else F.lit(0.0)

    return plan.select(
        F.col("SKU").alias("sku"),
        F.col("STORE").alias("store"),
        number("FINAL_REPLEN_QTY").alias("quantity"),
        number("PRIORITY_SCORE").alias("priority_score"),
        number("STOCK").alias("current_stock"),
        number("DAILY_SALES").alias("sales_velocity"),
        number("WAREHOUSE_STOCK").alias("warehouse_stock"),
    )

