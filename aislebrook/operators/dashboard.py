"""The aggregates behind the sales and stock dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, scalars, stable


def kpis(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Total sales, stores, SKUs and stock, one row. The distinct counts run on sums
    per pair, not on the sale lines."""
    held = scalars(stock.agg(F.sum("STOCK").alias("total_stock")))
    pairs = sales.groupBy("STORE", "SKU").agg(F.sum("QUANTITY").alias("q"))
    return pairs.agg(
        F.sum("q").alias("total_sales"),
        F.count_distinct("STORE").alias("stores"),
        F.count_distinct("SKU").alias("skus"),
    ).withColumn("total_stock", held["total_stock"])


def daily_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy("DATE").agg(F.sum("QUANTITY").alias("QUANTITY")).orderBy("DATE")


def top_by(df: DataFrame, key: str, metric: str, n: int = 10) -> DataFrame:
    """The n keys with the largest sum of metric."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum(metric).alias(metric))
        .orderBy(F.desc(metric), key)
        .limit(n)
    )


def total_by(df: DataFrame, key: str, metric: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(metric).alias(metric)).orderBy(F.desc(metric), key)
    )


def zero_stock(stock: DataFrame) -> DataFrame:
    return stock.where(F.col("STOCK") == 0).groupBy("STORE").agg(F.count(F.lit(1)).alias("zero_stock_items"))


def store_performance(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Sales, stock, SKU count and stock turn of the stores that have sales."""
    sold = (
        sales.where(F.col("STORE").isNotNull())
        .groupBy("STORE")
        .agg(F.min("STORE_NAME").alias("Store_Name"), F.sum("QUANTITY").alias("Total_Sales"))
    )
    held = stock.groupBy("STORE").agg(
        F.sum("STOCK").alias("Current_Stock"), F.count_distinct("SKU").alias("SKU_Count")
    )
    turn = F.coalesce(ratio(F.col("Total_Sales"), F.col("Current_Stock")), F.lit(0.0))
    return sold.join(held, "STORE", "left").withColumn("Stock_Turn", F.round(stable(turn), 2))


def attribute_sales(
    sales: DataFrame, sku_master: DataFrame, style_master: DataFrame, column: str, n: int | None = None
) -> DataFrame:
    """Units by GENDER, SIZE, COLOR or STYLE; sales are summed per SKU before the joins."""
    by_sku = sales.groupBy("SKU").agg(F.sum("QUANTITY").alias("QUANTITY"))
    joined = by_sku.join(sku_master.select("SKU", "STYLE", "COLOR", "SIZE"), "SKU").join(style_master, "STYLE")
    return top_by(joined, column, "QUANTITY", n) if n else total_by(joined, column, "QUANTITY")


def service_kpis(sales: DataFrame, stock: DataFrame, sku_master: DataFrame) -> DataFrame:
    """Service level, turnover, out-of-stock share, active and known SKUs, one row."""
    sold = scalars(
        sales.agg(F.sum("QUANTITY").alias("units"), F.count_distinct("SKU").alias("active_skus"))
    )
    known = scalars(sku_master.agg(F.count_distinct("SKU").alias("n")))["n"]
    rows = F.col("rows")
    return (
        stock.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("STOCK") > 0).alias("inn"),
            F.count_if(F.col("STOCK") == 0).alias("out"),
            F.sum("STOCK").alias("units_held"),
        )
        .withColumn("sold", sold)
        .select(
            stable(ratio(F.col("inn"), rows, 0) * 100).alias("service_level_pct"),
            stable(
                F.when(F.col("units_held") > 0, ratio(F.col("sold.units"), F.col("units_held"))).otherwise(0.0)
            ).alias("inventory_turnover"),
            stable(ratio(F.col("out"), rows, 0) * 100).alias("out_of_stock_pct"),
            F.col("sold.active_skus").alias("active_skus"),
        )
        .withColumn("total_skus", known)
    )
