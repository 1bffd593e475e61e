"""Steps shared by the replenishment editions, on (STORE, SKU) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, stable_ceil, stable_floor
from ..model import ReplenishParams
from ..sources.scratch import materialize, spread
from . import demand

NO_STOCK = "No warehouse stock available"


def velocity(sales: DataFrame, p: ReplenishParams, edition: str = "final") -> DataFrame:
    if p.method != "weighted":
        return demand.velocity_simple(sales, p.period_days, p.as_of)
    if edition == "base":
        return demand.velocity_trended(sales, p.period_days, p.as_of).drop("TREND_FACTOR")
    return demand.weighted_daily_sales(sales, p.period_days, p.as_of)


def stock_by_pair(stock: DataFrame) -> DataFrame:
    """One row per (STORE, SKU), so that repeated stock lines cannot fan out."""
    return (
        stock.where(F.col("STORE").isNotNull() & F.col("SKU").isNotNull())
        .groupBy("STORE", "SKU")
        .agg(F.sum("STOCK").alias("STOCK"))
    )


def pairs(vel: DataFrame, stock: DataFrame) -> DataFrame:
    """Velocity, one row per (STORE, SKU), and stock of the pairs that either has, missing
    figures 0. Both are stacked and dealt by SKU: what is joined by SKU and summed over a
    SKU later finds the pairs in place."""
    zero = F.lit(0.0)
    sold = vel.select("STORE", "SKU", "DAILY_SALES", F.lit(None).cast(stock.schema["STOCK"].dataType).alias("STOCK"))
    held = stock.where(F.col("STORE").isNotNull() & F.col("SKU").isNotNull()).select(
        "STORE", "SKU", F.lit(None).cast(vel.schema["DAILY_SALES"].dataType).alias("DAILY_SALES"), "STOCK"
    )
    figures = [F.coalesce(F.max("DAILY_SALES"), zero).alias("DAILY_SALES"), F.coalesce(F.sum("STOCK"), zero).alias("STOCK")]
    return spread(sold.union(held), "SKU").groupBy("STORE", "SKU").agg(*figures)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """Deterministic first row per key (smallest remaining columns)."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.where(F.col(key).isNotNull()).distinct()
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(*rest)).alias("first"))
        .select(key, *[F.col(f"first.{c}").alias(c) for c in rest])
    )


def store_names(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """One name per store, the sales name before the stock name. Give the sales of the
    planning window: older lines need not be read for names. Written once, so that its
    size is known and the pairs are not shuffled by store, of which there are few."""
    parts = [
        df.where(F.col("STORE_NAME").isNotNull()).groupBy("STORE").agg(F.min("STORE_NAME").alias(n))
        for df, n in ((sales, "a"), (stock, "b"))
        if "STORE_NAME" in df.columns
    ]
    if not parts:
        names = sales.select("STORE", F.col("STORE").alias("STORE_NAME")).distinct()
    elif len(parts) == 1:
        names = parts[0].toDF("STORE", "STORE_NAME")
    else:
        names = parts[0].join(parts[1], "STORE", "full").select("STORE", F.coalesce("a", "b").alias("STORE_NAME"))
    return materialize(names, "names")


def warehouse_by_sku(warehouse: DataFrame) -> DataFrame:
    return (
        warehouse.where(F.col("SKU").isNotNull())
        .groupBy("SKU")
        .agg(F.max("WAREHOUSE_STOCK").alias("WAREHOUSE_STOCK"))
    )


def with_stock_cover(df: DataFrame) -> DataFrame:
    """Days of cover; 999 with stock but no sales, 0 with neither."""
    cover = (
        F.when(F.col("DAILY_SALES") > 0, ratio(F.col("STOCK"), F.col("DAILY_SALES")))
        .when(F.col("STOCK") > 0, 999.0)
        .otherwise(0.0)
    )
    return df.withColumn("STOCK_COVER_DAYS", cover)


def with_base_forecast(df: DataFrame, p: ReplenishParams) -> DataFrame:
    return df.withColumn("FORECAST_DEMAND", F.col("DAILY_SALES") * p.cover_days)


def with_need(df: DataFrame, p: ReplenishParams) -> DataFrame:
    """TARGET_STOCK, REPLEN_QTY (at least the MOQ where anything is needed) and IS_NEW_ITEM."""
    gap = F.greatest(F.col("TARGET_STOCK") - F.col("STOCK"), F.lit(0.0))
    need = F.when((gap > 0) & (F.col("DAILY_SALES") > 0), F.greatest(gap, F.lit(float(p.moq)))).otherwise(0.0)
    return (
        df.withColumn("TARGET_STOCK", stable_ceil(F.col("FORECAST_DEMAND")))
        .withColumn("REPLEN_QTY", need)
        .withColumn("IS_NEW_ITEM", (F.col("DAILY_SALES") == 0) & (F.col("STOCK") == 0))
    )


def per_sku() -> "Window":
    """All stores of a SKU: at most one row per store, so the groups stay small."""
    return Window.partitionBy("SKU")


def share_of(weight: Column, amount: Column) -> Column:
    """floor(weight / sum of weights in the SKU * amount); 0 when the weights sum to 0."""
    return stable_floor(F.coalesce(F.try_divide(weight, F.sum(weight).over(per_sku())) * amount, F.lit(0.0)))


def with_place(df: DataFrame, *order: Column) -> DataFrame:
    """Add __place, the rank of the row within its SKU. Added before the sums over a
    SKU, whose windows then reuse this sort."""
    return df.withColumn("__place", F.row_number().over(per_sku().orderBy(*order)))


def equal_split(amount: Column) -> Column:
    """Even whole shares of amount over the rows of a SKU; the rest goes, one unit
    each, to the first rows by __place."""
    n = F.count(F.lit(1)).over(per_sku())
    base = F.floor(amount / n).cast("double")
    return base + F.when(F.col("__place") <= F.floor(amount - base * n), 1.0).otherwise(0.0)


def whole_number(c: Column) -> Column:
    return F.format_string("%.0f", c.cast("double"))

