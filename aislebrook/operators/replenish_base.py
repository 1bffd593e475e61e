"""Base replenishment edition: priority-weighted shares with a size-set check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ReplenishParams
from ..sources.scratch import materialize
from . import plan_steps as ps
from .windows import recent


def _sku_stock(warehouse: DataFrame, sku_master: DataFrame) -> DataFrame:
    """SKUs of the master and of the warehouse with attributes and warehouse stock."""
    master = ps.one_per_key(sku_master.select("SKU", "STYLE", "COLOR", "SIZE"), "SKU")
    return master.join(ps.warehouse_by_sku(warehouse), "SKU", "full")


def full_stock_sets(sku_stock: DataFrame, moq: int = 2) -> DataFrame:
    """(STYLE, COLOR) -> whether every stocked size holds at least the MOQ."""
    known = F.col("STYLE").isNotNull() & F.col("COLOR").isNotNull() & F.col("WAREHOUSE_STOCK").isNotNull()
    return (
        sku_stock.where(known).groupBy("STYLE", "COLOR").agg(F.bool_and(F.col("WAREHOUSE_STOCK") >= moq).alias("ALL_SIZES"))
    )


def sku_facts(warehouse: DataFrame, sku_master: DataFrame, style_master: DataFrame | None, moq: int = 2) -> DataFrame:
    """One row per SKU with everything the allocation reads: attributes, gender,
    warehouse stock and the size-set flag. Built on the SKU dimension so that the
    pairs are shuffled by SKU only once. What is joined by style is written once, so that
    its size is known and the SKUs are not shuffled by style, of which there are few."""
    stocked = _sku_stock(warehouse, sku_master)
    facts = stocked.join(materialize(full_stock_sets(stocked, moq), "sets"), ["STYLE", "COLOR"], "left")
    if style_master is None:
        return facts.withColumn("GENDER", F.lit("UNISEX"))
    genders = materialize(ps.one_per_key(style_master.select("STYLE", "GENDER"), "STYLE"), "genders")
    return facts.join(genders, "STYLE", "left").withColumn("GENDER", F.coalesce("GENDER", F.lit("UNISEX")))


def needs(
    sales: DataFrame, stock: DataFrame, priority: DataFrame, p: ReplenishParams = ReplenishParams()
) -> DataFrame:
    """Pairs with velocity, cover, target, need, priority and store name."""
    df = ps.pairs(ps.velocity(sales, p, "base"), stock)
    df = ps.with_need(ps.with_base_forecast(ps.with_stock_cover(df), p), p)
    return (
        df.join(priority.select("STORE", "PRIORITY_SCORE"), "STORE", "left")
        .withColumn("PRIORITY_SCORE", F.coalesce("PRIORITY_SCORE", F.lit(0.0)))
        .join(ps.store_names(recent(sales, p.period_days, as_of=p.as_of), stock), "STORE", "left")
    )


def allocate(df: DataFrame, p: ReplenishParams = ReplenishParams()) -> DataFrame:
    """FINAL_REPLEN_QTY and REMARKS from need, priority, warehouse stock and ALL_SIZES.

    Nothing in the warehouse: 0. Shortage: shares by priority x need, or an even
    split when these are all 0. Otherwise the need, at least the MOQ, and no more
    than the warehouse holds unless every size of the style-colour is in stock.
    """
    have, need = F.col("WAREHOUSE_STOCK"), F.col("REPLEN_QTY")
    total = F.sum("REPLEN_QTY").over(ps.per_sku())
    weight = F.col("PRIORITY_SCORE") * need
    shared = F.when(F.sum(weight).over(ps.per_sku()) > 0, ps.share_of(weight, have)).otherwise(
        ps.equal_split(have)
    )
    wanted = F.greatest(F.lit(float(p.moq)), need)
    enough = F.when(F.coalesce("ALL_SIZES", F.lit(True)), wanted).otherwise(F.least(wanted, have))
    short = F.concat(
        F.lit("Warehouse stock insufficient: Demand="),
        ps.whole_number(F.col("TOTAL_DEMAND")),
        F.lit(", Short by "),
        ps.whole_number(F.col("TOTAL_DEMAND") - have),
        F.lit(" units"),
    )
    final = (
        F.when(have <= 0, 0.0)
        .when(F.col("TOTAL_DEMAND") > have, shared)
        .when(need > 0, enough)
        .otherwise(0.0)
    )
    remarks = F.when(have <= 0, ps.NO_STOCK).when(F.col("TOTAL_DEMAND") > have, short).otherwise("")
    df = df.withColumn("WAREHOUSE_STOCK", F.coalesce("WAREHOUSE_STOCK", F.lit(0.0)))
    return (
        ps.with_place(df, F.desc("PRIORITY_SCORE"), F.asc("STORE"))
        .withColumn("TOTAL_DEMAND", total)
        .withColumn("FINAL_REPLEN_QTY", F.floor(final).cast("double"))
        .withColumn("REMARKS", remarks)
        .drop("__place")
    )


def with_complete_size_set(plan: DataFrame) -> DataFrame:
    """COMPLETE_SIZE_SET: every planned row of the style gets something.

    Aggregated and joined back: a style may own a large share of all rows, which
    a window would gather in one task. Written once, so that its size is known.
    """
    styles = plan.where(F.col("STYLE").isNotNull()).groupBy("STYLE").agg(
        F.bool_and(F.col("FINAL_REPLEN_QTY") > 0).alias("COMPLETE_SIZE_SET")
    )
    return plan.join(materialize(styles, "styles"), "STYLE", "left").withColumn(
        "COMPLETE_SIZE_SET", F.coalesce("COMPLETE_SIZE_SET", F.lit(False))
    )
