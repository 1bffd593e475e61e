"""End-to-end replenishment plans: canonical tables in, one row per (STORE, SKU) out."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ReplenishParams
from ..operators import plan_steps as ps
from ..operators import replenish_base as base
from ..operators import replenish_final as final
from ..operators.priority import store_priority
from ..operators.windows import recent
from ..sources.scratch import materialize


def with_planning_date(sales: DataFrame, p: ReplenishParams) -> ReplenishParams:
    """Resolve the planning date once, so that every later date filter is a literal
    that prunes partitions and row groups."""
    if p.as_of is not None:
        return p
    return replace(p, as_of=sales.agg(F.max("DATE")).first()[0])


def base_plan(
    sales: DataFrame,
    stock: DataFrame,
    warehouse: DataFrame,
    sku_master: DataFrame,
    style_master: DataFrame | None = None,
    params: ReplenishParams = ReplenishParams(),
) -> DataFrame:
    return base.with_complete_size_set(base_rows(sales, stock, warehouse, sku_master, style_master, params))


def base_rows(
    sales: DataFrame,
    stock: DataFrame,
    warehouse: DataFrame,
    sku_master: DataFrame,
    style_master: DataFrame | None = None,
    params: ReplenishParams = ReplenishParams(),
) -> DataFrame:
    """The base plan without COMPLETE_SIZE_SET, written once."""
    p = with_planning_date(sales, params)
    rows = base.needs(sales, stock, store_priority(sales, stock, p.period_days, p.as_of), p)
    facts = base.sku_facts(warehouse, sku_master, style_master, p.moq)
    rows = rows.join(facts, "SKU", "left").withColumn("GENDER", F.coalesce("GENDER", F.lit("UNISEX")))
    return materialize(base.allocate(rows.where(F.col("GENDER") != "FREEBIES"), p), "plan")


def final_pairs(
    sales: DataFrame,
    stock: DataFrame,
    warehouse: DataFrame,
    sku_master: DataFrame,
    style_master: DataFrame | None = None,
    params: ReplenishParams = ReplenishParams(),
) -> DataFrame:
    """Velocity, stock, attributes, gender, warehouse stock and cover per pair, written once."""
    p = with_planning_date(sales, params)
    vel = ps.velocity(sales, p)
    rows = ps.pairs(vel, stock)
    # Every SKU a pair may have; the warehouse adds its own in the universe.
    parts = [recent(sales, p.period_days, as_of=p.as_of), stock, *([warehouse] if p.mode == "universe" else [])]
    skus = reduce(DataFrame.union, [x.select("SKU") for x in parts]).where(F.col("SKU").isNotNull()).distinct()
    if p.mode == "universe":
        grid = final.store_sku_grid(stock, final.sku_universe(vel, stock, warehouse))
        zero = F.lit(0.0)
        rows = grid.join(rows, ["STORE", "SKU"], "left").withColumns(
            {"DAILY_SALES": F.coalesce("DAILY_SALES", zero), "STOCK": F.coalesce("STOCK", zero)}
        )
    rows = rows.join(final.sku_facts(skus, sku_master, warehouse, style_master), "SKU")
    return materialize(ps.with_stock_cover(rows), "pairs")


def final_needs(
    pairs: DataFrame,
    sales: DataFrame,
    stock: DataFrame,
    params: ReplenishParams = ReplenishParams(),
) -> DataFrame:
    """Classes, forecast, need, priority and names on written pairs."""
    p = with_planning_date(sales, params)
    rows = ps.with_need(_forecast(pairs, sales, p), p)
    priority = store_priority(sales, stock, p.period_days, p.as_of).select("STORE", "PRIORITY_SCORE")
    rows = rows.join(priority, "STORE", "left").withColumn(
        "PRIORITY_SCORE", F.coalesce("PRIORITY_SCORE", F.lit(0.0))
    )
    rows = rows.join(ps.store_names(recent(sales, p.period_days, as_of=p.as_of), stock), "STORE", "left")
    return materialize(final.with_importance(rows), "needs")


def _forecast(pairs: DataFrame, sales: DataFrame, p: ReplenishParams) -> DataFrame:
    return final.with_forecast(final.with_classes(pairs, p), sales, p)


def final_allocated(
    sales: DataFrame,
    stock: DataFrame,
    warehouse: DataFrame,
    sku_master: DataFrame,
    style_master: DataFrame | None = None,
    size_master: DataFrame | None = None,
    params: ReplenishParams = ReplenishParams(),
) -> DataFrame:
    """The plan after allocation and size completion, before the closing filter."""
    return completed(first_pass(sales, stock, warehouse, sku_master, style_master, size_master, params), params)


def first_pass(
    sales: DataFrame,
    stock: DataFrame,
    warehouse: DataFrame,
    sku_master: DataFrame,
    style_master: DataFrame | None = None,
    size_master: DataFrame | None = None,
    params: ReplenishParams = ReplenishParams(),
    columns: list[str] | None = None,
) -> DataFrame:
    """The plan (or its `columns`) after allocation and the first completion pass, written
    once if a second one follows: columns left out are not shuffled by SKU either."""
    p = with_planning_date(sales, params)
    rows = final_needs(final_pairs(sales, stock, warehouse, sku_master, style_master, p), sales, stock, p)
    rows = rows.join(final.size_set_bonus(rows), ["STORE", "STYLE", "COLOR"], "left").join(
        final.store_scores(rows), "STORE", "left"
    )
    rows = final.allocate(rows, p)
    rows = final.complete_sizes(rows, final.size_sets(sales.sparkSession, size_master), p)
    rows = rows if columns is None else rows.select(*columns)
    return materialize(rows, "allocated") if p.completion == "full" else rows


def completed(rows: DataFrame, p: ReplenishParams) -> DataFrame:
    """`first_pass` rows after the second completion pass, where the plan has one."""
    if p.completion == "full":
        rows = final.complete_sets(rows, p)
    return rows.withColumn("COMPLETE_SIZE_SET", F.lit(False))


def final_plan(
    sales: DataFrame,
    stock: DataFrame,
    warehouse: DataFrame,
    sku_master: DataFrame,
    style_master: DataFrame | None = None,
    size_master: DataFrame | None = None,
    params: ReplenishParams = ReplenishParams(),
) -> DataFrame:
    p = with_planning_date(sales, params)
    rows = final_allocated(sales, stock, warehouse, sku_master, style_master, size_master, p)
    return final.final_filter(rows, p)
