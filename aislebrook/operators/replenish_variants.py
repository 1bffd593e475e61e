"""Further allocation rules on (STORE, SKU) rows with REPLEN_QTY and WAREHOUSE_STOCK."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, stable_ceil
from ..sources.scratch import spread
from . import plan_steps as ps


def allocate_remainder(df: DataFrame) -> DataFrame:
    """Largest remainder: shares by priority x velocity over cover, leftover units
    to the largest fractions; the need itself where stock is enough."""
    have = F.col("WAREHOUSE_STOCK")
    weight = F.col("PRIORITY_SCORE") * ratio(F.lit(1.0), F.col("STOCK_COVER_DAYS") + 1) * F.greatest(
        F.col("DAILY_SALES"), F.lit(0.1)
    )
    share = F.coalesce(F.try_divide(weight, F.sum(weight).over(ps.per_sku())) * have, F.lit(0.0))
    df = (
        spread(df, "SKU").withColumn("TOTAL_DEMAND", F.sum("REPLEN_QTY").over(ps.per_sku()))
        .withColumn("share", F.round(share, 6))
        .withColumn("base", F.floor("share").cast("double"))
        .withColumn("part", F.round(F.col("share") - F.col("base"), 6))
    )
    left = F.floor(have - F.sum("base").over(ps.per_sku()))
    place = F.row_number().over(ps.per_sku().orderBy(F.desc("part"), F.asc("STORE")))
    extra = F.when(place <= left, 1.0).otherwise(0.0)
    got = F.when(F.col("TOTAL_DEMAND") <= have, F.col("REPLEN_QTY")).otherwise(F.col("base") + extra)
    return df.withColumn("OPTIMIZED_QTY", got).drop("share", "base", "part")


def round_to_packs(df: DataFrame, qty: str = "REPLEN_QTY", pack: int = 6, moq: int = 2, most: int | None = None) -> DataFrame:
    """Whole packs of at least moq and, where it is given, at most `most`; no more than the
    warehouse holds; under the MOQ nothing."""
    packs = F.greatest(stable_ceil(F.col(qty) / pack) * pack, F.lit(float(moq)))
    if most is not None:
        packs = F.least(packs, F.lit(float(most)))
    got = F.least(F.when(F.col(qty) > 0, packs).otherwise(0.0), F.col("WAREHOUSE_STOCK"))
    return df.withColumn("FINAL_REPLEN_QTY", F.when(got < moq, 0.0).otherwise(got))


def allocate_priority(df: DataFrame) -> DataFrame:
    """Shortage: floor of the priority x need share, or an even split with the rest to
    high priority and low cover; otherwise the need."""
    have, need = F.col("WAREHOUSE_STOCK"), F.col("REPLEN_QTY")
    weight = F.col("PRIORITY_SCORE") * need
    shared = F.when(F.sum(weight).over(ps.per_sku()) > 0, ps.share_of(weight, have)).otherwise(
        ps.equal_split(have)
    )
    short = (F.col("TOTAL_DEMAND") > have) & (have > 0)
    return (
        ps.with_place(spread(df, "SKU"), F.desc("PRIORITY_SCORE"), F.asc("STOCK_COVER_DAYS"), F.asc("STORE"))
        .withColumn("TOTAL_DEMAND", F.sum("REPLEN_QTY").over(ps.per_sku()))
        .withColumn("FINAL_REPLEN_QTY", F.when(short, shared).otherwise(need))
        .drop("__place")
    )
