"""Final replenishment edition: classified forecast, factor-weighted allocation,
size-set completion and the closing filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantiles, ratio, scalars, stable
from ..model import DEFAULT_SIZE_SETS, FINAL_FREEBIE_WORDS, FREEBIE_WORDS, PLUS_SIZES, ReplenishParams
from ..sources.scratch import materialize, spread
from . import demand
from . import plan_steps as ps
from .windows import latest

# Demand factor of each calendar month.
SEASONAL_FACTORS = {1: 0.8, 2: 0.9, 3: 1.1, 4: 1.0, 5: 1.0, 6: 1.0, 7: 0.9, 8: 0.9, 9: 1.1, 10: 1.2, 11: 1.3, 12: 1.4}

# Forecast multiplier by value class and velocity class.
FORECAST_MULTIPLIERS = {
    "A": {"Fast": 1.5, "Medium": 1.3, "Slow": 1.1},
    "B": {"Fast": 1.3, "Medium": 1.2, "Slow": 1.0},
    "C": {"Fast": 1.2, "Medium": 1.0, "Slow": 0.8},
}

# Factor by first letter of the style.
CATEGORY_FACTORS = {"A": 1.1, "F": 1.2, "S": 0.9, "B": 1.0, "C": 1.0}

# Class weights of the product importance.
ABC_WEIGHTS = {"A": 1.0, "B": 0.7, "C": 0.4}
VELOCITY_WEIGHTS = {"Fast": 1.0, "Medium": 0.6, "Slow": 0.2}


def _lookup(key: Column, table: dict, default: float) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


# --- universe and attributes -------------------------------------------------


def sku_universe(vel: DataFrame, stock: DataFrame, warehouse: DataFrame) -> DataFrame:
    """SKUs that sold, are held in a store, or are in the warehouse."""
    return (
        vel.select("SKU")
        .union(stock.where(F.col("STOCK") > 0).select("SKU"))
        .union(warehouse.select("SKU"))
        .where(F.col("SKU").isNotNull())
        .distinct()
    )


def store_sku_grid(stock: DataFrame, skus: DataFrame, chunk: int = 1024, skus_per_key: int = 4096) -> DataFrame:
    """Every stock store with every SKU.

    Stores are packed into arrays of about `chunk`, and each SKU row meets the
    arrays through an equality join on (chunk, salt), so the grid needs no cross
    join and no list of all stores. One join key takes about `skus_per_key` SKUs, so
    the keys grow with the SKUs and the stores are repeated once per that many.
    """
    stores = stock.where(F.col("STORE").isNotNull()).select("STORE").distinct()
    chunks = stores.agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("c")).scalar()
    n = F.greatest(chunks, F.lit(1))
    salts = F.greatest(skus.agg(F.ceil(F.count(F.lit(1)) / skus_per_key).cast("int")).scalar(), F.lit(1))
    packs = (
        stores.withColumn("chunk", F.pmod(F.xxhash64("STORE"), n).cast("int"))
        .groupBy("chunk")
        .agg(F.collect_list("STORE").alias("stores"))
        .withColumn("salts", salts)
        .select("chunk", "stores", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    return (
        skus.withColumn("n", n)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("salts", salts)
        .withColumn("salt", F.pmod(F.xxhash64("SKU"), F.col("salts")).cast("int"))
        .join(packs, ["chunk", "salt"])
        .select(F.explode("stores").alias("STORE"), "SKU")
    )


def with_attributes(df: DataFrame, sku_master: DataFrame) -> DataFrame:
    """STYLE, COLOR, SIZE from the master; for SKUs it lacks, read out of the code
    (first capital-led word, characters -5..-3, last two); blanks get defaults."""
    master = ps.one_per_key(sku_master.select("SKU", "STYLE", "COLOR", "SIZE"), "SKU")
    n = F.length("SKU")
    fifth = F.greatest(n - 5, F.lit(0))
    second = F.greatest(n - 2, F.lit(0))
    sku = F.col("SKU")
    word = F.regexp_extract("SKU", "([A-Z][A-Z0-9]+)", 1)
    unknown = F.col("STYLE").isNull()

    def filled(own: Column, read: Column, default: str) -> Column:
        return F.coalesce(F.nullif(F.when(unknown, read).otherwise(own), F.lit("")), F.lit(default))

    return df.join(master, "SKU", "left").withColumns(
        {
            "STYLE": F.upper(F.trim(filled(F.col("STYLE"), word, "UNKNOWN"))),
            "COLOR": filled(F.col("COLOR"), sku.substr(fifth + 1, second - fifth), "UNK"),
            "SIZE": filled(F.col("SIZE"), sku.substr(second + 1, F.lit(2)), "M"),
        }
    )


def with_gender(df: DataFrame, style_master: DataFrame | None) -> DataFrame:
    """GENDER of the style; styles outside the master become FREEBIES when their
    name gives them away, else UNKNOWN."""
    if style_master is None:
        return df.withColumn("GENDER", F.lit("UNKNOWN"))
    master = style_master.select(
        F.upper(F.trim("STYLE")).alias("STYLE"), F.upper(F.trim("GENDER")).alias("GENDER")
    )
    giveaway = F.upper("STYLE").rlike("|".join(FREEBIE_WORDS))
    return df.join(materialize(ps.one_per_key(master, "STYLE"), "genders"), "STYLE", "left").withColumn(
        "GENDER", F.coalesce("GENDER", F.when(giveaway, "FREEBIES").otherwise("UNKNOWN"))
    )


def sku_facts(
    skus: DataFrame, sku_master: DataFrame, warehouse: DataFrame, style_master: DataFrame | None = None
) -> DataFrame:
    """One row per SKU of `skus`: attributes, gender and warehouse stock. Built on the
    SKU dimension, so that the pairs are shuffled by SKU once and never by STYLE, where
    UNKNOWN may own much of them."""
    facts = with_gender(with_attributes(skus, sku_master), style_master)
    return facts.join(ps.warehouse_by_sku(warehouse), "SKU", "left").withColumn(
        "WAREHOUSE_STOCK", F.coalesce("WAREHOUSE_STOCK", F.lit(0.0))
    )


# --- forecast ----------------------------------------------------------------


def with_classes(df: DataFrame, p: ReplenishParams = ReplenishParams()) -> DataFrame:
    """ABC_CLASS on sales value (q0.9, q0.7) and VELOCITY_CLASS (q0.7, q0.3), or
    by fixed limits, as p.class_limits says. df should be a written table."""
    priced = "UNIT_PRICE" in df.columns
    price = F.col("UNIT_PRICE") if priced else F.lit(p.unit_price)
    df = df.withColumn("SALES_VALUE", F.col("DAILY_SALES") * price)
    # With one price for all, the limits of the value are those of the velocity times it.
    column = "SALES_VALUE" if priced else "DAILY_SALES"
    spec = {"medium": ("DAILY_SALES", 0.3), "fast": ("DAILY_SALES", 0.7), "b": (column, 0.7), "a": (column, 0.9)}
    cuts = F.lit(None) if p.class_limits == "fixed" else scalars(quantiles(df, spec, accuracy=p.quantile_accuracy, written=True))
    scale = 1.0 if priced else p.unit_price
    fixed = p.class_limits == "fixed"

    def cut(name: str, limit: float, scale: float = 1.0) -> Column:
        return F.lit(limit) if fixed else F.col(f"cuts.{name}") * scale

    value, speed = F.col("SALES_VALUE"), F.col("DAILY_SALES")
    abc = F.when(value >= cut("a", 200.0, scale), "A").when(value >= cut("b", 50.0, scale), "B").otherwise("C")
    vel = F.when(speed >= cut("fast", 0.5), "Fast").when(speed >= cut("medium", 0.1), "Medium").otherwise("Slow")
    return df.withColumn("cuts", cuts).withColumns({"ABC_CLASS": abc, "VELOCITY_CLASS": vel}).drop("cuts")


def seasonal_factor(day: Column) -> Column:
    return _lookup(F.month(day), SEASONAL_FACTORS, 1.0)


def forecast_multiplier(abc: Column, vel: Column, style: Column) -> Column:
    by_class = F.lit(1.0)
    for cls, row in FORECAST_MULTIPLIERS.items():
        by_class = F.when(abc == cls, _lookup(vel, row, 1.0)).otherwise(by_class)
    return by_class * category_factor(style)


def category_factor(style: Column) -> Column:
    return _lookup(F.substring(style, 1, 1), CATEGORY_FACTORS, 1.0)


def with_forecast(df: DataFrame, sales: DataFrame, p: ReplenishParams = ReplenishParams()) -> DataFrame:
    """FORECAST_DEMAND and each factor of it. The trend is 1, or the sales trend of
    the pair with trend="observed"."""
    if p.trend == "observed":
        trend = demand.simple_trend(sales, p.period_days, p.as_of)
        df = df.join(trend, ["STORE", "SKU"], "left").withColumn(
            "TREND_FACTOR", F.coalesce("TREND_FACTOR", F.lit(1.0))
        )
    else:
        df = df.withColumn("TREND_FACTOR", F.lit(1.0))
    empty = F.col("STOCK") == 0
    df = df.withColumns(
        {
            "SEASONAL_FACTOR": seasonal_factor(latest(sales, as_of=p.as_of)),
            "CATEGORY_FACTOR": category_factor(F.col("STYLE")),
            "FORECAST_MULTIPLIER": forecast_multiplier(
                F.col("ABC_CLASS"), F.col("VELOCITY_CLASS"), F.col("STYLE")
            ),
            "STOCKOUT_PENALTY": F.when(empty, 1.2).otherwise(1.0),
            "NEW_ITEM_BOOST": F.when(empty & (F.col("DAILY_SALES") == 0), 1.1).otherwise(1.0),
        }
    )
    return df.withColumn(
        "FORECAST_DEMAND",
        F.col("DAILY_SALES")
        * F.col("SEASONAL_FACTOR")
        * p.cover_days
        * F.col("FORECAST_MULTIPLIER")
        * F.col("TREND_FACTOR")
        * F.col("STOCKOUT_PENALTY")
        * F.col("NEW_ITEM_BOOST"),
    )


# --- allocation --------------------------------------------------------------


def with_importance(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "PRODUCT_IMPORTANCE",
        0.6 * _lookup(F.col("ABC_CLASS"), ABC_WEIGHTS, 0.4) + 0.4 * _lookup(F.col("VELOCITY_CLASS"), VELOCITY_WEIGHTS, 0.2),
    )


def store_scores(df: DataFrame) -> DataFrame:
    """ENHANCED_STORE_SCORE per store: 0.4 priority + 0.4 turn + 0.2 sales share."""
    per = df.groupBy("STORE").agg(
        stable(F.sum("DAILY_SALES"), 12).alias("sales"),
        F.sum("STOCK").alias("stock"),
        F.max("PRIORITY_SCORE").alias("priority"),
    )
    turn = F.when(F.col("stock") > 0, ratio(F.col("sales"), F.col("stock"))).otherwise(F.col("sales"))
    per = materialize(per.withColumn("turn", turn), "stores")
    top = scalars(per.agg(F.max("turn").alias("turn"), F.max("sales").alias("sales")))
    turn_top = F.when(F.col("top.turn") > 0, F.col("top.turn")).otherwise(1.0)
    return per.withColumn("top", top).select(
        "STORE",
        (
            0.4 * F.col("priority")
            + 0.4 * (F.col("turn") / turn_top)
            + 0.2 * ratio(F.col("sales"), F.col("top.sales"), 0)
        ).alias("ENHANCED_STORE_SCORE"),
    )


def size_set_bonus(df: DataFrame) -> DataFrame:
    """SIZE_SET_BONUS per (STORE, STYLE, COLOR) from the share of rows with stock and with
    sales. Written once, so that its size is known when it is joined to the rows."""
    rate = ratio(F.count_if(F.col("STOCK") > 0) + F.count_if(F.col("DAILY_SALES") > 0), F.count(F.lit(1)) * 2)
    bonus = F.when(F.col("rate") >= 0.7, 1.5).when(F.col("rate") >= 0.5, 1.2).otherwise(1.0)
    rates = df.groupBy("STORE", "STYLE", "COLOR").agg(rate.alias("rate"))
    return materialize(rates.select("STORE", "STYLE", "COLOR", bonus.alias("SIZE_SET_BONUS")), "bonus")


def allocate(df: DataFrame, p: ReplenishParams = ReplenishParams()) -> DataFrame:
    """Shortage: floor of the factor share of the warehouse stock; enough: the need."""
    have, need = F.col("WAREHOUSE_STOCK"), F.col("REPLEN_QTY")
    short = (F.col("TOTAL_DEMAND") > have) & (have > 0)
    factor = F.col("ENHANCED_STORE_SCORE") * F.col("PRODUCT_IMPORTANCE") * F.col("SIZE_SET_BONUS") * need
    enough = F.when(need > 0, F.greatest(F.lit(float(p.moq)), need)).otherwise(0.0)
    return (
        spread(df, "SKU").withColumn("TOTAL_DEMAND", F.sum("REPLEN_QTY").over(ps.per_sku()))
        .withColumn("ALLOC_FACTOR", F.when(short, factor))
        .withColumn(
            "FINAL_REPLEN_QTY",
            F.floor(F.when(have <= 0, 0.0).when(short, ps.share_of(F.col("ALLOC_FACTOR"), have)).otherwise(enough)).cast(
                "double"
            ),
        )
        .withColumn(
            "REMARKS", F.when(have <= 0, ps.NO_STOCK).when(short, "Warehouse stock insufficient").otherwise("")
        )
    )


# --- size sets ---------------------------------------------------------------


def size_sets(spark, size_master: DataFrame | None = None) -> DataFrame:
    """SIZE, SIZE_SET, MIN_SIZES_REQUIRED: the given master or the default sets."""
    if size_master is not None:
        return ps.one_per_key(size_master.select("SIZE", "SIZE_SET", "MIN_SIZES_REQUIRED"), "SIZE")
    rows = [(size, name, least) for name, (sizes, least) in DEFAULT_SIZE_SETS.items() for size in sizes]
    return spark.createDataFrame(rows, "SIZE string, SIZE_SET string, MIN_SIZES_REQUIRED int")


def _within_stock(pick: Column, want: Column) -> Column:
    """What each picked row gets of what the plan leaves of its SKU's warehouse stock: the
    stores' wants are served by priority until it is used up."""
    left = F.col("WAREHOUSE_STOCK") - F.sum("FINAL_REPLEN_QTY").over(ps.per_sku())
    line = ps.per_sku().orderBy(F.desc_nulls_last("PRIORITY_SCORE"), "STORE").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(pick, want).otherwise(0.0)).over(line), F.lit(0.0))
    return F.when(pick, F.greatest(F.lit(0.0), F.least(want, left - before))).otherwise(0.0)


def complete_sizes(df: DataFrame, sets: DataFrame, p: ReplenishParams = ReplenishParams()) -> DataFrame:
    """First completion pass: the MOQ for rows that got nothing though the warehouse
    has stock, in high-priority stores ("simple": > 0.7; "full": > 0.5 and a size
    that belongs to a set). With `cap_to_warehouse` no more than the warehouse has left
    for all stores of the SKU, by priority."""
    df = df.withColumn("SIZE_SET_ALLOCATION", F.lit(0.0))
    if p.completion == "none":
        return df
    idle = (F.col("FINAL_REPLEN_QTY") == 0) & (F.col("WAREHOUSE_STOCK") > 0)
    if p.completion == "simple":
        pick, remark = idle & (F.col("PRIORITY_SCORE") > 0.7), "High priority size completion"
    else:
        known = sets.select("SIZE", F.lit(True).alias("in_set")).distinct()
        df = df.join(known, "SIZE", "left")
        pick = idle & (F.col("PRIORITY_SCORE") > 0.5) & F.coalesce("in_set", F.lit(False))
        remark = "Priority size completion"
    moq = F.lit(float(p.moq))
    if p.cap_to_warehouse:
        df = df.withColumn("pick", pick).withColumn("granted", _within_stock(F.col("pick"), moq))
        pick, moq = F.col("granted") > 0, F.col("granted")
    return (
        df.withColumn("pick", pick)
        .withColumn("FINAL_REPLEN_QTY", F.when(F.col("pick"), moq).otherwise(F.col("FINAL_REPLEN_QTY")))
        .withColumn("SIZE_SET_ALLOCATION", F.when(F.col("pick"), moq).otherwise(F.col("SIZE_SET_ALLOCATION")))
        .withColumn("REMARKS", F.when(F.col("pick"), remark).otherwise(F.col("REMARKS")))
        .drop("pick", "in_set", "granted")
    )


def _size_level(df: DataFrame) -> DataFrame:
    """(STORE, STYLE, COLOR, SIZE) -> stocked: in stock or about to be."""
    covered = (F.col("STOCK") > 0) | (F.col("FINAL_REPLEN_QTY") > 0)
    return df.groupBy("STORE", "STYLE", "COLOR", "SIZE").agg(F.bool_or(covered).alias("stocked"))


def set_analysis(df: DataFrame) -> DataFrame:
    """Completeness of every (STORE, STYLE, COLOR)."""
    total, stocked = F.count(F.lit(1)), F.count_if(F.col("stocked"))
    plus = F.bool_or(F.col("SIZE").isin(PLUS_SIZES))
    return (
        _size_level(df)
        .groupBy("STORE", "STYLE", "COLOR")
        .agg(
            total.alias("TOTAL_SIZES"),
            stocked.alias("SIZES_WITH_INVENTORY"),
            (total - stocked).alias("MISSING_SIZES"),
            F.sort_array(F.collect_list(F.when(~F.col("stocked"), F.col("SIZE")))).alias("MISSING_SIZE_LIST"),
            plus.alias("IS_PLUS_COMBO"),
        )
        .withColumn("MIN_REQUIRED", F.when(F.col("IS_PLUS_COMBO"), 3).otherwise(4))
        .withColumn("IS_COMPLETE", F.col("SIZES_WITH_INVENTORY") >= F.col("MIN_REQUIRED"))
        .withColumn("COMPLETENESS_RATIO", F.col("SIZES_WITH_INVENTORY") / F.greatest(F.lit(1), F.col("TOTAL_SIZES")))
    )


def complete_sets(df: DataFrame, p: ReplenishParams = ReplenishParams()) -> DataFrame:
    """Second pass: min(MOQ, warehouse) for the missing sizes of incomplete sets; with
    `cap_to_warehouse` min(MOQ, what the warehouse has left for all stores of the SKU), by
    priority. df should be a written table. The gaps are written once, so that their size
    is known when they are joined to the rows."""
    keys = ["STORE", "STYLE", "COLOR"]
    sizes = _size_level(df)
    least = F.when(F.bool_or(F.col("SIZE").isin(PLUS_SIZES)), 3).otherwise(4)
    open_sets = (
        sizes.groupBy(*keys)
        .agg(F.count_if("stocked").alias("have"), least.alias("least"))
        .where(F.col("have") < F.col("least"))
        .select(*keys)
    )
    gaps = sizes.where(~F.col("stocked")).join(open_sets, keys, "left_semi").select(
        *keys, "SIZE", F.lit(True).alias("gap")
    )
    gaps = materialize(gaps, "gaps")
    pick = F.coalesce("gap", F.lit(False)) & (F.col("WAREHOUSE_STOCK") > 0) & (F.col("FINAL_REPLEN_QTY") == 0)
    df = df.join(gaps, [*keys, "SIZE"], "left")
    want = F.least(F.lit(float(p.moq)), F.col("WAREHOUSE_STOCK"))
    if p.cap_to_warehouse:
        df = spread(df, "SKU").withColumn("pick", pick).withColumn("granted", _within_stock(F.col("pick"), want))
        pick, want = F.col("granted") > 0, F.col("granted")
    return (
        df.withColumn("pick", pick)
        .withColumn("FINAL_REPLEN_QTY", F.when(F.col("pick"), want).otherwise(F.col("FINAL_REPLEN_QTY")))
        .withColumn("SIZE_SET_ALLOCATION", F.when(F.col("pick"), 1.0).otherwise(F.col("SIZE_SET_ALLOCATION")))
        .withColumn(
            "REMARKS",
            F.when(F.col("pick"), F.concat("REMARKS", F.lit("; Size set completion"))).otherwise(F.col("REMARKS")),
        )
        .drop("pick", "gap", "granted")
    )


def set_status(df: DataFrame) -> DataFrame:
    """One row: complete and incomplete sets."""
    return set_analysis(df).agg(
        F.count_if("IS_COMPLETE").alias("complete_sets"), F.count_if(~F.col("IS_COMPLETE")).alias("incomplete_sets")
    )


# --- closing filter ----------------------------------------------------------


def drop_cause(p: ReplenishParams = ReplenishParams()) -> Column:
    """Why a row leaves the plan, NULL when it stays."""
    gender = F.upper(F.trim("GENDER"))
    style = F.upper(F.trim("STYLE"))
    return (
        F.when(gender.contains("FREEBIE"), "FREEBIES")
        .when((gender == "UNISEX") & ~style.isin(*p.exception_styles), "UNISEX")
        .when((gender == "UNKNOWN") & style.rlike("|".join(FINAL_FREEBIE_WORDS)), "UNKNOWN FREEBIES")
    )


def final_filter(df: DataFrame, p: ReplenishParams = ReplenishParams()) -> DataFrame:
    return df.where(drop_cause(p).isNull())


def removal_counts(df: DataFrame, p: ReplenishParams = ReplenishParams()) -> DataFrame:
    """One row: rows removed by cause, and rows kept."""
    cause = drop_cause(p)
    return df.agg(
        F.count_if(cause == "FREEBIES").alias("freebies"),
        F.count_if(cause == "UNISEX").alias("unisex"),
        F.count_if(cause == "UNKNOWN FREEBIES").alias("unknown_freebies"),
        F.count_if(cause.isNull()).alias("kept"),
    )
