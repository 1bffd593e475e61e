"""Merchandising KPIs on bill lines: style metrics, size concentration, reason flags,
monthly series, top lists, daily run rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import month_of, quantiles, ratio, rolling_sum, scalars, stable, with_dense_rank_desc
from ..sources.scratch import materialize


def money(col: str | Column) -> Column:
    """Exact sum of an amount, as a double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(c.cast("decimal(18,4)")), F.lit(0).cast("decimal(18,4)")).cast("double")


def style_kpis(df: DataFrame, group_cols: tuple[str, ...] = ("STYLE",), within: tuple[str, ...] = ()) -> DataFrame:
    """Units, revenue, prices, voids, weeks on sale, velocity, unit share and dense
    revenue rank per group; share and rank are taken within the `within` columns."""
    keys = [*within, *group_cols]
    gross = "GROSS_AMOUNT" if "GROSS_AMOUNT" in df.columns else "NET_AMOUNT"
    promo = money("PROMO_AMOUNT") if "PROMO_AMOUNT" in df.columns else F.lit(0.0)
    voids = F.count_if(F.col("VOID_STATUS") == "Y") if "VOID_STATUS" in df.columns else F.lit(0).cast("long")
    keyed = df
    for k in keys:
        keyed = keyed.where(F.col(k).isNotNull())
    agg = keyed.groupBy(*keys).agg(
        F.sum("BILL_QUANTITY").alias("units_sold"),
        money("NET_AMOUNT").alias("revenue"),
        money(gross).alias("gross_amount"),
        stable(F.avg(F.when(F.col("RSP") > 0, F.col("RSP"))), 12).alias("avg_rsp"),
        money("ITEM_DISCOUNT_AMOUNT").alias("avg_item_discount"),
        promo.alias("promo_amount"),
        voids.alias("void_count"),
        F.min("BILL_DATE").alias("first_sale"),
        F.max("BILL_DATE").alias("last_sale"),
    )
    agg = agg.withColumns(
        {
            "avg_price": ratio(F.col("revenue"), F.col("units_sold")),
            "avg_item_discount_per_unit": ratio(F.col("avg_item_discount"), F.col("units_sold")),
            "weeks_on_sale": F.greatest(F.datediff("last_sale", "first_sale") / 7, F.lit(1.0)),
        }
    ).withColumn("velocity_units_per_week", ratio(F.col("units_sold"), F.col("weeks_on_sale")))
    agg = materialize(agg, "kpis")
    if within:
        totals = agg.groupBy(*within).agg(F.sum("units_sold").alias("total"))
        agg = agg.join(totals, list(within))
    else:
        agg = agg.withColumn("total", scalars(agg.agg(F.sum("units_sold").alias("t")))["t"])
    agg = agg.withColumn("share_of_units_pct", ratio(F.col("units_sold"), F.col("total")) * 100).drop("total")
    return with_dense_rank_desc(agg, "revenue", "revenue_rank", within)


def size_hhi(df: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Herfindahl index of the size mix and number of sizes per style."""
    keys = [*within, "STYLE"]
    sizes = (
        df.where(F.col("STYLE").isNotNull() & F.col("SIZE").isNotNull())
        .groupBy(*keys, "SIZE")
        .agg(F.sum("BILL_QUANTITY").alias("q"))
    )
    total = F.sum("q")
    hhi = F.when(total > 0, ratio(F.sum(F.col("q") * F.col("q")), total * total)).otherwise(0.0)
    return sizes.groupBy(*keys).agg(hhi.alias("size_hhi"), F.count("SIZE").alias("unique_sizes"))


def reason_flags(kpis: DataFrame, hhi: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Flags for slow, heavily discounted, size-concentrated and often voided styles,
    against medians over the styles (per `within`)."""
    within = list(within)
    df = kpis.join(hhi, [*within, "STYLE"], "left").withColumn(
        "discount_pct", ratio(F.col("avg_item_discount_per_unit"), F.col("avg_price"))
    )
    df = materialize(df, "flags")
    medians = {
        "med_velocity": ("velocity_units_per_week", 0.5),
        "med_discount": ("discount_pct", 0.5),
        "med_hhi": ("size_hhi", 0.5),
    }
    limits = quantiles(df, medians, within, written=True)
    if within:
        spread = df.groupBy(*within).agg(F.stddev_pop("velocity_units_per_week").alias("sd"))
        df = df.join(limits, within).join(spread, within)
    else:
        spread = df.agg(F.stddev_pop("velocity_units_per_week").alias("sd"))
        df = df.withColumn("lim", scalars(limits)).withColumn("sd", scalars(spread)["sd"])
        df = df.select("*", *[F.col(f"lim.{m}").alias(m) for m in medians]).drop("lim")
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "flag_low_velocity": F.coalesce(
                F.col("velocity_units_per_week") < F.greatest(F.lit(1.0), F.col("med_velocity") - F.col("sd")), F.lit(False)
            ),
            "flag_high_discount_pct": F.coalesce("discount_pct", zero)
            > F.greatest(F.lit(0.05), F.col("med_discount") * 1.5),
            "flag_high_size_concentration": F.coalesce("size_hhi", zero)
            > F.greatest(F.lit(0.2), F.col("med_hhi") * 1.2),
            "void_rate": ratio(F.col("void_count"), F.col("units_sold")),
        }
    ).withColumn("flag_high_void_rate", F.coalesce(F.col("void_rate") > 0.02, F.lit(False)))
    text = F.concat_ws(
        ",",
        F.when(F.col("flag_low_velocity"), "low_velocity"),
        F.when(F.col("flag_high_discount_pct"), "high_discount"),
        F.when(F.col("flag_high_size_concentration"), "size_concentration"),
        F.when(F.col("flag_high_void_rate"), "high_voids"),
    )
    return df.withColumn("reasons_flags", F.when(text == "", "none").otherwise(text)).drop(
        "discount_pct", "sd", *medians
    )


def monthly_series(df: DataFrame) -> DataFrame:
    """Units and revenue per style and month."""
    return (
        df.where(F.col("STYLE").isNotNull())
        .groupBy("STYLE", month_of("BILL_DATE").alias("month"))
        .agg(F.sum("BILL_QUANTITY").alias("units_sold"), money("NET_AMOUNT").alias("revenue"))
    )


def monthly_pivot(series: DataFrame, styles: list[str], other: str = "OTHER") -> DataFrame:
    """Month x style units with 0 where nothing sold: a column for each given style and
    one, `other`, for all the rest."""
    columns = [*styles, other]
    name = F.when(F.col("STYLE").isin(styles), F.col("STYLE")).otherwise(other)
    return series.withColumn("STYLE", name).groupBy("month").pivot("STYLE", columns).sum("units_sold").na.fill(0.0, columns)


def first_sale(sales: DataFrame, date_col: str = "BILL_DATE") -> DataFrame:
    return (
        sales.where(F.col(date_col).isNotNull() & F.col("STYLE").isNotNull())
        .groupBy("STYLE")
        .agg(F.min(date_col).alias("first_sale_date"))
    )


def with_launch_flag(df: DataFrame, first: DataFrame, start) -> DataFrame:
    launched = F.col("first_sale_date") >= F.lit(start).cast("date")
    return df.join(first, "STYLE", "left").withColumn("launched_after", F.coalesce(launched, F.lit(False)))


def by_attribute(df: DataFrame, column: str) -> DataFrame:
    """Units, revenue and average price per DEPARTMENT, CATEGORY or the like."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.sum("BILL_QUANTITY").alias("units_sold"), money("NET_AMOUNT").alias("revenue"))
        .withColumn("avg_price", ratio(F.col("revenue"), F.col("units_sold")))
        .orderBy(F.desc("revenue"), column)
    )


def top_lists(df: DataFrame, n: int = 50) -> dict[str, DataFrame]:
    """Top styles and SKUs by units, revenue and average selling price."""
    out = {}
    for key, tag in (("STYLE", "styles"), ("SKU", "skus")):
        agg = (
            df.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(
                F.sum("BILL_QUANTITY").alias("units_sold"),
                money("NET_AMOUNT").alias("revenue"),
                stable(F.avg("RSP")).alias("avg_price"),
            )
            .withColumn("asp", ratio(F.col("revenue"), F.col("units_sold")))
        )
        for metric, name in (("units_sold", "units"), ("revenue", "revenue"), ("asp", "asp")):
            out[f"top_{tag}_by_{name}"] = agg.orderBy(F.desc_nulls_last(metric), key).limit(n)
    return out


def style_daily(df: DataFrame) -> DataFrame:
    """Selling days, median daily units over the whole span, longest run of days
    without sales, and the best day, 7 days and calendar month per style.

    Days without sales are counted, not generated: the per-style arrays hold one
    number per selling day and so never exceed the calendar.
    """
    daily = (
        df.where(F.col("STYLE").isNotNull() & F.col("BILL_DATE").isNotNull())
        .groupBy("STYLE", "BILL_DATE")
        .agg(F.sum("BILL_QUANTITY").alias("units"))
    )
    in_month = Window.partitionBy("STYLE", F.trunc("BILL_DATE", "MM"))
    rows = rolling_sum(daily, ["STYLE"], "BILL_DATE", "units", "week_units").withColumn(
        "month_units", F.sum("units").over(in_month)
    )
    day = F.unix_date("BILL_DATE")
    per = rows.groupBy("STYLE").agg(
        F.min("BILL_DATE").alias("first_sale"),
        F.max("BILL_DATE").alias("last_sale"),
        F.sort_array(F.collect_list("units")).alias("sold"),
        F.sort_array(F.collect_list(F.when(F.col("units") != 0, day))).alias("days"),
        F.max("units").alias("max_daily_run_rate"),
        F.max("week_units").alias("max_weekly_run_rate"),
        F.max("month_units").alias("max_monthly_run_rate"),
    )
    span = F.datediff("last_sale", "first_sale") + 1
    blank = F.col("days_between") - F.size("sold")
    negative = F.size(F.filter("sold", lambda x: x < 0))

    def padded(k: Column) -> Column:
        """k-th smallest (from 0) of the daily units with `blank` zeros put in."""
        at = F.when(k < negative, k).otherwise(k - blank)
        return F.when((k >= negative) & (k < negative + blank), 0.0).otherwise(
            F.try_element_at("sold", (at + 1).cast("int"))
        )

    n = F.col("days_between")
    per = per.withColumn("days_between", span).withColumn(
        "median_daily_sales", (padded(F.floor((n - 1) / 2)) + padded(F.floor(n / 2))) / 2
    )
    marks = F.concat(F.array(F.unix_date("first_sale") - 1), "days", F.array(F.unix_date("last_sale") + 1))
    gaps = F.zip_with(
        F.slice("marks", 1, F.size("marks") - 1), F.slice("marks", 2, F.size("marks") - 1), lambda a, b: b - a - 1
    )
    median = F.col("median_daily_sales")
    above = F.size(F.filter("sold", lambda x: x > F.col("median_daily_sales"))) + F.when(median < 0, blank).otherwise(0)
    with_sales = F.size(F.filter("sold", lambda x: x > 0))
    without = F.size(F.filter("sold", lambda x: x == 0)) + blank
    return (
        per.withColumn("marks", marks)
        .withColumn("days_with_sales", with_sales)
        .withColumn("days_without_sales", without)
        .withColumn("days_above_median", above)
        .withColumn("longest_zero_gap_days", F.array_max(gaps))
        .drop("sold", "days", "marks")
    )


def monthly_key_styles(df: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Per month the top styles by revenue and by units, with category and department."""
    meta = (
        df.where(F.col("STYLE").isNotNull())
        .groupBy("STYLE")
        .agg(*[F.min(c).alias(c) for c in ("CATEGORY", "DEPARTMENT") if c in df.columns])
    )
    series = monthly_series(df)
    out = {}
    for name, metric in (("by_revenue", "revenue"), ("by_units", "units_sold")):
        best = Window.partitionBy("month").orderBy(F.desc(metric), F.asc("STYLE"))
        out[name] = (
            series.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).join(meta, "STYLE", "left")
        )
    return out


def gender_summary(df: DataFrame, genders: tuple[str, ...] = ("WOMEN", "BOYS"), column: str = "GENDER") -> DataFrame:
    """KPIs, size mix and reason flags of every style within its gender."""
    mine = df.withColumn("GENDER", F.upper(F.trim(column))).where(F.col("GENDER").isin(*genders))
    by = ("GENDER",)
    return reason_flags(style_kpis(mine, ("STYLE",), by), size_hhi(mine, by), by)


def revenue_extremes(flagged: DataFrame, n: int = 20) -> DataFrame:
    """The best and worst styles by revenue within every gender."""
    out = None
    for name, order in (("top", F.desc("revenue")), ("bottom", F.asc("revenue"))):
        w = Window.partitionBy("GENDER").orderBy(order, F.asc("STYLE"))
        part = flagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        part = part.select(F.lit(name).alias("list"), "GENDER", "rank", "STYLE", "revenue", "units_sold", "reasons_flags")
        out = part if out is None else out.unionByName(part)
    return out


def gender_totals(kpis: DataFrame) -> DataFrame:
    return kpis.groupBy("GENDER").agg(
        F.count(F.lit(1)).alias("total_styles"),
        F.sum("units_sold").alias("total_units"),
        F.sum(F.col("revenue").cast("decimal(24,4)")).cast("double").alias("total_revenue"),
    )
