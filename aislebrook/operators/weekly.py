"""Weekly demand forecast and reorder recommendations per SKU."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, scalars, stable, stable_ceil, week_start

# Service level and its z score.
Z_TABLE = {0.8: 0.841, 0.85: 1.036, 0.9: 1.282, 0.95: 1.645, 0.975: 1.96, 0.98: 2.054, 0.99: 2.326}


def z_value(level: float) -> float:
    """z of a service level: the table, linear in between, held at its ends."""
    known = sorted(Z_TABLE)
    if level <= known[0]:
        return Z_TABLE[known[0]]
    if level >= known[-1]:
        return Z_TABLE[known[-1]]
    upper = next(k for k in known if k >= level)
    if upper == level:
        return Z_TABLE[upper]
    lower = known[known.index(upper) - 1]
    part = (level - lower) / (upper - lower)
    return Z_TABLE[lower] + part * (Z_TABLE[upper] - Z_TABLE[lower])


def weekly_forecast(
    df: DataFrame,
    horizon_weeks: int = 12,
    history_weeks: int = 26,
    alpha: float = 0.3,
    key: str = "SKU",
) -> DataFrame:
    """Mean, spread, EWMA, 4-week mean and blended forecast of weekly units, from each
    SKU's first week within the history to the newest week of all.

    Weeks without sales add nothing to any of the sums, so they are counted but not
    generated.  The EWMA weighs week i with alpha (1 - alpha)^age; the first week
    carries the whole remaining weight (1 - alpha)^(n - 1).
    """
    dated = df.where(F.col("BILL_DATE").isNotNull() & F.col(key).isNotNull())
    last = scalars(dated.agg(F.max("BILL_DATE").alias("d")).select(week_start("d").alias("w")))["w"]
    # The filter on the raw date reaches the scan; whole weeks after the cutoff stay.
    recent = dated.where(F.col("BILL_DATE") >= F.date_add(last, -7 * (history_weeks - 1)))
    weekly = recent.groupBy(key, week_start("BILL_DATE").alias("week")).agg(F.sum("BILL_QUANTITY").alias("x"))
    weekly = weekly.withColumn("age", (F.datediff(last, F.col("week")) / 7).cast("int"))
    x, age, keep = F.col("x").cast("double"), F.col("age"), F.lit(1 - alpha)
    per = weekly.groupBy(key).agg(
        (F.max("age") + 1).alias("n"),
        F.sum(x).alias("s"),
        F.sum(x * x).alias("ss"),
        F.sum(F.lit(alpha) * F.pow(keep, age) * x).alias("decayed"),
        F.max_by(x, age).alias("first"),
        F.coalesce(F.sum(F.when(age < 4, x)), F.lit(0.0)).alias("s4"),
    )
    n = F.col("n").cast("double")
    mean = F.col("s") / n
    return (
        per.withColumn("mean_weekly", stable(mean, 12))
        .withColumn("std_weekly", stable(F.sqrt(F.greatest(F.col("ss") / n - mean * mean, F.lit(0.0))), 12))
        .withColumn("cv_weekly", ratio(F.col("std_weekly"), F.col("mean_weekly")))
        .withColumn("ewma_weekly", stable(F.col("decayed") + F.col("first") * F.pow(keep, n), 12))
        .withColumn("sma4_weekly", F.col("s4") / F.least(n, F.lit(4.0)))
        .withColumn("forecast_weekly", 0.6 * F.col("ewma_weekly") + 0.4 * F.col("sma4_weekly"))
        .withColumn("forecast_horizon_units", F.col("forecast_weekly") * horizon_weeks)
        .select(
            key,
            "mean_weekly",
            "std_weekly",
            "cv_weekly",
            "ewma_weekly",
            "sma4_weekly",
            "forecast_weekly",
            F.col("n").cast("long").alias("history_weeks"),
            "forecast_horizon_units",
        )
    )


def reorder_recommendations(
    forecast: DataFrame, lead_weeks: int = 4, service_level: float = 0.95, cover_weeks: int = 12
) -> DataFrame:
    """Safety stock, reorder point and order-up-to level in whole units, and a priority."""
    f = F.col("forecast_weekly")
    safety = F.col("std_weekly") * (lead_weeks**0.5) * z_value(service_level)

    def units(c):
        return F.coalesce(stable_ceil(c), F.lit(0.0)).cast("long")

    return (
        forecast.withColumn("safety_stock_units", units(safety))
        .withColumn("reorder_point_units", units(f * lead_weeks + safety))
        .withColumn("order_up_to_units", units(f * cover_weeks + safety))
        .withColumn(
            "priority_score", F.col("forecast_horizon_units") * (1 + F.coalesce("cv_weekly", F.lit(0.0)))
        )
        .orderBy(F.desc("priority_score"), F.asc(forecast.columns[0]))
    )

