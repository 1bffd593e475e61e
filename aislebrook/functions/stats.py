"""Distributed exact statistics.

Global figures reach other rows through one-row scalar subqueries, never through
a cross join.  Quantiles bracket each wanted position by a mergeable sketch and then
count, in one exact pass, what lies below the bracket and every value inside.  Ranks,
which need every value, collapse equal values to (value, count) and write that table
once; the values are then placed into as many range buckets as their number asks for, so
a value held by a third of the rows is one row and no task orders the whole column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

# Distinct values that one task orders.
BUCKET_VALUES = 1 << 16
# Accuracy of the sketch that brackets a quantile: 4 / SKETCH of the values are inside.
SKETCH = 10_000


def scalars(one_row: DataFrame) -> Column:
    """A one-row DataFrame as a struct column usable on any other DataFrame."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def stable(col: Column, digits: int = 6) -> Column:
    """Drop the last bits of a float, which depend on the order of summation."""
    return F.round(col, digits)


def stable_ceil(col: Column) -> Column:
    return F.ceil(stable(col)).cast("double")


def stable_floor(col: Column) -> Column:
    return F.floor(stable(col)).cast("double")


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den; NULL (or default) when den is 0 or NULL."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def _placed_values(df: DataFrame, columns: list[str], keys: list[str], bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """keys, __m (index of the column), __v, __n (rows with that value) and __b, the
    range bucket of __v. NULL and NaN are left out."""
    cells = [F.struct(F.lit(i).alias("__m"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(columns)]
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("__cell")).select(*keys, "__cell.*")
    counts = materialize(
        rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .groupBy(*keys, "__m", "__v")
        .agg(F.count(F.lit(1)).alias("__n")),
        "values",
    )
    # Two levels of `fan` splits each.
    fan = math.ceil(math.sqrt(counts.count() / bucket_values))
    if fan <= 1:
        return counts.withColumn("__b", F.lit(0))
    n = fan * fan
    fine = F.percentile_approx("__v", [i / n for i in range(1, n)], 10 * n)
    splits = scalars(
        counts.agg(fine.alias("fine")).select(
            "fine", F.filter("fine", lambda _, i: (i + 1) % fan == 0).alias("coarse")
        )
    )
    block = F.size(F.filter("__s.coarse", lambda s: s < F.col("__v")))
    near = F.slice("__s.fine", F.col("__c") * fan + 1, F.lit(fan))
    inner = F.size(F.filter(near, lambda s: s < F.col("__v")))
    return (
        counts.withColumn("__s", splits)
        .withColumn("__c", block)
        .withColumn("__b", F.col("__c") * fan + inner)
        .drop("__s", "__c")
    )


def _bucket_totals(placed: DataFrame, by: list[str]) -> DataFrame:
    """Per (by, bucket): rows and distinct values before it, and in the whole group."""
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy(*by, "__b")
        .agg(F.sum("__n").alias("__bn"), F.count(F.lit(1)).alias("__bd"))
        .select(
            *by,
            "__b",
            "__bn",
            F.coalesce(F.sum("__bn").over(before), F.lit(0)).alias("__before"),
            F.coalesce(F.sum("__bd").over(before), F.lit(0)).alias("__dbefore"),
            F.sum("__bn").over(whole).alias("__total"),
            F.sum("__bd").over(whole).alias("__distinct"),
        )
    )


def value_ranks(df: DataFrame, columns: list[str], keys: list[str], bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """by = keys + __m; per value: __below rows and __dbelow distinct values that are
    smaller, __total rows and __distinct values of the group."""
    by = [*keys, "__m"]
    placed = _placed_values(df, columns, keys, bucket_values)
    totals = _bucket_totals(placed, by)
    inside = Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(totals, [*by, "__b"]).select(
        *by,
        "__v",
        "__n",
        (F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).alias("__below"),
        (F.col("__dbefore") + F.count("__n").over(inside)).alias("__dbelow"),
        "__total",
        "__distinct",
    )


def _join_ranks(df: DataFrame, ranked: DataFrame, columns: dict[str, str], keys: list[str], value: Column) -> DataFrame:
    """df with a result per column. Several columns are melted to one row per column, meet
    their ranks in one join on (column, value), and come together again by row."""
    found = ranked.select(*[F.col(k).alias(f"__{k}") for k in keys], "__m", F.col("__v").alias("__value"), value.alias("__out"))
    if len(columns) == 1:
        ((column, out),) = columns.items()
        on = [df[k] == found[f"__{k}"] for k in keys] + [df[column].cast("double") == found["__value"]]
        return df.join(found, on, "left").drop("__m", "__value", *[f"__{k}" for k in keys]).withColumnRenamed("__out", out)
    row = F.struct(*df.columns)
    cells = [
        F.struct(F.lit(i).alias("__m"), F.col(c).cast("double").alias("__v"), (row if i == 0 else F.lit(None)).alias("__whole"))
        for i, c in enumerate(columns)
    ]
    melted = df.withColumn("__row", F.monotonically_increasing_id()).select("__row", *keys, F.explode(F.array(*cells)).alias("__cell"))
    melted = melted.select("__row", *keys, "__cell.*").withColumnRenamed("__m", "__of")
    on = [melted[k] == found[f"__{k}"] for k in keys] + [melted["__of"] == found["__m"], melted["__v"] == found["__value"]]
    results = [F.max(F.when(F.col("__of") == i, F.col("__out"))).alias(f"__out{i}") for i in range(len(columns))]
    back = melted.join(found, on, "left").groupBy("__row").agg(F.first("__whole", ignorenulls=True).alias("__whole"), *results)
    return back.select("__whole.*", *[F.col(f"__out{i}").alias(out) for i, out in enumerate(columns.values())])


def with_percent_ranks(
    df: DataFrame, columns: dict[str, str], *, keys: list[str] | tuple = (), constant: float | None = None
) -> DataFrame:
    """Add average-tie percent ranks in (0, 1], {column: result}; `constant` is the
    result where all values are equal. df should be a written table."""
    pct = (F.col("__below") + (F.col("__n") + 1) / 2) / F.col("__total")
    if constant is not None:
        pct = F.when(F.col("__distinct") == 1, F.lit(float(constant))).otherwise(pct)
    return _join_ranks(df, value_ranks(df, list(columns), list(keys)), columns, list(keys), pct)


def with_dense_rank_desc(df: DataFrame, column: str, out: str, keys: list[str] | tuple = ()) -> DataFrame:
    """Add the dense rank of column, largest first. df should be a written table."""
    rank = (F.col("__distinct") - F.col("__dbelow")).cast("long")
    return _join_ranks(df, value_ranks(df, [column], list(keys)), {column: out}, list(keys), rank)


def quantiles(
    df: DataFrame,
    spec: dict[str, tuple[str, float]],
    keys: list[str] | tuple = (),
    count_as: str | None = None,
    accuracy: int | None = None,
    written: bool = False,
    sketch: int = SKETCH,
) -> DataFrame:
    """Exact, linearly interpolated quantiles, {result: (column, probability)}, per key.

    The columns are read twice: once for the sketch that brackets the positions, once to
    count the rows below each bracket and the values inside, which alone are shuffled, one
    row per value. They are written in between unless df is a `written` table. `count_as`
    adds the number of values of the first column.  With `accuracy` the quantiles are
    approximate, in one pass, and not interpolated.  NULL and NaN values and NULL keys are
    left out.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in spec.values()))
    if accuracy is not None:
        aggs = [F.percentile_approx(F.col(c).cast("double"), p, accuracy).alias(out) for out, (c, p) in spec.items()]
        return df.groupBy(*keys).agg(*aggs, *([F.count(columns[0]).alias(count_as)] if count_as else []))
    values = [F.col(c).cast("double") for c in columns]
    rows = df.select(*keys, *[F.when(~F.isnan(v), v).alias(f"__v{i}") for i, v in enumerate(values)])
    if not written:
        rows = materialize(rows, "columns")
    places = [(f"__v{columns.index(c)}", float(p)) for c, p in spec.values()]
    ends = [
        F.percentile_approx(v, [max(0.0, p - 2 / sketch), min(1.0, p + 2 / sketch)], sketch).alias(f"__e{j}")
        for j, (v, p) in enumerate(places)
    ]
    brackets = rows.groupBy(*keys).agg(*ends)
    if keys:
        known = brackets.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*[f"__e{j}" for j in range(len(places))]).alias("__ends"))
        placed = rows.join(known, [rows[k] == known[f"__{k}"] for k in keys])
    else:
        placed = rows.withColumn("__ends", scalars(brackets))

    def cell(j: int, v: Column, low: Column, high: Column) -> Column:
        zone = F.when(v < low, -1).when(v > high, 1).when(v.isNotNull(), 0)
        return F.struct(F.lit(j).alias("j"), zone.alias("zone"), v.alias("v"))

    cells = [cell(j, F.col(v), F.col(f"__ends.__e{j}")[0], F.col(f"__ends.__e{j}")[1]) for j, (v, _) in enumerate(places)]
    cells = placed.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*").where("zone IS NOT NULL")
    counts = cells.groupBy(*keys, "j", "zone", F.when(F.col("zone") == 0, F.col("v")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    group = Window.partitionBy(*keys, "j")
    below = F.coalesce(F.sum("n").over(group.orderBy("zone", "value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("below", below).withColumn("total", F.sum("n").over(group))

    def at(k: Column) -> Column:
        """The value at place k: inside the bracket, or the nearest one outside it."""
        here = (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        nearest = F.when((F.col("zone") < 0) & (k == F.col("below") + F.col("n") - 1), F.col("most"))
        nearest = nearest.when((F.col("zone") > 0) & (k == F.col("below")), F.col("least"))
        found = F.when(F.col("zone") == 0, F.col("value")).otherwise(F.coalesce(nearest, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))
        return F.when(here, found)

    aggs = []
    for j, (_, p) in enumerate(places):
        pos = F.lit(p) * (F.col("total") - 1)
        mine = F.col("j") == j
        aggs.append(F.max(F.when(mine, at(F.floor(pos)))).alias(f"__lo{j}"))
        aggs.append(F.max(F.when(mine, at(F.ceil(pos)))).alias(f"__hi{j}"))
        aggs.append(F.max(F.when(mine, pos - F.floor(pos))).alias(f"__part{j}"))
    first = next(j for j, (v, _) in enumerate(places) if v == "__v0")
    found = counts.groupBy(*keys).agg(F.max(F.when(F.col("j") == first, F.col("total"))).alias("__count"), *aggs)
    cols = [
        (F.col(f"__lo{j}") + (F.col(f"__hi{j}") - F.col(f"__lo{j}")) * F.col(f"__part{j}")).alias(o) for j, o in enumerate(spec)
    ]
    if count_as:
        cols.append(F.coalesce(F.col("__count"), F.lit(0)).alias(count_as))
    return found.select(*keys, *cols)


def longest_gap(day: Column) -> Column:
    """An aggregate: the longest run of days without a row between the first and the last
    one; NULL without days. Its state is the set of days, which partial aggregates
    share and merge and which the calendar bounds."""
    days = F.sort_array(F.collect_set(F.unix_date(day)))
    return F.array_max(F.transform(days, lambda d, i: F.when(i > 0, d - F.get(days, i - 1) - 1).otherwise(0)))


def rolling_sum(df: DataFrame, keys: list[str], day: str, value: str, out: str, width: int = 7, chunk_days: int = 90) -> DataFrame:
    """df, one row per key and day, with the sum of `value` over the `width` days up to each;
    rows without a day are left out.

    Time is cut into chunks, and the last days of each are lent to the next one: windows
    are over (key, chunk), so that a key that owns much of the table is cut as well."""
    d = F.unix_date(F.col(day))
    chunk = F.floor(d / chunk_days).cast("int")
    # A chunk shorter than the window lends its days to several others.
    reach = F.sequence(chunk, F.floor((d + width - 1) / chunk_days).cast("int"))
    lent = df.where(F.col(day).isNotNull()).withColumn("__d", d).withColumn("__own", chunk).withColumn("__chunk", F.explode(reach))
    week = Window.partitionBy(*keys, "__chunk").orderBy("__d").rangeBetween(1 - width, 0)
    summed = lent.withColumn(out, F.sum(value).over(week))
    return summed.where(F.col("__own") == F.col("__chunk")).drop("__d", "__own", "__chunk")


def minmax_score(df: DataFrame, metrics: dict[str, tuple[str, bool]]) -> DataFrame:
    """Add 0-100 min-max scores: {score: (metric, higher_is_better)}; constant -> 50.
    df should be a written table."""
    bounds = scalars(
        df.agg(
            *[F.min(m).alias(f"lo_{s}") for s, (m, _) in metrics.items()],
            *[F.max(m).alias(f"hi_{s}") for s, (m, _) in metrics.items()],
        )
    )
    out = df.withColumn("__bounds", bounds)
    for score, (metric, higher) in metrics.items():
        lo, hi = F.col(f"__bounds.lo_{score}"), F.col(f"__bounds.hi_{score}")
        gain = F.col(metric) - lo if higher else hi - F.col(metric)
        out = out.withColumn(
            score, F.when(hi == lo, F.lit(50.0)).otherwise(F.try_divide(gain, hi - lo) * 100)
        )
    return out.drop("__bounds")


def month_of(col: str) -> Column:
    return F.date_format(F.col(col), "yyyy-MM")


def week_start(col: str) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", F.col(col)).cast("date")
