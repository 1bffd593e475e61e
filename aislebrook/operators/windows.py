"""Date windows relative to the data or to a given planning date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, date_col: str = "DATE", as_of: date | None = None) -> Column:
    """The planning date: `as_of`, or the newest date of the table as a scalar subquery."""
    if as_of is not None:
        return F.lit(as_of)
    return df.agg(F.max(date_col).alias("d")).scalar()


def recent(
    df: DataFrame, days: int, *, date_col: str = "DATE", inclusive: bool = False, as_of: date | None = None
) -> DataFrame:
    """Rows later than (or, inclusive, on or after) the planning date minus `days`.

    The bound is resolved before the scan, so the filter reaches the file reader.
    """
    start = F.date_sub(latest(df, date_col, as_of), days)
    keep = F.col(date_col) >= start if inclusive else F.col(date_col) > start
    return df.where(keep)


def month(df: DataFrame, year_month: str, date_col: str = "DATE") -> DataFrame:
    """Rows of one 'yyyy-MM', as a plain date range so that it prunes partitions."""
    first = F.to_date(F.lit(year_month + "-01"))
    return df.where((F.col(date_col) >= first) & (F.col(date_col) < F.add_months(first, 1)))


def since(df: DataFrame, start: date | str, date_col: str = "DATE") -> DataFrame:
    return df.where(F.col(date_col) >= F.lit(start).cast("date"))
