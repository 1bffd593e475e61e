"""Column expressions that clean raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "missing" in raw files.
NA_TOKENS = ["", "NA", "null", "NaN", "nan", "None"]


def clean_text(c: Column) -> Column:
    """NULL -> '', outer blanks off, inner blanks to one space, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " ")))


def fast_clean_text(c: Column) -> Column:
    """NULL -> '', outer blanks off, upper case; inner blanks stay."""
    return F.upper(strip(F.coalesce(c.cast("string"), F.lit(""))))


# The characters that count as blank at either end of a cell.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Blanks of any kind off both ends."""
    return F.btrim(c, F.lit(BLANKS))


def na_to_null(c: Column) -> Column:
    t = strip(c.cast("string"))
    return F.when(t.isin(*NA_TOKENS), None).otherwise(t)


def as_number(c: Column) -> Column:
    """The number a text stands for, NULL when there is none. The shape is tested
    first, since a cast alone would take NaN and Java's type letters."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double"))


def safe_numeric(c: Column) -> Column:
    """As as_number, with 0 for anything that is not a number."""
    return F.coalesce(as_number(c), F.lit(0.0))


def _rearranged_date(t: Column) -> Column:
    """Slashes, and the year last: month first, day first where that is no date."""
    even = F.translate(t, "/", "-")
    one, two, rest = (F.split_part(even, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    year, end = F.left(rest, F.lit(4)), F.substring(rest, 5, 1)
    return F.coalesce(
        even.try_cast("date"),
        F.when(end.isin("", " ", "T"), F.concat_ws("-", year, one, two).try_cast("date")),
        F.when(end.isin("", " ", "T"), F.concat_ws("-", year, two, one).try_cast("date")),
    )


def as_date(c: Column) -> Column:
    """The date a text stands for, NULL when it is not one.

    ISO text is cast. Other layouts are rearranged and cast, since a date pattern
    that fails raises an exception per row; they are worked out inside a lambda,
    which keeps the code generated for the whole row small enough to be compiled.
    """
    t = strip(c.cast("string"))
    return F.coalesce(t.try_cast("date"), F.transform(F.array(t), _rearranged_date)[0])
