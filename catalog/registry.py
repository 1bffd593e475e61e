"""Where queries register themselves, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislebrook.plans.testbed import Testbed
from aislebrook.sources.scratch import WrittenOnce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SHARED = WrittenOnce()
_KEPT: dict[tuple, DataFrame] = {}


def norm(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, small integers to bigint, decimals to double. Engines round
    exact halves differently; 1e-9 more settles them alike on both sides."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t in ("double", "float") or t.startswith("decimal"):
            x = F.round(x.cast("double") + 1e-9, 6)
        elif t in ("int", "smallint", "tinyint"):
            x = x.cast("bigint")
        out.append(x.alias(c))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register build(testbed) -> DataFrame under name, with its SQL if there is one."""

    def add(build: Callable[[Testbed], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: norm(build(Testbed(spark, sf_dir)))
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def shared(t: Testbed, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read (the finished plan, say), written once per
    application and state of the given tables."""
    return _SHARED.get(t.spark, (t.state, name), build)


def kept(t: Testbed, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read and that build has just written: it is not
    written again, and read with fresh column identities."""
    key = (t.spark.sparkContext.applicationId, t.state, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key].toDF(*_KEPT[key].columns)


def sales_and_stock(t: Testbed) -> tuple[DataFrame, DataFrame]:
    """Sales and stock for plans, which read each of them several times: the given tables
    are joined once, and both are written once per application and state of these."""
    sales = shared(t, "sales", lambda: t.sales)
    return sales, shared(t, "stock", lambda: t.stock)
