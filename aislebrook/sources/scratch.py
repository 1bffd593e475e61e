"""Intermediate tables in the shared folder named by spark.checkpoint.dir.

A written table is computed once, survives the loss of executors, and has a known
size, so Spark's broadcast decisions on it rest on a measured figure.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .files import Files

_CONF = "spark.checkpoint.dir"
# Bytes of the files behind a table that one task takes of it.
PIECE_BYTES = 4 << 20
# A table of no more pieces than this is left to adaptive execution.
FEW_PIECES = 16


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, or below the warehouse where
    that is not set. Executors have to share either: on a cluster a warehouse that lies on
    the driver's own disk is refused."""
    sc = spark.sparkContext
    base = sc.getConf().get(_CONF) or spark.conf.get(_CONF, "")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        one_machine = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        if not one_machine and (base.startswith("file:") or "://" not in base):
            raise RuntimeError(f"set {_CONF} to a folder that all executors share: {base} is local to one machine")
    return f"{base.rstrip('/')}/aislebrook-{sc.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, label: str = "table") -> str:
    """Write df once as Parquet in the shared folder; its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, label))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over the tasks by `keys`, in pieces by the size of the files it is read
    from; a small table as it is.

    Adaptive execution merges pieces of a shuffle by their compressed bytes. Rows of few
    distinct values are ten times as large in memory, and a sort of them goes to disk.
    There are as many pieces as shuffles have partitions at least: a smaller table that is
    joined by `keys` then goes to df, not df to it."""
    spark = df.sparkSession
    pieces = math.ceil(Files(spark).total(df.inputFiles()) / PIECE_BYTES)
    return df if pieces <= FEW_PIECES else df.repartition(max(pieces, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


class WrittenOnce:
    """Tables written once per application and named by a key. Every read has fresh
    column identities, so a table may be joined with itself."""

    def __init__(self):
        self._known: dict[tuple, tuple[str, StructType]] = {}

    def get(self, spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        full = (spark.sparkContext.applicationId, *key)
        if full not in self._known:
            df = build()
            self._known[full] = (write_scratch(df, str(key[-1])), df.schema)
        path, schema = self._known[full]
        return spark.read.schema(schema).parquet(path)

    def clear(self) -> None:
        """Build every table anew when it is next asked for."""
        self._known.clear()


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are written."""
    Files(spark).delete(scratch_root(spark))
