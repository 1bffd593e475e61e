"""Named dataset snapshots: one Parquet folder per dataset and published version, and
manifests that name them.

A snapshot is written under a version of its own; its manifest, one small file, comes
last and publishes it. A write that fails leaves the snapshot before it, and a reader
keeps the version whose manifest it read until `drop_superseded` deletes it.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files

MANIFEST = "dataset string, path string, rows bigint, columns array<string>, timestamp string, version string, published bigint"


def write_snapshot(tables: dict[str, DataFrame], root: str, stamp: str | None = None) -> None:
    """Write every non-empty dataset (snappy Parquet) and then the manifest."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    stamp = stamp or datetime.now(timezone.utc).isoformat()
    version = uuid.uuid4().hex
    entries = []
    for name, df in tables.items():
        path = f"{root}/{version}/{name}"
        df.write.option("compression", "snappy").parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        if rows:
            entries.append((name, path, rows, df.columns, stamp))
    published = (_manifests(spark, root).agg(F.max("published")).first()[0] or 0) + 1
    # A row without a dataset publishes a snapshot that has none.
    entries = [(*e, version, published) for e in entries or [(None, None, 0, [], stamp)]]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/_manifests")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    # The leading underscore keeps manifests out of directory scans, so they are named in full.
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/_manifests/*.json")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], MANIFEST)
        raise


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The datasets of the snapshot that was published last."""
    every = _manifests(spark, root)
    newest = every.agg(F.max("published")).scalar()
    return every.where((F.col("published") == newest) & F.col("dataset").isNotNull())


def drop_superseded(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the `keep` newest snapshots; the number of those deleted. For when no
    reader needs them any more."""
    every = _manifests(spark, root).select("version", "published").distinct()
    old = [r["version"] for r in every.orderBy(F.desc("published")).offset(keep).toLocalIterator()]
    for version in old:
        Files(spark).delete(f"{root}/{version}")
    return len([v for v in old if v])


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All datasets of the manifest that still exist. The manifest holds one row per
    dataset, so it is read on the driver."""
    out = {}
    for row in manifest(spark, root).collect():
        try:
            out[row.dataset] = spark.read.parquet(row.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def snapshot_details(spark: SparkSession, root: str) -> DataFrame:
    """Rows, columns, size and time per dataset; sizes come from the file listing."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(root)
        .groupBy(F.element_at(F.split("path", "/"), -3).alias("version"), F.element_at(F.split("path", "/"), -2).alias("dataset"))
        .agg(F.sum("length").alias("bytes"))
    )
    return (
        manifest(spark, root)
        .join(files, ["version", "dataset"], "left")
        .select("dataset", "rows", F.size("columns").alias("columns"), "bytes", "timestamp")
    )


def snapshot_info(spark: SparkSession, root: str) -> DataFrame:
    """One row: datasets, rows, size in MB and the latest write."""
    return snapshot_details(spark, root).agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum("rows").alias("total_rows"),
        F.round(F.sum("bytes") / (1024 * 1024), 2).alias("total_size_mb"),
        F.max("timestamp").alias("last_updated"),
    )
