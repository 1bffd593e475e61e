"""Sales table with an upload history, month statistics and a merged view.

Rows lie in Parquet, partitioned by sale month, upload and version. An upload is a batch
number of one origin; delivering it again writes a new version. A commit is one small
file in the log that says which pieces (month, upload, version) came and which went, with
each piece's row count, dates and units. Its appearance is the commit: a write that fails
half-way is not seen, and a reader takes the log as it is when the read is planned, so
later commits do not change what it reads.

* The summary and the history come from the log alone.
* `merge()` keeps a second table with the newest batch per key. It rewrites the months
  that commits since the last merge touched. A month whose live rows are all of one upload
  is copied without a shuffle, as that upload's batch is the newest of every key; in the
  others only the keys that those commits hold are worked out anew.
* `compact()` deletes what commits have taken away longer ago than readers may need, and
  writes the log anew as one commit.

Appends, merges and compactions of one store follow each other; readers come at any time.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files
from .scratch import materialize

SALES = "date date, store string, sku string, quantity double, amount double, bill_no string, created_at timestamp"
HISTORY = "batch bigint, type string, filename string, rows_count bigint, columns_count int, upload_date timestamp, status string"
PIECES = ", batch bigint, sale_month string, upload string, version string"
# What a commit says: a piece of the rows or of the merged table, an upload, a merge (its
# `rows` is the last commit that it took in), a commit that stands for all before it.
LOG = (
    "seq bigint, at timestamp, kind string, added boolean, sale_month string, upload string, version string, rows bigint,"
    " first date, last date, units double, batch bigint, type string, filename string, columns_count int, status string"
)
ROWS, MERGED, UPLOAD, MERGE, WHOLE = "rows", "merged", "upload", "merge", "whole"
UNDATED = "undated"

# Which stored lines a newer one replaces.
UPDATE_KEY = ["date", "store", "sku", "bill_no"]


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.strip(", ").split(",")]


class SalesStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.sales_path, self.merged_path, self.log_path = f"{root}/sales", f"{root}/merged", f"{root}/commits"

    # --- writing -------------------------------------------------------------

    def append(self, df: DataFrame, source: str, batch: int, kind: str = "sales", origin: str | None = None) -> None:
        """Store one batch and note it in the history. Columns the store does not know
        are left out, columns the batch lacks are NULL. `source` is the file name to note;
        `origin`, by default the source, says whose batch numbers these are."""
        columns = {c.lower(): c for c in df.columns}
        fields = [f.strip().split(" ", 1) for f in SALES.split(",")]
        rows = df.select(
            *[
                (F.col(f"`{columns[n]}`").try_cast(t) if n in columns else F.lit(None).cast(t)).alias(n)
                for n, t in fields
                if n != "created_at"
            ]
        )
        upload = f"{hashlib.sha256((origin or source).encode()).hexdigest()[:16]}-{batch}"
        version = uuid.uuid4().hex
        rows = rows.withColumns({"created_at": F.current_timestamp(), "batch": F.lit(batch).cast("bigint")})
        rows = rows.withColumns({"sale_month": self._month(), "upload": F.lit(upload), "version": F.lit(version)})
        log = self._log()
        went = self._live(log, ROWS).where(F.col("upload") == upload)
        self._by_month(rows).write.mode("append").partitionBy("sale_month", "upload", "version").parquet(self.sales_path)
        pieces = self._measured(self._stored(self.sales_path).where((F.col("upload") == upload) & (F.col("version") == version)), ROWS)
        note = pieces.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).withColumns(
            {
                "kind": F.lit(UPLOAD),
                "added": F.lit(True),
                "upload": F.lit(upload),
                "version": F.lit(version),
                "batch": F.lit(batch),
                "type": F.lit(kind),
                "filename": F.lit(source),
                "columns_count": F.lit(len(df.columns)),
                "status": F.lit("completed"),
            }
        )
        self._commit(log, pieces, went, note)

    def merge(self) -> list[str]:
        """Bring the merged table up to date; the months that were rewritten."""
        log = self._log()
        merged = log.where(F.col("kind") == MERGE).agg(F.max("rows")).first()[0] or 0
        changed = self._changed(log, merged)
        touched = changed.groupBy("sale_month").agg(F.max("seq").alias("seq")).collect()  # one row per month
        if not touched:
            return []
        months = sorted(r["sale_month"] for r in touched)
        here = F.col("sale_month").isin(months)
        live = self._live(log, ROWS).where(here)
        met = live.groupBy("sale_month").agg(F.count_distinct("upload").alias("n")).where("n > 1").select("sale_month").collect()
        met = F.col("sale_month").isin([r["sale_month"] for r in met]) if met else None
        columns = [*_names(SALES), "batch", "sale_month"]
        # These rows lie in files of their months, and stay together without a shuffle.
        rows = self._live_rows(log, ROWS, here if met is None else here & ~met).select(*columns)
        if met is not None:
            pieces = changed.where(met).select("sale_month", "upload", "version").distinct()
            keys = self._stored(self.sales_path).where(met).join(pieces, ["sale_month", "upload", "version"], "left_semi")
            keys = materialize(keys.select("sale_month", *UPDATE_KEY).distinct(), "keys")
            stay = _same_key(self._live_rows(log, MERGED, here & met), keys, "left_anti")
            anew = merge_batches(_same_key(self._live_rows(log, ROWS, here & met), keys, "left_semi"), "update", ["sale_month", *UPDATE_KEY])
            rows = rows.unionByName(self._by_month(stay.select(*columns).unionByName(anew.select(*columns))))
        version = uuid.uuid4().hex
        rows = rows.withColumns({"upload": F.lit(MERGED), "version": F.lit(version)})
        rows.write.mode("append").partitionBy("sale_month", "upload", "version").parquet(self.merged_path)
        made = self._measured(self._stored(self.merged_path).where(F.col("version") == version), MERGED)
        went = self._live(log, MERGED).where(here)
        seen = max(r["seq"] for r in touched)
        note = self.spark.range(1).select(F.lit(MERGE).alias("kind"), F.lit(True).alias("added"), F.lit(seen).alias("rows"))
        self._commit(log, made, went, note)
        return months

    def compact(self, grace_seconds: float = 7 * 24 * 3600) -> int:
        """Delete the pieces that a commit took away more than `grace_seconds` ago, and
        leave the log as one commit with what is live, what went later, and the merges'
        state. A read that was planned within that time still finds its files. Returns the
        number of folders deleted. Pieces that the next merge still has to look at stay."""
        log = self._log()
        before = [unquote(f) for f in log.inputFiles()]
        if not before:
            return 0
        old = F.col("at") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(grace_seconds)))
        merged = log.where(F.col("kind") == MERGE).agg(F.max("rows")).first()[0]
        keyed = ["kind", "sale_month", "upload", "version"]
        last = log.where(F.col("kind").isin(ROWS, MERGED)).groupBy(*keyed).agg(F.max_by("added", "seq").alias("added"), F.max("seq").alias("seq"), F.max_by("at", "seq").alias("at"))
        # Before the first merge there is no merged table that would need to see what went.
        pending = (F.col("kind") == ROWS) & (F.col("seq") > merged) if merged is not None else F.lit(False)
        gone = last.where(~F.col("added") & old & ~pending)
        folders = [(r["kind"], f"sale_month={r['sale_month']}/upload={r['upload']}/version={r['version']}") for r in gone.toLocalIterator()]
        kept = log.where(F.col("kind").isin(ROWS, MERGED)).join(gone, keyed, "left_anti")
        notes = log.where(F.col("kind").isin(UPLOAD, MERGE))
        newest = notes.groupBy("kind", "upload").agg(F.max_by(F.struct(*log.columns), "seq").alias("x")).select("x.*")
        whole = self.spark.range(1).select(F.lit(WHOLE).alias("kind"))
        top = log.agg(F.max("seq")).scalar()
        whole = whole.withColumns({"seq": top, "at": F.current_timestamp(), "added": F.lit(True)})
        # One file, so that the log changes over at one moment; its rows keep their numbers.
        out = self._as_log(kept).unionByName(self._as_log(newest)).unionByName(self._as_log(whole))
        out.coalesce(1).write.mode("append").parquet(self.log_path)
        files = Files(self.spark)
        for kind, folder in folders:
            files.delete(f"{self.sales_path if kind == ROWS else self.merged_path}/{folder}")
        # Older commits go once no reader can have planned on them.
        for path in before:
            if files.age(path) >= grace_seconds:
                files.delete(path, recursive=False)
        return len(folders)

    @staticmethod
    def _month() -> Column:
        return F.coalesce(F.date_format("date", "yyyy-MM"), F.lit(UNDATED))

    @staticmethod
    def _by_month(rows: DataFrame) -> DataFrame:
        """Rebalanced by month, so that a month is a few large files and a busy one is split."""
        return rows.hint("rebalance", F.col("sale_month"))

    def _measured(self, rows: DataFrame, kind: str) -> DataFrame:
        """The pieces that rows lie in, with their additive statistics."""
        per = rows.groupBy("sale_month", "upload", "version").agg(
            F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("quantity").alias("units")
        )
        return materialize(per.withColumns({"kind": F.lit(kind), "added": F.lit(True)}), "pieces")

    def _as_log(self, df: DataFrame) -> DataFrame:
        kinds = dict(f.strip().split(" ") for f in LOG.split(","))
        return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    def _commit(self, log: DataFrame, came: DataFrame, went: DataFrame, note: DataFrame) -> None:
        went = went.withColumn("added", F.lit(False))
        entries = self._as_log(came).unionByName(self._as_log(went)).unionByName(self._as_log(note))
        seq = F.coalesce(log.agg(F.max("seq")).scalar(), F.lit(0)) + 1
        entries.withColumns({"seq": seq, "at": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(self.log_path)

    # --- reading -------------------------------------------------------------

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def _log(self) -> DataFrame:
        """The commits as they are now. Entries that a compaction repeats are equal."""
        return self._read(self.log_path, LOG).distinct()

    def _stored(self, path: str) -> DataFrame:
        return self._read(path, SALES + PIECES)

    @staticmethod
    def _live(log: DataFrame, kind: str) -> DataFrame:
        """The pieces of a kind that have come and not gone, with their statistics."""
        facts = ["rows", "first", "last", "units"]
        last = log.where(F.col("kind") == kind).groupBy("kind", "sale_month", "upload", "version").agg(
            F.max_by("added", "seq").alias("added"), *[F.max(c).alias(c) for c in facts]
        )
        return last.where("added")

    @staticmethod
    def _changed(log: DataFrame, seq: int) -> DataFrame:
        return log.where((F.col("kind") == ROWS) & (F.col("seq") > seq))

    def _live_rows(self, log: DataFrame, kind: str, where: Column | None = None) -> DataFrame:
        """Rows of the live pieces. The log was listed before the files, so every piece it
        names is there."""
        stored = self._stored(self.sales_path if kind == ROWS else self.merged_path)
        live = self._live(log, kind).select("sale_month", "upload", "version")
        if where is not None:
            stored, live = stored.where(where), live.where(where)
        return stored.join(live, ["sale_month", "upload", "version"], "left_semi").drop("upload", "version")

    def rows(self) -> DataFrame:
        """The rows of the newest version of every upload."""
        return self._live_rows(self._log(), ROWS).select(*_names(SALES), "sale_month", "batch")

    def read_all(self) -> DataFrame:
        """All rows by date. The further columns let the sort split a very busy date."""
        return self.rows().orderBy("date", "store", "sku", "bill_no")

    def month_statistics(self) -> DataFrame:
        """sale_month, rows, first, last and units, from the log."""
        live = self._live(self._log(), ROWS)
        return live.groupBy("sale_month").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("units").alias("units"))

    def summary(self) -> DataFrame:
        """Row count, first and last date, 'N/A' when there are none; no row is read."""
        none = F.lit("N/A")
        return self._live(self._log(), ROWS).agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.min("first").cast("string"), none).alias("min_date"),
            F.coalesce(F.max("last").cast("string"), none).alias("max_date"),
        )

    def merged(self, how: str = "append") -> DataFrame:
        """append: all rows; dedupe: without exact repeats; update: the newest batch per
        key, from the merged table and, for months that changed after the last merge, from
        their rows."""
        if how != "update":
            return merge_batches(self.rows().drop("sale_month"), how)
        log = self._log()
        seen = F.coalesce(log.where(F.col("kind") == MERGE).agg(F.max("rows")).scalar(), F.lit(0))
        late = log.where((F.col("kind") == ROWS) & (F.col("seq") > seen)).select("sale_month").distinct()
        done = self._live_rows(log, MERGED).join(late, "sale_month", "left_anti")
        anew = merge_batches(self._live_rows(log, ROWS).join(late, "sale_month", "left_semi"), "update")
        columns = [*_names(SALES), "batch"]
        return done.select(*columns).unionByName(anew.select(*columns))

    def history(self) -> DataFrame:
        newest = self._log().where(F.col("kind") == UPLOAD).groupBy("upload").agg(F.max_by(F.struct(*_names(LOG)), "seq").alias("x"))
        return newest.select(
            "x.batch", "x.type", "x.filename", F.col("x.rows").alias("rows_count"), "x.columns_count", F.col("x.at").alias("upload_date"), "x.status"
        )

    def latest_uploads(self) -> DataFrame:
        """Uploads, rows and the newest file per type."""
        newest = F.struct("upload_date", "batch")
        return (
            self.history()
            .groupBy("type")
            .agg(
                F.count(F.lit(1)).alias("uploads"),
                F.sum("rows_count").alias("total_rows"),
                F.max_by("filename", newest).alias("filename"),
                F.max_by("rows_count", newest).alias("rows_count"),
                F.max_by("columns_count", newest).alias("columns_count"),
            )
        )


def _same_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows with (left_semi) or without (left_anti) a key in `keys`; NULL equals NULL."""
    k = keys.select(*[F.col(c).alias(f"__{c}") for c in keys.columns])
    on = F.lit(True)
    for c in keys.columns:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(k, on, how)


def merge_batches(rows: DataFrame, how: str, key: list[str] | None = None, batch: str = "batch") -> DataFrame:
    """append: all rows; update: rows of the newest batch per key; dedupe: without
    exact repeats (batch and load time aside).

    A key keeps all lines of its newest batch. The newest batch per key is an
    aggregate joined back, so a key with very many lines needs no window.
    """
    if how == "append":
        return rows
    if how == "dedupe":
        same = [c for c in rows.columns if c not in (batch, "created_at")]
        extra = [F.min(c).alias(c) for c in rows.columns if c not in same]
        return rows.groupBy(*same).agg(*extra).select(*rows.columns)
    if how == "update":
        key = key or UPDATE_KEY
        newest = rows.groupBy(*key).agg(F.max(batch).alias("__newest"))
        newest = newest.select(*[F.col(k).alias(f"__{k}") for k in key], "__newest")
        on = F.col(batch) == F.col("__newest")
        for k in key:
            on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        return rows.join(newest, on, "left_semi")
    raise ValueError(f"unknown merge: {how}")
