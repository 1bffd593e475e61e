"""Reading raw files and writing results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_date, as_number, strip
from ..operators.plan_views import PLAN_COLUMNS, records

# Cell texts read as missing.
NA_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def csv_scan(spark: SparkSession, paths: str | list[str], *, infer: bool = False, names: list[str] | None = None) -> DataFrame:
    """CSV with a header; every column as text with NA cells NULL. `names` declares the
    header (no look at the files); `infer` then types each column in which all other
    cells are numbers: bigint if they are whole and none is missing, else double."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    if names:
        reader = reader.schema(", ".join(f"`{n}` string" for n in names))
    df = reader.csv(paths)
    df = df.select(*[F.when(F.col(f"`{c}`").isin(NA_CELLS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _typed(df) if infer else df


def _typed(df: DataFrame) -> DataFrame:
    if not df.columns:
        return df
    seen = []
    for i, c in enumerate(df.columns):
        x = F.trim(F.col(f"`{c}`"))
        whole = x.rlike(r"^[-+]?\d+$") & x.try_cast("bigint").isNotNull()
        seen += [F.count(x).alias(f"n{i}"), F.count_if(whole).alias(f"w{i}"), F.count(as_number(x)).alias(f"d{i}")]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *seen).first()

    def typed(i: int, c: str):
        x = F.col(f"`{c}`")
        if not found[f"n{i}"] or found[f"d{i}"] < found[f"n{i}"]:
            return x
        whole = found[f"w{i}"] == found["rows"]
        return (F.trim(x).cast("bigint") if whole else as_number(x)).alias(c)

    return df.select(*[typed(i, c) for i, c in enumerate(df.columns)])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its extension: CSV with typed numbers, else Parquet."""
    return csv_scan(spark, path, infer=True) if path.endswith(".csv") else spark.read.parquet(path)


def path_scan(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Load {type: path}; paths that do not exist are left out. Headers are trimmed and
    upper-cased, sales dates parsed, numbers of the fact tables filled with 0, text trimmed."""
    out = {}
    for name, path in paths.items():
        if not path:
            continue
        try:
            df = read_table(spark, path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        df = df.toDF(*[c.strip().upper() for c in df.columns])
        types = dict(df.dtypes)
        if name == "sales" and "DATE" in types and types["DATE"] != "date":
            df = df.withColumn("DATE", as_date(F.col("DATE")))
        if name in ("sales", "stock", "warehouse"):
            df = df.na.fill(0)
        text = {c: strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c, t in df.dtypes if t == "string"}
        out[name] = df.withColumns(text) if text else df
    return out


def union_files(frames: list[DataFrame]) -> DataFrame:
    """All rows of all files; columns missing from a file are NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_uploader(df: DataFrame, user: str) -> DataFrame:
    return df.withColumn("uploaded_by", F.lit(user))


def plan_columns_first(plan: DataFrame) -> DataFrame:
    """Known plan columns in their order, then the rest; giveaways never leave."""
    known = [c for c in PLAN_COLUMNS if c in plan.columns]
    out = plan.select(*known, *[c for c in plan.columns if c not in known])
    if "GENDER" in out.columns:
        out = out.where(~F.coalesce(F.upper("GENDER").contains("FREEBIE"), F.lit(False)))
    return out


def write_plan_csv(plan: DataFrame, path: str) -> None:
    plan_columns_first(plan).write.mode("overwrite").option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per named table."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}")


def write_plan_records(plan: DataFrame, path: str) -> None:
    records(plan).write.mode("overwrite").json(path)
