"""Data quality checks and table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, scalars, stable
from ..functions.text import as_date, as_number
from ..model import REQUIRED_COLUMNS


def required_columns(df: DataFrame, table: str, *, partial: bool = False) -> tuple[bool, list[str]]:
    """Whether the table has its required columns, and which are missing. `partial`
    accepts a column whose name contains the required one."""
    have = df.columns
    if partial:
        missing = [r for r in REQUIRED_COLUMNS.get(table, []) if not any(r.lower() in c.lower() for c in have)]
    else:
        missing = [r for r in REQUIRED_COLUMNS.get(table, []) if r not in have]
    return not missing, missing


def required_tables(tables: dict[str, DataFrame]) -> tuple[bool, dict[str, list[str]]]:
    """Every required table with its missing columns (all of them when it is absent)."""
    gaps = {
        name: required_columns(tables[name], name)[1] if name in tables else cols
        for name, cols in REQUIRED_COLUMNS.items()
    }
    gaps = {n: g for n, g in gaps.items() if g}
    return not gaps, gaps


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one in all columns."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def _per_column(df: DataFrame, tests: dict[str, Column], name: str) -> DataFrame:
    """One pass over df: (column, count of rows that fail the column's test)."""
    if not tests:
        return df.sparkSession.createDataFrame([], f"column string, {name} bigint")
    row = df.agg(*[F.count_if(t).alias(c) for c, t in tests.items()])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(name)) for c in tests]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def invalid_dates(df: DataFrame) -> DataFrame:
    """Per date-like column: values that are present but not a date."""
    cols = [c for c in df.columns if "date" in c.lower()]
    return _per_column(
        df, {c: F.col(f"`{c}`").isNotNull() & as_date(F.col(f"`{c}`")).isNull() for c in cols}, "invalid_dates"
    )


def invalid_numbers(df: DataFrame) -> DataFrame:
    """Per quantity-, stock- or amount-like column: values present but not a number."""
    words = ("quantity", "stock", "amount")
    cols = [c for c in df.columns if any(w in c.lower() for w in words)]
    return _per_column(
        df, {c: F.col(f"`{c}`").isNotNull() & as_number(F.col(f"`{c}`")).isNull() for c in cols}, "invalid_numbers"
    )


def mixed_types(df: DataFrame) -> DataFrame:
    """Per text column: values that read as numbers, values that do not, and whether
    both kinds occur."""
    cols = [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, numeric bigint, textual bigint, mixed boolean")
    aggs = []
    for i, c in enumerate(cols):
        number = as_number(F.col(f"`{c}`"))
        aggs += [
            F.count_if(number.isNotNull()).alias(f"n{i}"),
            F.count_if(F.col(f"`{c}`").isNotNull() & number.isNull()).alias(f"t{i}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("numeric"),
            F.col(f"t{i}").alias("textual"),
            ((F.col(f"n{i}") > 0) & (F.col(f"t{i}") > 0)).alias("mixed"),
        )
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def store_mapping(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """Stores of both tables with names, record counts and Matched / Sales Only / Stock Only."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        name = F.min("STORE_NAME") if "STORE_NAME" in df.columns else F.min("STORE")
        return (
            df.where(F.col("STORE").isNotNull())
            .groupBy("STORE")
            .agg(name.alias(f"{prefix}_Name"), F.count(F.lit(1)).alias(f"{prefix}_Records"))
        )

    zero, none = F.lit(0).cast("long"), F.lit("NOT FOUND")
    status = (
        F.when(F.col("Sales_Records").isNull(), "Stock Only")
        .when(F.col("Stock_Records").isNull(), "Sales Only")
        .otherwise("Matched")
    )
    return (
        side(sales, "Sales")
        .join(side(stock, "Stock"), "STORE", "full")
        .select(
            F.col("STORE").alias("Store_Code"),
            F.when(F.col("Sales_Records").isNull(), none).otherwise(F.col("Sales_Name")).alias("Sales_Name"),
            F.when(F.col("Stock_Records").isNull(), none).otherwise(F.col("Stock_Name")).alias("Stock_Name"),
            status.alias("Status"),
            F.coalesce("Sales_Records", zero).alias("Sales_Records"),
            F.coalesce("Stock_Records", zero).alias("Stock_Records"),
        )
    )


def mapping_status(mapping: DataFrame) -> DataFrame:
    """Stores per status, and the warnings the two one-sided ones stand for."""
    text = F.when(
        F.col("Status") == "Sales Only",
        F.format_string("%d stores found in sales data but not in stock data", F.col("stores")),
    ).when(
        F.col("Status") == "Stock Only",
        F.format_string("%d stores found in stock data but not in sales data", F.col("stores")),
    )
    return mapping.groupBy("Status").agg(F.count(F.lit(1)).alias("stores")).withColumn("warning", text)


def style_matching(plan_styles: DataFrame, style_master: DataFrame) -> DataFrame:
    """Styles of the plan that the master knows, and those it does not."""
    ours = plan_styles.select(F.upper(F.trim("STYLE")).alias("STYLE")).where(F.col("STYLE").isNotNull()).distinct()
    theirs = style_master.select(F.upper(F.trim("STYLE")).alias("STYLE"))
    matched = ours.join(theirs, "STYLE", "left_semi").withColumn("matched", F.lit(True))
    return matched.unionByName(ours.join(theirs, "STYLE", "left_anti").withColumn("matched", F.lit(False)))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, distinct stores and SKUs and total warehouse stock, one row."""
    n = F.lit(None).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        (F.count_distinct("STORE") if "STORE" in df.columns else n).alias("unique_stores"),
        (F.count_distinct("SKU") if "SKU" in df.columns else n).alias("unique_skus"),
        (F.sum("WAREHOUSE_STOCK") if "WAREHOUSE_STOCK" in df.columns else F.lit(None).cast("double")).alias(
            "total_warehouse_stock"
        ),
    )


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """A preview of n rows, smallest first so that it is repeatable."""
    return df.orderBy(*df.columns).limit(n)


def sku_coverage(sales: DataFrame, stock: DataFrame) -> DataFrame:
    """SKUs in both tables over SKUs in either, in percent."""
    a = sales.select("SKU").distinct().withColumn("s", F.lit(1))
    b = stock.select("SKU").distinct().withColumn("k", F.lit(1))
    return (
        a.join(b, "SKU", "full")
        .agg(F.count_if(F.col("s").isNotNull() & F.col("k").isNotNull()).alias("both"), F.count(F.lit(1)).alias("any"))
        .select(
            F.col("both").alias("common_skus"),
            F.col("any").alias("all_skus"),
            stable(ratio(F.col("both"), F.col("any")) * 100).alias("coverage_pct"),
        )
    )


def history_span(sales: DataFrame, date_col: str = "DATE") -> DataFrame:
    return sales.agg(
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
        F.datediff(F.max(date_col), F.min(date_col)).alias("days"),
    )


def data_summary(sales: DataFrame, stock: DataFrame, warehouse: DataFrame) -> DataFrame:
    """Record counts, distinct SKUs, styles and stores, dates and totals, one row. Lines
    are first summed per store and SKU, so the distinct counts see few rows."""
    pairs = sales.groupBy("STORE", "SKU", "STYLE").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("DATE").alias("first"),
        F.max("DATE").alias("last"),
        F.sum("QUANTITY").alias("q"),
        F.sum(F.col("NET_AMOUNT").cast("decimal(18,4)")).alias("amount"),
    )
    out = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sales_records"),
        F.count_distinct("SKU").alias("skus"),
        F.count_distinct("STYLE").alias("styles"),
        F.count_distinct("STORE").alias("stores"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.sum("q").alias("total_quantity"),
        F.sum("amount").cast("double").alias("total_value"),
    )
    for name, df in (("stock_records", stock), ("warehouse_records", warehouse)):
        out = out.withColumn(name, scalars(df.agg(F.count(F.lit(1)).alias("n")))["n"])
    return out


def store_info(sales: DataFrame) -> DataFrame:
    return (
        sales.where(F.col("STORE").isNotNull())
        .groupBy(F.col("STORE").alias("STORE_CODE"))
        .agg(
            F.min("STORE_NAME").alias("STORE_NAME"),
            F.sum("QUANTITY").alias("TOTAL_SALES"),
            F.count_distinct("SKU").alias("UNIQUE_SKUS"),
        )
    )


def style_nulls(df: DataFrame) -> DataFrame:
    """Rows without a STYLE and the number of distinct styles."""
    return df.agg(
        F.count_if(F.col("STYLE").isNull() | (F.col("STYLE") == "")).alias("null_or_empty"),
        F.count_if(F.col("STYLE").isNull()).alias("nulls"),
        F.count_distinct("STYLE").alias("distinct_styles"),
    )
