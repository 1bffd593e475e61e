"""Dashboard aggregates and data quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from aislebrook.operators import dashboard as v
from aislebrook.operators import quality as qa
from aislebrook.operators.windows import month, recent, since

from .registry import query
from .sqlbase import ALL, BILLS, SALES, STYLE_SALES, q


@query(
    "v01_kpis",
    q(
        ALL,
        """SELECT sum(QUANTITY) AS total_sales, count(DISTINCT STORE) AS stores, count(DISTINCT SKU) AS skus,
  (SELECT sum(STOCK) FROM stock) AS total_stock FROM sales""",
        f="total_sales total_stock",
    ),
)
def _(t):
    return v.kpis(t.sales, t.stock)


@query("v02_daily_sales", q(SALES, "SELECT DATE, sum(QUANTITY) AS QUANTITY FROM sales GROUP BY 1", f="QUANTITY"))
def _(t):
    return v.daily_sales(t.sales)


@query("v03_top_products", q(SALES, "SELECT SKU, sum(QUANTITY) AS QUANTITY FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", f="QUANTITY"))
def _(t):
    return v.top_by(t.sales, "SKU", "QUANTITY")


@query("v03_top_stock", q(ALL, "SELECT SKU, sum(STOCK) AS STOCK FROM stock GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", f="STOCK"))
def _(t):
    return v.top_by(t.stock, "SKU", "STOCK")


@query("v04_sales_by_store", q(SALES, "SELECT STORE, sum(QUANTITY) AS QUANTITY FROM sales GROUP BY 1", f="QUANTITY"))
def _(t):
    return v.total_by(t.sales, "STORE", "QUANTITY")


@query("v04_stock_by_store", q(ALL, "SELECT STORE, sum(STOCK) AS STOCK FROM stock GROUP BY 1", f="STOCK"))
def _(t):
    return v.total_by(t.stock, "STORE", "STOCK")


@query("v05_zero_stock", q(ALL, "SELECT STORE, count(*) AS zero_stock_items FROM stock WHERE STOCK = 0 GROUP BY 1"))
def _(t):
    return v.zero_stock(t.stock)


@query(
    "v06_store_performance",
    q(
        ALL,
        """a AS (SELECT STORE, min(STORE_NAME) AS Store_Name, sum(QUANTITY) AS Total_Sales FROM sales GROUP BY 1),
b AS (SELECT STORE, sum(STOCK) AS Current_Stock, count(DISTINCT SKU) AS SKU_Count FROM stock GROUP BY 1)
SELECT a.*, Current_Stock, SKU_Count, round(round(coalesce(Total_Sales / nullif(Current_Stock, 0), 0), 6), 2) AS Stock_Turn
FROM a LEFT JOIN b ON a.STORE = b.STORE""",
        f="Total_Sales Current_Stock Stock_Turn",
    ),
)
def _(t):
    return v.store_performance(t.sales, t.stock)


ATTR = """js AS (
  SELECT m.*, GENDER, QUANTITY FROM sales s JOIN sku_master m ON s.SKU = m.SKU JOIN style_master g ON m.STYLE = g.STYLE)"""


@query(
    "v07_attribute_sales",
    q(
        ALL,
        f"""{ATTR},
parts AS (
  SELECT 'GENDER' AS attribute, GENDER AS value, sum(QUANTITY) AS QUANTITY FROM js GROUP BY 2
  UNION ALL SELECT 'SIZE', SIZE, sum(QUANTITY) FROM js GROUP BY 2
  UNION ALL SELECT * FROM (SELECT 'COLOR', COLOR, sum(QUANTITY) AS x FROM js GROUP BY 2 ORDER BY x DESC, COLOR LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'STYLE', STYLE, sum(QUANTITY) AS x FROM js GROUP BY 2 ORDER BY x DESC, STYLE LIMIT 10))
SELECT * FROM parts""",
        f="QUANTITY",
    ),
)
def _(t):
    parts = [
        v.attribute_sales(t.sales, t.sku_master, t.style_master, c, n).select(
            F.lit(c).alias("attribute"), F.col(c).alias("value"), "QUANTITY"
        )
        for c, n in (("GENDER", None), ("SIZE", None), ("COLOR", 10), ("STYLE", 10))
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "v08_service_kpis",
    q(
        ALL,
        """SELECT count(*) FILTER (WHERE STOCK > 0) / count(*) * 100 AS service_level_pct,
  (SELECT sum(QUANTITY) FROM sales) / sum(STOCK) AS inventory_turnover,
  count(*) FILTER (WHERE STOCK = 0) / count(*) * 100 AS out_of_stock_pct,
  (SELECT count(DISTINCT SKU) FROM sales) AS active_skus, (SELECT count(DISTINCT SKU) FROM sku_master) AS total_skus
FROM stock""",
        f="service_level_pct inventory_turnover out_of_stock_pct",
    ),
)
def _(t):
    return v.service_kpis(t.sales, t.stock, t.sku_master)


# --- data quality ------------------------------------------------------------


@query(
    "q01_required_columns",
    q(
        ALL,
        """SELECT 'sales' AS "table", TRUE AS ok, '' AS missing, count(*) AS rows FROM sales
UNION ALL SELECT 'stock', TRUE, '', count(*) FROM stock
UNION ALL SELECT 'warehouse', FALSE, 'WAREHOUSE_STOCK', count(*) FROM warehouse
UNION ALL SELECT 'sku_master', TRUE, '', count(*) FROM sku_master""",
    ),
)
def _(t):
    tables = {
        "sales": t.sales,
        "stock": t.stock,
        "warehouse": t.warehouse.withColumnRenamed("WAREHOUSE_STOCK", "LEFT_OVER"),
        "sku_master": t.sku_master,
    }
    out = None
    for name, df in tables.items():
        ok, missing = qa.required_columns(df, name)
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.lit(ok).alias("ok"), F.lit(",".join(missing)).alias("missing"), "rows"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "q02_duplicate_count",
    q(
        "s AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)",
        "SELECT (SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) AS duplicate_rows",
        i="duplicate_rows",
    ),
)
def _(t):
    # All lines, and every first line once more.
    lines = t.table("lineitem")
    return qa.duplicate_count(lines.union(lines.where("l_linenumber = 1")))


def _raw_text(t):
    """Orders as text, with some dates and amounts spoiled."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.table("orders").select(
        F.when(key % 7 == 0, F.lit("31-31-2020")).when(key % 11 == 0, None).otherwise(day).alias("BILL_DATE"),
        F.when(key % 5 == 0, F.lit("n.a.")).otherwise(F.col("o_totalprice").cast("string")).alias("NET_AMOUNT"),
        F.when(key % 3 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("REFERENCE"),
    )


@query(
    "q03_invalid_dates",
    "SELECT 'BILL_DATE' AS \"column\", count(*) AS invalid_dates FROM orders WHERE o_orderkey % 7 = 0",
)
def _(t):
    return qa.invalid_dates(_raw_text(t))


@query(
    "q04_invalid_numbers",
    "SELECT 'NET_AMOUNT' AS \"column\", count(*) AS invalid_numbers FROM orders WHERE o_orderkey % 5 = 0",
)
def _(t):
    return qa.invalid_numbers(_raw_text(t))


@query(
    "q05_mixed_types",
    """SELECT 'BILL_DATE' AS "column", CAST(0 AS BIGINT) AS "numeric",
  count(*) FILTER (WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0)) AS textual, FALSE AS mixed FROM orders
UNION ALL SELECT 'NET_AMOUNT', count(*) FILTER (WHERE o_orderkey % 5 <> 0), count(*) FILTER (WHERE o_orderkey % 5 = 0), TRUE FROM orders
UNION ALL SELECT 'REFERENCE', count(*) FILTER (WHERE o_orderkey % 3 = 0), count(*) FILTER (WHERE o_orderkey % 3 <> 0), TRUE FROM orders""",
)
def _(t):
    return qa.mixed_types(_raw_text(t))


MAPPING = """a AS (SELECT STORE, min(STORE_NAME) AS n, count(*) AS c FROM
  (SELECT STORE, STORE_NAME FROM sales UNION ALL SELECT 'ST900', 'NEW' FROM nation) w GROUP BY 1),
b AS (SELECT STORE, min(STORE_NAME) AS n, count(*) AS c FROM
  (SELECT STORE, STORE_NAME FROM stock UNION ALL SELECT 'ST901', 'OLD' FROM region) w GROUP BY 1),
mapping AS (
  SELECT coalesce(a.STORE, b.STORE) AS Store_Code, coalesce(a.n, 'NOT FOUND') AS Sales_Name, coalesce(b.n, 'NOT FOUND') AS Stock_Name,
    CASE WHEN a.STORE IS NULL THEN 'Stock Only' WHEN b.STORE IS NULL THEN 'Sales Only' ELSE 'Matched' END AS Status,
    coalesce(a.c, 0) AS Sales_Records, coalesce(b.c, 0) AS Stock_Records
  FROM a FULL JOIN b ON a.STORE = b.STORE)"""


def _mapping(t):
    # A made-up store on either side, so that all three states occur.
    def and_one(df, other: str, store: str, name: str):
        more = t.table(other).select(F.lit(store).alias("STORE"), F.lit(name).alias("STORE_NAME"))
        return df.select("STORE", "STORE_NAME").union(more)

    return qa.store_mapping(and_one(t.sales, "nation", "ST900", "NEW"), and_one(t.stock, "region", "ST901", "OLD"))


@query("q06_store_mapping", q(ALL, f"{MAPPING} SELECT * FROM mapping"))
def _(t):
    return _mapping(t)


@query(
    "q06_mapping_status",
    q(
        ALL,
        f"""{MAPPING}
SELECT Status, count(*) AS stores, CASE Status WHEN 'Sales Only' THEN count(*) || ' stores found in sales data but not in stock data'
  WHEN 'Stock Only' THEN count(*) || ' stores found in stock data but not in sales data' END AS warning
FROM mapping GROUP BY 1""",
    ),
)
def _(t):
    return qa.mapping_status(_mapping(t))


@query(
    "q07_style_matching",
    q(ALL, "SELECT DISTINCT STYLE, STYLE IN (SELECT STYLE FROM style_master) AS matched FROM sku_master"),
)
def _(t):
    return qa.style_matching(t.sku_master, t.style_master)


@query(
    "q08_table_profile",
    q(
        ALL,
        """SELECT 'sales' AS "table", count(*) AS rows, CAST(5 AS BIGINT) AS columns, count(DISTINCT STORE) AS unique_stores,
  count(DISTINCT SKU) AS unique_skus, CAST(NULL AS DOUBLE) AS total_warehouse_stock FROM sales
UNION ALL SELECT 'warehouse', count(*), 2, NULL, count(DISTINCT SKU), sum(WAREHOUSE_STOCK) FROM warehouse""",
        f="total_warehouse_stock",
        i="columns",
    ),
)
def _(t):
    a = qa.table_profile(t.sales).select(F.lit("sales").alias("table"), "*")
    return a.unionByName(qa.table_profile(t.warehouse).select(F.lit("warehouse").alias("table"), "*"))


@query("q08_sample_rows", q(ALL, "SELECT * FROM sku_master ORDER BY SKU, STYLE, COLOR, SIZE LIMIT 5"))
def _(t):
    return qa.sample_rows(t.sku_master)


@query(
    "q09_sku_coverage",
    q(
        ALL,
        """a AS (SELECT DISTINCT SKU FROM sales),
b AS (SELECT SKU FROM stock UNION SELECT 'NEW' || SKU FROM warehouse WHERE WAREHOUSE_STOCK > 30),
c AS (SELECT a.SKU AS x, b.SKU AS y FROM a FULL JOIN b ON a.SKU = b.SKU)
SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS common_skus, count(*) AS all_skus,
  count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(*) * 100 AS coverage_pct FROM c""",
        f="coverage_pct",
    ),
)
def _(t):
    # Made-up SKUs that are held and never sold.
    new = t.warehouse.where("WAREHOUSE_STOCK > 30").select(F.concat(F.lit("NEW"), "SKU").alias("SKU"))
    return qa.sku_coverage(t.sales, t.stock.select("SKU").union(new))


@query(
    "q10_history_span",
    q(SALES, "SELECT min(DATE) AS first_date, max(DATE) AS last_date, max(DATE) - min(DATE) AS days FROM sales", i="days"),
)
def _(t):
    return qa.history_span(t.sales)


@query(
    "q11_data_summary",
    q(
        STYLE_SALES,
        """SELECT count(*) AS sales_records, count(DISTINCT SKU) AS skus, count(DISTINCT STYLE) AS styles, count(DISTINCT STORE) AS stores,
  min(DATE) AS first_date, max(DATE) AS last_date, sum(QUANTITY) AS total_quantity, CAST(sum(NET_AMOUNT) AS DOUBLE) AS total_value,
  (SELECT count(*) FROM stock) AS stock_records, (SELECT count(*) FROM warehouse) AS warehouse_records FROM style_sales""",
        f="total_quantity total_value",
    ),
)
def _(t):
    return qa.data_summary(t.style_sales, t.stock, t.warehouse)


@query(
    "q12_store_info",
    q(
        SALES,
        """SELECT STORE AS STORE_CODE, min(STORE_NAME) AS STORE_NAME, sum(QUANTITY) AS TOTAL_SALES, count(DISTINCT SKU) AS UNIQUE_SKUS
FROM sales GROUP BY 1""",
        f="TOTAL_SALES",
    ),
)
def _(t):
    return qa.store_info(t.sales)


@query(
    "q13_style_nulls",
    q(
        BILLS,
        """s AS (SELECT CASE WHEN BILL_NO % 10 = 0 THEN NULL WHEN BILL_NO % 10 = 1 THEN '' ELSE STYLE END AS STYLE FROM bills)
SELECT count(*) FILTER (WHERE STYLE IS NULL OR STYLE = '') AS null_or_empty, count(*) FILTER (WHERE STYLE IS NULL) AS nulls,
  count(DISTINCT STYLE) AS distinct_styles FROM s""",
    ),
)
def _(t):
    spoiled = F.when(F.col("BILL_NO") % 10 == 0, None).when(F.col("BILL_NO") % 10 == 1, "").otherwise(F.col("STYLE"))
    return qa.style_nulls(t.bills.select(spoiled.alias("STYLE")))


# --- date windows ------------------------------------------------------------


@query(
    "c16_month_filter",
    q(
        BILLS,
        "SELECT * FROM bills WHERE strftime(BILL_DATE, '%Y-%m') = '1998-10'",
        f="BILL_QUANTITY GROSS_AMOUNT NET_AMOUNT ITEM_DISCOUNT_AMOUNT PROMO_AMOUNT RSP",
    ),
)
def _(t):
    return month(t.bills, "1998-10", "BILL_DATE")


@query(
    "c17_date_range_filter",
    q(SALES, "SELECT STORE, count(*) AS lines, sum(QUANTITY) AS units FROM sales WHERE DATE >= DATE '2000-04-01' GROUP BY 1", f="units"),
)
def _(t):
    return since(t.sales, "2000-04-01").groupBy("STORE").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("QUANTITY").alias("units")
    )


@query(
    "c18_recent_window",
    q(
        SALES,
        """m AS (SELECT max(DATE) AS d FROM sales)
SELECT 'after' AS bound, count(*) AS lines, min(DATE) AS first_date FROM sales, m WHERE DATE > d - 90
UNION ALL SELECT 'on_or_after', count(*), min(DATE) FROM sales, m WHERE DATE >= d - 90""",
    ),
)
def _(t):
    parts = [
        recent(t.sales, 90, inclusive=inc).agg(F.count(F.lit(1)).alias("lines"), F.min("DATE").alias("first_date")).select(
            F.lit(name).alias("bound"), "lines", "first_date"
        )
        for name, inc in (("after", False), ("on_or_after", True))
    ]
    return parts[0].unionByName(parts[1])

