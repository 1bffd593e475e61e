"""Cleaning of raw files, sources and sinks, the sales store and the landing stream.

Raw files are made from the test tables: headers, blanks, missing tokens and bad
values are put in by plain arithmetic on the keys, and each query reads them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aislebrook.functions import text
from aislebrook.functions.stats import month_of
from aislebrook.operators import cleaning, plan_views
from aislebrook.sources import readers, snapshots
from aislebrook.sources.sales_store import SalesStore, merge_batches
from aislebrook.sources.scratch import scratch_path
from aislebrook.streaming.landing import ingest_attachments, ingest_batch, landing_ingest, stream_origin

from .registry import query, shared
from .replenish import BASE_SQL, base_plan
from .sqlbase import ALL, BILLS, BILLS_ALL, SALES, q


def raw_sales(t):
    """Bill lines as a retailer's export, written once for queries that read them often."""
    return shared(t, "raw_sales", lambda: raw_lines(t))


def raw_lines(t):
    """Odd headers, all text, some cells spoiled; for queries that read them once."""
    k, day = F.col("BILL_NO"), F.col("BILL_DATE")
    when = F.when(k % 7 == 0, F.lit("not a date")).when(k % 11 == 0, F.lit(None).cast("string"))
    when = when.when(k % 5 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    qty = F.when(k % 13 == 0, F.lit("abc")).when(k % 17 == 0, F.lit("-3")).otherwise(F.col("BILL_QUANTITY").cast("string"))
    rate = F.when(k % 19 == 0, F.lit("0")).when(k % 23 == 0, F.lit("NA")).otherwise(F.col("RSP").cast("string"))
    return t.bills.select(
        F.concat(F.lit("  "), F.lower("STORE"), F.lit(" ")).alias("Store Code"),
        F.concat(F.lower("STORE_NAME"), F.lit("\t")).alias("EBO NAME"),
        F.concat(F.lit(" sku  "), "SKU").alias("Item SKU"),
        when.alias("Bill Date"),
        qty.alias("Bill Quantity"),
        rate.alias("Rate"),
        k.cast("string").alias("Bill No"),
    )


RAW_SALES = """kept AS (
  SELECT *, CASE WHEN BILL_NO % 13 = 0 THEN 0 WHEN BILL_NO % 17 = 0 THEN -3 ELSE BILL_QUANTITY END AS rq,
    CASE WHEN BILL_NO % 7 = 0 OR BILL_NO % 11 = 0 THEN NULL ELSE BILL_DATE END AS rd FROM bills
  WHERE NOT (BILL_NO % 19 = 0 OR BILL_NO % 23 = 0))"""


@query(
    "c01_detect_column",
    q(
        BILLS,
        """SELECT 'store' AS wanted, 'Store Code' AS found, count(*) AS lines FROM bills
UNION ALL SELECT 'label', 'EBO NAME', count(*) FROM bills UNION ALL SELECT 'sku', 'Item SKU', count(*) FROM bills
UNION ALL SELECT 'date', 'Bill Date', count(*) FILTER (WHERE BILL_NO % 7 = 0 OR BILL_NO % 11 <> 0) FROM bills
UNION ALL SELECT 'quantity', 'Bill Quantity', count(*) FROM bills UNION ALL SELECT 'rate', 'Rate', count(*) FROM bills""",
    ),
)
def _(t):
    raw = raw_sales(t)
    wanted = {
        "store": cleaning.STORE_NAMES,
        "label": cleaning.STORE_LABEL_NAMES,
        "sku": cleaning.SKU_NAMES,
        "date": cleaning.DATE_NAMES,
        "quantity": cleaning.QUANTITY_NAMES,
        "rate": cleaning.RATE_NAMES,
    }
    found = {w: cleaning.detect_column(raw.columns, names) for w, names in wanted.items()}
    row = raw.agg(*[F.count(F.col(f"`{c}`")).alias(w) for w, c in found.items()])
    cells = [F.struct(F.lit(w).alias("wanted"), F.lit(c).alias("found"), F.col(w).alias("lines")) for w, c in found.items()]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _spoiled():
    return F.concat(F.lit("\t "), F.lower("p_name"), F.lit("   "), F.col("p_type"), F.lit("\n"))


@query("c02_clean_text", "SELECT p_partkey, upper(p_name) || ' ' || upper(p_type) AS cleaned FROM part")
def _(t):
    return t.table("part").select("p_partkey", text.clean_text(_spoiled()).alias("cleaned"))


@query("c03_fast_clean_text", "SELECT p_partkey, upper(p_name) || '   ' || upper(p_type) AS cleaned FROM part")
def _(t):
    return t.table("part").select("p_partkey", text.fast_clean_text(_spoiled()).alias("cleaned"))


@query(
    "c04_safe_numeric",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 0 ELSE round(o_totalprice, 6) + 0.0 END AS amount
FROM orders""",
)
def _(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.lit("n/a")).when(k % 7 == 0, F.lit("NaN")).otherwise(F.col("o_totalprice").cast("string"))
    return t.table("orders").select("o_orderkey", text.safe_numeric(raw).alias("amount"))


@query(
    "c05_coerce_types",
    q(
        BILLS,
        """SELECT lower(STORE) AS "Store Code", 'sku  ' || SKU AS "Item SKU",
  CASE WHEN BILL_NO % 7 = 0 OR BILL_NO % 11 = 0 THEN NULL ELSE BILL_DATE END AS "Bill Date",
  CASE WHEN BILL_NO % 13 = 0 THEN 0 WHEN BILL_NO % 17 = 0 THEN -3 ELSE BILL_QUANTITY END AS "Bill Quantity",
  CASE WHEN BILL_NO % 19 = 0 THEN 0 WHEN BILL_NO % 23 = 0 THEN NULL ELSE RSP END AS "Rate", lower(STORE_NAME) AS "EBO NAME",
  CAST(BILL_NO AS VARCHAR) AS "Bill No" FROM bills""",
        f="Rate",
    ),
)
def _(t):
    out = cleaning.coerce_types(raw_lines(t))
    # The rate stays text; as a number it does not depend on how an engine prints doubles.
    return out.withColumn("Rate", F.col("Rate").cast("double"))


@query(
    "c06_clean_sales",
    q(
        BILLS,
        f"""{RAW_SALES}
SELECT 'SKU  ' || SKU AS SKU, rd AS DATE, rq AS QUANTITY, STORE, STORE_NAME FROM kept WHERE rd IS NOT NULL AND rq > 0""",
        f="QUANTITY",
    ),
)
def _(t):
    return cleaning.clean_sales(raw_lines(t))


@query(
    "c06_clean_sales_base",
    q(
        BILLS,
        f"""{RAW_SALES}
SELECT 'SKU ' || SKU AS SKU, rd AS DATE, rq AS QUANTITY, STORE, STORE_NAME FROM kept WHERE rd IS NOT NULL AND rq > 0""",
        f="QUANTITY",
    ),
)
def _(t):
    return cleaning.clean_sales(raw_lines(t), "base")


def raw_stock(t):
    held = F.when(F.col("STOCK") == 0, F.lit("none")).otherwise(F.col("STOCK").cast("string"))
    return t.stock.select(
        F.concat(F.lit(" "), F.lower("STORE")).alias("store_code"),
        F.lower("STORE_NAME").alias("Store Name"),
        F.col("SKU").alias("EAN"),
        held.alias("Qty"),
    )


@query("c07_clean_stock", q(ALL, "SELECT SKU, STOCK, STORE, STORE_NAME FROM stock", f="STOCK"))
def _(t):
    return cleaning.clean_stock(raw_stock(t))


@query("c08_clean_warehouse", q(ALL, "SELECT SKU, WAREHOUSE_STOCK FROM warehouse", f="WAREHOUSE_STOCK"))
def _(t):
    held = F.when(F.col("WAREHOUSE_STOCK") == 0, F.lit("?")).otherwise(F.col("WAREHOUSE_STOCK").cast("string"))
    raw = t.warehouse.select(
        F.lit("W1").alias("Stock Location"),
        F.concat("SKU", F.lit(" ")).alias("Each Client SKU ID"),
        held.alias("Total Available Quantity"),
    )
    return cleaning.clean_warehouse(raw)


@query("c09_clean_sku_master", q(ALL, "SELECT * FROM sku_master"))
def _(t):
    m = t.sku_master
    raw = m.select(
        F.col("SKU").alias("Product Code"),
        F.lower("STYLE").alias("Style Code"),
        F.concat("COLOR", F.lit("  ")).alias("Colour"),
        F.lower("SIZE").alias("Size"),
    )
    return cleaning.clean_sku_master(raw)


@query("c10_clean_style_master", q(ALL, "SELECT * FROM style_master WHERE GENDER <> 'FREEBIES'"))
def _(t):
    raw = t.style_master.select(F.lower("STYLE").alias("Style"), F.concat(F.lit(" "), F.lower("GENDER")).alias("Department"))
    return cleaning.clean_style_master(raw)


@query(
    "c11_clean_size_master",
    q(
        ALL,
        "SELECT SIZE, upper(SIZE_SET) AS SIZE_SET, CASE WHEN SIZE = '5XL' THEN 4 ELSE MIN_SIZES_REQUIRED END AS MIN_SIZES_REQUIRED FROM size_master",
        i="MIN_SIZES_REQUIRED",
    ),
)
def _(t):
    least = F.when(F.col("SIZE") == "5XL", F.lit("many")).otherwise(F.col("MIN_SIZES_REQUIRED").cast("string"))
    return cleaning.clean_size_master(t.size_master.withColumn("MIN_SIZES_REQUIRED", least))


def mapped_raw(t):
    k = F.col("BILL_NO")
    return t.bills.select(
        F.when(k % 9 == 0, F.lit("?")).otherwise(F.date_format("BILL_DATE", "yyyy-MM-dd")).alias("BILL_DATE"),
        F.col("STORE").alias("store_code"),
        F.col("STORE_NAME").alias("EBO NAME"),
        F.when(k % 14 == 0, F.lit(" ")).otherwise(F.col("SKU")).alias("SKU"),
        F.col("BILL_QUANTITY").cast("string").alias("BILL_QUANTITY"),
        F.when(k % 25 == 0, None).otherwise(F.concat("STYLE", F.lit(" "))).alias("STYLE"),
        "COLOR",
        "SIZE",
        "DEPARTMENT",
        F.col("NET_AMOUNT").cast("string").alias("NET_AMOUNT"),
    )


@query(
    "c12_map_columns",
    q(
        BILLS,
        """SELECT BILL_DATE AS DATE, STORE, STORE_NAME, SKU, BILL_QUANTITY AS QUANTITY, STYLE, COLOR, SIZE, DEPARTMENT,
  CAST(NET_AMOUNT AS DOUBLE) AS NET_AMOUNT FROM bills WHERE BILL_NO % 9 <> 0 AND BILL_NO % 14 <> 0 AND BILL_NO % 25 <> 0""",
        f="QUANTITY NET_AMOUNT",
    ),
)
def _(t):
    return cleaning.map_columns(mapped_raw(t), cleaning.SALES_MAP, need_style=True)


@query(
    "c13_derive_masters",
    q(
        BILLS,
        """SELECT DISTINCT 'sku' AS master, SKU AS key, STYLE || '/' || COLOR || '/' || SIZE AS value FROM bills
UNION ALL SELECT DISTINCT 'style', STYLE, DEPARTMENT FROM bills""",
    ),
)
def _(t):
    skus, styles = cleaning.derive_masters(t.style_sales)
    a = skus.select(F.lit("sku").alias("master"), F.col("SKU").alias("key"), F.concat_ws("/", "STYLE", "COLOR", "SIZE").alias("value"))
    return a.unionByName(styles.select(F.lit("style").alias("master"), F.col("STYLE").alias("key"), F.col("GENDER").alias("value")))


@query("c14_normalise_headers", q(ALL, "SELECT * FROM sku_master"))
def _(t):
    return cleaning.normalise_headers(t.sku_master.toDF(" sku", "Style ", "color", " Size "))


PROMO = """promo AS (
  SELECT *, CASE WHEN BILL_NO % 4 = 0 THEN 'Buy 2 Get 1 FREE' WHEN BILL_NO % 9 = 0 THEN 'a gift' ELSE '10 off' END AS PROMO_NAME,
    CASE WHEN BILL_NO % 21 = 0 THEN 'unisex gym bag' ELSE COLOR END AS ITEM_DESC FROM bills)"""


def promo_lines(t):
    k = F.col("BILL_NO")
    name = F.when(k % 4 == 0, "Buy 2 Get 1 FREE").when(k % 9 == 0, "a gift").otherwise("10 off")
    desc = F.when(k % 21 == 0, "unisex gym bag").otherwise(F.col("COLOR"))
    return t.bills.withColumns({"PROMO_NAME": name, "ITEM_DESC": desc})


def described_master(t):
    desc = F.when(F.col("SKU").cast("int") % 10 == 0, "Trolley Case grey").otherwise(F.col("STYLE"))
    return t.sku_master.select("SKU", desc.alias("DESCRIPTION"))


@query(
    "c15_exclude_promos",
    q(
        BILLS,
        f"""{PROMO}
SELECT BILL_NO, SKU, BILL_QUANTITY, CAST(NET_AMOUNT AS DOUBLE) AS NET_AMOUNT, PROMO_NAME, ITEM_DESC FROM promo
WHERE NET_AMOUNT > 0 AND PROMO_NAME = '10 off' AND ITEM_DESC <> 'unisex gym bag' AND CAST(SKU AS INTEGER) % 10 <> 0""",
        f="BILL_QUANTITY NET_AMOUNT",
    ),
)
def _(t):
    out = cleaning.exclude_promos(promo_lines(t), described_master(t))
    return out.select("BILL_NO", "SKU", "BILL_QUANTITY", "NET_AMOUNT", "PROMO_NAME", "ITEM_DESC")


@query("c19_gender_filter", q(ALL, "SELECT * FROM style_master WHERE GENDER IN ('WOMEN', 'BOYS')"))
def _(t):
    return cleaning.of_genders(t.style_master, ["Women", "Boys"])


@query(
    "c20_enrich_sales",
    q(
        BILLS_ALL,
        """SELECT b.BILL_NO, b.SKU, b.BILL_QUANTITY, b.STYLE, m.STYLE AS STYLE_sku, m.SIZE AS SIZE_sku, GENDER
FROM bills b LEFT JOIN sku_master m ON b.SKU = m.SKU
LEFT JOIN (SELECT * FROM style_master WHERE GENDER IN ('WOMEN', 'BOYS')) g ON b.STYLE = g.STYLE""",
        f="BILL_QUANTITY",
    ),
)
def _(t):
    out = cleaning.enrich_sales(t.bills, t.sku_master, cleaning.of_genders(t.style_master, ["Women", "Boys"]))
    return out.select("BILL_NO", "SKU", "BILL_QUANTITY", "STYLE", "STYLE_sku", "SIZE_sku", "GENDER")


@query(
    "c21_enrich_basket",
    q(
        BILLS_ALL,
        f"""{PROMO}
SELECT p.BILL_NO, p.SKU, p.STYLE, BILL_QUANTITY, GENDER, 'D' AS marker
FROM promo p JOIN style_master g ON p.STYLE = g.STYLE
WHERE NET_AMOUNT > 0 AND PROMO_NAME = '10 off' AND ITEM_DESC <> 'unisex gym bag' AND CAST(SKU AS INTEGER) % 10 <> 0
  AND GENDER <> 'FREEBIES' AND strftime(BILL_DATE, '%Y-%m') = '1998-10'""",
        f="BILL_QUANTITY",
    ),
)
def _(t):
    out = cleaning.enrich_basket(promo_lines(t), described_master(t), t.style_master, "1998-10")
    return out.select("BILL_NO", "SKU", "STYLE", "BILL_QUANTITY", "GENDER", F.lit("D").alias("marker"))


# --- sources and sinks -------------------------------------------------------


def raw_csv(t) -> str:
    """The raw export as CSV files in the shared folder."""
    path = scratch_path(t.spark, "raw_csv")
    raw_sales(t).write.option("header", True).option("ignoreTrailingWhiteSpace", False).option(
        "ignoreLeadingWhiteSpace", False
    ).csv(path)
    return path


@query(
    "i01_csv_scan",
    q(
        BILLS,
        """SELECT count(*) AS lines, count(*) FILTER (WHERE BILL_NO % 7 = 0 OR BILL_NO % 11 <> 0) AS dated,
  count(*) FILTER (WHERE BILL_NO % 19 = 0 OR BILL_NO % 23 <> 0) AS rated, count(DISTINCT BILL_NO) AS bills FROM bills""",
    ),
)
def _(t):
    df = readers.csv_scan(t.spark, raw_csv(t))
    return df.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("`Bill Date`").alias("dated"),
        F.count("Rate").alias("rated"),
        F.count_distinct("`Bill No`").alias("bills"),
    )


@query(
    "i02_path_scan",
    q(
        ALL,
        """SELECT 'sales' AS "table", count(*) AS rows, CAST(5 AS BIGINT) AS columns FROM sales
UNION ALL SELECT 'warehouse', count(*), 2 FROM warehouse""",
        i="columns",
    ),
)
def _(t):
    root = scratch_path(t.spark, "paths")
    t.sales.withColumn("DATE", F.col("DATE").cast("string")).toDF(" sku", "Date", "quantity", "store", "store_name ").write.parquet(f"{root}/sales")
    t.warehouse.write.parquet(f"{root}/warehouse")
    tables = readers.path_scan(
        t.spark, {"sales": f"{root}/sales", "warehouse": f"{root}/warehouse", "stock": f"{root}/stock", "style_master": ""}
    )
    out = None
    for name, df in tables.items():
        dated = F.count_if(F.col("DATE").isNotNull()) if "DATE" in df.columns else F.count(F.lit(1))
        row = df.agg(dated.alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "i03_multi_file_union",
    q(
        SALES,
        """SELECT STORE, count(*) AS lines, sum(QUANTITY) AS units, count(STORE_NAME) FILTER (WHERE DATE < DATE '1998-01-01') AS named
FROM sales GROUP BY 1""",
        f="units",
    ),
)
def _(t):
    early = t.sales.where("DATE < DATE '1998-01-01'")
    late = t.sales.where("DATE >= DATE '1998-01-01'").drop("STORE_NAME")
    both = readers.union_files([early, late])
    return both.groupBy("STORE").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("QUANTITY").alias("units"), F.count("STORE_NAME").alias("named")
    )


def snapshot(t) -> str:
    root = scratch_path(t.spark, "snapshot")
    tables = {"sales": t.sales, "stock": t.stock, "warehouse": t.warehouse, "empty": t.sales.where("SKU IS NULL")}
    snapshots.write_snapshot(tables, root, "2025-11-03T00:00:00")
    return root


@query(
    "i04_snapshot_write",
    q(
        ALL,
        """SELECT 'sales' AS dataset, count(*) AS rows, 'SKU,DATE,QUANTITY,STORE,STORE_NAME' AS columns, '2025-11-03T00:00:00' AS timestamp FROM sales
UNION ALL SELECT 'stock', count(*), 'SKU,STOCK,STORE,STORE_NAME', '2025-11-03T00:00:00' FROM stock
UNION ALL SELECT 'warehouse', count(*), 'SKU,WAREHOUSE_STOCK', '2025-11-03T00:00:00' FROM warehouse""",
    ),
)
def _(t):
    return snapshots.manifest(t.spark, snapshot(t)).select(
        "dataset", "rows", F.array_join("columns", ",").alias("columns"), "timestamp"
    )


@query(
    "i05_snapshot_read",
    q(
        ALL,
        """SELECT STORE, sum(QUANTITY) AS units, (SELECT sum(WAREHOUSE_STOCK) FROM warehouse) AS central,
  CAST(3 AS BIGINT) AS datasets FROM sales GROUP BY 1""",
        f="units central",
    ),
)
def _(t):
    tables = snapshots.read_snapshot(t.spark, snapshot(t))
    central = tables["warehouse"].agg(F.sum("WAREHOUSE_STOCK").alias("c")).scalar()
    units = tables["sales"].groupBy("STORE").agg(F.sum("QUANTITY").alias("units"))
    return units.withColumn("central", central).withColumn("datasets", F.lit(len(tables)))


@query(
    "i05_snapshot_versions",
    q(
        ALL,
        """SELECT 'first' AS reader, count(*) AS rows, sum(STOCK) AS units FROM stock
UNION ALL SELECT 'second', count(*), sum(STOCK + 1) FROM stock WHERE STOCK > 0""",
        f="units",
    ),
)
def _(t):
    """A reader keeps the snapshot that it opened while another one is published."""
    root = scratch_path(t.spark, "snapshot")
    snapshots.write_snapshot({"stock": t.stock}, root, "2025-11-03T00:00:00")
    first = snapshots.read_snapshot(t.spark, root)["stock"]
    snapshots.write_snapshot({"stock": t.stock.where("STOCK > 0").withColumn("STOCK", F.col("STOCK") + 1)}, root, "2025-11-04T00:00:00")
    second = snapshots.read_snapshot(t.spark, root)["stock"]
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.sum("STOCK").alias("units")).select(F.lit(name).alias("reader"), "rows", "units")
        for name, df in (("first", first), ("second", second))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "i06_snapshot_info",
    q(
        ALL,
        """SELECT CAST(3 AS BIGINT) AS datasets, (SELECT count(*) FROM sales) + (SELECT count(*) FROM stock) + (SELECT count(*) FROM warehouse)
  AS total_rows, TRUE AS sized, '2025-11-03T00:00:00' AS last_updated""",
    ),
)
def _(t):
    info = snapshots.snapshot_info(t.spark, snapshot(t))
    return info.select("datasets", "total_rows", (F.col("total_size_mb") > 0).alias("sized"), "last_updated")


_STORES: dict[tuple, SalesStore] = {}


def filled_store(t) -> SalesStore:
    """Two uploads: bills up to 1998, then bills from 1998 on with 1998 corrected; the
    second is delivered twice, and the merged table made in between and after. Filled once
    per application."""
    key = (t.spark.sparkContext.applicationId, t.state)
    if key not in _STORES:
        _STORES[key] = _fill_store(t)
    return _STORES[key]


def store_lines(t):
    return t.bills.select(
        F.col("BILL_DATE").alias("date"),
        F.col("STORE").alias("store"),
        F.col("SKU").alias("sku"),
        F.col("BILL_QUANTITY").alias("quantity"),
        F.col("NET_AMOUNT").alias("amount"),
        F.col("BILL_NO").cast("string").alias("bill_no"),
        month_of("BILL_DATE").alias("sale_month"),
    )


def written_lines(t):
    """The lines that uploads are made of: several uploads, one join of the given tables."""
    return shared(t, "store_lines", lambda: store_lines(t).drop("sale_month"))


def _fill_store(t) -> SalesStore:
    store = SalesStore(t.spark, scratch_path(t.spark, "store"))
    lines = written_lines(t)
    store.append(lines.where("date < DATE '1999-01-01'"), "first.csv", 1)
    again = lines.where("date >= DATE '1998-01-01'").withColumn("quantity", F.col("quantity") + 1)
    store.append(again, "second.csv", 2)
    store.merge()
    store.append(again, "second.csv", 2)
    store.merge()
    return store


STORED = """stored AS (
  SELECT BILL_DATE AS date, STORE AS store, SKU AS sku, BILL_QUANTITY AS quantity, CAST(NET_AMOUNT AS DOUBLE) AS amount,
    BILL_NO AS bill_no, 1 AS batch FROM bills WHERE BILL_DATE < DATE '1999-01-01'
  UNION ALL SELECT BILL_DATE, STORE, SKU, BILL_QUANTITY + 1, CAST(NET_AMOUNT AS DOUBLE), BILL_NO, 2 FROM bills WHERE BILL_DATE >= DATE '1998-01-01')"""


@query(
    "i07_sales_append",
    q(BILLS, f"{STORED} SELECT batch, count(*) AS lines, sum(quantity) AS units, min(date) AS first, max(date) AS last FROM stored GROUP BY 1", f="units", i="batch"),
)
def _(t):
    return _fill_store(t).rows().groupBy("batch").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.min("date").alias("first"), F.max("date").alias("last")
    )


@query(
    "i08_sales_read_all",
    q(BILLS, f"{STORED} SELECT date, store, sku, quantity, amount, bill_no, batch FROM stored", f="quantity amount", i="batch", s="bill_no"),
)
def _(t):
    return filled_store(t).read_all().select("date", "store", "sku", "quantity", "amount", "bill_no", "batch")


@query(
    "i09_sales_summary",
    q(BILLS, f"{STORED} SELECT count(*) AS total_rows, CAST(min(date) AS VARCHAR) AS min_date, CAST(max(date) AS VARCHAR) AS max_date FROM stored"),
)
def _(t):
    return filled_store(t).summary()


@query("i10_merge_append", q(BILLS, f"{STORED} SELECT count(*) AS lines, sum(quantity) AS units FROM stored", f="units"))
def _(t):
    return filled_store(t).merged("append").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))


@query(
    "i10_merge_update",
    q(
        BILLS,
        f"""{STORED},
m AS (SELECT *, max(batch) OVER (PARTITION BY date, store, sku, bill_no) AS newest FROM stored)
SELECT strftime(date, '%Y-%m') AS month, count(*) AS lines, sum(quantity) AS units FROM m WHERE batch = newest GROUP BY 1""",
        f="units",
    ),
)
def _(t):
    rows = filled_store(t).merged("update")
    return rows.groupBy(month_of("date").alias("month")).agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))


@query(
    "i10_update_one_month",
    q(
        BILLS,
        f"""{STORED},
third AS (SELECT * FROM stored UNION ALL SELECT BILL_DATE, STORE, SKU, BILL_QUANTITY + 2, CAST(NET_AMOUNT AS DOUBLE), BILL_NO, 3 FROM bills
  WHERE strftime(BILL_DATE, '%Y-%m') = '1998-03' AND BILL_NO % 2 = 0),
m AS (SELECT *, max(batch) OVER (PARTITION BY date, store, sku, bill_no) AS newest FROM third)
SELECT strftime(date, '%Y-%m') AS month, count(*) AS lines, sum(quantity) AS units, strftime(date, '%Y-%m') = '1998-03' AS rewritten
FROM m WHERE batch = newest GROUP BY 1, 4""",
        f="units",
    ),
)
def _(t):
    """A third upload corrects half of the bills of one month: the merge rewrites that month."""
    store = _fill_store(t)
    lines = written_lines(t).where((month_of("date") == "1998-03") & (F.col("bill_no").cast("long") % 2 == 0))
    store.append(lines.withColumn("quantity", F.col("quantity") + 2), "third.csv", 3)
    months = store.merge()
    rows = store.merged("update").groupBy(month_of("date").alias("month")).agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))
    return rows.withColumn("rewritten", F.col("month").isin(months))


@query(
    "i09_month_statistics",
    q(
        BILLS,
        f"""{STORED} SELECT strftime(date, '%Y-%m') AS sale_month, count(*) AS rows, min(date) AS first, max(date) AS last, sum(quantity) AS units
FROM stored GROUP BY 1""",
        f="units",
    ),
)
def _(t):
    return filled_store(t).month_statistics()


@query(
    "i07_compacted_store",
    q(
        BILLS,
        f"""{STORED} SELECT batch, count(*) AS lines, sum(quantity) AS units,
  (SELECT count(DISTINCT strftime(date, '%Y-%m')) FROM stored WHERE batch = 2) AS folders FROM stored GROUP BY 1""",
        f="units",
        i="batch",
    ),
)
def _(t):
    """Compaction deletes the folders of the second upload's first delivery."""
    store = SalesStore(t.spark, scratch_path(t.spark, "store"))
    lines = written_lines(t)
    again = lines.where("date >= DATE '1998-01-01'").withColumn("quantity", F.col("quantity") + 1)
    store.append(lines.where("date < DATE '1999-01-01'"), "first.csv", 1)
    store.append(again, "second.csv", 2)
    store.append(again, "second.csv", 2)
    folders = store.compact(grace_seconds=0)
    per = store.rows().groupBy("batch").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))
    return per.withColumn("folders", F.lit(folders))


@query(
    "i10_merge_dedupe",
    q(
        BILLS,
        """twice AS (SELECT BILL_DATE AS date, STORE AS store, SKU AS sku, BILL_QUANTITY AS quantity FROM bills),
d AS (SELECT DISTINCT * FROM twice)
SELECT store, count(*) AS lines, sum(quantity) AS units FROM d GROUP BY 1""",
        f="units",
    ),
)
def _(t):
    lines = t.bills.select(
        F.col("BILL_DATE").alias("date"), F.col("STORE").alias("store"), F.col("SKU").alias("sku"), F.col("BILL_QUANTITY").alias("quantity")
    )
    both = lines.withColumn("batch", F.lit(1)).unionByName(lines.withColumn("batch", F.lit(2)))
    return merge_batches(both, "dedupe").groupBy("store").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))


@query(
    "i11_history_list",
    q(
        BILLS,
        f"""{STORED}
SELECT 'sales' AS type, CAST(2 AS BIGINT) AS uploads, count(*) AS total_rows, 'second.csv' AS filename,
  count(*) FILTER (WHERE batch = 2) AS rows_count, CAST(6 AS BIGINT) AS columns_count FROM stored""",
    ),
)
def _(t):
    return filled_store(t).latest_uploads()


@query(
    "i12_lineage_column",
    q(SALES, "SELECT STORE, 'admin' AS uploaded_by, count(*) AS lines FROM sales GROUP BY 1"),
)
def _(t):
    return readers.with_uploader(t.sales, "admin").groupBy("STORE", "uploaded_by").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "i13_plan_csv_sink",
    q(
        ALL,
        f"""{BASE_SQL}
SELECT 'STORE,STORE_NAME,SKU,STYLE,COLOR,SIZE,GENDER,STOCK,WAREHOUSE_STOCK,DAILY_SALES,STOCK_COVER_DAYS,TARGET_STOCK,REPLEN_QTY,'
  || 'FINAL_REPLEN_QTY,PRIORITY_SCORE,REMARKS,IS_NEW_ITEM' AS first_columns, count(*) AS lines, sum(FINAL_REPLEN_QTY) AS units
FROM base_plan WHERE FINAL_REPLEN_QTY > 0""",
        f="units",
    ),
)
def _(t):
    path = scratch_path(t.spark, "plan_csv")
    readers.write_plan_csv(plan_views.recommendations(base_plan(t)), path)
    back = readers.csv_scan(t.spark, path)
    return back.agg(
        F.lit(",".join(back.columns[:17])).alias("first_columns"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("FINAL_REPLEN_QTY").cast("double")).alias("units"),
    )


@query(
    "i14_report_sink",
    q(
        ALL,
        """SELECT 'by_store' AS "table", count(DISTINCT STORE) AS rows, sum(QUANTITY) AS units FROM sales
UNION ALL SELECT 'by_day', count(DISTINCT DATE), sum(QUANTITY) FROM sales""",
        f="units",
    ),
)
def _(t):
    path = scratch_path(t.spark, "report")
    readers.write_report(
        {
            "by_store": t.sales.groupBy("STORE").agg(F.sum("QUANTITY").alias("units")),
            "by_day": t.sales.groupBy("DATE").agg(F.sum("QUANTITY").alias("units")),
        },
        path,
    )
    parts = [
        t.spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units")).select(
            F.lit(n).alias("table"), "rows", "units"
        )
        for n in ("by_store", "by_day")
    ]
    return parts[0].unionByName(parts[1])


RECORDS = """SELECT SKU AS sku, STORE AS store, FINAL_REPLEN_QTY AS quantity, PRIORITY_SCORE AS priority_score, STOCK AS current_stock,
  DAILY_SALES AS sales_velocity, WAREHOUSE_STOCK AS warehouse_stock FROM base_plan"""


@query(
    "i15_plan_records",
    q(
        ALL,
        f"{BASE_SQL} {RECORDS}",
        f="quantity priority_score current_stock sales_velocity warehouse_stock",
    ),
)
def _(t):
    path = scratch_path(t.spark, "records")
    readers.write_plan_records(base_plan(t), path)
    kinds = "sku string, store string, quantity double, priority_score double, current_stock double, sales_velocity double, warehouse_stock double"
    return t.spark.read.schema(kinds).json(path)


CLEAN_STORED = f"""{RAW_SALES},
stored AS (SELECT rd AS date, STORE AS store, 'SKU  ' || SKU AS sku, rq AS quantity, BILL_NO AS bill_no FROM kept WHERE rd IS NOT NULL AND rq > 0)"""
BY_MONTH = "SELECT strftime(date, '%Y-%m') AS month, count(*) AS lines, sum(quantity) AS units, count(DISTINCT bill_no) AS bills FROM stored GROUP BY 1"


def by_month(rows):
    return rows.groupBy(month_of("date").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.count_distinct("bill_no").alias("bills")
    )


@query("i16_attachment_ingest", q(BILLS, f"{CLEAN_STORED} {BY_MONTH}", f="units"))
def _(t):
    raw = raw_sales(t)
    number = F.col("Bill No").cast("bigint")
    store = SalesStore(t.spark, scratch_path(t.spark, "store"))
    ingest_attachments(store, [raw.where(number % 2 == 0), raw.where(number % 2 == 1)], "mail", 1)
    return by_month(store.rows())


@query("s01_landing_ingest", q(BILLS, f"{CLEAN_STORED} {BY_MONTH}", f="units"))
def _(t):
    """Files land in two lots; each run of the stream takes what is new, and the last
    batch delivered once more changes nothing."""
    spark = t.spark
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "offsets")
    store = SalesStore(spark, scratch_path(spark, "store"))
    raw = raw_sales(t)
    number = F.col("Bill No").cast("bigint")
    for part in (0, 1):
        lot = raw.where(number % 2 == part)
        lot.write.mode("append").option("header", True).option("ignoreTrailingWhiteSpace", False).option(
            "ignoreLeadingWhiteSpace", False
        ).csv(landing)
        query = landing_ingest(spark, landing, raw.columns, store, checkpoint)
        query.awaitTermination()
    ingest_batch(store, raw.where(number % 2 == 1), 1, origin=stream_origin(query.id))
    return by_month(store.rows())

