"""Common table expressions that map the test tables to the canonical tables."""

X = """x AS (
  SELECT *, CAST(o_orderdate AS DATE) AS d,
         'ST' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS st,
         CAST(split_part(p_brand, '#', 2) AS INTEGER) AS bno
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey)"""

SALES = X + """,
sales AS (
  SELECT CAST(l_partkey AS VARCHAR) AS SKU, d AS DATE, l_quantity AS QUANTITY, st AS STORE, n_name AS STORE_NAME FROM x)"""

ITEM = """upper(p_brand) AS STYLE,
    upper(split_part(p_name, ' ', 1)) AS COLOR,
    (['XS','S','M','L','XL','2XL','3XL','4XL','5XL'])[CAST(p_size % 9 AS INTEGER) + 1] AS SIZE,
    upper(split_part(p_name, ' ', 2)) AS CATEGORY, p_type AS DEPARTMENT"""

BILLS = X + f""",
bills AS (
  SELECT d AS BILL_DATE, l_orderkey AS BILL_NO, st AS STORE, n_name AS STORE_NAME,
    CAST(l_partkey AS VARCHAR) AS SKU, l_quantity AS BILL_QUANTITY, {ITEM},
    CAST(l_extendedprice AS DECIMAL(18,4)) AS GROSS_AMOUNT,
    CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS NET_AMOUNT,
    CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS ITEM_DISCOUNT_AMOUNT,
    CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS PROMO_AMOUNT,
    p_retailprice AS RSP,
    CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND bno % 5 = 0) THEN 'Y' ELSE 'N' END AS VOID_STATUS
  FROM x)"""

MASTERS = f"""sku_attributes AS (SELECT CAST(p_partkey AS VARCHAR) AS SKU, {ITEM} FROM part),
sku_master AS (SELECT SKU, STYLE, COLOR, SIZE FROM sku_attributes),
style_master AS (
  SELECT DISTINCT upper(p_brand) AS STYLE,
    CASE CAST(split_part(p_brand, '#', 2) AS INTEGER) % 5
      WHEN 0 THEN 'FREEBIES' WHEN 1 THEN 'WOMEN' WHEN 2 THEN 'BOYS' WHEN 3 THEN 'UNISEX' ELSE 'MENS' END AS GENDER
  FROM part WHERE p_brand <> 'Brand#25'),
warehouse AS (
  SELECT CAST(p_partkey AS VARCHAR) AS SKU,
    CAST(CASE WHEN (p_partkey * 37) % 61 < 8 THEN 0 ELSE (p_partkey * 37) % 61 END AS DOUBLE) AS WAREHOUSE_STOCK
  FROM part),
size_master AS (
  SELECT * FROM (VALUES ('S','Regular',4),('M','Regular',4),('L','Regular',4),('XL','Regular',4),('2XL','Regular',4),
    ('3XL','Plus',3),('4XL','Plus',3),('5XL','Plus',3)) t(SIZE, SIZE_SET, MIN_SIZES_REQUIRED))"""

STOCK = """stock AS (
  SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS SKU,
    CAST(CASE WHEN (n_nationkey * 7 + l_partkey * 13) % 11 < 2 THEN 0
         ELSE (n_nationkey * 7 + l_partkey * 13) % 11 END AS DOUBLE) AS STOCK,
    st AS STORE, n_name AS STORE_NAME
  FROM x)"""

ALL = f"{SALES}, {STOCK}, {MASTERS}"
BILLS_ALL = f"{BILLS}, {STOCK}, {MASTERS}"
STYLE_SALES = BILLS_ALL + """,
style_sales AS (
  SELECT BILL_DATE AS DATE, STORE, STORE_NAME, SKU, STYLE, COLOR, SIZE, DEPARTMENT,
    BILL_QUANTITY AS QUANTITY, NET_AMOUNT FROM bills)"""


def q(ctes: str, body: str, f: str = "", i: str = "", s: str = "") -> str:
    """A full statement. body is a SELECT, or more CTEs ending in one. f: columns to
    round to 6 places, i: to BIGINT, s: to VARCHAR (comma-separated)."""
    body = body.strip()
    sep = "" if body[:6].upper() == "SELECT" else ","
    inner = f"WITH {ctes}{sep}\n{body}"
    changes = [f'round(CAST("{c}" AS DOUBLE) + 1e-9, 6) + 0.0 AS "{c}"' for c in f.split()]
    changes += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in i.split()]
    changes += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in s.split()]
    if not changes:
        return inner
    return f"SELECT * REPLACE ({', '.join(changes)}) FROM (\n{inner}\n) result"
