"""Replenishment steps, both editions, the allocation variants and the plan views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aislebrook.functions.stats import month_of
from aislebrook.model import ReplenishParams
from aislebrook.operators import demand, plan_steps, plan_views, replenish_base, replenish_final, replenish_variants
from aislebrook.operators.priority import store_priority
from aislebrook.plans import replenishment as plans
from aislebrook.sources.scratch import materialize

from .demand import D01, PRIORITY
from .registry import kept, query, sales_and_stock
from .sqlbase import ALL, SALES, q

BASE = ReplenishParams(exception_styles=("BRAND#3",))

PAIRS = """pairs AS (
  SELECT coalesce(v.STORE, k.STORE) AS STORE, coalesce(v.SKU, k.SKU) AS SKU,
    coalesce(DAILY_SALES, 0) AS v, coalesce(STOCK, 0) AS st
  FROM vel v FULL JOIN stock k ON v.STORE = k.STORE AND v.SKU = k.SKU),
covered AS (SELECT *, CASE WHEN v > 0 THEN st / v WHEN st > 0 THEN 999 ELSE 0 END AS cover FROM pairs)"""

NEED = """need1 AS (SELECT *, ceil(round(fc, 6)) AS target FROM need0),
need AS (
  SELECT *, CASE WHEN target - st > 0 AND v > 0 THEN greatest(target - st, 2) ELSE 0 END AS need,
    (v = 0 AND st = 0) AS is_new
  FROM need1),
names AS (SELECT STORE, min(STORE_NAME) AS STORE_NAME FROM sales GROUP BY 1)"""

BASE_SQL = f"""{D01}, {PAIRS},
need0 AS (SELECT *, v * 31 AS fc FROM covered), {NEED}, {PRIORITY},
sets AS (
  SELECT STYLE, COLOR, bool_and(WAREHOUSE_STOCK >= 2) AS full_set
  FROM warehouse w JOIN sku_master m ON w.SKU = m.SKU GROUP BY 1, 2),
rows0 AS (
  SELECT n.*, p.PRIORITY_SCORE AS pr, nm.STORE_NAME, coalesce(w.WAREHOUSE_STOCK, 0) AS W, m.STYLE, m.COLOR, m.SIZE,
    coalesce(g.GENDER, 'UNISEX') AS GENDER, full_set
  FROM need n LEFT JOIN priority p ON n.STORE = p.STORE LEFT JOIN names nm ON n.STORE = nm.STORE
  LEFT JOIN warehouse w ON n.SKU = w.SKU LEFT JOIN sku_master m ON n.SKU = m.SKU
  LEFT JOIN style_master g ON m.STYLE = g.STYLE
  LEFT JOIN sets s ON m.STYLE = s.STYLE AND m.COLOR = s.COLOR
  WHERE coalesce(g.GENDER, 'UNISEX') <> 'FREEBIES'),
rows1 AS (
  SELECT *, sum(need) OVER k AS td, sum(pr * need) OVER k AS tw, count(*) OVER k AS n,
    row_number() OVER (PARTITION BY SKU ORDER BY pr DESC, STORE) AS rn
  FROM rows0 WINDOW k AS (PARTITION BY SKU)),
base_plan AS (
  SELECT STORE, STORE_NAME, SKU, STYLE, COLOR, SIZE, GENDER, st AS STOCK, W AS WAREHOUSE_STOCK, v AS DAILY_SALES,
    cover AS STOCK_COVER_DAYS, fc AS FORECAST_DEMAND, target AS TARGET_STOCK, need AS REPLEN_QTY, is_new AS IS_NEW_ITEM,
    pr AS PRIORITY_SCORE, td AS TOTAL_DEMAND,
    floor(CASE WHEN W <= 0 THEN 0
      WHEN td > W THEN CASE WHEN tw > 0 THEN floor(round(pr * need / tw * W, 6))
        ELSE floor(W / n) + CASE WHEN rn <= W - floor(W / n) * n THEN 1 ELSE 0 END END
      WHEN need > 0 THEN CASE WHEN full_set THEN greatest(2, need) ELSE least(greatest(2, need), W) END
      ELSE 0 END) AS FINAL_REPLEN_QTY,
    CASE WHEN W <= 0 THEN 'No warehouse stock available'
      WHEN td > W THEN 'Warehouse stock insufficient: Demand=' || CAST(CAST(td AS BIGINT) AS VARCHAR) || ', Short by '
        || CAST(CAST(td - W AS BIGINT) AS VARCHAR) || ' units'
      ELSE '' END AS REMARKS
  FROM rows1),
style_sets AS (SELECT STYLE, bool_and(FINAL_REPLEN_QTY > 0) AS COMPLETE_SIZE_SET FROM base_plan GROUP BY 1)"""

PLAN_NUMBERS = (
    "STOCK WAREHOUSE_STOCK DAILY_SALES STOCK_COVER_DAYS FORECAST_DEMAND TARGET_STOCK REPLEN_QTY PRIORITY_SCORE "
    "TOTAL_DEMAND FINAL_REPLEN_QTY"
)


def base_plan(t):
    rows = kept(t, "base_plan", lambda: plans.base_rows(*sales_and_stock(t), t.warehouse, t.sku_master, t.style_master, BASE))
    return replenish_base.with_complete_size_set(rows.drop("ALL_SIZES"))


# --- single steps ------------------------------------------------------------


@query(
    "r05_stock_cover",
    q(
        ALL,
        f"{D01}, {PAIRS} SELECT STORE, SKU, v AS DAILY_SALES, st AS STOCK, cover AS STOCK_COVER_DAYS FROM covered",
        f="DAILY_SALES STOCK STOCK_COVER_DAYS",
    ),
)
def _(t):
    return plan_steps.with_stock_cover(plan_steps.pairs(demand.velocity_simple(t.sales, 90), t.stock))


@query(
    "r12_forecast_base",
    q(
        ALL,
        f"{D01}, {PAIRS} SELECT STORE, SKU, v AS DAILY_SALES, st AS STOCK, v * 31 AS FORECAST_DEMAND FROM covered",
        f="DAILY_SALES STOCK FORECAST_DEMAND",
    ),
)
def _(t):
    return plan_steps.with_base_forecast(plan_steps.pairs(demand.velocity_simple(t.sales, 90), t.stock), BASE)


@query(
    "r13_target_and_need",
    q(
        ALL,
        f"""{D01}, {PAIRS}, need0 AS (SELECT *, v * 31 AS fc FROM covered), {NEED}, {PRIORITY}
SELECT n.STORE, SKU, v AS DAILY_SALES, n.st AS STOCK, cover AS STOCK_COVER_DAYS, fc AS FORECAST_DEMAND,
  target AS TARGET_STOCK, need AS REPLEN_QTY, is_new AS IS_NEW_ITEM, PRIORITY_SCORE, STORE_NAME
FROM need n JOIN priority p ON n.STORE = p.STORE JOIN names m ON n.STORE = m.STORE""",
        f="DAILY_SALES STOCK STOCK_COVER_DAYS FORECAST_DEMAND TARGET_STOCK REPLEN_QTY PRIORITY_SCORE",
    ),
)
def _(t):
    sales, stock = sales_and_stock(t)
    return replenish_base.needs(sales, stock, store_priority(sales, stock, 90), BASE)


@query(
    "r03_sku_universe",
    q(
        ALL,
        f"""{D01},
skus AS (SELECT SKU FROM vel UNION SELECT SKU FROM stock WHERE STOCK > 0 UNION SELECT SKU FROM warehouse)
SELECT STORE, SKU FROM (SELECT DISTINCT STORE FROM stock) s CROSS JOIN skus""",
    ),
)
def _(t):
    vel = demand.velocity_simple(t.sales, 90)
    return replenish_final.store_sku_grid(t.stock, replenish_final.sku_universe(vel, t.stock, t.warehouse))


@query(
    "r04_sku_attributes",
    q(
        ALL,
        """codes AS (
  SELECT SKU FROM warehouse UNION ALL
  SELECT 'X' || STYLE || COLOR || SIZE FROM sku_master UNION ALL SELECT lower(COLOR) FROM sku_master)
SELECT c.SKU,
  CASE WHEN m.SKU IS NOT NULL THEN m.STYLE
    ELSE coalesce(nullif(regexp_extract(c.SKU, '([A-Z][A-Z0-9]+)', 1), ''), 'UNKNOWN') END AS STYLE,
  CASE WHEN m.SKU IS NOT NULL THEN m.COLOR
    ELSE coalesce(nullif(substr(c.SKU, greatest(length(c.SKU) - 5, 0) + 1,
      greatest(length(c.SKU) - 2, 0) - greatest(length(c.SKU) - 5, 0)), ''), 'UNK') END AS COLOR,
  CASE WHEN m.SKU IS NOT NULL THEN m.SIZE ELSE coalesce(nullif(right(c.SKU, 2), ''), 'M') END AS SIZE
FROM codes c LEFT JOIN sku_master m ON c.SKU = m.SKU""",
    ),
)
def _(t):
    m = t.sku_master
    codes = (
        t.warehouse.select("SKU")
        .union(m.select(F.concat(F.lit("X"), "STYLE", "COLOR", "SIZE")))
        .union(m.select(F.lower("COLOR")))
    )
    return replenish_final.with_attributes(codes, m)


@query(
    "r08_seasonal_factor",
    q(
        SALES,
        """SELECT strftime(DATE, '%Y-%m') AS month,
  CASE month(any_value(DATE)) WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 1.1 WHEN 7 THEN 0.9 WHEN 8 THEN 0.9 WHEN 9 THEN 1.1
    WHEN 10 THEN 1.2 WHEN 11 THEN 1.3 WHEN 12 THEN 1.4 ELSE 1.0 END AS factor, sum(QUANTITY) AS units
FROM sales GROUP BY 1""",
        f="factor units",
    ),
)
def _(t):
    months = t.sales.groupBy(month_of("DATE").alias("month")).agg(
        F.min("DATE").alias("d"), F.sum("QUANTITY").alias("units")
    )
    return months.select("month", replenish_final.seasonal_factor(F.col("d")).alias("factor"), "units")


# --- base edition ------------------------------------------------------------


@query(
    "r19_allocate_base",
    q(
        ALL,
        f"""{BASE_SQL}
SELECT b.*, coalesce(s.COMPLETE_SIZE_SET, FALSE) AS COMPLETE_SIZE_SET FROM base_plan b LEFT JOIN style_sets s ON b.STYLE = s.STYLE""",
        f=PLAN_NUMBERS,
    ),
)
def _(t):
    return plans.base_plan(*sales_and_stock(t), t.warehouse, t.sku_master, t.style_master, BASE).drop("ALL_SIZES")


@query(
    "r14_attach_gender",
    q(
        ALL,
        """styles AS (SELECT DISTINCT STYLE FROM sku_master UNION ALL SELECT DISTINCT 'GYM BAG ' || COLOR FROM sku_master)
SELECT s.STYLE, coalesce(g.GENDER, CASE WHEN s.STYLE LIKE '%BAG%' THEN 'FREEBIES' ELSE 'UNKNOWN' END) AS GENDER
FROM styles s LEFT JOIN style_master g ON s.STYLE = g.STYLE""",
    ),
)
def _(t):
    m = t.sku_master
    styles = m.select("STYLE").distinct().union(m.select(F.concat(F.lit("GYM BAG "), "COLOR")).distinct())
    return replenish_final.with_gender(styles, t.style_master)


@query(
    "r23_complete_size_set",
    q(
        ALL,
        f"""{BASE_SQL},
chosen AS (SELECT *, CASE WHEN STYLE = 'BRAND#4' THEN 1 ELSE FINAL_REPLEN_QTY END AS fq FROM base_plan)
SELECT STYLE, bool_and(fq > 0) AS COMPLETE_SIZE_SET, count(*) AS rows FROM chosen GROUP BY 1""",
    ),
)
def _(t):
    qty = F.when(F.col("STYLE") == "BRAND#4", F.lit(1.0)).otherwise(F.col("FINAL_REPLEN_QTY"))
    plan = base_plan(t).drop("COMPLETE_SIZE_SET").withColumn("FINAL_REPLEN_QTY", qty)
    flagged = replenish_base.with_complete_size_set(plan)
    return flagged.groupBy("STYLE", "COMPLETE_SIZE_SET").agg(F.count(F.lit(1)).alias("rows"))


# --- variants ----------------------------------------------------------------


@query(
    "r24_allocate_remainder",
    q(
        ALL,
        f"""{BASE_SQL},
w0 AS (SELECT *, PRIORITY_SCORE * (1 / (STOCK_COVER_DAYS + 1)) * greatest(DAILY_SALES, 0.1) AS wt FROM base_plan),
w1 AS (SELECT *, round(coalesce(wt / nullif(sum(wt) OVER (PARTITION BY SKU), 0) * WAREHOUSE_STOCK, 0), 6) AS share FROM w0),
w2 AS (
  SELECT *, floor(share) AS b, round(share - floor(share), 6) AS part,
    floor(WAREHOUSE_STOCK - sum(floor(share)) OVER (PARTITION BY SKU)) AS rest FROM w1),
w3 AS (SELECT *, row_number() OVER (PARTITION BY SKU ORDER BY part DESC, STORE) AS rn FROM w2)
SELECT STORE, SKU, WAREHOUSE_STOCK, REPLEN_QTY,
  CASE WHEN TOTAL_DEMAND <= WAREHOUSE_STOCK THEN REPLEN_QTY ELSE b + CASE WHEN rn <= rest THEN 1 ELSE 0 END END AS OPTIMIZED_QTY
FROM w3""",
        f="WAREHOUSE_STOCK REPLEN_QTY OPTIMIZED_QTY",
    ),
)
def _(t):
    out = replenish_variants.allocate_remainder(base_plan(t))
    return out.select("STORE", "SKU", "WAREHOUSE_STOCK", "REPLEN_QTY", "OPTIMIZED_QTY")


@query(
    "r25_pack_rounding",
    q(
        ALL,
        f"""{BASE_SQL},
packed AS (
  SELECT *, least(CASE WHEN REPLEN_QTY > 0 THEN greatest(ceil(round(REPLEN_QTY / 6, 6)) * 6, 2) ELSE 0 END,
    WAREHOUSE_STOCK) AS pq FROM base_plan)
SELECT STORE, SKU, WAREHOUSE_STOCK, REPLEN_QTY, CASE WHEN pq < 2 THEN 0 ELSE pq END AS FINAL_REPLEN_QTY FROM packed""",
        f="WAREHOUSE_STOCK REPLEN_QTY FINAL_REPLEN_QTY",
    ),
)
def _(t):
    out = replenish_variants.round_to_packs(base_plan(t))
    return out.select("STORE", "SKU", "WAREHOUSE_STOCK", "REPLEN_QTY", "FINAL_REPLEN_QTY")


@query(
    "r26_allocate_priority",
    q(
        ALL,
        f"""{BASE_SQL},
a0 AS (
  SELECT *, sum(PRIORITY_SCORE * REPLEN_QTY) OVER (PARTITION BY SKU) AS tw, count(*) OVER (PARTITION BY SKU) AS n,
    row_number() OVER (PARTITION BY SKU ORDER BY PRIORITY_SCORE DESC, STOCK_COVER_DAYS, STORE) AS rn FROM base_plan)
SELECT STORE, SKU, REPLEN_QTY, WAREHOUSE_STOCK,
  CASE WHEN TOTAL_DEMAND > WAREHOUSE_STOCK AND WAREHOUSE_STOCK > 0 THEN
    CASE WHEN tw > 0 THEN floor(round(PRIORITY_SCORE * REPLEN_QTY / tw * WAREHOUSE_STOCK, 6))
    ELSE floor(WAREHOUSE_STOCK / n) + CASE WHEN rn <= WAREHOUSE_STOCK - floor(WAREHOUSE_STOCK / n) * n THEN 1 ELSE 0 END END
  ELSE REPLEN_QTY END AS FINAL_REPLEN_QTY
FROM a0""",
        f="REPLEN_QTY WAREHOUSE_STOCK FINAL_REPLEN_QTY",
    ),
)
def _(t):
    out = replenish_variants.allocate_priority(base_plan(t))
    return out.select("STORE", "SKU", "REPLEN_QTY", "WAREHOUSE_STOCK", "FINAL_REPLEN_QTY")


# --- plan views --------------------------------------------------------------


@query(
    "r27_plan_overview",
    q(
        ALL,
        f"""{BASE_SQL}
SELECT sum(FINAL_REPLEN_QTY) AS total_replen_qty,
  count(DISTINCT CASE WHEN FINAL_REPLEN_QTY > 0 THEN STORE END) AS stores_needing_stock,
  count(DISTINCT CASE WHEN FINAL_REPLEN_QTY > 0 THEN SKU END) AS skus_to_replenish,
  count(*) FILTER (WHERE IS_NEW_ITEM) AS new_items,
  quantile_cont(STOCK_COVER_DAYS, 0.5) FILTER (WHERE STOCK_COVER_DAYS < 999) AS median_stock_cover
FROM base_plan""",
        f="total_replen_qty median_stock_cover",
    ),
)
def _(t):
    return plan_views.overview(base_plan(t))


@query(
    "r28_recommendations",
    q(
        ALL,
        f"""{BASE_SQL}
SELECT STORE || ' - ' || STORE_NAME AS STORE_DISPLAY, SKU, STYLE, COLOR, SIZE, GENDER, STOCK,
  round(round(DAILY_SALES, 9), 2) AS DAILY_SALES, round(round(STOCK_COVER_DAYS, 9), 1) AS STOCK_COVER_DAYS, TARGET_STOCK,
  FINAL_REPLEN_QTY, STOCK = 0 AS STOCK_OUT, STOCK_COVER_DAYS < 8 AND DAILY_SALES > 0 AS CRITICAL_STOCK
FROM base_plan WHERE FINAL_REPLEN_QTY > 0""",
        f="STOCK DAILY_SALES STOCK_COVER_DAYS TARGET_STOCK FINAL_REPLEN_QTY",
    ),
)
def _(t):
    return plan_views.display(plan_views.recommendations(base_plan(t)))


@query(
    "r29_new_items",
    q(
        ALL,
        f"""{BASE_SQL}
SELECT STORE || ' - ' || STORE_NAME AS STORE_DISPLAY, SKU, STYLE, COLOR, SIZE, GENDER FROM base_plan WHERE IS_NEW_ITEM""",
    ),
)
def _(t):
    return plan_views.new_items(base_plan(t))


@query(
    "r30_shortage_summary",
    q(
        ALL,
        f"""{BASE_SQL}
SELECT DISTINCT SKU, STYLE, WAREHOUSE_STOCK, REMARKS FROM base_plan
WHERE FINAL_REPLEN_QTY > 0 AND REMARKS LIKE '%insufficient%'""",
        f="WAREHOUSE_STOCK",
    ),
)
def _(t):
    return plan_views.shortage_summary(base_plan(t))


@query(
    "r31_replen_by_store",
    q(
        ALL,
        f"""{BASE_SQL},
a AS (SELECT STORE, STORE_NAME, sum(FINAL_REPLEN_QTY) AS replen_qty FROM base_plan WHERE FINAL_REPLEN_QTY > 0 GROUP BY 1, 2),
b AS (
  SELECT STORE, min(STOCK_COVER_DAYS) AS cover_min, quantile_cont(STOCK_COVER_DAYS, 0.25) AS cover_q1,
    quantile_cont(STOCK_COVER_DAYS, 0.5) AS cover_median, quantile_cont(STOCK_COVER_DAYS, 0.75) AS cover_q3,
    max(STOCK_COVER_DAYS) AS cover_max FROM base_plan GROUP BY 1)
SELECT b.*, STORE_NAME, replen_qty FROM b LEFT JOIN a ON a.STORE = b.STORE""",
        f="replen_qty cover_min cover_q1 cover_median cover_q3 cover_max",
    ),
)
def _(t):
    plan = base_plan(t)
    return plan_views.cover_summary(plan).join(plan_views.quantity_by_store(plan), "STORE", "left")


# --- final edition -----------------------------------------------------------

FINAL = ReplenishParams(period_days=730, method="weighted", exception_styles=("BRAND#3",))

FINAL_PAIRS_SQL = f"""recent AS (SELECT * FROM sales WHERE DATE > (SELECT max(DATE) FROM sales) - 730),
lastday AS (SELECT max(DATE) AS m FROM sales),
w AS (SELECT *, exp(-(m - DATE) / 219.0) AS w FROM recent, lastday),
vel AS (SELECT STORE, SKU, round(sum(QUANTITY * w) / sum(w) / 730 * count(QUANTITY), 12) AS DAILY_SALES FROM w GROUP BY 1, 2),
{PAIRS}"""

CLASSED_SQL = f"""{FINAL_PAIRS_SQL},
valued AS (SELECT *, v * 100 AS sv FROM covered),
cuts AS (
  SELECT quantile_cont(sv, 0.7) AS b, quantile_cont(sv, 0.9) AS a, quantile_cont(v, 0.3) AS med, quantile_cont(v, 0.7) AS fast
  FROM valued),
classed AS (
  SELECT valued.*, CASE WHEN sv >= a THEN 'A' WHEN sv >= b THEN 'B' ELSE 'C' END AS abc,
    CASE WHEN v >= fast THEN 'Fast' WHEN v >= med THEN 'Medium' ELSE 'Slow' END AS vc
  FROM valued, cuts)"""

FORECAST_SQL = f"""{CLASSED_SQL},
attributed AS (
  SELECT c.*, m.STYLE, m.COLOR, m.SIZE, coalesce(w.WAREHOUSE_STOCK, 0) AS W,
    CASE left(m.STYLE, 1) WHEN 'A' THEN 1.1 WHEN 'F' THEN 1.2 WHEN 'S' THEN 0.9 ELSE 1.0 END AS cf,
    CASE abc || vc WHEN 'AFast' THEN 1.5 WHEN 'AMedium' THEN 1.3 WHEN 'ASlow' THEN 1.1 WHEN 'BFast' THEN 1.3
      WHEN 'BMedium' THEN 1.2 WHEN 'BSlow' THEN 1.0 WHEN 'CFast' THEN 1.2 WHEN 'CMedium' THEN 1.0 ELSE 0.8 END AS cm,
    CASE month((SELECT m FROM lastday)) WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 1.1 WHEN 7 THEN 0.9 WHEN 8 THEN 0.9
      WHEN 9 THEN 1.1 WHEN 10 THEN 1.2 WHEN 11 THEN 1.3 WHEN 12 THEN 1.4 ELSE 1.0 END AS season,
    CASE WHEN st = 0 THEN 1.2 ELSE 1.0 END AS pen, CASE WHEN st = 0 AND v = 0 THEN 1.1 ELSE 1.0 END AS boost
  FROM classed c LEFT JOIN sku_master m ON c.SKU = m.SKU LEFT JOIN warehouse w ON c.SKU = w.SKU),
need0 AS (SELECT *, cm * cf AS mult, v * season * 31 * (cm * cf) * 1.0 * pen * boost AS fc FROM attributed)"""

NEEDS_SQL = f"""{FORECAST_SQL}, {NEED}, {PRIORITY},
full_need AS (
  SELECT n.*, PRIORITY_SCORE AS pr, STORE_NAME, coalesce(GENDER, 'UNKNOWN') AS GENDER,
    0.6 * (CASE abc WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 ELSE 0.4 END)
    + 0.4 * (CASE vc WHEN 'Fast' THEN 1.0 WHEN 'Medium' THEN 0.6 ELSE 0.2 END) AS imp
  FROM need n LEFT JOIN priority p ON n.STORE = p.STORE LEFT JOIN names m ON n.STORE = m.STORE
  LEFT JOIN style_master g ON n.STYLE = g.STYLE)"""

SCORES_SQL = """per0 AS (SELECT STORE, round(sum(v), 12) AS sales, sum(st) AS stock, max(pr) AS pr FROM full_need GROUP BY 1),
per1 AS (SELECT *, CASE WHEN stock > 0 THEN sales / stock ELSE sales END AS turn FROM per0),
scores AS (
  SELECT STORE, 0.4 * pr + 0.4 * (turn / (SELECT max(turn) FROM per1)) + 0.2 * (sales / (SELECT max(sales) FROM per1)) AS score
  FROM per1),
bonus AS (
  SELECT STORE, STYLE, COLOR,
    CASE WHEN (count(*) FILTER (WHERE st > 0) + count(*) FILTER (WHERE v > 0)) / (count(*) * 2) >= 0.7 THEN 1.5
      WHEN (count(*) FILTER (WHERE st > 0) + count(*) FILTER (WHERE v > 0)) / (count(*) * 2) >= 0.5 THEN 1.2 ELSE 1.0 END AS bonus
  FROM full_need GROUP BY 1, 2, 3)"""

ALLOC_SQL = f"""{NEEDS_SQL}, {SCORES_SQL},
f0 AS (
  SELECT n.*, score, bonus, sum(need) OVER (PARTITION BY n.SKU) AS td
  FROM full_need n JOIN scores s ON n.STORE = s.STORE
  JOIN bonus b ON n.STORE = b.STORE AND n.STYLE = b.STYLE AND n.COLOR = b.COLOR),
f1 AS (SELECT *, CASE WHEN td > W AND W > 0 THEN score * imp * bonus * need END AS af FROM f0),
f2 AS (
  SELECT *, floor(CASE WHEN W <= 0 THEN 0
      WHEN td > W THEN floor(round(coalesce(af / nullif(sum(af) OVER (PARTITION BY SKU), 0) * W, 0), 6))
      WHEN need > 0 THEN greatest(2, need) ELSE 0 END) AS fin,
    CASE WHEN W <= 0 THEN 'No warehouse stock available' WHEN td > W THEN 'Warehouse stock insufficient' ELSE '' END AS rem
  FROM f1)"""


def _pass1(pick: str, remark: str) -> str:
    return f"""c1 AS (
  SELECT * REPLACE (CASE WHEN pick THEN 2 ELSE fin END AS fin, CASE WHEN pick THEN '{remark}' ELSE rem END AS rem),
    CASE WHEN pick THEN 2 ELSE 0 END AS ssa
  FROM (SELECT *, fin = 0 AND W > 0 AND {pick} AS pick FROM f2) z)"""


SETS_SQL = """lvl AS (SELECT STORE, STYLE, COLOR, SIZE, bool_or(st > 0 OR fin > 0) AS ok FROM {src} GROUP BY 1, 2, 3, 4),
sets AS (
  SELECT STORE, STYLE, COLOR, count(*) AS total, count(*) FILTER (WHERE ok) AS have,
    CASE WHEN bool_or(SIZE IN ('2XL', '3XL', '4XL', '5XL')) THEN 3 ELSE 4 END AS least,
    bool_or(SIZE IN ('2XL', '3XL', '4XL', '5XL')) AS plus,
    coalesce(string_agg(CASE WHEN NOT ok THEN SIZE END, ',' ORDER BY SIZE), '') AS gaps
  FROM lvl GROUP BY 1, 2, 3)"""

FULL_SQL = f"""{ALLOC_SQL},
{_pass1("pr > 0.5 AND SIZE IN (SELECT SIZE FROM size_master)", "Priority size completion")},
{SETS_SQL.format(src="c1")},
missing AS (
  SELECT l.STORE, l.STYLE, l.COLOR, l.SIZE FROM lvl l
  JOIN sets s ON l.STORE = s.STORE AND l.STYLE = s.STYLE AND l.COLOR = s.COLOR WHERE NOT ok AND have < least),
c2 AS (
  SELECT * REPLACE (CASE WHEN pick2 THEN least(2, W) ELSE fin END AS fin,
    CASE WHEN pick2 THEN rem || '; Size set completion' ELSE rem END AS rem, CASE WHEN pick2 THEN 1 ELSE ssa END AS ssa)
  FROM (
    SELECT p.*, (m.SIZE IS NOT NULL AND W > 0 AND fin = 0) AS pick2
    FROM c1 p LEFT JOIN missing m ON p.STORE = m.STORE AND p.STYLE = m.STYLE AND p.COLOR = m.COLOR AND p.SIZE = m.SIZE) z)"""

FINAL_COLS = """STORE, STORE_NAME, SKU, STYLE, COLOR, SIZE, GENDER, st AS STOCK, W AS WAREHOUSE_STOCK, v AS DAILY_SALES,
  cover AS STOCK_COVER_DAYS, target AS TARGET_STOCK, need AS REPLEN_QTY, fin AS FINAL_REPLEN_QTY, ssa AS SIZE_SET_ALLOCATION,
  pr AS PRIORITY_SCORE, rem AS REMARKS, is_new AS IS_NEW_ITEM"""
FINAL_NUMBERS = (
    "STOCK WAREHOUSE_STOCK DAILY_SALES STOCK_COVER_DAYS TARGET_STOCK REPLEN_QTY FINAL_REPLEN_QTY SIZE_SET_ALLOCATION PRIORITY_SCORE"
)


def final_pairs(t):
    return kept(
        t, "final_pairs", lambda: plans.final_pairs(*sales_and_stock(t), t.warehouse, t.sku_master, t.style_master, FINAL)
    )


def final_needs(t):
    return kept(
        t, "final_needs", lambda: plans.final_needs(final_pairs(t), *sales_and_stock(t), FINAL)
    )


def final_allocated(t):
    columns = [*plan_views.PLAN_COLUMNS]
    return plans.completed(
        kept(
            t,
            "first_pass",
            lambda: plans.first_pass(*sales_and_stock(t), t.warehouse, t.sku_master, t.style_master, t.size_master, FINAL, columns),
        ),
        FINAL,
    )


def with_factors(t):
    n = final_needs(t)
    return n.join(replenish_final.size_set_bonus(n), ["STORE", "STYLE", "COLOR"], "left").join(
        replenish_final.store_scores(n), "STORE", "left"
    )


@query(
    "r06_abc_class",
    q(ALL, f"{CLASSED_SQL} SELECT STORE, SKU, abc AS ABC_CLASS FROM classed"),
)
def _(t):
    return replenish_final.with_classes(final_pairs(t), FINAL).select("STORE", "SKU", "ABC_CLASS")


@query(
    "r07_velocity_class",
    q(ALL, f"{CLASSED_SQL} SELECT STORE, SKU, v AS DAILY_SALES, vc AS VELOCITY_CLASS FROM classed", f="DAILY_SALES"),
)
def _(t):
    return replenish_final.with_classes(final_pairs(t), FINAL).select("STORE", "SKU", "DAILY_SALES", "VELOCITY_CLASS")


@query(
    "r09_forecast_multiplier",
    q(
        ALL,
        f"{FORECAST_SQL} SELECT STORE, SKU, STYLE, abc AS ABC_CLASS, vc AS VELOCITY_CLASS, mult AS FORECAST_MULTIPLIER FROM need0",
        f="FORECAST_MULTIPLIER",
    ),
)
def _(t):
    df = replenish_final.with_classes(final_pairs(t), FINAL)
    mult = replenish_final.forecast_multiplier(F.col("ABC_CLASS"), F.col("VELOCITY_CLASS"), F.col("STYLE"))
    return df.select("STORE", "SKU", "STYLE", "ABC_CLASS", "VELOCITY_CLASS", mult.alias("FORECAST_MULTIPLIER"))


@query(
    "r10_demand_adjust",
    q(
        ALL,
        f"""{FORECAST_SQL}, pairmax AS (SELECT STORE, SKU, max(DATE) AS pm, count(*) AS n FROM recent GROUP BY 1, 2),
halves AS (
  SELECT r.STORE, r.SKU, any_value(n) AS n, coalesce(sum(CASE WHEN r.DATE > pm - 365 THEN QUANTITY END), 0) AS new,
    coalesce(sum(CASE WHEN r.DATE <= pm - 365 THEN QUANTITY END), 0) AS old
  FROM recent r JOIN pairmax p ON r.STORE = p.STORE AND r.SKU = p.SKU GROUP BY 1, 2)
SELECT f.STORE, f.SKU, CASE WHEN n >= 4 AND old > 0 THEN 0.7 + 0.3 * new / old ELSE 1.0 END AS TREND_FACTOR,
  pen AS STOCKOUT_PENALTY, boost AS NEW_ITEM_BOOST
FROM need0 f LEFT JOIN halves h ON f.STORE = h.STORE AND f.SKU = h.SKU""",
        f="TREND_FACTOR STOCKOUT_PENALTY NEW_ITEM_BOOST",
    ),
)
def _(t):
    from dataclasses import replace

    p = replace(FINAL, trend="observed")
    df = replenish_final.with_forecast(replenish_final.with_classes(final_pairs(t), p), sales_and_stock(t)[0], p)
    return df.select("STORE", "SKU", "TREND_FACTOR", "STOCKOUT_PENALTY", "NEW_ITEM_BOOST")


@query(
    "r11_forecast_final",
    q(
        ALL,
        f"{FORECAST_SQL} SELECT STORE, SKU, season AS SEASONAL_FACTOR, fc AS FORECAST_DEMAND FROM need0",
        f="SEASONAL_FACTOR FORECAST_DEMAND",
    ),
)
def _(t):
    sales, _ = sales_and_stock(t)
    df = replenish_final.with_forecast(replenish_final.with_classes(final_pairs(t), FINAL), sales, FINAL)
    return df.select("STORE", "SKU", "SEASONAL_FACTOR", "FORECAST_DEMAND")


@query(
    "r15_product_importance",
    q(ALL, f"{NEEDS_SQL} SELECT STORE, SKU, GENDER, imp AS PRODUCT_IMPORTANCE FROM full_need", f="PRODUCT_IMPORTANCE"),
)
def _(t):
    return final_needs(t).select("STORE", "SKU", "GENDER", "PRODUCT_IMPORTANCE")


@query(
    "r16_enhanced_store_score",
    q(ALL, f"{NEEDS_SQL}, {SCORES_SQL} SELECT STORE, score AS ENHANCED_STORE_SCORE FROM scores", f="ENHANCED_STORE_SCORE"),
)
def _(t):
    return replenish_final.store_scores(final_needs(t))


@query(
    "r17_size_set_bonus",
    q(ALL, f"{NEEDS_SQL}, {SCORES_SQL} SELECT STORE, STYLE, COLOR, bonus AS SIZE_SET_BONUS FROM bonus", f="SIZE_SET_BONUS"),
)
def _(t):
    return replenish_final.size_set_bonus(final_needs(t))


@query(
    "r18_allocate_final",
    q(
        ALL,
        f"""{ALLOC_SQL}
SELECT STORE, SKU, td AS TOTAL_DEMAND, W AS WAREHOUSE_STOCK, need AS REPLEN_QTY, fin AS FINAL_REPLEN_QTY, rem AS REMARKS FROM f2""",
        f="TOTAL_DEMAND WAREHOUSE_STOCK REPLEN_QTY FINAL_REPLEN_QTY",
    ),
)
def _(t):
    out = replenish_final.allocate(with_factors(t), FINAL)
    return out.select("STORE", "SKU", "TOTAL_DEMAND", "WAREHOUSE_STOCK", "REPLEN_QTY", "FINAL_REPLEN_QTY", "REMARKS")


@query(
    "r20_size_sets",
    q(ALL, "SELECT SIZE, SIZE_SET, MIN_SIZES_REQUIRED FROM size_master", i="MIN_SIZES_REQUIRED"),
)
def _(t):
    return replenish_final.size_sets(t.spark, t.size_master)


@query(
    "r20_default_size_sets",
    q(
        ALL,
        f"""{ALLOC_SQL},
own AS (SELECT * FROM (VALUES ('S','Regular',4),('M','Regular',4),('L','Regular',4),('XL','Regular',4),('2XL','Regular',4),
  ('3XL','Plus',3),('4XL','Plus',3),('5XL','Plus',3)) v(SIZE, SIZE_SET, least)),
{_pass1("pr > 0.5 AND SIZE IN (SELECT SIZE FROM own)", "Priority size completion")}
SELECT c1.SIZE, SIZE_SET, least AS MIN_SIZES_REQUIRED, count(*) AS rows, count(*) FILTER (WHERE ssa > 0) AS completed, sum(fin) AS units
FROM c1 LEFT JOIN own ON c1.SIZE = own.SIZE GROUP BY 1, 2, 3""",
        f="units",
        i="MIN_SIZES_REQUIRED",
    ),
)
def _(t):
    """Size completion without a size master."""
    sets = replenish_final.size_sets(t.spark)
    out = replenish_final.complete_sizes(replenish_final.allocate(with_factors(t), FINAL), sets, FINAL)
    out = out.select("SIZE", "FINAL_REPLEN_QTY", "SIZE_SET_ALLOCATION").join(sets, "SIZE", "left")
    return out.groupBy("SIZE", "SIZE_SET", "MIN_SIZES_REQUIRED").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("SIZE_SET_ALLOCATION") > 0).alias("completed"), F.sum("FINAL_REPLEN_QTY").alias("units")
    )


@query(
    "r21_capped_completion",
    q(
        ALL,
        f"""{ALLOC_SQL},
cap_p1 AS (SELECT *, fin = 0 AND W > 0 AND pr > 0.5 AND SIZE IN (SELECT SIZE FROM size_master) AS pick FROM f2),
cap_g1 AS (
  SELECT *, CASE WHEN pick THEN greatest(0, least(2, W - sum(fin) OVER (PARTITION BY SKU)
    - coalesce(sum(CASE WHEN pick THEN 2 ELSE 0 END) OVER (PARTITION BY SKU ORDER BY pr DESC, STORE ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
    ELSE 0 END AS g FROM cap_p1),
c1 AS (
  SELECT * REPLACE (CASE WHEN g > 0 THEN g ELSE fin END AS fin, CASE WHEN g > 0 THEN 'Priority size completion' ELSE rem END AS rem),
    g AS ssa FROM cap_g1),
{SETS_SQL.format(src="c1")},
missing AS (
  SELECT l.STORE, l.STYLE, l.COLOR, l.SIZE FROM lvl l
  JOIN sets s ON l.STORE = s.STORE AND l.STYLE = s.STYLE AND l.COLOR = s.COLOR WHERE NOT ok AND have < least),
cap_p2 AS (
  SELECT p.*, (m.SIZE IS NOT NULL AND W > 0 AND fin = 0) AS pick2
  FROM c1 p LEFT JOIN missing m ON p.STORE = m.STORE AND p.STYLE = m.STYLE AND p.COLOR = m.COLOR AND p.SIZE = m.SIZE),
cap_g2 AS (
  SELECT *, CASE WHEN pick2 THEN greatest(0, least(least(2, W), W - sum(fin) OVER (PARTITION BY SKU)
    - coalesce(sum(CASE WHEN pick2 THEN least(2, W) ELSE 0 END) OVER (PARTITION BY SKU ORDER BY pr DESC, STORE ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
    ELSE 0 END AS h FROM cap_p2),
c2 AS (
  SELECT * REPLACE (CASE WHEN h > 0 THEN h ELSE fin END AS fin, CASE WHEN h > 0 THEN rem || '; Size set completion' ELSE rem END AS rem,
    CASE WHEN h > 0 THEN 1 ELSE ssa END AS ssa) FROM cap_g2)
SELECT STORE, SKU, fin AS FINAL_REPLEN_QTY, ssa AS SIZE_SET_ALLOCATION, rem AS REMARKS,
  sum(fin) OVER (PARTITION BY SKU) <= greatest(W, 0) AS within_stock FROM c2""",
        f="FINAL_REPLEN_QTY SIZE_SET_ALLOCATION",
    ),
)
def _(t):
    """Both completion passes share what the warehouse has left."""
    from dataclasses import replace

    p = replace(FINAL, cap_to_warehouse=True)
    rows = replenish_final.allocate(with_factors(t), p)
    rows = replenish_final.complete_sizes(rows, replenish_final.size_sets(t.spark, t.size_master), p)
    out = replenish_final.complete_sets(materialize(rows.select(*plan_views.PLAN_COLUMNS), "allocated"), p)
    used = F.sum("FINAL_REPLEN_QTY").over(Window.partitionBy("SKU")) <= F.greatest("WAREHOUSE_STOCK", F.lit(0.0))
    return out.select("STORE", "SKU", "FINAL_REPLEN_QTY", "SIZE_SET_ALLOCATION", "REMARKS", used.alias("within_stock"))


@query(
    "r21_size_completion_simple",
    q(
        ALL,
        f"""{ALLOC_SQL}, {_pass1("pr > 0.7", "High priority size completion")}
SELECT STORE, SKU, fin AS FINAL_REPLEN_QTY, ssa AS SIZE_SET_ALLOCATION, rem AS REMARKS FROM c1""",
        f="FINAL_REPLEN_QTY SIZE_SET_ALLOCATION",
    ),
)
def _(t):
    from dataclasses import replace

    p = replace(FINAL, completion="simple")
    rows = replenish_final.allocate(with_factors(t), p)
    out = replenish_final.complete_sizes(rows, replenish_final.size_sets(t.spark, t.size_master), p)
    return out.select("STORE", "SKU", "FINAL_REPLEN_QTY", "SIZE_SET_ALLOCATION", "REMARKS")


@query(
    "r21_size_completion_full",
    q(
        ALL,
        f"{FULL_SQL} SELECT STORE, SKU, fin AS FINAL_REPLEN_QTY, ssa AS SIZE_SET_ALLOCATION, rem AS REMARKS FROM c2",
        f="FINAL_REPLEN_QTY SIZE_SET_ALLOCATION",
    ),
)
def _(t):
    return final_allocated(t).select("STORE", "SKU", "FINAL_REPLEN_QTY", "SIZE_SET_ALLOCATION", "REMARKS")


@query(
    "r21_set_analysis",
    q(
        ALL,
        f"""{ALLOC_SQL}, {SETS_SQL.format(src="f2")}
SELECT STORE, STYLE, COLOR, total AS TOTAL_SIZES, have AS SIZES_WITH_INVENTORY, total - have AS MISSING_SIZES,
  gaps AS MISSING_SIZE_LIST, plus AS IS_PLUS_COMBO, least AS MIN_REQUIRED, have >= least AS IS_COMPLETE,
  have / greatest(1, total) AS COMPLETENESS_RATIO
FROM sets""",
        f="COMPLETENESS_RATIO",
        i="MIN_REQUIRED",
    ),
)
def _(t):
    rows = replenish_final.allocate(with_factors(t), FINAL)
    return replenish_final.set_analysis(rows).withColumn("MISSING_SIZE_LIST", F.array_join("MISSING_SIZE_LIST", ","))


@query(
    "r21_set_status",
    q(
        ALL,
        f"""{FULL_SQL},
after_lvl AS (SELECT STORE, STYLE, COLOR, SIZE, bool_or(st > 0 OR fin > 0) AS ok FROM c2 GROUP BY 1, 2, 3, 4),
after_sets AS (
  SELECT STORE, STYLE, COLOR, count(*) FILTER (WHERE ok) >=
    CASE WHEN bool_or(SIZE IN ('2XL', '3XL', '4XL', '5XL')) THEN 3 ELSE 4 END AS complete FROM after_lvl GROUP BY 1, 2, 3)
SELECT count(*) FILTER (WHERE complete) AS complete_sets, count(*) FILTER (WHERE NOT complete) AS incomplete_sets FROM after_sets""",
    ),
)
def _(t):
    return replenish_final.set_status(final_allocated(t))


@query(
    "r22_final_filter",
    q(
        ALL,
        f"""{FULL_SQL}
SELECT {FINAL_COLS} FROM c2
WHERE GENDER <> 'FREEBIES' AND NOT (GENDER = 'UNISEX' AND STYLE <> 'BRAND#3')
  AND NOT (GENDER = 'UNKNOWN' AND STYLE LIKE '%BAG%')""",
        f=FINAL_NUMBERS,
    ),
)
def _(t):
    return replenish_final.final_filter(final_allocated(t), FINAL).select(*plan_views.PLAN_COLUMNS)


@query(
    "r22_removal_counts",
    q(
        ALL,
        f"""{NEEDS_SQL}
SELECT count(*) FILTER (WHERE GENDER = 'FREEBIES') AS freebies,
  count(*) FILTER (WHERE GENDER = 'UNISEX' AND STYLE <> 'BRAND#3') AS unisex,
  CAST(0 AS BIGINT) AS unknown_freebies,
  count(*) FILTER (WHERE GENDER <> 'FREEBIES' AND NOT (GENDER = 'UNISEX' AND STYLE <> 'BRAND#3')) AS kept
FROM full_need""",
    ),
)
def _(t):
    return replenish_final.removal_counts(final_needs(t), FINAL)


GRID_SQL = PAIRS.replace("pairs AS (", "sparse AS (", 1).replace(
    "covered AS (",
    """grid AS (
  SELECT STORE, SKU FROM (SELECT DISTINCT STORE FROM stock) s
  CROSS JOIN (SELECT SKU FROM vel UNION SELECT SKU FROM stock WHERE STOCK > 0 UNION SELECT SKU FROM warehouse) k),
pairs AS (
  SELECT g.STORE, g.SKU, coalesce(v, 0) AS v, coalesce(st, 0) AS st
  FROM grid g LEFT JOIN sparse p ON g.STORE = p.STORE AND g.SKU = p.SKU),
covered AS (""",
)
UNIVERSE_SQL = FULL_SQL.replace(PAIRS, GRID_SQL).replace("730", "90").replace("219.0", "27.0")


@query(
    "r22_final_plan_universe",
    q(
        ALL,
        f"""{UNIVERSE_SQL}
SELECT {FINAL_COLS} FROM c2
WHERE GENDER <> 'FREEBIES' AND NOT (GENDER = 'UNISEX' AND STYLE <> 'BRAND#3')""",
        f=FINAL_NUMBERS,
    ),
)
def _(t):
    p = ReplenishParams(mode="universe", method="weighted", exception_styles=("BRAND#3",))
    plan = plans.final_plan(*sales_and_stock(t), t.warehouse, t.sku_master, t.style_master, t.size_master, p)
    return plan.select(*plan_views.PLAN_COLUMNS)


@query(
    "v09_factor_summary",
    q(
        ALL,
        f"""{FORECAST_SQL}
SELECT max(season) AS seasonal, avg(mult) AS avg_multiplier, 1.0 AS avg_trend, avg(cf) AS avg_category,
  count(*) FILTER (WHERE abc = 'A') AS a_items, count(*) FILTER (WHERE abc = 'B') AS b_items,
  count(*) FILTER (WHERE abc = 'C') AS c_items, count(*) FILTER (WHERE vc = 'Fast') AS fast_movers,
  count(*) FILTER (WHERE vc = 'Medium') AS medium_movers, count(*) FILTER (WHERE vc = 'Slow') AS slow_movers
FROM need0""",
        f="seasonal avg_multiplier avg_trend avg_category",
    ),
)
def _(t):
    return plan_views.factor_summary(final_needs(t))

