"""Demand velocity, trend, variability, similar products, store priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislebrook.operators import demand, priority

from .registry import query
from .sqlbase import ALL, MASTERS, SALES, STOCK, q

RECENT = """recent AS (SELECT * FROM sales WHERE DATE > (SELECT max(DATE) FROM sales) - 90),
lastday AS (SELECT max(DATE) AS m FROM sales)"""

D01 = f"""{RECENT},
vel AS (SELECT STORE, SKU, sum(QUANTITY) / 90.0 AS DAILY_SALES FROM recent GROUP BY 1, 2)"""


@query("d01_velocity_simple", q(SALES, f"{D01} SELECT * FROM vel", f="DAILY_SALES"))
def _(t):
    return demand.velocity_simple(t.sales, 90)


@query(
    "d02_weighted_demand",
    q(
        SALES,
        f"""{RECENT},
w AS (SELECT *, exp(-(m - DATE) / 30.0) AS w FROM recent, lastday)
SELECT STORE, SKU, sum(QUANTITY * w) / sum(w) / 90 AS DAILY_SALES FROM w GROUP BY 1, 2""",
        f="DAILY_SALES",
    ),
)
def _(t):
    return demand.weighted_demand(t.sales, 90)


TREND = """pairmax AS (SELECT STORE, SKU, max(DATE) AS pm, count(*) AS n FROM recent GROUP BY 1, 2),
halves AS (
  SELECT r.STORE, r.SKU, any_value(n) AS n,
    coalesce(sum(CASE WHEN r.DATE > pm - 45 THEN QUANTITY END), 0) AS new,
    coalesce(sum(CASE WHEN r.DATE <= pm - 45 THEN QUANTITY END), 0) AS old
  FROM recent r JOIN pairmax p ON r.STORE = p.STORE AND r.SKU = p.SKU GROUP BY 1, 2),
trend AS (
  SELECT STORE, SKU, CASE WHEN n < 4 OR old <= 0 THEN 1.0 ELSE 0.7 + 0.3 * new / old END AS TREND_FACTOR FROM halves)"""

WDS = """weighted AS (
  SELECT r.STORE, r.SKU,
    greatest(0, sum(QUANTITY * exp(-(pm - r.DATE) / 27.0)) / sum(exp(-(pm - r.DATE) / 27.0)) / 90 * count(*)) AS DAILY_SALES
  FROM recent r JOIN pairmax p ON r.STORE = p.STORE AND r.SKU = p.SKU GROUP BY 1, 2)"""


@query("d03_simple_trend", q(SALES, f"{RECENT}, {TREND} SELECT * FROM trend", f="TREND_FACTOR"))
def _(t):
    return demand.simple_trend(t.sales, 90)


@query("d04_weighted_daily_sales", q(SALES, f"{RECENT}, {TREND}, {WDS} SELECT * FROM weighted", f="DAILY_SALES"))
def _(t):
    return demand.weighted_daily_sales(t.sales, 90)


D05 = f"""{RECENT},
w AS (SELECT *, exp(-(m - DATE) / 27.0) AS w FROM recent, lastday),
vel AS (SELECT STORE, SKU, round(sum(QUANTITY * w) / sum(w) / 90 * count(QUANTITY), 12) AS DAILY_SALES FROM w GROUP BY 1, 2)"""


@query("d05_velocity_wma_final", q(SALES, f"{D05} SELECT * FROM vel", f="DAILY_SALES"))
def _(t):
    return demand.weighted_daily_sales(t.sales, 90)


@query(
    "d06_velocity_wma_base",
    q(
        SALES,
        f"""{RECENT}, {TREND}, {WDS}
SELECT w.STORE, w.SKU, DAILY_SALES * least(greatest(TREND_FACTOR, 0.5), 1.5) AS DAILY_SALES, TREND_FACTOR
FROM weighted w JOIN trend t ON w.STORE = t.STORE AND w.SKU = t.SKU""",
        f="DAILY_SALES TREND_FACTOR",
    ),
)
def _(t):
    return demand.velocity_trended(t.sales, 90)


DAILY = "daily AS (SELECT STORE, SKU, DATE, sum(QUANTITY) AS q FROM recent GROUP BY 1, 2, 3)"


@query(
    "d07_dow_factors",
    q(
        SALES,
        f"""{RECENT}, {DAILY}
SELECT isodow(DATE) - 1 AS DOW, avg(q) / (SELECT avg(q) FROM daily) AS DOW_FACTOR FROM daily GROUP BY 1""",
        f="DOW_FACTOR",
        i="DOW",
    ),
)
def _(t):
    return demand.weekday_factors(t.sales, 90)


@query(
    "d08_demand_cv_safety",
    q(
        SALES,
        f"""{RECENT}, {DAILY},
cv AS (SELECT STORE, SKU, sum(q) / 90.0 AS v, coalesce(stddev_samp(q) / avg(q), 0) AS cv FROM daily GROUP BY 1, 2),
s AS (SELECT *, ceil(round(1.645 * v * cv * sqrt(14.0), 6)) AS ss FROM cv)
SELECT STORE, SKU, v AS DAILY_SALES, cv AS CV, ss AS SAFETY_STOCK, ceil(round(v * 14 + ss, 6)) AS DESIRED_STOCK FROM s""",
        f="DAILY_SALES CV SAFETY_STOCK DESIRED_STOCK",
    ),
)
def _(t):
    return demand.variability_safety(t.sales, 90)


@query(
    "d09_similar_products",
    q(
        f"{SALES}, {MASTERS}",
        f"""{RECENT},
listed AS (
  SELECT SKU, STYLE, CATEGORY FROM sku_attributes
  UNION ALL SELECT 'NEW' || SKU, STYLE, CATEGORY FROM sku_attributes WHERE SIZE = 'XS'),
items AS (SELECT a.SKU, a.STYLE, g.GENDER, a.CATEGORY FROM listed a LEFT JOIN style_master g ON a.STYLE = g.STYLE),
sold AS (SELECT DISTINCT SKU FROM sales),
scored AS (
  SELECT n.SKU, c.SKU AS SIMILAR_SKU,
    CASE WHEN n.STYLE = c.STYLE THEN 3 ELSE 0 END + CASE WHEN n.GENDER = c.GENDER THEN 2 ELSE 0 END
    + CASE WHEN n.CATEGORY = c.CATEGORY THEN 1 ELSE 0 END AS SIMILARITY_SCORE
  FROM items n, items c
  WHERE n.SKU NOT IN (SELECT SKU FROM sold) AND c.SKU IN (SELECT SKU FROM sold)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY SKU ORDER BY SIMILARITY_SCORE DESC, SIMILAR_SKU) AS RANK
  FROM scored WHERE SIMILARITY_SCORE > 0)
SELECT * FROM ranked WHERE RANK <= 3""",
        i="SIMILARITY_SCORE RANK",
    ),
)
def _(t):
    # A made-up SKU that never sold beside each one of size XS.
    own = t.sku_attributes
    new = own.where("SIZE = 'XS'").withColumn("SKU", F.concat(F.lit("NEW"), "SKU"))
    return demand.similar_products(own.union(new).join(t.style_master, "STYLE", "left"), t.sales, 3)


PRIORITY = """ss AS (SELECT STORE, sum(QUANTITY) AS q FROM recent GROUP BY 1),
sk AS (SELECT STORE, sum(STOCK) AS st, count(DISTINCT SKU) AS n, count(*) FILTER (WHERE STOCK = 0) AS oos FROM stock GROUP BY 1),
p0 AS (
  SELECT sk.STORE, coalesce(q, 0) AS q, st, n, oos, CASE WHEN st > 0 THEN coalesce(q, 0) / st ELSE 0 END AS turn
  FROM sk LEFT JOIN ss ON sk.STORE = ss.STORE),
p1 AS (SELECT *, q / (SELECT max(q) FROM p0) AS a, turn / (SELECT max(turn) FROM p0) AS b, oos / n AS c FROM p0),
p2 AS (SELECT *, 0.4 * a + 0.3 * b + 0.3 * c AS raw FROM p1),
priority AS (
  SELECT STORE, q, st, n, oos, turn, a, b, c,
    round((raw - (SELECT min(raw) FROM p2)) / ((SELECT max(raw) FROM p2) - (SELECT min(raw) FROM p2)), 12) AS PRIORITY_SCORE
  FROM p2)"""


@query(
    "r01_store_priority",
    q(
        ALL,
        f"""{RECENT}, {PRIORITY}
SELECT STORE, q AS total_sales, st AS total_stock, n AS sku_count, oos AS oos_count, turn AS STOCK_TURN,
  a AS SALES_SCORE, b AS STOCK_TURN_SCORE, c AS OOS_SCORE, PRIORITY_SCORE FROM priority""",
        f="total_sales total_stock STOCK_TURN SALES_SCORE STOCK_TURN_SCORE OOS_SCORE PRIORITY_SCORE",
    ),
)
def _(t):
    return priority.store_priority(t.sales, t.stock, 90)


@query(
    "r02_store_priority_rank",
    q(
        f"{SALES}, {STOCK}",
        f"""{RECENT},
ss AS (SELECT STORE, sum(QUANTITY) AS q FROM recent GROUP BY 1),
sk AS (SELECT STORE, sum(STOCK) AS st, count(*) FILTER (WHERE STOCK = 0) AS oos FROM stock GROUP BY 1),
p0 AS (SELECT sk.STORE, q, q / st AS turn, oos FROM sk LEFT JOIN ss ON sk.STORE = ss.STORE),
p1 AS (
  SELECT STORE,
    (rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0) / count(*) OVER () AS a,
    (rank() OVER (ORDER BY turn) + (count(*) OVER (PARTITION BY turn) - 1) / 2.0) / count(*) OVER () AS b,
    1 - (rank() OVER (ORDER BY oos) + (count(*) OVER (PARTITION BY oos) - 1) / 2.0) / count(*) OVER () AS c
  FROM p0),
p2 AS (SELECT *, 0.4 * a + 0.3 * b + 0.3 * c AS raw FROM p1)
SELECT STORE, a AS SALES_RANK, b AS STOCK_TURN_RANK, c AS OOS_RANK,
  (raw - (SELECT min(raw) FROM p2)) / ((SELECT max(raw) FROM p2) - (SELECT min(raw) FROM p2) + 1e-10) AS PRIORITY_SCORE
FROM p2""",
        f="SALES_RANK STOCK_TURN_RANK OOS_RANK PRIORITY_SCORE",
    ),
)
def _(t):
    return priority.store_priority_rank(t.sales, t.stock, 90)

