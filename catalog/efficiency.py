"""Style efficiency: the scored metrics, the min-max and the percent-rank analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislebrook.operators import efficiency as ef
from aislebrook.operators import efficiency_scripts as es
from aislebrook.operators import plan_steps
from aislebrook.plans.style_report import minmax_report, rank_report, style_report

from .registry import query, shared
from .sqlbase import ALL, STYLE_SALES, q

DAYS, THRESHOLD = 365, 40

E01 = """recent AS (SELECT * FROM sales WHERE DATE > (SELECT max(DATE) FROM sales) - 365),
sold AS (
  SELECT r.STORE, m.STYLE, sum(QUANTITY) AS ts, count(QUANTITY) AS tx, min(DATE) AS fd, max(DATE) AS ld
  FROM recent r JOIN sku_master m ON r.SKU = m.SKU GROUP BY 1, 2),
held AS (SELECT k.STORE, m.STYLE, sum(STOCK) AS st FROM stock k JOIN sku_master m ON k.SKU = m.SKU GROUP BY 1, 2),
wh AS (SELECT m.STYLE, sum(WAREHOUSE_STOCK) AS ws FROM warehouse w JOIN sku_master m ON w.SKU = m.SKU GROUP BY 1),
j AS (
  SELECT coalesce(s.STORE, h.STORE) AS STORE, coalesce(s.STYLE, h.STYLE) AS STYLE, coalesce(ts, 0) AS ts,
    coalesce(tx, 0) AS tx, fd, ld, coalesce(st, 0) AS st
  FROM sold s FULL JOIN held h ON s.STORE = h.STORE AND s.STYLE = h.STYLE),
k AS (
  SELECT j.*, ts / 365 AS vel, tx / 365 AS freq, CASE WHEN tx = 0 THEN 0 ELSE ts / tx END AS per,
    CASE WHEN st > 0 THEN ts / st WHEN ts > 0 THEN 999 ELSE 0 END AS turn, coalesce(ws, 0) AS ws,
    coalesce(GENDER, 'UNISEX') AS GENDER
  FROM j LEFT JOIN wh ON j.STYLE = wh.STYLE LEFT JOIN style_master g ON j.STYLE = g.STYLE),
l AS (
  SELECT *, CASE WHEN vel > 0 THEN st / vel WHEN st > 0 THEN 999 ELSE 0 END AS cover,
    tx / (SELECT max(tx) FROM k) * 100 AS cons
  FROM k),
metrics AS (
  SELECT *, round(round(round(vel / (SELECT max(vel) FROM k) * 30 + least(greatest(turn, 0), 10) / 10 * 25 + cons / 100 * 20
      + ts / (SELECT max(ts) FROM k) * 15
      + CASE WHEN cover > 0 THEN greatest(0, 10 - cover / 30 * 10) ELSE 10 END, 12), 1)
    * CASE WHEN ws > 0 THEN 1.0 ELSE 0.7 END, 9) AS score
  FROM l)"""


def metrics(t):
    return shared(
        t,
        "style_metrics",
        lambda: ef.style_metrics(t.sales, t.stock, t.sku_master, t.warehouse, t.style_master, DAYS),
    )


def stores(t):
    return shared(
        t,
        "store_recommendations",
        lambda: ef.store_recommendations(metrics(t), plan_steps.store_names(t.sales, t.stock), THRESHOLD),
    )


@query(
    "e01_style_metrics",
    q(
        ALL,
        f"""{E01}
SELECT STORE, STYLE, ts AS TOTAL_SALES, tx AS SALES_TRANSACTIONS, fd AS FIRST_SALE_DATE, ld AS LAST_SALE_DATE, st AS STOCK,
  per AS AVG_SALES_PER_TXN, vel AS SALES_VELOCITY, freq AS SALES_FREQUENCY, turn AS STOCK_TURNOVER, cover AS DAYS_STOCK_COVER,
  ws AS WAREHOUSE_STOCK, GENDER, ts AS REVENUE_CONTRIBUTION, cons AS CONSISTENCY_SCORE, score AS STYLE_EFFICIENCY_SCORE
FROM metrics""",
        f="TOTAL_SALES STOCK AVG_SALES_PER_TXN SALES_VELOCITY SALES_FREQUENCY STOCK_TURNOVER DAYS_STOCK_COVER WAREHOUSE_STOCK "
        "REVENUE_CONTRIBUTION CONSISTENCY_SCORE STYLE_EFFICIENCY_SCORE",
    ),
)
def _(t):
    return ef.style_metrics(t.sales, t.stock, t.sku_master, t.warehouse, t.style_master, DAYS)


CAPPED = "least(n, CASE category WHEN 'High Performer' THEN 20 WHEN 'Good Performer' THEN 15 WHEN 'Average Performer' THEN 10 ELSE 8 END)"

E02 = f"""{E01},
agg AS (
  SELECT STORE, count(*) AS n, count(*) FILTER (WHERE score >= 40) AS eff, sum(ts) AS ts, sum(st) AS st,
    coalesce(sum(ts) FILTER (WHERE score >= 40), 0) AS ets, coalesce(sum(st) FILTER (WHERE score >= 40), 0) AS est,
    round(round(coalesce(avg(score) FILTER (WHERE score >= 40), 0), 6), 1) AS es,
    round(round(coalesce(avg(vel) FILTER (WHERE score >= 40), 0), 6), 2) AS ev,
    round(round(coalesce(avg(turn) FILTER (WHERE score >= 40), 0), 6), 2) AS et,
    avg(score) AS alls, quantile_cont(ts, 0.75) AS q75, quantile_cont(ts, 0.5) AS q50
  FROM metrics GROUP BY 1),
cat AS (
  SELECT *, CASE WHEN alls >= 70 AND ts >= q75 THEN 'High Performer' WHEN alls >= 50 AND ts >= q50 THEN 'Good Performer'
    WHEN alls >= 30 THEN 'Average Performer' ELSE 'Needs Improvement' END AS category FROM agg),
rec AS (
  SELECT *, CAST(greatest(1, least(
    CASE category WHEN 'High Performer' THEN least(eff + 2, n) WHEN 'Good Performer' THEN eff
      WHEN 'Average Performer' THEN greatest(eff - 1, 1) ELSE greatest(eff // 2, 1) END,
    n
  )) AS BIGINT) AS recommended FROM cat),
focus AS (
  SELECT m.STORE, sum(ts) AS f FROM (
    SELECT STORE, ts, row_number() OVER (PARTITION BY STORE ORDER BY score DESC, STYLE) AS rn FROM metrics WHERE score >= 40) m
  JOIN (SELECT STORE, recommended FROM rec) r ON m.STORE = r.STORE WHERE rn <= recommended GROUP BY 1),
store_recs AS (
  SELECT rec.STORE, category AS STORE_CATEGORY, n AS CURRENT_TOTAL_STYLES, eff AS CURRENT_EFFICIENT_STYLES,
    recommended AS RECOMMENDED_STYLES, recommended - eff AS EFFICIENCY_IMPROVEMENT, ts AS TOTAL_SALES,
    round(round(CASE WHEN ts > 0 THEN ets / ts * 100 ELSE 0 END, 6), 1) AS EFFICIENT_SALES_PCT, es AS AVG_EFFICIENCY_SCORE,
    ev AS AVG_SALES_VELOCITY, et AS AVG_STOCK_TURNOVER,
    round(round(CASE WHEN ts > 0 THEN coalesce(f, 0) / ts * 100 ELSE 0 END, 6), 1) AS PROJECTED_SALES_FOCUS_PCT,
    st AS TOTAL_STOCK, est AS EFFICIENT_STOCK, nm.STORE_NAME
  FROM rec LEFT JOIN focus ON rec.STORE = focus.STORE
  LEFT JOIN (SELECT STORE, min(STORE_NAME) AS STORE_NAME FROM sales GROUP BY 1) nm ON rec.STORE = nm.STORE)"""


@query(
    "e02_store_recommendations",
    q(
        ALL,
        f"{E02} SELECT * FROM store_recs",
        f="TOTAL_SALES EFFICIENT_SALES_PCT AVG_EFFICIENCY_SCORE AVG_SALES_VELOCITY AVG_STOCK_TURNOVER "
        "PROJECTED_SALES_FOCUS_PCT TOTAL_STOCK EFFICIENT_STOCK",
    ),
)
def _(t):
    return ef.store_recommendations(metrics(t), plan_steps.store_names(t.sales, t.stock), THRESHOLD)


@query(
    "e02_store_recommendations_capped",
    q(
        ALL,
        E02.replace("END,\n    n\n  ))", f"END, {CAPPED}))")
        + " SELECT STORE, STORE_CATEGORY, RECOMMENDED_STYLES, PROJECTED_SALES_FOCUS_PCT FROM store_recs",
        f="PROJECTED_SALES_FOCUS_PCT",
    ),
)
def _(t):
    out = ef.store_recommendations(metrics(t), threshold=THRESHOLD, caps=ef.STYLE_CAPS)
    return out.select("STORE", "STORE_CATEGORY", "RECOMMENDED_STYLES", "PROJECTED_SALES_FOCUS_PCT")


E03 = f"""{E02},
picked AS (
  SELECT m.STORE, r.STORE_CATEGORY, m.STYLE AS RECOMMENDED_STYLE, rn AS RANK, round(score, 2) AS EFFICIENCY_SCORE,
    round(round(vel, 6), 2) AS SALES_VELOCITY, round(round(turn, 6), 2) AS STOCK_TURNOVER, ts AS TOTAL_SALES, st AS CURRENT_STOCK
  FROM (SELECT *, row_number() OVER (PARTITION BY STORE ORDER BY score DESC, STYLE) AS rn FROM metrics) m
  JOIN store_recs r ON m.STORE = r.STORE WHERE rn <= r.RECOMMENDED_STYLES)"""


@query(
    "e03_style_recommendations",
    q(
        ALL,
        f"{E03} SELECT * FROM picked",
        f="EFFICIENCY_SCORE SALES_VELOCITY STOCK_TURNOVER TOTAL_SALES CURRENT_STOCK",
    ),
)
def _(t):
    return ef.style_recommendations(metrics(t), stores(t))


@query(
    "e03_nested_recommendations",
    q(
        ALL,
        f"""{E03}
SELECT STORE, STORE_CATEGORY, count(*) AS RECOMMENDED_COUNT, string_agg(RECOMMENDED_STYLE, ',' ORDER BY RANK) AS STYLES
FROM picked GROUP BY 1, 2""",
    ),
)
def _(t):
    nested = ef.nested_style_recommendations(metrics(t), stores(t))
    return nested.withColumn("STYLES", F.array_join(F.col("STYLES.RECOMMENDED_STYLE"), ","))


@query(
    "e04_category_analysis",
    q(
        ALL,
        f"""{E02}
SELECT STORE_CATEGORY, count(*) AS Store_Count, round(round(avg(CURRENT_TOTAL_STYLES), 6), 2) AS Avg_Current_Styles,
  sum(CURRENT_TOTAL_STYLES) AS Total_Current_Styles, round(round(avg(RECOMMENDED_STYLES), 6), 2) AS Avg_Recommended_Styles,
  sum(RECOMMENDED_STYLES) AS Total_Recommended_Styles, round(round(avg(AVG_EFFICIENCY_SCORE), 6), 2) AS Avg_Efficiency_Score,
  round(round(avg(TOTAL_SALES), 6), 2) AS Avg_Total_Sales
FROM store_recs GROUP BY 1""",
        f="Avg_Current_Styles Avg_Recommended_Styles Avg_Efficiency_Score Avg_Total_Sales",
        i="Total_Current_Styles Total_Recommended_Styles",
    ),
)
def _(t):
    return ef.category_analysis(stores(t))


@query(
    "e05_summary_stats",
    q(
        ALL,
        f"""{E02}
SELECT count(*) AS total_stores, avg(CURRENT_TOTAL_STYLES) AS avg_current_styles, avg(RECOMMENDED_STYLES) AS avg_recommended_styles,
  avg(AVG_EFFICIENCY_SCORE) AS avg_efficiency_score, sum(CURRENT_TOTAL_STYLES) AS total_current_styles,
  sum(RECOMMENDED_STYLES) AS total_recommended_styles, sum(CURRENT_TOTAL_STYLES) - sum(RECOMMENDED_STYLES) AS style_reduction,
  count(*) FILTER (WHERE STORE_CATEGORY = 'High Performer') AS high_stores,
  count(*) FILTER (WHERE STORE_CATEGORY = 'Good Performer') AS good_stores,
  count(*) FILTER (WHERE STORE_CATEGORY = 'Average Performer') AS average_stores,
  count(*) FILTER (WHERE STORE_CATEGORY = 'Needs Improvement') AS needs_stores
FROM store_recs""",
        f="avg_current_styles avg_recommended_styles avg_efficiency_score",
        i="total_current_styles total_recommended_styles style_reduction",
    ),
)
def _(t):
    return ef.summary_stats(stores(t))


@query(
    "e06_top_store_styles",
    q(
        ALL,
        f"""{E01}
SELECT STORE, STYLE, round(score, 2) AS STYLE_EFFICIENCY_SCORE, round(round(vel, 6), 2) AS SALES_VELOCITY,
  round(round(turn, 6), 2) AS STOCK_TURNOVER, ts AS TOTAL_SALES, st AS STOCK
FROM metrics ORDER BY score DESC, STORE, STYLE LIMIT 50""",
        f="STYLE_EFFICIENCY_SCORE SALES_VELOCITY STOCK_TURNOVER TOTAL_SALES STOCK",
    ),
)
def _(t):
    return ef.top_store_styles(metrics(t), 50)


@query(
    "e06_top_styles",
    q(
        ALL,
        f"""{E01}
SELECT STYLE, avg(score) AS STYLE_EFFICIENCY_SCORE, sum(ts) AS TOTAL_SALES, avg(vel) AS SALES_VELOCITY, avg(turn) AS STOCK_TURNOVER
FROM metrics GROUP BY 1 ORDER BY round(avg(score), 6) DESC, STYLE LIMIT 20""",
        f="STYLE_EFFICIENCY_SCORE TOTAL_SALES SALES_VELOCITY STOCK_TURNOVER",
    ),
)
def _(t):
    return ef.top_styles(metrics(t), 20)


@query(
    "e07_change_view",
    q(
        ALL,
        f"""{E02}
SELECT STORE, STORE_NAME, CURRENT_TOTAL_STYLES, RECOMMENDED_STYLES, RECOMMENDED_STYLES - CURRENT_TOTAL_STYLES AS STYLE_CHANGE,
  round(round((RECOMMENDED_STYLES - CURRENT_TOTAL_STYLES) / CURRENT_TOTAL_STYLES * 100, 6), 1) AS CHANGE_PCT, STORE_CATEGORY
FROM store_recs""",
        f="CHANGE_PCT",
    ),
)
def _(t):
    cols = ["STORE", "STORE_NAME", "CURRENT_TOTAL_STYLES", "RECOMMENDED_STYLES", "STYLE_CHANGE", "CHANGE_PCT", "STORE_CATEGORY"]
    return ef.style_changes(stores(t)).select(*cols)


@query(
    "e07_insights",
    q(
        ALL,
        f"""{E02}
SELECT count(*) FILTER (WHERE STORE_CATEGORY = 'High Performer') AS high_stores,
  avg(AVG_EFFICIENCY_SCORE) FILTER (WHERE STORE_CATEGORY = 'High Performer') AS high_avg_score,
  avg(RECOMMENDED_STYLES) FILTER (WHERE STORE_CATEGORY = 'High Performer') AS high_avg_recommended,
  count(*) FILTER (WHERE STORE_CATEGORY = 'Needs Improvement') AS needs_stores,
  avg(AVG_EFFICIENCY_SCORE) FILTER (WHERE STORE_CATEGORY = 'Needs Improvement') AS needs_avg_score,
  avg(RECOMMENDED_STYLES) FILTER (WHERE STORE_CATEGORY = 'Needs Improvement') AS needs_avg_recommended,
  sum(CURRENT_TOTAL_STYLES) - sum(RECOMMENDED_STYLES) AS total_reduction
FROM store_recs""",
        f="high_avg_score high_avg_recommended needs_avg_score needs_avg_recommended",
        i="total_reduction",
    ),
)
def _(t):
    return ef.insights(stores(t))


@query(
    "e08_score_histogram",
    q(
        ALL,
        f"""{E02},
ends AS (SELECT min(AVG_EFFICIENCY_SCORE) AS lo, (max(AVG_EFFICIENCY_SCORE) - min(AVG_EFFICIENCY_SCORE)) / 20 AS w FROM store_recs),
binned AS (
  SELECT least(floor(round((AVG_EFFICIENCY_SCORE - lo) / w, 9)), 19) AS bin, count(*) AS n FROM store_recs, ends GROUP BY 1)
SELECT r.bin, lo + r.bin * w AS bin_start, lo + (r.bin + 1) * w AS bin_end, coalesce(n, 0) AS stores
FROM (SELECT unnest(range(20)) AS bin) r LEFT JOIN binned b ON r.bin = b.bin, ends""",
        f="bin_start bin_end",
        i="bin",
    ),
)
def _(t):
    return ef.score_histogram(stores(t))


@query(
    "e08_category_shares",
    q(
        ALL,
        f"""{E02}
SELECT STORE_CATEGORY, count(*) AS stores, count(*) / (SELECT count(*) FROM store_recs) * 100 AS share_pct FROM store_recs GROUP BY 1""",
        f="share_pct",
    ),
)
def _(t):
    return ef.category_shares(stores(t))


# --- min-max analysis --------------------------------------------------------

SCRIPT = """recent AS (SELECT * FROM style_sales WHERE DATE >= (SELECT max(DATE) FROM style_sales) - 365),
perf AS (
  SELECT STORE, STORE_NAME, STYLE, sum(QUANTITY) AS tq, count(*) AS tx, CAST(sum(NET_AMOUNT) AS DOUBLE) AS rev,
    count(DISTINCT DATE) AS days
  FROM recent GROUP BY 1, 2, 3),
held AS (SELECT k.STORE, m.STYLE, sum(STOCK) AS st FROM stock k JOIN sku_master m ON k.SKU = m.SKU GROUP BY 1, 2),
wh AS (SELECT m.STYLE, sum(WAREHOUSE_STOCK) AS ws FROM warehouse w JOIN sku_master m ON w.SKU = m.SKU GROUP BY 1),
base AS (
  SELECT p.*, coalesce(st, 0) AS st, coalesce(ws, 0) AS ws, tq / 365 AS dq, days / 365 AS fr
  FROM perf p LEFT JOIN held h ON p.STORE = h.STORE AND p.STYLE = h.STYLE LEFT JOIN wh ON p.STYLE = wh.STYLE)"""


def _minmax(col: str, low_is_good: bool = False) -> str:
    lo, hi = f"(SELECT min({col}) FROM sd)", f"(SELECT max({col}) FROM sd)"
    gain = f"({hi} - {col})" if low_is_good else f"({col} - {lo})"
    return f"CASE WHEN {hi} = {lo} THEN 50 ELSE {gain} / ({hi} - {lo}) * 100 END"


E09 = f"""{SCRIPT},
sd AS (SELECT *, st / (dq + 0.1) AS sdays FROM base),
sc AS (
  SELECT *, {_minmax("dq")} AS a, {_minmax("rev")} AS b, {_minmax("fr")} AS c, {_minmax("sdays", True)} AS d FROM sd),
eff AS (SELECT *, round(a * 0.30 + b * 0.25 + c * 0.25 + d * 0.20, 12) AS score FROM sc)"""


def style_stock(t):
    return t.stock.join(t.sku_master.select("SKU", "STYLE"), "SKU")


def style_warehouse(t):
    return t.warehouse.join(t.sku_master.select("SKU", "STYLE"), "SKU")


def minmax_styles(t):
    return shared(t, "minmax_styles", lambda: es.minmax_efficiency(t.style_sales, style_stock(t), DAYS))


@query(
    "e09_minmax_efficiency",
    q(
        STYLE_SALES,
        f"""{E09}
SELECT STORE, STORE_NAME, STYLE, tq AS TOTAL_QTY, rev AS TOTAL_REVENUE, days AS SALES_DAYS, st AS STOCK, dq AS DAILY_AVG_QTY,
  rev / tq AS REVENUE_PER_QTY, fr AS SALES_FREQUENCY, sdays AS STOCK_DAYS, a AS SALES_VELOCITY_SCORE, b AS REVENUE_SCORE,
  c AS FREQUENCY_SCORE, d AS STOCK_EFFICIENCY_SCORE, score AS EFFICIENCY_SCORE
FROM eff""",
        f="TOTAL_QTY TOTAL_REVENUE STOCK DAILY_AVG_QTY REVENUE_PER_QTY SALES_FREQUENCY STOCK_DAYS SALES_VELOCITY_SCORE "
        "REVENUE_SCORE FREQUENCY_SCORE STOCK_EFFICIENCY_SCORE EFFICIENCY_SCORE",
    ),
)
def _(t):
    return es.minmax_efficiency(t.style_sales, style_stock(t), DAYS)


E10 = f"""{E09},
st0 AS (
  SELECT STORE, STORE_NAME, count(*) AS n, round(avg(score), 12) AS e, sum(tq) AS tq,
    CAST(sum(CAST(rev AS DECIMAL(24,4))) AS DOUBLE) AS rev, count(*) FILTER (WHERE score >= 70) AS hi,
    count(*) FILTER (WHERE score >= 50 AND score < 70) AS me, count(*) FILTER (WHERE score < 50) AS low
  FROM eff GROUP BY 1, 2),
st1 AS (
  SELECT *, CASE WHEN e >= 70 THEN greatest(hi + floor(round(me * 0.5, 9)), n) WHEN e >= 50 THEN hi + floor(round(me * 0.7, 9))
    ELSE greatest(hi + floor(round(me * 0.3, 9)), floor(round(n * 0.5, 9))) END AS r FROM st0),
mm_stores AS (
  SELECT STORE, STORE_NAME, n AS CURRENT_STYLES, e AS EFFICIENCY_SCORE, tq AS TOTAL_SALES_QTY, rev AS TOTAL_REVENUE,
    hi AS HIGH_PERFORMERS, me AS MEDIUM_PERFORMERS, low AS LOW_PERFORMERS, r AS RECOMMENDED_STYLES, r - n AS CHANGE,
    (r - n) / n * 100 AS CHANGE_PCT,
    CASE WHEN e >= 70 THEN 'High Performer' WHEN e >= 50 THEN 'Medium Performer' ELSE 'Needs Improvement' END AS CATEGORY,
    CASE WHEN e >= 70 THEN 'Maintain high performers, selective expansion'
      WHEN e >= 50 THEN 'Focus on proven styles, reduce underperformers'
      ELSE 'Major optimization needed, focus on top performers' END AS STRATEGY
  FROM st1)"""


@query(
    "e10_minmax_store_plan",
    q(
        STYLE_SALES,
        f"{E10} SELECT * FROM mm_stores",
        f="EFFICIENCY_SCORE TOTAL_SALES_QTY TOTAL_REVENUE CHANGE_PCT",
        i="RECOMMENDED_STYLES CHANGE",
    ),
)
def _(t):
    return es.minmax_store_plan(minmax_styles(t))


@query(
    "e10_minmax_summary",
    q(
        STYLE_SALES,
        f"""{E10}
SELECT count(*) AS total_stores, avg(CURRENT_STYLES) AS avg_styles_per_store, avg(EFFICIENCY_SCORE) AS avg_efficiency_score,
  count(*) FILTER (WHERE CATEGORY = 'High Performer') AS high_stores,
  count(*) FILTER (WHERE CATEGORY = 'Medium Performer') AS medium_stores,
  count(*) FILTER (WHERE CATEGORY = 'Needs Improvement') AS low_stores, sum(TOTAL_SALES_QTY) AS total_sales_qty,
  sum(CAST(TOTAL_REVENUE AS DECIMAL(24,4))) AS total_revenue, sum(CHANGE) AS style_change,
  count(*) FILTER (WHERE CHANGE < 0) AS stores_needing_reduction, (SELECT count(DISTINCT STYLE) FROM eff) AS total_styles
FROM mm_stores""",
        f="avg_styles_per_store avg_efficiency_score total_sales_qty total_revenue",
        i="style_change",
    ),
)
def _(t):
    return es.minmax_summary(es.minmax_store_plan(minmax_styles(t)), minmax_styles(t))


@query(
    "e10_attention_list",
    q(
        STYLE_SALES,
        f"{E10} SELECT STORE, STORE_NAME, CURRENT_STYLES, CHANGE FROM mm_stores WHERE CHANGE < -5",
        i="CHANGE",
    ),
)
def _(t):
    out = es.attention_list(es.minmax_store_plan(minmax_styles(t)))
    return out.select("STORE", "STORE_NAME", "CURRENT_STYLES", "CHANGE")


# --- percent-rank analysis ---------------------------------------------------


def _pct(col: str) -> str:
    return (
        f"CASE WHEN (SELECT count(DISTINCT {col}) FROM pr0) = 1 THEN 50 ELSE "
        f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0) / count(*) OVER () * 100 END"
    )


E11 = f"""{SCRIPT},
pr0 AS (
  SELECT *, tq / (st + 1) AS turn, st + ws AS avail, tq / tx AS per, rev / tq AS rpu, st / (dq + 0.01) AS dos,
    ws / (dq + 0.01) AS wcd FROM base),
pr1 AS (
  SELECT *, {_pct("dq")} AS a, {_pct("fr")} AS b, {_pct("rev")} AS c, {_pct("turn")} AS d, {_pct("avail")} AS e FROM pr0),
tiered AS (
  SELECT *, CASE WHEN score >= 80 THEN 'Star Performer' WHEN score >= 60 THEN 'Strong Performer'
    WHEN score >= 40 THEN 'Average Performer' WHEN score >= 20 THEN 'Weak Performer' ELSE 'Poor Performer' END AS tier
  FROM (SELECT *, round(a * 0.30 + b * 0.25 + c * 0.20 + d * 0.15 + e * 0.10, 12) AS score FROM pr1) z)"""


def ranked_styles(t):
    return shared(
        t, "ranked_styles", lambda: es.rank_efficiency(t.style_sales, style_stock(t), style_warehouse(t), DAYS)
    )


@query(
    "e11_pctrank_efficiency",
    q(
        STYLE_SALES,
        f"""{E11}
SELECT STORE, STORE_NAME, STYLE, tq AS TOTAL_QTY, tx AS TRANSACTION_COUNT, rev AS TOTAL_REVENUE, days AS SALES_DAYS, st AS STOCK,
  ws AS WAREHOUSE_STOCK, dq AS DAILY_AVG_QTY, fr AS SALES_FREQUENCY, per AS AVG_TRANSACTION_SIZE, rpu AS REVENUE_PER_UNIT,
  dos AS DAYS_OF_STOCK, turn AS STOCK_TURNOVER, avail AS TOTAL_AVAILABLE, wcd AS WAREHOUSE_COVERAGE_DAYS,
  a AS SALES_VELOCITY_SCORE, b AS FREQUENCY_SCORE, c AS REVENUE_SCORE, d AS TURNOVER_SCORE, e AS AVAILABILITY_SCORE,
  score AS EFFICIENCY_SCORE, tier AS PERFORMANCE_TIER
FROM tiered""",
        f="TOTAL_QTY TOTAL_REVENUE STOCK WAREHOUSE_STOCK DAILY_AVG_QTY SALES_FREQUENCY AVG_TRANSACTION_SIZE REVENUE_PER_UNIT "
        "DAYS_OF_STOCK STOCK_TURNOVER TOTAL_AVAILABLE WAREHOUSE_COVERAGE_DAYS SALES_VELOCITY_SCORE FREQUENCY_SCORE REVENUE_SCORE "
        "TURNOVER_SCORE AVAILABILITY_SCORE EFFICIENCY_SCORE",
    ),
)
def _(t):
    return es.rank_efficiency(t.style_sales, style_stock(t), style_warehouse(t), DAYS)


E12 = f"""{E11},
o0 AS (
  SELECT STORE, min(STORE_NAME) AS STORE_NAME, count(*) AS n, CAST(sum(CAST(rev AS DECIMAL(24,4))) AS DOUBLE) AS rev,
    round(avg(score), 12) AS e, count(*) FILTER (WHERE tier = 'Star Performer') AS star,
    count(*) FILTER (WHERE tier = 'Strong Performer') AS strong, count(*) FILTER (WHERE tier = 'Average Performer') AS aver,
    count(*) FILTER (WHERE tier = 'Weak Performer') AS weak, count(*) FILTER (WHERE tier = 'Poor Performer') AS poor
  FROM tiered GROUP BY 1),
o1 AS (
  SELECT *, CAST(star + strong
    + floor(round(aver * CASE WHEN e >= 50 THEN 0.7 WHEN e >= 30 THEN 0.5 ELSE 0.3 END, 9)) AS BIGINT) AS opt FROM o0),
port AS (
  SELECT t.*, rn AS RANK FROM (SELECT *, row_number() OVER (PARTITION BY STORE ORDER BY score DESC, STYLE) AS rn FROM tiered) t
  JOIN o1 ON t.STORE = o1.STORE WHERE rn <= opt),
kept AS (SELECT STORE, CAST(sum(CAST(rev AS DECIMAL(24,4))) AS DOUBLE) AS k FROM port GROUP BY 1),
opt_stores AS (
  SELECT o1.STORE, STORE_NAME, n AS CURRENT_STYLES, rev AS TOTAL_REVENUE, e AS EFFICIENCY_SCORE, star AS STAR_PERFORMERS,
    strong AS STRONG_PERFORMERS, aver AS AVERAGE_PERFORMERS, weak AS WEAK_PERFORMERS, poor AS POOR_PERFORMERS,
    opt AS OPTIMAL_STYLES, n - opt AS STYLE_REDUCTION, (n - opt) / n * 100 AS REDUCTION_PERCENTAGE,
    CASE WHEN e >= 50 THEN 'Optimize & Expand' WHEN e >= 30 THEN 'Focus & Improve' ELSE 'Radical Optimization' END
      AS STRATEGY_CATEGORY,
    coalesce(k / rev, 0) * 100 AS ESTIMATED_REVENUE_RETENTION
  FROM o1 LEFT JOIN kept ON o1.STORE = kept.STORE)"""


def optimal_stores(t):
    return shared(t, "optimal_stores", lambda: es.optimal_style_count(ranked_styles(t)))


@query(
    "e12_optimal_style_count",
    q(
        STYLE_SALES,
        f"{E12} SELECT * FROM opt_stores",
        f="TOTAL_REVENUE EFFICIENCY_SCORE REDUCTION_PERCENTAGE ESTIMATED_REVENUE_RETENTION",
    ),
)
def _(t):
    return es.optimal_style_count(ranked_styles(t))


@query(
    "e12_optimal_style_count_bounded",
    q(
        STYLE_SALES,
        E12.replace("CAST(star + strong", "greatest(20, least(150, CAST(star + strong").replace("AS BIGINT) AS opt", "AS BIGINT))) AS opt")
        + " SELECT STORE, OPTIMAL_STYLES, STYLE_REDUCTION, ESTIMATED_REVENUE_RETENTION FROM opt_stores",
        f="ESTIMATED_REVENUE_RETENTION",
    ),
)
def _(t):
    out = es.optimal_style_count(ranked_styles(t), es.STYLE_BOUNDS)
    return out.select("STORE", "OPTIMAL_STYLES", "STYLE_REDUCTION", "ESTIMATED_REVENUE_RETENTION")


@query(
    "e12_recommended_portfolio",
    q(
        STYLE_SALES,
        f"{E12} SELECT STORE, STYLE, RANK, score AS EFFICIENCY_SCORE, tier AS PERFORMANCE_TIER FROM port",
        f="EFFICIENCY_SCORE",
    ),
)
def _(t):
    out = es.recommended_portfolio(ranked_styles(t), optimal_stores(t))
    return out.select("STORE", "STYLE", "RANK", "EFFICIENCY_SCORE", "PERFORMANCE_TIER")


@query(
    "e12_tier_table",
    q(
        STYLE_SALES,
        f"""{E11}
SELECT STORE, STORE_NAME, count(*) FILTER (WHERE tier = 'Star Performer') AS "Star Performer",
  count(*) FILTER (WHERE tier = 'Strong Performer') AS "Strong Performer",
  count(*) FILTER (WHERE tier = 'Average Performer') AS "Average Performer",
  count(*) FILTER (WHERE tier = 'Weak Performer') AS "Weak Performer",
  count(*) FILTER (WHERE tier = 'Poor Performer') AS "Poor Performer"
FROM tiered GROUP BY 1, 2""",
    ),
)
def _(t):
    return es.tier_table(ranked_styles(t))


@query(
    "e12_optimal_summary",
    q(
        STYLE_SALES,
        f"""{E12}
SELECT count(*) AS total_stores, sum(CURRENT_STYLES) AS current_styles, sum(OPTIMAL_STYLES) AS optimal_styles,
  sum(STYLE_REDUCTION) AS style_reduction, avg(REDUCTION_PERCENTAGE) AS avg_reduction_pct,
  avg(ESTIMATED_REVENUE_RETENTION) AS avg_revenue_retention_pct,
  count(*) FILTER (WHERE STYLE_REDUCTION > 0) AS stores_needing_reduction,
  count(*) FILTER (WHERE STYLE_REDUCTION < 0) AS stores_ready_for_expansion,
  count(*) FILTER (WHERE EFFICIENCY_SCORE >= 50) AS high_stores,
  count(*) FILTER (WHERE EFFICIENCY_SCORE >= 30 AND EFFICIENCY_SCORE < 50) AS medium_stores,
  count(*) FILTER (WHERE EFFICIENCY_SCORE < 30) AS low_stores
FROM opt_stores""",
        f="avg_reduction_pct avg_revenue_retention_pct",
        i="current_styles optimal_styles style_reduction",
    ),
)
def _(t):
    return es.optimal_summary(optimal_stores(t))


def _tables(report, measures):
    """Rows and a sum for some tables of a report."""
    parts = [
        report[name].agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(column).cast("double")).alias("total")).select(
            F.lit(name).alias("table"), "rows", "total"
        )
        for name, column in measures.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "e03_style_report",
    q(
        ALL,
        f"""{E03}
SELECT 'Store_Recommendations' AS "table", count(*) AS rows, sum(TOTAL_SALES) AS total FROM store_recs
UNION ALL SELECT 'Style_Performance', count(*), sum(ts) FROM metrics
UNION ALL SELECT 'Detailed_Style_Recs', count(*), sum(TOTAL_SALES) FROM picked""",
        f="total",
    ),
)
def _(t):
    tables = {"sales": t.sales, "stock": t.stock, "warehouse": t.warehouse, "sku_master": t.sku_master, "style_master": t.style_master}
    measures = {"Store_Recommendations": "TOTAL_SALES", "Style_Performance": "TOTAL_SALES", "Detailed_Style_Recs": "TOTAL_SALES"}
    return _tables(style_report(tables, DAYS, THRESHOLD), measures)


@query(
    "e10_minmax_report",
    q(
        STYLE_SALES,
        f"""{E10}
SELECT 'Store_Recommendations' AS "table", count(*) AS rows, sum(TOTAL_REVENUE) AS total FROM mm_stores
UNION ALL SELECT 'Style_Performance', count(*), sum(score) FROM eff
UNION ALL SELECT 'Top_Performing_Styles', count(*), sum(rev) FROM (SELECT * FROM eff ORDER BY score DESC, STORE, STYLE LIMIT 50) best
UNION ALL SELECT 'Summary_Statistics', 1, sum(TOTAL_SALES_QTY) FROM mm_stores
UNION ALL SELECT 'Stores_Needing_Attention', count(*), sum(CHANGE) FROM mm_stores WHERE CHANGE < -5""",
        f="total",
    ),
)
def _(t):
    report = minmax_report(t.style_sales, style_stock(t), DAYS)
    return _tables(
        report,
        {
            "Store_Recommendations": "TOTAL_REVENUE",
            "Style_Performance": "EFFICIENCY_SCORE",
            "Top_Performing_Styles": "TOTAL_REVENUE",
            "Summary_Statistics": "total_sales_qty",
            "Stores_Needing_Attention": "CHANGE",
        },
    )


@query(
    "e12_rank_report",
    q(
        STYLE_SALES,
        f"""{E12}
SELECT 'Store_Recommendations' AS "table", count(*) AS rows, sum(OPTIMAL_STYLES) AS total FROM opt_stores
UNION ALL SELECT 'Style_Analysis', count(*), sum(rev) FROM tiered
UNION ALL SELECT 'Recommended_Portfolio', count(*), sum(RANK) FROM port""",
        f="total",
    ),
)
def _(t):
    report = rank_report(t.style_sales, style_stock(t), style_warehouse(t), DAYS)
    return _tables(report, {"Store_Recommendations": "OPTIMAL_STYLES", "Style_Analysis": "TOTAL_REVENUE", "Recommended_Portfolio": "RANK"})
