"""Merchandising KPIs, weekly forecast and reorder recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from aislebrook.operators import merch, weekly
from aislebrook.plans.gender_report import gender_report

from .registry import query, shared
from .sqlbase import BILLS, BILLS_ALL, q

# The styles with a column of their own; the others share one.
STYLES = [f"BRAND#{i}" for i in range(11, 26)]


def kpi_sql(keys: str, src: str = "bills", total: str = "(SELECT sum(u) FROM k0)", rank: str = "") -> str:
    return f"""k0 AS (
  SELECT {keys}, sum(BILL_QUANTITY) AS u, CAST(sum(NET_AMOUNT) AS DOUBLE) AS rev, CAST(sum(GROSS_AMOUNT) AS DOUBLE) AS gross,
    avg(CASE WHEN RSP > 0 THEN RSP END) AS rsp, CAST(sum(ITEM_DISCOUNT_AMOUNT) AS DOUBLE) AS disc,
    CAST(sum(PROMO_AMOUNT) AS DOUBLE) AS promo, count(*) FILTER (WHERE VOID_STATUS = 'Y') AS voids,
    min(BILL_DATE) AS first_sale, max(BILL_DATE) AS last_sale
  FROM {src} GROUP BY {keys}),
k1 AS (SELECT *, rev / u AS ap, disc / u AS dpu, greatest((last_sale - first_sale) / 7, 1) AS weeks FROM k0),
kpis AS (
  SELECT *, u / weeks AS vel, u / {total} * 100 AS share, dense_rank() OVER ({rank} ORDER BY rev DESC) AS rk FROM k1)"""


HHI = """z AS (SELECT {g}STYLE, SIZE, sum(BILL_QUANTITY) AS q FROM {src} GROUP BY ALL),
hhi AS (
  SELECT {g}STYLE, CASE WHEN sum(q) > 0 THEN sum(q * q) / (sum(q) * sum(q)) ELSE 0 END AS hhi, count(*) AS sizes
  FROM z GROUP BY ALL)"""

KPI_COLS = """u AS units_sold, rev AS revenue, gross AS gross_amount, rsp AS avg_rsp, disc AS avg_item_discount,
  promo AS promo_amount, voids AS void_count, first_sale, last_sale, ap AS avg_price, dpu AS avg_item_discount_per_unit,
  weeks AS weeks_on_sale, vel AS velocity_units_per_week, share AS share_of_units_pct, rk AS revenue_rank"""
KPI_NUMBERS = (
    "units_sold revenue gross_amount avg_rsp avg_item_discount promo_amount avg_price avg_item_discount_per_unit "
    "weeks_on_sale velocity_units_per_week share_of_units_pct"
)


def flags_sql(by: str = "") -> str:
    on = "k.STYLE = h.STYLE" + (f" AND k.{by} = h.{by}" if by else "")
    g = f"GROUP BY {by}" if by else ""
    b = f"{by}, " if by else ""
    join = f"JOIN lim l ON f.{by} = l.{by}" if by else ", lim l"
    return f"""f0 AS (SELECT k.*, hhi, sizes, dpu / ap AS dp FROM kpis k LEFT JOIN hhi h ON {on}),
lim AS (
  SELECT {b}quantile_cont(vel, 0.5) AS mv, stddev_pop(vel) AS sv, quantile_cont(dp, 0.5) AS md, quantile_cont(hhi, 0.5) AS mh
  FROM f0 {g}),
f1 AS (
  SELECT f.*, vel < greatest(1, mv - sv) AS f_vel, coalesce(dp, 0) > greatest(0.05, md * 1.5) AS f_disc,
    coalesce(hhi, 0) > greatest(0.2, mh * 1.2) AS f_hhi, voids / u AS void_rate, voids / u > 0.02 AS f_void
  FROM f0 f {join}),
flags AS (
  SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN f_vel THEN 'low_velocity' END, CASE WHEN f_disc THEN 'high_discount' END,
    CASE WHEN f_hhi THEN 'size_concentration' END, CASE WHEN f_void THEN 'high_voids' END), ''), 'none') AS reasons FROM f1)"""


@query("m01_style_kpis", q(BILLS, f"{kpi_sql('STYLE')} SELECT STYLE, {KPI_COLS} FROM kpis", f=KPI_NUMBERS))
def _(t):
    return merch.style_kpis(t.bills)


@query(
    "m02_size_hhi",
    q(BILLS, HHI.format(g="", src="bills") + " SELECT STYLE, hhi AS size_hhi, sizes AS unique_sizes FROM hhi", f="size_hhi"),
)
def _(t):
    return merch.size_hhi(t.bills)


FLAG_COLS = """hhi AS size_hhi, sizes AS unique_sizes, f_vel AS flag_low_velocity, f_disc AS flag_high_discount_pct,
  f_hhi AS flag_high_size_concentration, void_rate, f_void AS flag_high_void_rate, reasons AS reasons_flags"""


@query(
    "m03_reason_flags",
    q(
        BILLS,
        f"{kpi_sql('STYLE')}, {HHI.format(g='', src='bills')}, {flags_sql()} SELECT STYLE, {KPI_COLS}, {FLAG_COLS} FROM flags",
        f=KPI_NUMBERS + " size_hhi void_rate",
    ),
)
def _(t):
    return merch.reason_flags(merch.style_kpis(t.bills), merch.size_hhi(t.bills))


GENDER_SQL = f"""gendered AS (
  SELECT b.*, GENDER FROM bills b JOIN style_master g ON b.STYLE = g.STYLE WHERE GENDER IN ('WOMEN', 'BOYS')),
{kpi_sql('GENDER, STYLE', 'gendered', 'sum(u) OVER (PARTITION BY GENDER)', 'PARTITION BY GENDER')},
{HHI.format(g='GENDER, ', src='gendered')}, {flags_sql('GENDER')}"""


def gendered(t):
    return t.bills.join(t.style_master, "STYLE", "left")


def gender_flags(t):
    return shared(t, "gender_flags", lambda: merch.gender_summary(gendered(t)))


@query(
    "m04_gender_summary",
    q(BILLS_ALL, f"{GENDER_SQL} SELECT GENDER, STYLE, {KPI_COLS}, {FLAG_COLS} FROM flags", f=KPI_NUMBERS + " size_hhi void_rate"),
)
def _(t):
    return merch.gender_summary(gendered(t))


@query(
    "m04_revenue_extremes",
    q(
        BILLS_ALL,
        f"""{GENDER_SQL},
r AS (
  SELECT 'top' AS list, *, row_number() OVER (PARTITION BY GENDER ORDER BY rev DESC, STYLE) AS n FROM flags
  UNION ALL
  SELECT 'bottom' AS list, *, row_number() OVER (PARTITION BY GENDER ORDER BY rev, STYLE) AS n FROM flags)
SELECT list, GENDER, n AS rank, STYLE, rev AS revenue, u AS units_sold, reasons AS reasons_flags FROM r WHERE n <= 20""",
        f="revenue units_sold",
    ),
)
def _(t):
    return merch.revenue_extremes(gender_flags(t))


SERIES = """series AS (
  SELECT STYLE, strftime(BILL_DATE, '%Y-%m') AS month, sum(BILL_QUANTITY) AS units_sold, CAST(sum(NET_AMOUNT) AS DOUBLE) AS revenue
  FROM bills GROUP BY 1, 2)"""


@query("m05_monthly_series", q(BILLS, f"{SERIES} SELECT * FROM series", f="units_sold revenue"))
def _(t):
    return merch.monthly_series(t.bills)


@query(
    "m05_monthly_pivot",
    q(
        BILLS,
        f"{SERIES} SELECT month, "
        + ", ".join(f"coalesce(sum(units_sold) FILTER (WHERE STYLE = '{s}'), 0) AS \"{s}\"" for s in STYLES)
        + ", coalesce(sum(units_sold) FILTER (WHERE STYLE NOT IN ("
        + ", ".join(f"'{s}'" for s in STYLES)
        + ")), 0) AS OTHER FROM series GROUP BY 1",
        f=" ".join(STYLES) + " OTHER",
    ),
)
def _(t):
    return merch.monthly_pivot(merch.monthly_series(t.bills), STYLES)


@query(
    "m06_first_sale",
    q(
        BILLS,
        """f AS (SELECT STYLE, min(BILL_DATE) AS first_sale_date FROM bills GROUP BY 1)
SELECT b.STYLE, first_sale_date, first_sale_date >= DATE '1995-01-03' AS launched_after, count(*) AS lines
FROM bills b JOIN f ON b.STYLE = f.STYLE GROUP BY 1, 2, 3""",
    ),
)
def _(t):
    lines = t.bills.groupBy("STYLE").agg(F.count(F.lit(1)).alias("lines"))
    out = merch.with_launch_flag(lines, merch.first_sale(t.bills), "1995-01-03")
    return out.select("STYLE", "first_sale_date", "launched_after", "lines")


@query(
    "m07_dept_category",
    q(
        BILLS,
        """a AS (
  SELECT 'DEPARTMENT' AS level, DEPARTMENT AS name, sum(BILL_QUANTITY) AS u, CAST(sum(NET_AMOUNT) AS DOUBLE) AS r FROM bills GROUP BY 2
  UNION ALL
  SELECT 'CATEGORY', CATEGORY, sum(BILL_QUANTITY), CAST(sum(NET_AMOUNT) AS DOUBLE) FROM bills GROUP BY 2)
SELECT level, name, u AS units_sold, r AS revenue, r / u AS avg_price FROM a""",
        f="units_sold revenue avg_price",
    ),
)
def _(t):
    parts = [
        merch.by_attribute(t.bills, c).select(F.lit(c).alias("level"), F.col(c).alias("name"), "units_sold", "revenue", "avg_price")
        for c in ("DEPARTMENT", "CATEGORY")
    ]
    return parts[0].unionByName(parts[1])


def _top_sql() -> str:
    parts = []
    for key, tag in (("STYLE", "styles"), ("SKU", "skus")):
        for metric, name in (("u", "units"), ("r", "revenue"), ("asp", "asp")):
            parts.append(
                f"SELECT 'top_{tag}_by_{name}' AS list, key, u AS units_sold, r AS revenue, p AS avg_price, asp FROM "
                f"(SELECT * FROM agg_{tag} ORDER BY {metric} DESC, key LIMIT 10)"
            )
    aggs = ", ".join(
        f"agg_{tag} AS (SELECT {key} AS key, sum(BILL_QUANTITY) AS u, CAST(sum(NET_AMOUNT) AS DOUBLE) AS r, avg(RSP) AS p, "
        f"CAST(sum(NET_AMOUNT) AS DOUBLE) / sum(BILL_QUANTITY) AS asp FROM bills GROUP BY 1)"
        for key, tag in (("STYLE", "styles"), ("SKU", "skus"))
    )
    return f"{aggs}, alltops AS ({' UNION ALL '.join(parts)}) SELECT * FROM alltops"


@query("m08_top_lists", q(BILLS, _top_sql(), f="units_sold revenue avg_price asp"))
def _(t):
    parts = [
        df.select(F.lit(name).alias("list"), F.col(df.columns[0]).alias("key"), "units_sold", "revenue", "avg_price", "asp")
        for name, df in merch.top_lists(t.bills, 10).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "m09_style_daily",
    q(
        BILLS,
        """daily AS (SELECT STYLE, BILL_DATE AS d, sum(BILL_QUANTITY) AS u FROM bills GROUP BY 1, 2),
ends AS (SELECT STYLE, min(d) AS a, max(d) AS b FROM daily GROUP BY 1),
cal AS (SELECT STYLE, a, b, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM ends),
padded AS (SELECT c.STYLE, a, b, c.d, coalesce(u, 0) AS u FROM cal c LEFT JOIN daily x ON c.STYLE = x.STYLE AND c.d = x.d),
med AS (SELECT STYLE, quantile_cont(u, 0.5) AS m FROM padded GROUP BY 1),
rolled AS (
  SELECT p.*, sum(u) OVER (PARTITION BY STYLE ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS w,
    sum(CASE WHEN u = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY STYLE ORDER BY d) AS run FROM padded p),
gaps AS (SELECT STYLE, run, count(*) FILTER (WHERE u = 0) AS g FROM rolled GROUP BY 1, 2),
months AS (SELECT STYLE, date_trunc('month', d) AS mo, sum(u) AS mu FROM daily GROUP BY 1, 2)
SELECT r.STYLE, any_value(a) AS first_sale, any_value(b) AS last_sale, any_value(b - a + 1) AS days_between,
  count(*) FILTER (WHERE u > 0) AS days_with_sales, count(*) FILTER (WHERE u = 0) AS days_without_sales,
  any_value(m) AS median_daily_sales, count(*) FILTER (WHERE u > m) AS days_above_median,
  (SELECT max(g) FROM gaps g WHERE g.STYLE = r.STYLE) AS longest_zero_gap_days,
  max(u) AS max_daily_run_rate, max(w) AS max_weekly_run_rate,
  (SELECT max(mu) FROM months o WHERE o.STYLE = r.STYLE) AS max_monthly_run_rate
FROM rolled r JOIN med ON r.STYLE = med.STYLE GROUP BY 1""",
        f="median_daily_sales max_daily_run_rate max_weekly_run_rate max_monthly_run_rate",
    ),
)
def _(t):
    return merch.style_daily(t.bills)


WEEKLY = """wk AS (SELECT SKU, CAST(date_trunc('week', BILL_DATE) AS DATE) AS w, sum(BILL_QUANTITY) AS x FROM bills GROUP BY 1, 2),
lw AS (SELECT max(w) AS m FROM wk),
rw AS (SELECT wk.* FROM wk, lw WHERE w > m - 182),
fw AS (SELECT SKU, min(w) AS a FROM rw GROUP BY 1),
cal AS (SELECT SKU, CAST(unnest(generate_series(a, m, INTERVAL 7 DAY)) AS DATE) AS w FROM fw, lw),
pad AS (
  SELECT c.SKU, c.w, coalesce(x, 0) AS x, row_number() OVER (PARTITION BY c.SKU ORDER BY c.w) - 1 AS i,
    count(*) OVER (PARTITION BY c.SKU) AS n
  FROM cal c LEFT JOIN rw r ON c.SKU = r.SKU AND c.w = r.w),
fc0 AS (
  SELECT SKU, any_value(n) AS n, avg(x) AS mean, stddev_pop(x) AS sd,
    sum(x * CASE WHEN i = 0 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - 1 - i) END) AS ewma,
    avg(x) FILTER (WHERE n - 1 - i < 4) AS sma
  FROM pad GROUP BY 1),
fc AS (SELECT *, sd / nullif(mean, 0) AS cv, 0.6 * ewma + 0.4 * sma AS f FROM fc0)"""

FC_COLS = """SKU, mean AS mean_weekly, sd AS std_weekly, cv AS cv_weekly, ewma AS ewma_weekly,
  sma AS sma4_weekly, f AS forecast_weekly, n AS history_weeks, f * 12 AS forecast_horizon_units"""
FC_NUMBERS = "mean_weekly std_weekly cv_weekly ewma_weekly sma4_weekly forecast_weekly forecast_horizon_units"


@query("m10_weekly_forecast", q(BILLS, f"{WEEKLY} SELECT {FC_COLS} FROM fc", f=FC_NUMBERS))
def _(t):
    return weekly.weekly_forecast(t.bills)


LEVELS = {0.75: "0.841", 0.875: "(1.036 + 1.282) / 2", 0.95: "1.645", 0.9625: "(1.645 + 1.96) / 2", 0.999: "2.326"}


@query(
    "m11_z_value",
    q(
        BILLS,
        f"{WEEKLY}, lv AS ("
        + " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS level, CAST({z} AS DOUBLE) AS z" for p, z in LEVELS.items())
        + """)
SELECT level, SKU, ceil(round(sd * 2.0 * z, 6)) AS safety_stock_units,
  ceil(round(f * 4 + sd * 2.0 * z, 6)) AS reorder_point_units FROM fc, lv""",
        f="level",
        i="safety_stock_units reorder_point_units",
    ),
)
def _(t):
    """Safety stock and reorder point of every SKU at service levels in, between and
    beyond the table."""
    forecast = shared(t, "forecast", lambda: weekly.weekly_forecast(t.bills))
    parts = [
        weekly.reorder_recommendations(forecast, service_level=p).select(
            F.lit(p).alias("level"), "SKU", "safety_stock_units", "reorder_point_units"
        )
        for p in LEVELS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "m12_reorder_reco",
    q(
        BILLS,
        f"""{WEEKLY}
SELECT {FC_COLS}, ceil(round(sd * 2.0 * 1.645, 6)) AS safety_stock_units, ceil(round(f * 4 + sd * 2.0 * 1.645, 6)) AS reorder_point_units,
  ceil(round(f * 12 + sd * 2.0 * 1.645, 6)) AS order_up_to_units, f * 12 * (1 + coalesce(cv, 0)) AS priority_score
FROM fc""",
        f=FC_NUMBERS + " priority_score",
        i="safety_stock_units reorder_point_units order_up_to_units",
    ),
)
def _(t):
    return weekly.reorder_recommendations(weekly.weekly_forecast(t.bills))


@query(
    "m13_monthly_key_styles",
    q(
        BILLS,
        f"""{SERIES},
meta AS (SELECT STYLE, min(CATEGORY) AS CATEGORY, min(DEPARTMENT) AS DEPARTMENT FROM bills GROUP BY 1),
r AS (
  SELECT 'by_revenue' AS list, *, row_number() OVER (PARTITION BY month ORDER BY revenue DESC, STYLE) AS rank FROM series
  UNION ALL
  SELECT 'by_units' AS list, *, row_number() OVER (PARTITION BY month ORDER BY units_sold DESC, STYLE) AS rank FROM series)
SELECT r.*, CATEGORY, DEPARTMENT FROM r JOIN meta ON r.STYLE = meta.STYLE WHERE rank <= 10""",
        f="units_sold revenue",
    ),
)
def _(t):
    parts = [df.withColumn("list", F.lit(n)) for n, df in merch.monthly_key_styles(t.bills, 10).items()]
    return parts[0].unionByName(parts[1])


@query(
    "m14_gender_report_summary",
    q(
        BILLS_ALL,
        f"""{GENDER_SQL}
SELECT GENDER, count(*) AS total_styles, sum(u) AS total_units, sum(rev) AS total_revenue FROM flags GROUP BY 1""",
        f="total_units total_revenue",
    ),
)
def _(t):
    return merch.gender_totals(gender_flags(t))


START = "1996-01-01"


def _gender_tables_sql(gender: str) -> str:
    """Rows and a sum of every table of one gender; `gendered` holds its lines, `flags` its styles."""
    tag, lines, styles = gender.lower(), f"(SELECT * FROM gendered WHERE GENDER = '{gender}') bl", f"(SELECT * FROM flags WHERE GENDER = '{gender}') fl"

    def row(name: str, total: str, src: str) -> str:
        return f"SELECT '{tag}_{name}' AS \"table\", count(*) AS rows, CAST(sum(CAST({total} AS DECIMAL(24,4))) AS DOUBLE) AS total FROM {src}"

    series = f"SELECT STYLE, strftime(BILL_DATE, '%Y-%m') AS month, sum(BILL_QUANTITY) AS u, CAST(sum(NET_AMOUNT) AS DOUBLE) AS r FROM {lines} GROUP BY 1, 2"
    forecast = f"(WITH {WEEKLY.replace('FROM bills', f'FROM {lines}')} SELECT *, ceil(round(f * 12 + sd * 2.0 * 1.645, 6)) AS upto FROM fc) fcs"
    parts = [
        row("raw", "BILL_QUANTITY", lines),
        row("style_metrics", "u", styles),
        row("top20", "rev", f"(SELECT * FROM {styles} ORDER BY rev DESC, STYLE LIMIT 20) x"),
        row("bottom20", "rev", f"(SELECT * FROM {styles} ORDER BY rev, STYLE LIMIT 20) x"),
        row("reasons", "void_rate", styles),
        row("ts_monthly", "u", f"({series}) x"),
        row("demand_forecast", "f", forecast),
        row("reorder_reco", "upto", forecast),
        row("department", "r", f"(SELECT DEPARTMENT, sum(NET_AMOUNT) AS r FROM {lines} GROUP BY 1) x"),
        row("category", "r", f"(SELECT CATEGORY, sum(NET_AMOUNT) AS r FROM {lines} GROUP BY 1) x"),
        row("style_daily", "n", f"(SELECT STYLE, max(BILL_DATE) - min(BILL_DATE) + 1 AS n FROM {lines} GROUP BY 1) x"),
    ]
    for key, plural in (("STYLE", "styles"), ("SKU", "skus")):
        agg = (
            f"(SELECT {key} AS k, sum(BILL_QUANTITY) AS u, CAST(sum(NET_AMOUNT) AS DOUBLE) AS r, "
            f"CAST(sum(NET_AMOUNT) AS DOUBLE) / sum(BILL_QUANTITY) AS asp FROM {lines} GROUP BY 1) g"
        )
        parts += [row(f"top_{plural}_by_{name}", c, f"(SELECT * FROM {agg} ORDER BY {c} DESC, k LIMIT 100) x") for name, c in (("units", "u"), ("revenue", "r"), ("asp", "asp"))]
    for name, c in (("revenue", "r"), ("units", "u")):
        place = f"SELECT *, row_number() OVER (PARTITION BY month ORDER BY {c} DESC, STYLE) AS n FROM ({series}) y"
        parts.append(row(f"monthly_by_{name}", c, f"(SELECT * FROM ({place}) z WHERE n <= 20) x"))
    return " UNION ALL ".join(parts)


@query(
    "m14_gender_report",
    q(
        BILLS_ALL,
        GENDER_SQL.replace("WHERE GENDER IN", f"WHERE BILL_DATE >= DATE '{START}' AND GENDER IN")
        + f""",
every AS (
  SELECT 'summary' AS "table", count(DISTINCT GENDER) AS rows, CAST(sum(CAST(rev AS DECIMAL(24,4))) AS DOUBLE) AS total FROM flags
  UNION ALL {_gender_tables_sql("WOMEN")} UNION ALL {_gender_tables_sql("BOYS")})
SELECT * FROM every""",
        f="total",
    ),
)
def _(t):
    """Rows and a sum of all tables of the gender report."""
    report = gender_report(t.bills, t.sku_attributes, t.style_master, START)
    measures = {"summary": "total_revenue"}
    per = {
        "raw": "BILL_QUANTITY",
        "style_metrics": "units_sold",
        "top20": "revenue",
        "bottom20": "revenue",
        "reasons": "void_rate",
        "ts_monthly": "units_sold",
        "demand_forecast": "forecast_weekly",
        "reorder_reco": "order_up_to_units",
        "department": "revenue",
        "category": "revenue",
        "style_daily": "days_between",
        "monthly_by_revenue": "revenue",
        "monthly_by_units": "units_sold",
    }
    per |= {f"top_{k}_by_{n}": c for k in ("styles", "skus") for n, c in (("units", "units_sold"), ("revenue", "revenue"), ("asp", "asp"))}
    measures |= {f"{g}_{name}": column for g in ("women", "boys") for name, column in per.items()}
    if set(measures) != set(report):
        raise ValueError(f"tables without a measure: {set(measures) ^ set(report)}")
    parts = [
        report[name].agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(column).cast("decimal(24,4)")).alias("total")).select(F.lit(name).alias("table"), "rows", "total")
        for name, column in measures.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
