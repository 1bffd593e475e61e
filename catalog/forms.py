"""The join, aggregate, window and set forms the operators are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from aislebrook.functions.stats import longest_gap, month_of, quantiles, ratio, rolling_sum, stable, with_dense_rank_desc, with_percent_ranks
from aislebrook.operators import plan_steps, replenish_final
from aislebrook.operators.demand import velocity_simple
from aislebrook.sources.scratch import materialize

from .registry import query
from .sqlbase import ALL, BILLS, BILLS_ALL, SALES, q

BY_SKU = "by_sku AS (SELECT SKU, sum(QUANTITY) AS units FROM sales GROUP BY 1)"


def by_sku(t):
    return t.sales.groupBy("SKU").agg(F.sum("QUANTITY").alias("units"))


# The master with a made-up SKU, never sold, beside each of its own.
WITH_NEW = "items AS (SELECT SKU, STYLE FROM sku_master UNION ALL SELECT 'NEW' || SKU, STYLE FROM sku_master)"


def with_new(t):
    own = t.sku_master.select("SKU", "STYLE")
    return own.union(own.withColumn("SKU", F.concat(F.lit("NEW"), "SKU")))


# --- joins -------------------------------------------------------------------


@query(
    "j01_left_join",
    q(
        ALL,
        f"""{BY_SKU}
SELECT b.SKU, units, STYLE, GENDER, WAREHOUSE_STOCK FROM by_sku b LEFT JOIN sku_master m USING (SKU)
LEFT JOIN style_master g USING (STYLE) LEFT JOIN warehouse w ON b.SKU = w.SKU""",
        f="units WAREHOUSE_STOCK",
    ),
)
def _(t):
    out = by_sku(t).join(t.sku_master, "SKU", "left").join(t.style_master, "STYLE", "left").join(t.warehouse, "SKU", "left")
    return out.select("SKU", "units", "STYLE", "GENDER", "WAREHOUSE_STOCK")


@query(
    "j02_full_outer_join",
    q(
        ALL,
        """v AS (SELECT STORE, SKU, sum(QUANTITY) / 90.0 AS d FROM sales WHERE DATE > (SELECT max(DATE) FROM sales) - 90 GROUP BY 1, 2),
k AS (SELECT STORE, SKU, STOCK FROM stock)
SELECT coalesce(v.STORE, k.STORE) AS STORE, coalesce(v.SKU, k.SKU) AS SKU, coalesce(d, 0) AS DAILY_SALES, coalesce(STOCK, 0) AS STOCK
FROM v FULL JOIN k ON v.STORE = k.STORE AND v.SKU = k.SKU""",
        f="DAILY_SALES STOCK",
    ),
)
def _(t):
    return plan_steps.pairs(velocity_simple(t.sales, 90), t.stock)


@query(
    "j03_inner_join",
    q(
        ALL,
        f"""{BY_SKU}
SELECT GENDER, SIZE, sum(units) AS units FROM by_sku JOIN sku_master USING (SKU) JOIN style_master USING (STYLE) GROUP BY 1, 2""",
        f="units",
    ),
)
def _(t):
    out = by_sku(t).join(t.sku_master, "SKU").join(t.style_master, "STYLE")
    return out.groupBy("GENDER", "SIZE").agg(F.sum("units").alias("units"))


@query(
    "j04_cross_join",
    q(ALL, "SELECT STORE, m.SKU FROM (SELECT DISTINCT STORE FROM stock) s CROSS JOIN (SELECT DISTINCT SKU FROM sku_master) m"),
)
def _(t):
    return replenish_final.store_sku_grid(t.stock, t.sku_master.select("SKU").distinct(), chunk=8)


@query(
    "j05_semi_join",
    q(ALL, f"{WITH_NEW} SELECT SKU, STYLE FROM items WHERE SKU IN (SELECT SKU FROM sales)"),
)
def _(t):
    return with_new(t).join(t.sales.select("SKU"), "SKU", "left_semi")


@query(
    "j06_anti_join",
    q(ALL, "SELECT SKU, STYLE FROM sku_master m WHERE NOT EXISTS (SELECT 1 FROM style_master g WHERE g.STYLE = m.STYLE)"),
)
def _(t):
    return t.sku_master.select("SKU", "STYLE").join(t.style_master, "STYLE", "left_anti")


@query(
    "j07_map_lookup",
    q(
        SALES,
        """SELECT strftime(DATE, '%Y-%m') AS month, sum(QUANTITY * CASE month(DATE) WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 1.1
  WHEN 7 THEN 0.9 WHEN 8 THEN 0.9 WHEN 9 THEN 1.1 WHEN 10 THEN 1.2 WHEN 11 THEN 1.3 WHEN 12 THEN 1.4 ELSE 1.0 END) AS adjusted
FROM sales GROUP BY 1""",
        f="adjusted",
    ),
)
def _(t):
    factor = replenish_final.seasonal_factor(F.col("DATE"))
    return t.sales.groupBy(month_of("DATE").alias("month")).agg(F.sum(F.col("QUANTITY") * factor).alias("adjusted"))


@query(
    "j08_self_pair_join",
    q(
        BILLS,
        """c AS (SELECT DISTINCT BILL_NO AS b, COLOR AS i FROM bills)
SELECT x.i AS item1, y.i AS item2, count(*) AS frequency FROM c x JOIN c y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2""",
    ),
)
def _(t):
    from aislebrook.operators.basket import common_pairs

    return common_pairs(t.bills, "COLOR", block_items=3)


@query(
    "j09_renamed_key_join",
    q(
        BILLS_ALL,
        """c AS (SELECT SKU AS ICODE, sum(BILL_QUANTITY) AS units FROM bills GROUP BY 1)
SELECT ICODE, units, m.STYLE, m.SIZE FROM c LEFT JOIN sku_master m ON c.ICODE = m.SKU""",
        f="units",
    ),
)
def _(t):
    codes = t.bills.groupBy(F.col("SKU").alias("ICODE")).agg(F.sum("BILL_QUANTITY").alias("units"))
    m = t.sku_master
    return codes.join(m, codes.ICODE == m.SKU, "left").select("ICODE", "units", "STYLE", "SIZE")


# --- aggregates --------------------------------------------------------------


@query(
    "a01_basic_aggregates",
    q(
        BILLS,
        """SELECT STORE, STYLE, sum(BILL_QUANTITY) AS units, avg(BILL_QUANTITY) AS mean, count(*) AS lines, min(BILL_DATE) AS first,
  max(BILL_DATE) AS last FROM bills GROUP BY 1, 2""",
        f="units mean",
    ),
)
def _(t):
    return t.bills.groupBy("STORE", "STYLE").agg(
        F.sum("BILL_QUANTITY").alias("units"),
        F.avg("BILL_QUANTITY").alias("mean"),
        F.count(F.lit(1)).alias("lines"),
        F.min("BILL_DATE").alias("first"),
        F.max("BILL_DATE").alias("last"),
    )


@query("a02_count_distinct", q(BILLS, "SELECT STORE, count(DISTINCT SKU) AS skus, count(DISTINCT BILL_DATE) AS days FROM bills GROUP BY 1"))
def _(t):
    return t.bills.groupBy("STORE").agg(F.count_distinct("SKU").alias("skus"), F.count_distinct("BILL_DATE").alias("days"))


@query(
    "a03_conditional_aggregates",
    q(
        BILLS,
        """SELECT STYLE, count(*) FILTER (WHERE VOID_STATUS = 'Y') AS voids, avg(CASE WHEN RSP > 950 THEN RSP END) AS high_rsp,
  avg(CASE WHEN BILL_QUANTITY = 1 THEN 1.0 ELSE 0.0 END) AS single_share FROM bills GROUP BY 1""",
        f="high_rsp single_share",
    ),
)
def _(t):
    return t.bills.groupBy("STYLE").agg(
        F.count_if(F.col("VOID_STATUS") == "Y").alias("voids"),
        F.avg(F.when(F.col("RSP") > 950, F.col("RSP"))).alias("high_rsp"),
        F.avg((F.col("BILL_QUANTITY") == 1).cast("double")).alias("single_share"),
    )


@query(
    "a04_weighted_aggregate",
    q(
        SALES,
        """m AS (SELECT max(DATE) AS d FROM sales)
SELECT STORE, sum(QUANTITY * exp(-(d - DATE) / 365.0)) / sum(exp(-(d - DATE) / 365.0)) AS weighted FROM sales, m GROUP BY 1""",
        f="weighted",
    ),
)
def _(t):
    last = t.sales.agg(F.max("DATE").alias("d")).scalar()
    w = F.exp(-F.datediff(last, F.col("DATE")) / 365.0)
    return t.sales.groupBy("STORE").agg(ratio(F.sum(F.col("QUANTITY") * w), F.sum(w)).alias("weighted"))


@query("a05_first_per_group", q(ALL, "SELECT STYLE, min(SKU) AS SKU, arg_min(COLOR, SKU) AS COLOR FROM sku_master GROUP BY 1"))
def _(t):
    return t.sku_master.groupBy("STYLE").agg(F.min("SKU").alias("SKU"), F.min_by("COLOR", "SKU").alias("COLOR"))


@query(
    "a06_quantiles_mode_spread",
    q(
        SALES,
        """c AS (SELECT STORE, QUANTITY, count(*) AS n FROM sales GROUP BY 1, 2),
md AS (SELECT STORE, QUANTITY AS mode FROM c QUALIFY row_number() OVER (PARTITION BY STORE ORDER BY n DESC, QUANTITY) = 1)
SELECT s.STORE, quantile_cont(QUANTITY, 0.5) AS median, quantile_cont(QUANTITY, 0.9) AS q90, any_value(mode) AS mode,
  stddev_pop(QUANTITY) AS sd_pop, stddev_samp(QUANTITY) AS sd_samp FROM sales s JOIN md ON s.STORE = md.STORE GROUP BY 1""",
        f="median q90 mode sd_pop sd_samp",
    ),
)
def _(t):
    cuts = quantiles(t.sales, {"median": ("QUANTITY", 0.5), "q90": ("QUANTITY", 0.9)}, ["STORE"])
    sizes = t.sales.groupBy("STORE", "QUANTITY").agg(F.count(F.lit(1)).alias("n"))
    mode = sizes.groupBy("STORE").agg(
        F.min_by("QUANTITY", F.struct((-F.col("n")).alias("k"), F.col("QUANTITY").alias("v"))).alias("mode")
    )
    spread = t.sales.groupBy("STORE").agg(
        F.stddev_pop("QUANTITY").alias("sd_pop"), F.stddev_samp("QUANTITY").alias("sd_samp")
    )
    return cuts.join(mode, "STORE").join(spread, "STORE")


TOTALS = """p AS (SELECT STORE, STYLE, sum(BILL_QUANTITY) AS units FROM bills GROUP BY 1, 2)"""


def store_styles(t):
    return t.bills.groupBy("STORE", "STYLE").agg(F.sum("BILL_QUANTITY").alias("units"))


@query(
    "a07_group_total_to_rows",
    q(BILLS, f"{TOTALS} SELECT *, units / sum(units) OVER (PARTITION BY STORE) AS share FROM p", f="units share"),
)
def _(t):
    p = materialize(store_styles(t))
    total = p.groupBy("STORE").agg(F.sum("units").alias("total"))
    return p.join(total, "STORE").select("STORE", "STYLE", "units", ratio(F.col("units"), F.col("total")).alias("share"))


# The departments with a column of their own; the others share one.
DEPARTMENTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
PIVOTED = [*DEPARTMENTS, "OTHER"]
NAMED = f"CASE WHEN DEPARTMENT IN ({', '.join(map(repr, DEPARTMENTS))}) THEN DEPARTMENT ELSE 'OTHER' END"


def _named_departments(t):
    return t.bills.withColumn("DEPARTMENT", F.expr(NAMED))


@query(
    "a08_pivot",
    q(
        BILLS,
        "SELECT strftime(BILL_DATE, '%Y-%m') AS month, "
        + ", ".join(f"coalesce(sum(BILL_QUANTITY) FILTER (WHERE {NAMED} = '{d}'), 0) AS {d}" for d in PIVOTED)
        + " FROM bills GROUP BY 1",
        f=" ".join(PIVOTED),
    ),
)
def _(t):
    lines = _named_departments(t).groupBy(month_of("BILL_DATE").alias("month"))
    return lines.pivot("DEPARTMENT", PIVOTED).sum("BILL_QUANTITY").na.fill(0.0, PIVOTED)


@query(
    "a09_crosstab",
    q(
        BILLS,
        "SELECT BILL_NO, " + ", ".join(f"CAST(bool_or({NAMED} = '{d}') AS BIGINT) AS {d}" for d in PIVOTED) + " FROM bills GROUP BY 1",
    ),
)
def _(t):
    present = _named_departments(t).select("BILL_NO", "DEPARTMENT").distinct()
    return present.groupBy("BILL_NO").pivot("DEPARTMENT", PIVOTED).count().na.fill(0, PIVOTED)


@query("a10_value_counts", q(BILLS, "SELECT SIZE, count(*) AS n FROM bills GROUP BY 1"))
def _(t):
    return t.bills.groupBy("SIZE").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a11_multi_level_names",
    q(
        BILLS,
        f"""{TOTALS}
SELECT STYLE, count(*) AS Store_Count, round(round(avg(units), 6), 2) AS Avg_Units, sum(units) AS Total_Units,
  max(units) AS Max_Units FROM p GROUP BY 1""",
        f="Avg_Units Total_Units Max_Units",
    ),
)
def _(t):
    return store_styles(t).groupBy("STYLE").agg(
        F.count(F.lit(1)).alias("Store_Count"),
        F.round(stable(F.avg("units")), 2).alias("Avg_Units"),
        F.sum("units").alias("Total_Units"),
        F.max("units").alias("Max_Units"),
    )


@query(
    "a12_global_normalisation",
    q(
        BILLS,
        f"""{TOTALS}
SELECT STORE, STYLE, units / (SELECT max(units) FROM p) AS of_max,
  (units - (SELECT min(units) FROM p)) / ((SELECT max(units) FROM p) - (SELECT min(units) FROM p)) * 100 AS minmax FROM p""",
        f="of_max minmax",
    ),
)
def _(t):
    from aislebrook.functions.stats import minmax_score

    p = materialize(store_styles(t))
    top = p.agg(F.max("units").alias("m")).scalar()
    scored = minmax_score(p, {"minmax": ("units", True)})
    return scored.select("STORE", "STYLE", ratio(F.col("units"), top).alias("of_max"), "minmax")


# --- windows, ranks, limits --------------------------------------------------


@query(
    "w01_percent_rank",
    q(
        BILLS,
        f"""{TOTALS}
SELECT STORE, STYLE, (rank() OVER (ORDER BY units) + (count(*) OVER (PARTITION BY units) - 1) / 2.0) / count(*) OVER () * 100 AS pct,
  (1 - (rank() OVER (ORDER BY units) + (count(*) OVER (PARTITION BY units) - 1) / 2.0) / count(*) OVER ()) * 100 AS inverse FROM p""",
        f="pct inverse",
    ),
)
def _(t):
    ranked = with_percent_ranks(materialize(store_styles(t)), {"units": "r"}, constant=0.5)
    return ranked.select("STORE", "STYLE", (F.col("r") * 100).alias("pct"), ((1 - F.col("r")) * 100).alias("inverse"))


@query(
    "w02_dense_rank",
    q(BILLS, f"{TOTALS} SELECT STORE, STYLE, dense_rank() OVER (ORDER BY units DESC) AS rank FROM p"),
)
def _(t):
    return with_dense_rank_desc(materialize(store_styles(t)), "units", "rank").drop("units")


@query(
    "w03_top_n_per_group",
    q(
        BILLS,
        f"""{TOTALS}, r AS (SELECT *, row_number() OVER (PARTITION BY STORE ORDER BY units DESC, STYLE) AS rank FROM p)
SELECT * FROM r WHERE rank <= 5""",
        f="units",
    ),
)
def _(t):
    best = Window.partitionBy("STORE").orderBy(F.desc("units"), "STYLE")
    return store_styles(t).withColumn("rank", F.row_number().over(best)).where("rank <= 5")


@query(
    "w04_variable_top_n",
    q(
        BILLS,
        f"""{TOTALS}, n AS (SELECT STORE, least(10, 1 + count(*) FILTER (WHERE units > 1500)) AS n FROM p GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY STORE ORDER BY units DESC, STYLE) AS rank FROM p)
SELECT r.* FROM r JOIN n ON r.STORE = n.STORE WHERE rank <= n""",
        f="units",
    ),
)
def _(t):
    p = materialize(store_styles(t))
    n = p.groupBy("STORE").agg(F.least(F.lit(10), 1 + F.count_if(F.col("units") > 1500)).alias("n"))
    best = Window.partitionBy("STORE").orderBy(F.desc("units"), "STYLE")
    top = p.withColumn("rank", F.row_number().over(best)).where("rank <= 10")
    return top.join(n, "STORE").where("rank <= n").drop("n")


@query(
    "w05_rolling_seven_days",
    q(
        SALES,
        """d AS (SELECT STORE, DATE, sum(QUANTITY) AS units FROM sales GROUP BY 1, 2)
SELECT *, sum(units) OVER (PARTITION BY STORE ORDER BY DATE RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS week_units FROM d""",
        f="units week_units",
    ),
)
def _(t):
    daily = t.sales.groupBy("STORE", "DATE").agg(F.sum("QUANTITY").alias("units"))
    return rolling_sum(daily, ["STORE"], "DATE", "units", "week_units")


@query(
    "w06_last_four_and_decayed_mean",
    q(
        SALES,
        """w AS (SELECT STORE, CAST(date_trunc('week', DATE) AS DATE) AS wk, sum(QUANTITY) AS x FROM sales GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY STORE ORDER BY wk DESC) - 1 AS age, count(*) OVER (PARTITION BY STORE) AS n FROM w)
SELECT STORE, avg(x) FILTER (WHERE age < 4) AS sma4,
  sum(x * CASE WHEN age = n - 1 THEN pow(0.7, age) ELSE 0.3 * pow(0.7, age) END) AS ewma FROM o GROUP BY 1""",
        f="sma4 ewma",
    ),
)
def _(t):
    from aislebrook.functions.stats import week_start

    weekly = t.sales.groupBy("STORE", week_start("DATE").alias("wk")).agg(F.sum("QUANTITY").alias("x"))
    newest = Window.partitionBy("STORE").orderBy(F.desc("wk"))
    o = weekly.withColumn("age", F.row_number().over(newest) - 1).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("STORE"))
    )
    w = F.pow(F.lit(0.7), F.col("age")) * F.when(F.col("age") == F.col("n") - 1, 1.0).otherwise(0.3)
    return o.groupBy("STORE").agg(
        F.avg(F.when(F.col("age") < 4, F.col("x"))).alias("sma4"), F.sum(F.col("x") * w).alias("ewma")
    )


@query(
    "w07_longest_gap",
    q(
        SALES,
        """d AS (SELECT DISTINCT SKU, DATE FROM sales),
g AS (SELECT SKU, DATE - lag(DATE) OVER (PARTITION BY SKU ORDER BY DATE) - 1 AS gap FROM d)
SELECT SKU, coalesce(max(gap), 0) AS longest_gap FROM g GROUP BY 1""",
        i="longest_gap",
    ),
)
def _(t):
    return t.sales.groupBy("SKU").agg(longest_gap(F.col("DATE")).alias("longest_gap"))


@query(
    "w08_rank_pct",
    q(
        ALL,
        """s AS (SELECT STORE, count(*) FILTER (WHERE STOCK = 0) AS zero, sum(STOCK) AS held FROM stock GROUP BY 1)
SELECT STORE, (rank() OVER (ORDER BY zero) + (count(*) OVER (PARTITION BY zero) - 1) / 2.0) / count(*) OVER () AS zero_rank,
  (rank() OVER (ORDER BY held) + (count(*) OVER (PARTITION BY held) - 1) / 2.0) / count(*) OVER () AS held_rank FROM s""",
        f="zero_rank held_rank",
    ),
)
def _(t):
    s = t.stock.groupBy("STORE").agg(F.count_if(F.col("STOCK") == 0).alias("zero"), F.sum("STOCK").alias("held"))
    return with_percent_ranks(materialize(s), {"zero": "zero_rank", "held": "held_rank"}).drop("zero", "held")


SHARES = """s AS (SELECT STORE, SKU, sum(QUANTITY) AS u FROM sales GROUP BY 1, 2),
sx AS (
  SELECT s.*, WAREHOUSE_STOCK AS W, round(u / sum(u) OVER (PARTITION BY s.SKU) * WAREHOUSE_STOCK, 6) AS share,
    count(*) OVER (PARTITION BY s.SKU) AS n, row_number() OVER (PARTITION BY s.SKU ORDER BY u DESC, STORE) AS place
  FROM s JOIN warehouse w ON s.SKU = w.SKU)"""


def shares(t):
    s = t.sales.groupBy("STORE", "SKU").agg(F.sum("QUANTITY").alias("u")).join(t.warehouse, "SKU")
    k = Window.partitionBy("SKU")
    return s.withColumn("share", F.round(F.col("u") / F.sum("u").over(k) * F.col("WAREHOUSE_STOCK"), 6))


@query(
    "w09_largest_remainder",
    q(
        ALL,
        f"""{SHARES},
sy AS (
  SELECT *, row_number() OVER (PARTITION BY SKU ORDER BY round(share - floor(share), 6) DESC, STORE) AS rn,
    W - sum(floor(share)) OVER (PARTITION BY SKU) AS rest FROM sx)
SELECT STORE, SKU, floor(share) + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS units FROM sy""",
        f="units",
    ),
)
def _(t):
    k = Window.partitionBy("SKU")
    s = shares(t).withColumn("base", F.floor("share")).withColumn("part", F.round(F.col("share") - F.col("base"), 6))
    rest = F.col("WAREHOUSE_STOCK") - F.sum("base").over(k)
    place = F.row_number().over(k.orderBy(F.desc("part"), "STORE"))
    extra = F.when(place <= rest, 1).otherwise(0)
    return s.select("STORE", "SKU", (F.col("base") + extra).cast("double").alias("units"))


@query("w10_global_top_n", q(SALES, f"{BY_SKU} SELECT * FROM by_sku ORDER BY units DESC, SKU LIMIT 25", f="units"))
def _(t):
    return by_sku(t).orderBy(F.desc("units"), "SKU").limit(25)


@query("w11_multi_key_sort", q(BILLS, f"{TOTALS} SELECT * FROM p ORDER BY STORE, units DESC, STYLE", f="units"))
def _(t):
    return store_styles(t).orderBy("STORE", F.desc("units"), "STYLE")


@query(
    "w12_equal_split",
    q(
        ALL,
        f"{SHARES} SELECT STORE, SKU, floor(W / n) + CASE WHEN place <= W - floor(W / n) * n THEN 1 ELSE 0 END AS units FROM sx",
        f="units",
    ),
)
def _(t):
    placed = plan_steps.with_place(shares(t), F.desc("u"), F.asc("STORE"))
    return placed.select("STORE", "SKU", plan_steps.equal_split(F.col("WAREHOUSE_STOCK")).alias("units"))


# --- set operations ----------------------------------------------------------


def _skus(t):
    return with_new(t).select("SKU").distinct(), t.sales.select("SKU").distinct()


SETS = f"{WITH_NEW}, listed AS (SELECT DISTINCT SKU FROM items), sold AS (SELECT DISTINCT SKU FROM sales)"


@query("x01_union_all", q(ALL, f"{SETS}, u AS (SELECT SKU FROM listed UNION ALL SELECT SKU FROM sold) SELECT * FROM u"))
def _(t):
    return reduce(lambda a, b: a.unionByName(b), _skus(t))


@query("x02_union_distinct", q(ALL, f"{SETS}, u AS (SELECT SKU FROM listed UNION SELECT SKU FROM sold) SELECT * FROM u"))
def _(t):
    listed, sold = _skus(t)
    return listed.union(sold).distinct()


@query("x03_intersect", q(ALL, f"{SETS}, u AS (SELECT SKU FROM listed INTERSECT SELECT SKU FROM sold) SELECT * FROM u"))
def _(t):
    listed, sold = _skus(t)
    return listed.intersect(sold)


@query("x04_except", q(ALL, f"{SETS}, u AS (SELECT SKU FROM listed EXCEPT SELECT SKU FROM sold) SELECT * FROM u"))
def _(t):
    listed, sold = _skus(t)
    return listed.subtract(sold)


@query("x05_distinct_by_subset", q(BILLS, "SELECT STYLE, min(CATEGORY) AS CATEGORY, min(DEPARTMENT) AS DEPARTMENT FROM bills GROUP BY 1"))
def _(t):
    return t.bills.groupBy("STYLE").agg(F.min("CATEGORY").alias("CATEGORY"), F.min("DEPARTMENT").alias("DEPARTMENT"))


@query(
    "x06_array_set_operations",
    q(
        BILLS_ALL,
        """m AS (SELECT STYLE, COLOR, list_sort(list(DISTINCT SIZE)) AS avail FROM
  (SELECT STYLE, COLOR, SIZE FROM sku_master UNION ALL SELECT STYLE, COLOR, '6XL' FROM sku_master) w GROUP BY 1, 2),
s AS (SELECT STYLE, COLOR, list_sort(list(DISTINCT SIZE)) AS sold FROM bills GROUP BY 1, 2)
SELECT m.STYLE, m.COLOR, array_to_string(list_sort(list_filter(avail, lambda x: NOT list_contains(coalesce(sold, []), x))), ',') AS missing,
  len(avail) AS total, list_has_any(avail, ['2XL', '3XL', '4XL', '5XL']) AS plus
FROM m LEFT JOIN s ON m.STYLE = s.STYLE AND m.COLOR = s.COLOR""",
    ),
)
def _(t):
    own = t.sku_master.select("STYLE", "COLOR", "SIZE")
    # A made-up size that never sold.
    avail = own.union(own.withColumn("SIZE", F.lit("6XL"))).groupBy("STYLE", "COLOR").agg(F.collect_set("SIZE").alias("avail"))
    sold = t.bills.groupBy("STYLE", "COLOR").agg(F.collect_set("SIZE").alias("sold"))
    gone = F.array_except("avail", F.coalesce("sold", F.array().cast("array<string>")))
    plus = F.array(*map(F.lit, ["2XL", "3XL", "4XL", "5XL"]))
    return avail.join(sold, ["STYLE", "COLOR"], "left").select(
        "STYLE",
        "COLOR",
        F.array_join(F.sort_array(gone), ",").alias("missing"),
        F.size("avail").alias("total"),
        F.arrays_overlap("avail", plus).alias("plus"),
    )
