"""Baskets, itemsets, rules, pairs and sizes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from aislebrook.operators import basket, cleaning
from aislebrook.plans.basket_report import basket_report

from .registry import query, shared
from .sqlbase import BILLS, BILLS_ALL, q

# Itemsets of up to four items by joins; the next size is empty on these tables.
SETS = """bi AS (SELECT DISTINCT BILL_NO AS b, {item} AS i FROM {src}),
nb AS (SELECT count(DISTINCT b) AS n, ceil(count(DISTINCT b) * {s} - 1e-9) AS least FROM bi),
s1 AS (SELECT i AS i1, count(*) AS freq FROM bi GROUP BY 1 HAVING count(*) >= (SELECT least FROM nb)),
fi AS (SELECT bi.* FROM bi JOIN s1 ON bi.i = s1.i1),
b2 AS (SELECT x.b, x.i AS i1, y.i AS i2 FROM fi x JOIN fi y ON x.b = y.b AND x.i < y.i),
s2 AS (SELECT i1, i2, count(*) AS freq FROM b2 GROUP BY 1, 2 HAVING count(*) >= (SELECT least FROM nb)),
b3 AS (
  SELECT x.b, x.i1, x.i2, y.i AS i3 FROM b2 x JOIN s2 ON x.i1 = s2.i1 AND x.i2 = s2.i2 JOIN fi y ON x.b = y.b AND y.i > x.i2),
s3 AS (SELECT i1, i2, i3, count(*) AS freq FROM b3 GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT least FROM nb)),
b4 AS (
  SELECT x.b, x.i1, x.i2, x.i3, y.i AS i4 FROM b3 x JOIN s3 ON x.i1 = s3.i1 AND x.i2 = s3.i2 AND x.i3 = s3.i3
  JOIN fi y ON x.b = y.b AND y.i > x.i3),
s4 AS (SELECT i1, i2, i3, i4, count(*) AS freq FROM b4 GROUP BY 1, 2, 3, 4 HAVING count(*) >= (SELECT least FROM nb)),
sets AS (
  SELECT [i1] AS items, freq FROM s1 UNION ALL SELECT [i1, i2], freq FROM s2
  UNION ALL SELECT [i1, i2, i3], freq FROM s3 UNION ALL SELECT [i1, i2, i3, i4], freq FROM s4)"""

STYLE_SETS = SETS.format(item="STYLE", src="bills", s="0.01")
WIDE_SETS = SETS.format(item="DEPARTMENT || '/' || substr(CATEGORY, 1, 1)", src="bills", s="0.01")
SKU_SETS = SETS.format(item="SKU", src="bills", s="0.001")


@query("b01_baskets", q(BILLS, "SELECT DISTINCT BILL_NO AS bill, STYLE AS item FROM bills"))
def _(t):
    return basket.basket_items(t.bills, "STYLE")


SET_COLS = "SELECT array_to_string(items, ',') AS items, freq, freq / n AS support, n AS bills FROM sets, nb"


def _named(sets):
    return sets.withColumn("items", F.array_join("items", ","))


def style_sets(t):
    return shared(t, "style_sets", lambda: basket.frequent_itemsets(t.bills, "STYLE", min_support=0.01))


def _wide(t):
    return t.bills.withColumn("GROUP_ITEM", F.concat("DEPARTMENT", F.lit("/"), F.substring("CATEGORY", 1, 1)))


def wide_sets(t):
    return shared(t, "wide_sets", lambda: basket.frequent_itemsets(_wide(t), "GROUP_ITEM", min_support=0.01))


@query("b02_frequent_itemsets", q(BILLS, f"{STYLE_SETS} {SET_COLS}", f="support"))
def _(t):
    return _named(basket.frequent_itemsets(t.bills, "STYLE", min_support=0.01))


@query("b02_frequent_itemsets_sku", q(BILLS, f"{SKU_SETS} {SET_COLS}", f="support"))
def _(t):
    return _named(basket.frequent_itemsets(t.bills, "SKU", min_support=0.001))


@query("b02_frequent_itemsets_long", q(BILLS, f"{WIDE_SETS} {SET_COLS}", f="support"))
def _(t):
    return _named(wide_sets(t))


RULES = """splits AS (
  SELECT items, freq, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT) - 1)) AS mask FROM sets WHERE len(items) >= 2),
sided AS (
  SELECT items, freq, mask, [items[k] for k in range(1, len(items) + 1) if (mask >> (k - 1)) & 1 = 1] AS a,
    [items[k] for k in range(1, len(items) + 1) if (mask >> (k - 1)) & 1 = 0] AS c FROM splits),
metered AS (
  SELECT s.a, s.c, s.freq, x.freq AS fa, y.freq AS fc, n, s.freq / x.freq AS conf, s.freq * CAST(n AS DOUBLE) / (x.freq * y.freq) AS lift
  FROM sided s JOIN sets x ON s.a = x.items JOIN sets y ON s.c = y.items, nb),
rules AS (
  SELECT a, c, fa / n AS antecedent_support, fc / n AS consequent_support, freq / n AS support, conf AS confidence, lift,
    freq / n - (fa / n) * (fc / n) AS leverage,
    CASE WHEN freq = fa THEN CAST('inf' AS DOUBLE) ELSE (1 - fc / n) / (1 - conf) END AS conviction
  FROM metered WHERE conf >= {conf} AND lift >= {lift})"""

RULE_NUMBERS = "antecedent_support consequent_support support confidence lift leverage conviction"
SIDES = "array_to_string(a, ',') AS antecedents, array_to_string(c, ',') AS consequents"


def _texts(rules):
    return rules.withColumns(
        {"antecedents": F.array_join("antecedents", ","), "consequents": F.array_join("consequents", ",")}
    )


@query(
    "b03_association_rules",
    q(
        BILLS,
        f"{STYLE_SETS}, {RULES.format(conf='0.1', lift='0.5')} SELECT {SIDES}, * EXCLUDE (a, c) FROM rules",
        f=RULE_NUMBERS,
    ),
)
def _(t):
    return _texts(basket.association_rules(style_sets(t), 0.1, 0.5))


@query(
    "b03_association_rules_long",
    q(
        BILLS,
        f"{WIDE_SETS}, {RULES.format(conf='0.1', lift='1.0')} SELECT {SIDES}, * EXCLUDE (a, c) FROM rules",
        f=RULE_NUMBERS,
    ),
)
def _(t):
    return _texts(basket.association_rules(wide_sets(t), 0.1, 1.0))


def _meta(side: str, col: str, name: str) -> str:
    return (
        f"(SELECT string_agg(coalesce({col}, 'Unknown'), ' + ' ORDER BY m.item) FROM meta m "
        f"WHERE list_contains(r.{side}, m.item)) AS {name}"
    )


@query(
    "b04_rule_metadata",
    q(
        BILLS,
        f"""{STYLE_SETS}, {RULES.format(conf='0.1', lift='0.5')},
meta AS (SELECT STYLE AS item, min(CATEGORY) AS CATEGORY, min(DEPARTMENT) AS DEPARTMENT FROM bills GROUP BY 1)
SELECT {SIDES}, confidence, {_meta('a', 'CATEGORY', 'antecedent_CATEGORY')}, {_meta('a', 'DEPARTMENT', 'antecedent_DEPARTMENT')},
  {_meta('c', 'CATEGORY', 'consequent_CATEGORY')}, {_meta('c', 'DEPARTMENT', 'consequent_DEPARTMENT')}
FROM rules r""",
        f="confidence",
    ),
)
def _(t):
    rules = shared(t, "style_rules", lambda: basket.association_rules(style_sets(t), 0.1, 0.5))
    out = basket.with_rule_metadata(rules, t.bills, "STYLE", ["CATEGORY", "DEPARTMENT"])
    drop = ["antecedent_support", "consequent_support", "support", "lift", "leverage", "conviction"]
    return _texts(out.drop(*drop))


PAIRS = """bi AS (SELECT DISTINCT BILL_NO AS b, {item} AS i FROM bills)
SELECT x.i AS item1, y.i AS item2, count(*) AS frequency FROM bi x JOIN bi y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2"""


@query("b05_common_pairs", q(BILLS, PAIRS.format(item="SKU")))
def _(t):
    return basket.common_pairs(t.bills, "SKU")


@query("b05_common_pairs_support", q(BILLS, PAIRS.format(item="SKU") + " HAVING count(*) >= 2"))
def _(t):
    return basket.common_pairs(t.bills, "SKU", min_count=2)


@query("b05_common_pairs_style", q(BILLS, PAIRS.format(item="STYLE")))
def _(t):
    return basket.common_pairs(t.bills, "STYLE")


SIZES = """z AS (SELECT BILL_NO, count(*) AS n FROM {src} GROUP BY 1),
h AS (SELECT n, count(*) AS c FROM z GROUP BY 1),
sizes AS (
  SELECT 'Average items per basket' AS metric, avg(n) AS value FROM z
  UNION ALL SELECT 'Median items per basket', quantile_cont(n, 0.5) FROM z
  UNION ALL SELECT 'Most common basket size', (SELECT n FROM h ORDER BY c DESC, n LIMIT 1)
  UNION ALL SELECT 'Max items in a basket', max(n) FROM z
  UNION ALL SELECT '% single-item baskets', avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) * 100 FROM z)"""


@query("b06_basket_sizes", q(BILLS, SIZES.format(src="bills") + " SELECT * FROM sizes", f="value"))
def _(t):
    return basket.basket_sizes(t.bills)


# The same expressions once more for SKUs, under names of their own.
_LEVEL_NAMES = r"\b(bi|nb|s[1-4]|fi|b[2-4]|sets|splits|sided|metered|rules|pairs)\b"
PAIRS = "pairs AS (SELECT x.i AS a, y.i AS b, count(*) AS f FROM bi x JOIN bi y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2)"
SKU_LEVEL = re.sub(
    _LEVEL_NAMES, r"sku_\1", f"{SETS.format(item='SKU', src='oct', s='0.01')}, {RULES.format(conf='0.1', lift='1.0')},\n{PAIRS}"
)

OCT = """oct AS (
  SELECT b.* FROM bills b JOIN style_master g ON b.STYLE = g.STYLE
  WHERE NET_AMOUNT > 0 AND GENDER <> 'FREEBIES' AND BILL_DATE >= DATE '1998-10-01' AND BILL_DATE < DATE '1998-11-01')"""


@query(
    "b07_basket_report",
    q(
        BILLS_ALL,
        f"""{OCT}, {SETS.format(item="STYLE", src="oct", s="0.01")}, {RULES.format(conf='0.1', lift='1.0')},
{SIZES.format(src="oct")},
{PAIRS},
{SKU_LEVEL}
SELECT 'basket_stats' AS "table", count(*) AS rows, sum(value) AS total FROM sizes
UNION ALL SELECT 'style_frequent_itemsets', count(*), sum(freq) FROM sets
UNION ALL SELECT 'style_association_rules', count(*), sum(lift) FROM rules
UNION ALL SELECT 'style_common_pairs', count(*), sum(f) FROM pairs
UNION ALL SELECT 'sku_frequent_itemsets', count(*), sum(freq) FROM sku_sets
UNION ALL SELECT 'sku_association_rules', count(*), sum(lift) FROM sku_rules
UNION ALL SELECT 'sku_common_pairs', count(*), sum(f) FROM sku_pairs""",
        f="total",
    ),
)
def _(t):
    return report_totals(t)


@query(
    "b07_basket_report_support",
    q(
        BILLS_ALL,
        f"""{OCT}, {PAIRS.replace("bi x JOIN bi y", "(SELECT DISTINCT BILL_NO AS b, STYLE AS i FROM oct) x JOIN (SELECT DISTINCT BILL_NO AS b, STYLE AS i FROM oct) y")}
SELECT 'style_common_pairs' AS "table", count(*) AS rows, sum(f) AS total FROM pairs WHERE f >= 3""",
        f="total",
    ),
)
def _(t):
    return report_totals(t, min_pairs=3).where("table = 'style_common_pairs'")


def report_totals(t, **options):
    """Rows and a sum of every table of the basket report on one month."""
    lines = cleaning.enrich_basket(t.bills, t.sku_attributes.select("SKU"), t.style_master, "1998-10")
    report = basket_report(lines, **options)
    measures = {
        "basket_stats": "value",
        "style_frequent_itemsets": "freq",
        "style_association_rules": "lift",
        "style_common_pairs": "frequency",
        "sku_frequent_itemsets": "freq",
        "sku_association_rules": "lift",
        "sku_common_pairs": "frequency",
    }
    out = None
    for name, column in measures.items():
        row = report[name].agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(column).cast("double")).alias("total"))
        row = row.select(F.lit(name).alias("table"), "rows", "total")
        out = row if out is None else out.unionByName(row)
    return out
