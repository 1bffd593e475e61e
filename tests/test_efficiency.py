from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from aislebrook.operators import efficiency as ef
from aislebrook.operators import efficiency_scripts as es
from aislebrook.sources.scratch import materialize

DAY = date(2025, 3, 31)


def metrics(spark, lines):
    return materialize(
        spark.createDataFrame(
            [(s, k, float(q), float(st), float(sc), float(q) / 90, 1.0) for s, k, q, st, sc in lines],
            "STORE string, STYLE string, TOTAL_SALES double, STOCK double, STYLE_EFFICIENCY_SCORE double, "
            "SALES_VELOCITY double, STOCK_TURNOVER double",
        )
    )


def test_store_categories_and_caps(spark):
    lines = [("high", f"a{i}", 5, 1, 90) for i in range(30)]
    lines += [("good", f"a{i}", 5, 1, 65) for i in range(30)]
    lines += [("mean", f"a{i}", 5, 1, 65 if i < 12 else 20) for i in range(30)]
    lines += [("poor", "a", 5, 1, 10), ("poor", "b", 5, 1, 10)]
    capped = ef.store_recommendations(metrics(spark, lines), caps=ef.STYLE_CAPS)
    got = {r.STORE: r for r in capped.collect()}
    assert [got[s].STORE_CATEGORY for s in ("high", "good", "mean", "poor")] == ef.CATEGORIES
    assert [got[s].RECOMMENDED_STYLES for s in ("high", "good", "mean", "poor")] == [20, 15, 10, 1]
    # A store without any efficient style.
    assert (got["poor"].CURRENT_EFFICIENT_STYLES, got["poor"].AVG_EFFICIENCY_SCORE, got["poor"].PROJECTED_SALES_FOCUS_PCT) == (0, 0.0, 0.0)
    recs = ef.style_recommendations(metrics(spark, lines), capped)
    assert dict(rows(recs.groupBy("STORE").count())) == {"high": 20, "good": 15, "mean": 10, "poor": 1}
    # Without caps nothing bounds the counts but the store's own styles.
    recs = ef.style_recommendations(metrics(spark, lines), ef.store_recommendations(metrics(spark, lines)))
    assert dict(rows(recs.groupBy("STORE").count())) == {"high": 30, "good": 30, "mean": 11, "poor": 1}


def test_metrics_of_one_sided_stores(spark):
    sales = spark.createDataFrame([("x", DAY, 4.0, "sells"), ("x", DAY - timedelta(1), 4.0, "sells"), ("q", DAY, 1.0, "sells")], "SKU string, DATE date, QUANTITY double, STORE string")
    stock = spark.createDataFrame([("holds", "x", 5.0), ("holds", "x", 5.0)], "STORE string, SKU string, STOCK double")
    master = spark.createDataFrame([("x", "S1"), ("x", "S1")], "SKU string, STYLE string")
    wh = spark.createDataFrame([("x", 0.0)], "SKU string, WAREHOUSE_STOCK double")
    got = {r.STORE: r for r in ef.style_metrics(sales, stock, master, wh).collect()}
    assert set(got) == {"sells", "holds"}
    a, b = got["sells"], got["holds"]
    assert (a.STOCK_TURNOVER, a.DAYS_STOCK_COVER, a.SALES_TRANSACTIONS) == (999.0, 0.0, 2)
    assert (b.STOCK, b.STOCK_TURNOVER, b.DAYS_STOCK_COVER, b.FIRST_SALE_DATE) == (10.0, 0.0, 999.0, None)
    # 30 + 25 + 20 + 15 + 10, less 30 % without warehouse stock.
    assert a.STYLE_EFFICIENCY_SCORE == pytest.approx(70.0) and b.STYLE_EFFICIENCY_SCORE == 0.0


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (9.99,)], "AVG_EFFICIENCY_SCORE double")
    got = ef.score_histogram(df).orderBy("bin").collect()
    assert len(got) == 20 and got[0].stores == 1 and got[19].stores == 2 and sum(r.stores for r in got) == 3
    same = ef.score_histogram(spark.createDataFrame([(5.0,), (5.0,)], "AVG_EFFICIENCY_SCORE double"))
    assert same.where("bin = 0").first().stores == 2


def script_sales(spark):
    rows_ = [("st", "n", f"s{i}", DAY - timedelta(days=d), float(i + 1), 10.0 * (i + 1)) for i in range(30) for d in range(i + 1)]
    return spark.createDataFrame(rows_, "STORE string, STORE_NAME string, STYLE string, DATE date, QUANTITY double, NET_AMOUNT double")


def test_rank_analysis_bounds(spark):
    stock = spark.createDataFrame([("st", "s1", 5.0)], "STORE string, STYLE string, STOCK double")
    wh = spark.createDataFrame([("s1", 5.0)], "STYLE string, WAREHOUSE_STOCK double")
    styles = materialize(es.rank_efficiency(script_sales(spark), stock, wh))
    assert styles.where("EFFICIENCY_SCORE < 0 OR EFFICIENCY_SCORE > 100").count() == 0
    mean = styles.agg(F.avg("REVENUE_SCORE")).first()[0]
    assert mean == pytest.approx(31 / 60 * 100)
    store = es.optimal_style_count(styles, es.STYLE_BOUNDS).first()
    assert 20 <= store.OPTIMAL_STYLES <= 30 and 0 < store.ESTIMATED_REVENUE_RETENTION <= 100
    assert es.recommended_portfolio(styles, es.optimal_style_count(styles, es.STYLE_BOUNDS)).count() == store.OPTIMAL_STYLES
    free = es.optimal_style_count(styles).first()
    assert free.OPTIMAL_STYLES == free.STAR_PERFORMERS + free.STRONG_PERFORMERS + int(free.AVERAGE_PERFORMERS * (0.7 if free.EFFICIENCY_SCORE >= 50 else 0.5))


def test_minmax_analysis_constant_columns(spark):
    df = script_sales(spark).where("STYLE = 's3'")
    stock = spark.createDataFrame([], "STORE string, STYLE string, STOCK double")
    r = es.minmax_efficiency(df, stock).first()
    assert r.EFFICIENCY_SCORE == 50.0 and r.STOCK == 0.0
    plan = es.minmax_store_plan(es.minmax_efficiency(df, stock)).first()
    assert (plan.CATEGORY, plan.RECOMMENDED_STYLES, plan.CHANGE) == ("Medium Performer", 0, -1)
