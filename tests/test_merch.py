from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from aislebrook.operators import merch, weekly

D0 = date(2025, 1, 6)  # a Monday


def bills(spark, lines):
    """(style, size, day, quantity, amount, discount, void)"""
    full = [
        (z[0], z[0] + z[1], z[1], D0 + timedelta(days=z[2]), float(z[3]), float(z[4]), float(z[5]), z[6], 10.0, i)
        for i, z in enumerate(lines)
    ]
    return spark.createDataFrame(
        full,
        "STYLE string, SKU string, SIZE string, BILL_DATE date, BILL_QUANTITY double, NET_AMOUNT double, "
        "ITEM_DISCOUNT_AMOUNT double, VOID_STATUS string, RSP double, BILL_NO int",
    )


def test_style_kpis_of_one_day_and_ties(spark):
    df = bills(spark, [("a", "S", 0, 2, 20, 0, "N"), ("b", "S", 0, 2, 20, 0, "N"), ("c", "S", 0, 0, 0, 0, "N")])
    out = merch.style_kpis(df).orderBy("STYLE").collect()
    assert [r.revenue_rank for r in out] == [1, 1, 2]
    assert [r.weeks_on_sale for r in out] == [1.0] * 3 and [r.avg_price for r in out] == [10.0, 10.0, None]
    assert sum(r.share_of_units_pct for r in out) == pytest.approx(100)


def test_size_hhi(spark):
    df = bills(spark, [("a", "S", 0, 3, 1, 0, "N"), ("a", "M", 0, 1, 1, 0, "N"), ("z", "S", 0, 0, 0, 0, "N")])
    assert rows(merch.size_hhi(df)) == [("a", 0.625, 2), ("z", 0.0, 1)]


def test_reason_flags(spark):
    lines = [("fine", s, d, 20, 400, 4, "N") for s in ("S", "M", "L", "XL", "2XL") for d in range(0, 70, 7)]
    lines += [("slow", s, d, 0.5, 10, 0, "N") for s in ("S", "M", "L", "XL", "2XL") for d in (0, 70)]
    lines += [("cheap", "S", d, 20, 100, 300, "Y") for d in range(0, 70, 7)]
    out = dict(rows(merch.reason_flags(merch.style_kpis(bills(spark, lines)), merch.size_hhi(bills(spark, lines))), "STYLE", "reasons_flags"))
    assert out["fine"] == "none" and out["slow"] == "low_velocity"
    assert out["cheap"] == "high_discount,size_concentration,high_voids"


def brute_daily(days, units):
    """Padded-calendar figures with pandas, the long way."""
    s = pd.Series(units, index=pd.to_datetime(days)).groupby(level=0).sum()
    full = s.reindex(pd.date_range(s.index.min(), s.index.max())).fillna(0)
    u = full.values
    gap = best = 0
    for v in u:
        gap = gap + 1 if v == 0 else 0
        best = max(best, gap)
    med = float(np.median(u))
    return (
        len(u), int((u > 0).sum()), int((u == 0).sum()), med, int((u > med).sum()), best, float(s.max()),
        float(s.rolling("7D").sum().max()), float(s.groupby(s.index.to_period("M")).sum().max()),
    )


@pytest.mark.parametrize(
    "lines",
    [
        [(0, 4)],
        [(0, 1), (11, 2), (13, 5)],
        [(0, 3), (1, 0), (2, 0), (5, 2), (6, -4)],
        [(0, 0), (4, 2), (9, 0)],
        [(d, d % 4) for d in range(0, 60)],
        [(0, -2), (1, -3), (2, 5)],
    ],
)
def test_style_daily_matches_the_padded_calendar(spark, lines):
    df = bills(spark, [("a", "S", d, q, 1, 0, "N") for d, q in lines])
    cols = [
        "days_between", "days_with_sales", "days_without_sales", "median_daily_sales", "days_above_median",
        "longest_zero_gap_days", "max_daily_run_rate", "max_weekly_run_rate", "max_monthly_run_rate",
    ]
    got = rows(merch.style_daily(df), *cols)[0]
    assert got == pytest.approx(brute_daily([D0 + timedelta(days=d) for d, _ in lines], [float(q) for _, q in lines]))


def test_weekly_forecast_matches_pandas(spark):
    rng = np.random.default_rng(5)
    lines = [(f"k{k}", "S", int(d), int(q), 1, 0, "N") for k in range(6) for d, q in zip(rng.integers(0, 300, 12), rng.integers(1, 9, 12))]
    lines.append(("one", "S", 300, 7, 1, 0, "N"))
    df = bills(spark, lines)
    got = {r.STYLE: r for r in weekly.weekly_forecast(df, key="STYLE").collect()}
    pdf = df.toPandas()
    pdf["week"] = pd.to_datetime(pdf.BILL_DATE).dt.to_period("W").dt.start_time
    wk = pdf.groupby(["STYLE", "week"]).BILL_QUANTITY.sum().reset_index()
    last = wk.week.max()
    wk = wk[wk.week > last - pd.Timedelta(weeks=26)]
    assert set(got) == set(wk.STYLE)
    for style, g in wk.groupby("STYLE"):
        x = g.set_index("week").BILL_QUANTITY.reindex(pd.date_range(g.week.min(), last, freq="W-MON")).fillna(0.0)
        r = got[style]
        ewma = x.ewm(alpha=0.3, adjust=False).mean().iloc[-1]
        assert (r.mean_weekly, r.std_weekly, r.ewma_weekly) == pytest.approx((x.mean(), x.std(ddof=0), ewma))
        assert r.forecast_weekly == pytest.approx(0.6 * ewma + 0.4 * x.tail(4).mean()) and r.history_weeks == len(x)
    assert got["one"].ewma_weekly == 7.0 and got["one"].std_weekly == 0.0


def test_z_values():
    assert [weekly.z_value(p) for p in (0.5, 0.8, 0.95, 0.99, 0.999)] == [0.841, 0.841, 1.645, 2.326, 2.326]
    assert weekly.z_value(0.925) == pytest.approx((1.282 + 1.645) / 2)


def test_reorder_rounds_up(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0, 0.5, 2.0, 24.0)], "SKU string, mean_weekly double, std_weekly double, cv_weekly double, forecast_weekly double, forecast_horizon_units double")
    r = weekly.reorder_recommendations(df).first()
    assert (r.safety_stock_units, r.reorder_point_units, r.order_up_to_units, r.priority_score) == (4, 12, 28, 36.0)


def test_top_lists_without_units(spark):
    df = bills(spark, [("a", "S", 0, 0, 0, 0, "N"), ("b", "S", 0, 1, 5, 0, "N")])
    lists = merch.top_lists(df, 5)
    assert [r.STYLE for r in lists["top_styles_by_asp"].collect()] == ["b", "a"]
    assert set(lists) == {f"top_{t}_by_{m}" for t in ("styles", "skus") for m in ("units", "revenue", "asp")}


def test_launch_flag(spark):
    df = bills(spark, [("a", "S", 0, 1, 1, 0, "N"), ("b", "S", 9, 1, 1, 0, "N")])
    out = merch.with_launch_flag(df.select("STYLE"), merch.first_sale(df), D0 + timedelta(days=5))
    assert rows(out, "STYLE", "launched_after") == [("a", False), ("b", True)]
