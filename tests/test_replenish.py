from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from aislebrook.model import ReplenishParams
from aislebrook.operators import demand, plan_steps, plan_views, replenish_base, replenish_final, replenish_variants
from aislebrook.operators.priority import store_priority
from aislebrook.plans import replenishment as plans
from aislebrook.sources.scratch import materialize

DAY = date(2025, 3, 31)


def sales(spark, lines):
    full = [(sku, DAY - timedelta(days=age), float(q), store, store + " name") for store, sku, age, q in lines]
    return spark.createDataFrame(full, "SKU string, DATE date, QUANTITY double, STORE string, STORE_NAME string")


def stock(spark, lines):
    return spark.createDataFrame([(s, k, float(q)) for s, k, q in lines], "STORE string, SKU string, STOCK double")


def warehouse(spark, lines):
    return spark.createDataFrame([(k, float(q)) for k, q in lines], "SKU string, WAREHOUSE_STOCK double")


def master(spark, lines):
    return spark.createDataFrame(lines, "SKU string, STYLE string, COLOR string, SIZE string")


def test_window_excludes_its_first_day_and_null_keys(spark):
    df = sales(spark, [("A", "x", 0, 9), ("A", "x", 89, 9), ("A", "x", 90, 9)])
    df = df.unionByName(df.limit(1).withColumn("SKU", F.lit(None).cast("string")))
    assert rows(demand.velocity_simple(df, 90)) == [("A", "x", 0.2)]


def test_weighted_daily_sales_of_one_day_counts_lines(spark):
    df = sales(spark, [("A", "x", 3, 4), ("A", "x", 3, 2), ("B", "y", 0, 1)])
    # One date: equal weights, so mean 3 over 90 days times 2 lines.
    got = dict(((s, k), v) for s, k, v in rows(demand.weighted_daily_sales(df, 90)))
    assert got[("A", "x")] == pytest.approx(3 / 90 * 2)


def test_trend_needs_four_lines_and_older_sales(spark):
    few = [("A", "few", a, 1) for a in (0, 50, 60)]
    new = [("A", "new", a, 1) for a in (0, 1, 2, 3)]
    up = [("A", "up", a, 1) for a in (0, 1, 2, 60)]
    got = {k: v for _, k, v in rows(demand.simple_trend(sales(spark, few + new + up), 90))}
    assert got == {"few": 1.0, "new": 1.0, "up": pytest.approx(0.7 + 0.3 * 3)}


def test_priority_is_one_when_all_stores_are_equal(spark):
    df = sales(spark, [("A", "x", 0, 2), ("B", "x", 0, 2)])
    got = store_priority(df, stock(spark, [("A", "x", 1), ("B", "x", 1)]))
    assert rows(got, "STORE", "PRIORITY_SCORE") == [("A", 1.0), ("B", 1.0)]


def test_priority_covers_stock_stores_without_sales(spark):
    got = store_priority(sales(spark, [("A", "x", 0, 2)]), stock(spark, [("A", "x", 1), ("C", "x", 0)]))
    assert [s for s, in rows(got, "STORE")] == ["A", "C"]


def alloc_rows(spark, lines, sizes=True):
    return spark.createDataFrame(
        [(s, k, float(n), float(p), float(w), sizes) for s, k, n, p, w in lines],
        "STORE string, SKU string, REPLEN_QTY double, PRIORITY_SCORE double, WAREHOUSE_STOCK double, ALL_SIZES boolean",
    )


def test_base_allocation_branches(spark):
    short = alloc_rows(spark, [("A", "s", 6, 1.0, 10), ("B", "s", 6, 0.5, 10)])
    none = alloc_rows(spark, [("A", "n", 5, 1.0, 0)])
    even = alloc_rows(spark, [("A", "e", 4, 0.0, 5), ("B", "e", 4, 0.0, 5), ("C", "e", 0, 0.0, 5)])
    capped = alloc_rows(spark, [("A", "c", 1, 1.0, 1)], sizes=False)
    loose = alloc_rows(spark, [("A", "l", 1, 1.0, 1)], sizes=True)
    df = short.union(none).union(even).union(capped).union(loose)
    got = {(s, k): (q, r) for s, k, q, r in rows(replenish_base.allocate(df), "STORE", "SKU", "FINAL_REPLEN_QTY", "REMARKS")}
    text = "Warehouse stock insufficient: Demand=12, Short by 2 units"
    assert got[("A", "s")] == (6.0, text) and got[("B", "s")] == (3.0, text)
    assert got[("A", "n")] == (0.0, "No warehouse stock available")
    assert [got[(s, "e")][0] for s in "ABC"] == [2.0, 2.0, 1.0]
    assert got[("A", "c")][0] == 1.0 and got[("A", "l")][0] == 2.0


def tiny(spark):
    lines = [("A", "x", a, 3) for a in range(0, 80, 4)] + [("B", "x", a, 1) for a in range(0, 40, 4)] + [("A", "y", 5, 2)]
    return dict(
        sales=sales(spark, lines),
        stock=stock(spark, [("A", "x", 0), ("A", "x", 2), ("B", "x", 1), ("B", "z", 3)]),
        warehouse=warehouse(spark, [("x", 9), ("x", 7), ("y", 50), ("z", 1)]),
        sku_master=master(spark, [("x", "S1", "RED", "M"), ("x", "S1", "RED", "M"), ("y", "S1", "RED", "L")]),
        style_master=spark.createDataFrame([("S1", "MENS"), ("S1", "MENS")], "STYLE string, GENDER string"),
    )


def test_base_plan_has_one_row_per_pair_despite_repeated_inputs(spark):
    plan = plans.base_plan(**tiny(spark))
    got = rows(plan, "STORE", "SKU")
    assert got == [("A", "x"), ("A", "y"), ("B", "x"), ("B", "z")]
    z = plan.where("SKU = 'z'").first()
    assert z.STYLE is None and z.GENDER == "UNISEX" and z.FINAL_REPLEN_QTY == 0 and z.COMPLETE_SIZE_SET is False


def test_allocation_never_exceeds_the_warehouse_in_a_shortage(spark):
    plan = plans.base_plan(**tiny(spark)).where(F.col("REMARKS").contains("insufficient"))
    per = plan.groupBy("SKU").agg(F.sum("FINAL_REPLEN_QTY").alias("q"), F.max("WAREHOUSE_STOCK").alias("w"))
    assert per.count() == 1 and per.where("q > w").count() == 0


@pytest.mark.parametrize("method", ["simple", "weighted"])
def test_plans_do_not_depend_on_order_or_partitions(spark, method):
    p = ReplenishParams(method=method)
    t = tiny(spark)
    for build in (plans.base_plan, plans.final_plan):
        first = rows(build(**t, params=p), "STORE", "SKU", "FINAL_REPLEN_QTY", "REMARKS")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        shuffled = {k: v.repartition(3).orderBy(F.rand(1)) for k, v in t.items()}
        again = rows(build(**shuffled, params=p), "STORE", "SKU", "FINAL_REPLEN_QTY", "REMARKS")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert first == again


def test_attributes_fall_back_to_the_code(spark):
    df = spark.createDataFrame([("12AB9-REDXL",), ("7",), ("x",), ("abc",)], "SKU string")
    m = master(spark, [("x", "", None, "")])
    got = {k: rest for k, *rest in rows(replenish_final.with_attributes(df, m), "SKU", "STYLE", "COLOR", "SIZE")}
    assert got["12AB9-REDXL"] == ["AB9", "RED", "XL"]
    # No capital-led word; the code is too short for a colour.
    assert got["7"] == ["UNKNOWN", "UNK", "7"] and got["abc"] == ["UNKNOWN", "a", "bc"]
    # A master row with blanks is not read out of the code.
    assert got["x"] == ["UNKNOWN", "UNK", "M"]


def test_classes_use_fixed_limits_for_ten_rows_or_fewer(spark):
    small = spark.createDataFrame([(2.0,), (0.6,), (0.2,), (0.05,)], "DAILY_SALES double")
    got = rows(replenish_final.with_classes(small, ReplenishParams(class_limits="fixed")), "DAILY_SALES", "ABC_CLASS", "VELOCITY_CLASS")
    assert got == [(0.05, "C", "Slow"), (0.2, "C", "Medium"), (0.6, "B", "Fast"), (2.0, "A", "Fast")]


def test_gender_detects_giveaways_by_name(spark):
    df = spark.createDataFrame([("GYM BAG",), ("S1",), ("S9",)], "STYLE string")
    m = spark.createDataFrame([(" s1", "mens")], "STYLE string, GENDER string")
    assert rows(replenish_final.with_gender(df, m)) == [("GYM BAG", "FREEBIES"), ("S1", "MENS"), ("S9", "UNKNOWN")]


def test_final_filter_and_counts(spark):
    df = spark.createDataFrame(
        [("S1", "MENS"), ("S2", "Freebies"), ("A201", "UNISEX"), ("S3", "UNISEX"), ("POWER BANK X", "UNKNOWN"), ("S4", "UNKNOWN")],
        "STYLE string, GENDER string",
    )
    assert rows(replenish_final.final_filter(df), "STYLE") == [("A201",), ("S1",), ("S4",)]
    assert rows(replenish_final.removal_counts(df)) == [(1, 1, 1, 3)]


def set_rows(spark, sizes):
    return spark.createDataFrame(
        [("A", f"S1-{z}", "S1", "RED", z, float(st), float(fin), float(w), 0.6, "") for z, st, fin, w in sizes],
        "STORE string, SKU string, STYLE string, COLOR string, SIZE string, STOCK double, FINAL_REPLEN_QTY double, "
        "WAREHOUSE_STOCK double, PRIORITY_SCORE double, REMARKS string",
    )


def test_size_sets_regular_needs_four_and_plus_three(spark):
    regular = replenish_final.set_analysis(set_rows(spark, [("S", 1, 0, 1), ("M", 0, 2, 1), ("L", 0, 0, 1), ("XL", 1, 0, 1)])).first()
    assert (regular.IS_COMPLETE, regular.MISSING_SIZE_LIST, regular.MIN_REQUIRED) == (False, ["L"], 4)
    plus = replenish_final.set_analysis(set_rows(spark, [("S", 1, 0, 1), ("M", 0, 2, 1), ("2XL", 1, 0, 1)])).first()
    assert plus.IS_PLUS_COMBO and plus.IS_COMPLETE and plus.MIN_REQUIRED == 3


def test_completion_passes(spark):
    rows_in = set_rows(spark, [("S", 1, 0, 5), ("M", 0, 0, 5), ("XS", 0, 0, 5), ("XXS", 0, 0, 1), ("OS", 0, 0, 0)])
    one = replenish_final.complete_sizes(rows_in, replenish_final.size_sets(spark))
    got = {z: (q, r) for z, q, r in rows(one, "SIZE", "FINAL_REPLEN_QTY", "REMARKS")}
    assert got["M"] == (2.0, "Priority size completion") and got["XS"] == (0.0, "")
    two = replenish_final.complete_sets(one)
    got = {z: (q, a, r) for z, q, a, r in rows(two, "SIZE", "FINAL_REPLEN_QTY", "SIZE_SET_ALLOCATION", "REMARKS")}
    assert got["XS"] == (2.0, 1.0, "; Size set completion") and got["XXS"][0] == 1.0 and got["OS"][0] == 0.0
    simple = replenish_final.complete_sizes(rows_in, replenish_final.size_sets(spark), ReplenishParams(completion="simple"))
    assert simple.where("FINAL_REPLEN_QTY > 0").count() == 0
    cap = ReplenishParams(cap_to_warehouse=True)
    assert replenish_final.complete_sizes(set_rows(spark, [("S", 0, 0, 1)]), replenish_final.size_sets(spark), cap).first().FINAL_REPLEN_QTY == 1.0


def test_capped_completion_never_exceeds_the_stock_of_a_sku(spark):
    import random

    rng = random.Random(8)
    data = []
    for k in range(60):
        left = rng.randint(0, 9)
        for store in range(rng.randint(1, 8)):
            final = rng.choice([0, 0, 0, 1]) if left else 0
            data.append((f"s{store}", f"k{k}", "T", "C", rng.choice(["S", "M", "L", "2XL"]), 0.0, float(final), float(left + 8), rng.choice([0.4, 0.6, 0.6, 0.9]), ""))
    by_sku = {}
    for r in data:
        by_sku.setdefault(r[1], []).append(r)
    data = [(*r[:7], float(max(sum(x[6] for x in by_sku[r[1]]), int(r[7]) % 9)), *r[8:]) for r in data]
    df = spark.createDataFrame(
        data, "STORE string, SKU string, STYLE string, COLOR string, SIZE string, STOCK double, FINAL_REPLEN_QTY double, WAREHOUSE_STOCK double, PRIORITY_SCORE double, REMARKS string"
    )
    cap = ReplenishParams(cap_to_warehouse=True)
    one = materialize(replenish_final.complete_sizes(df, replenish_final.size_sets(spark), cap))
    two = replenish_final.complete_sets(one, cap)
    for out in (one, two):
        used, stock = {}, {}
        for r in out.collect():
            used[r.SKU] = used.get(r.SKU, 0) + r.FINAL_REPLEN_QTY
            stock[r.SKU] = max(stock.get(r.SKU, 0), r.WAREHOUSE_STOCK)
        assert all(used[k] <= stock[k] for k in used)
    # By priority, then store; what is left serves the first in line.
    want = {}
    for k, group in by_sku.items():
        group = [r for r in data if r[1] == k]
        left = max(r[7] for r in group) - sum(r[6] for r in group)
        for r in sorted(group, key=lambda r: (-r[8], r[0])):
            pick = r[6] == 0 and r[7] > 0 and r[8] > 0.5
            want[r[0], k] = r[6] + (max(0.0, min(2.0, left)) if pick else 0.0)
            left -= 2.0 if pick else 0.0
    # Rows of one SKU share their stock here.
    same = {k for k, g in by_sku.items() if len({r[7] for r in data if r[1] == k}) == 1}
    got = {(r.STORE, r.SKU): r.FINAL_REPLEN_QTY for r in one.collect()}
    assert same and all(got[s, k] == q for (s, k), q in want.items() if k in same)


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_grid_is_every_store_with_every_sku(spark, chunk):
    st = stock(spark, [(f"S{i}", "x", 1) for i in range(7)])
    skus = spark.createDataFrame([(f"k{i}",) for i in range(5)], "SKU string")
    got = rows(replenish_final.store_sku_grid(st, skus, chunk, skus_per_key=2))
    assert got == sorted((f"S{i}", f"k{j}") for i in range(7) for j in range(5))


def test_universe_plan_keeps_unsold_pairs(spark):
    plan = plans.final_plan(**tiny(spark), params=ReplenishParams(mode="universe"))
    assert plan.where("STORE = 'B' AND SKU = 'y'").first().IS_NEW_ITEM


def test_variants(spark):
    df = spark.createDataFrame(
        [("A", "s", 6.0, 1.0, 7.0, 2.0, 0.5), ("B", "s", 6.0, 1.0, 7.0, 2.0, 0.5), ("A", "z", 3.0, 0.0, 2.0, 1.0, 0.0), ("A", "o", 2.0, 1.0, 9.0, 1.0, 1.0)],
        "STORE string, SKU string, REPLEN_QTY double, PRIORITY_SCORE double, WAREHOUSE_STOCK double, STOCK_COVER_DAYS double, DAILY_SALES double",
    )
    got = {(s, k): q for s, k, q in rows(replenish_variants.allocate_remainder(df), "STORE", "SKU", "OPTIMIZED_QTY")}
    # A tie goes to the first store; whole stock is handed out; no weight means none.
    assert got[("A", "s")] == 4.0 and got[("B", "s")] == 3.0 and got[("A", "o")] == 2.0
    got = {(s, k): q for s, k, q in rows(replenish_variants.allocate_priority(df), "STORE", "SKU", "FINAL_REPLEN_QTY")}
    assert got == {("A", "s"): 3.0, ("B", "s"): 3.0, ("A", "z"): 2.0, ("A", "o"): 2.0}
    packs = spark.createDataFrame([(1.0, 50.0), (7.0, 50.0), (7.0, 9.0), (200.0, 500.0), (5.0, 1.0), (0.0, 9.0)], "REPLEN_QTY double, WAREHOUSE_STOCK double")
    assert [r.FINAL_REPLEN_QTY for r in replenish_variants.round_to_packs(packs, most=100).collect()] == [6.0, 12.0, 9.0, 100.0, 0.0, 0.0]
    assert [r.FINAL_REPLEN_QTY for r in replenish_variants.round_to_packs(packs).collect()] == [6.0, 12.0, 9.0, 204.0, 0.0, 0.0]


def test_cover_and_need(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 4.0), (0.1, 0.0), (0.1, 3.0)], "DAILY_SALES double, STOCK double")
    p = ReplenishParams()
    out = plan_steps.with_need(plan_steps.with_base_forecast(plan_steps.with_stock_cover(df), p), p)
    got = [(r.STOCK_COVER_DAYS, r.TARGET_STOCK, r.REPLEN_QTY, r.IS_NEW_ITEM) for r in out.collect()]
    assert got == [(0.0, 0.0, 0.0, True), (999.0, 0.0, 0.0, False), (0.0, 4.0, 4.0, False), (30.0, 4.0, 2.0, False)]


def test_plan_views(spark):
    plan = plans.base_plan(**tiny(spark))
    recs = plan_views.recommendations(plan, 8)
    assert recs.where("STOCK_OUT AND STOCK > 0").count() == 0
    assert plan_views.new_items(plan).count() == plan.where("IS_NEW_ITEM").count()
    assert plan_views.records(plan).columns[:3] == ["sku", "store", "quantity"]
    assert plan_views.cover_summary(plan).where("cover_min > cover_median OR cover_median > cover_max").count() == 0


def test_similar_products_match_brute_force(spark):
    import itertools

    items = [(f"k{i:02d}", f"S{i % 3}", "M" if i % 2 else None, f"C{i % 4}") for i in range(24)]
    sold = {f"k{i:02d}" for i in range(0, 24, 2)} | {"k01", "k05", "k07"}
    df = spark.createDataFrame(items, "SKU string, STYLE string, GENDER string, CATEGORY string")
    got = rows(demand.similar_products(df, spark.createDataFrame([(s,) for s in sold], "SKU string")), "SKU", "RANK", "SIMILAR_SKU", "SIMILARITY_SCORE")
    want = []
    for n in items:
        if n[0] in sold:
            continue
        scored = []
        for c in items:
            same = [a is not None and a == b for a, b in itertools.islice(zip(n, c), 1, None)]
            score = 3 * same[0] + 2 * same[1] + same[2]
            if c[0] in sold and score:
                scored.append((-score, c[0]))
        want += [(n[0], r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:3])]
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_a_pair_with_a_third_of_all_lines(spark):
    """One pair holds a third of the lines; the plan still has one row per pair and the
    same velocity as pandas."""
    import numpy as np

    rng = np.random.default_rng(9)
    n = 3000
    hot = rng.random(n) < 0.34
    stores = np.where(hot, "S0", [f"S{i}" for i in rng.integers(0, 8, n)])
    skus = np.where(hot, "k0", [f"k{i}" for i in rng.integers(0, 40, n)])
    lines = [(str(s), str(k), int(a), int(q)) for s, k, a, q in zip(stores, skus, rng.integers(0, 90, n), rng.integers(1, 6, n))]
    df = sales(spark, lines)
    plan = plans.base_plan(
        df,
        stock(spark, [(f"S{i}", f"k{j}", (i + j) % 3) for i in range(8) for j in range(40)]),
        warehouse(spark, [(f"k{j}", 5 * j) for j in range(40)]),
        master(spark, [(f"k{j}", "ST", "RED", "M") for j in range(40)]),
    ).toPandas()
    assert len(plan) == 320 and not plan.duplicated(["STORE", "SKU"]).any()
    want = df.toPandas().groupby(["STORE", "SKU"]).QUANTITY.sum() / 90
    got = plan[plan.DAILY_SALES > 0].set_index(["STORE", "SKU"]).DAILY_SALES
    assert got.sort_index().to_dict() == pytest.approx(want.sort_index().to_dict())
    short = plan[plan.TOTAL_DEMAND > plan.WAREHOUSE_STOCK]
    assert (short.groupby("SKU").FINAL_REPLEN_QTY.sum() <= short.groupby("SKU").WAREHOUSE_STOCK.first()).all()
