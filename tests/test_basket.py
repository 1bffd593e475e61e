from itertools import combinations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from aislebrook.operators import basket
from aislebrook.plans.basket_report import basket_report
from aislebrook.sources.scratch import materialize


@pytest.fixture(scope="module")
def bills():
    rng = np.random.default_rng(11)
    out = {b: sorted({f"i{int(x)}" for x in rng.geometric(0.25, 4)}) for b in range(120)}
    out.update({b: ["i1", "i2", "i3"] for b in range(200, 260)})  # many copies of one basket
    out[999] = sorted(f"i{k}" for k in range(1, 40))  # one very long bill
    return out


@pytest.fixture(scope="module")
def lines(spark, bills):
    data = [(b, i, "C" + i) for b, items in bills.items() for i in items for _ in range(1 + b % 2)]
    return spark.createDataFrame(data, "BILL_NO int, STYLE string, CATEGORY string")


def supports(bills, least):
    """Brute force over all subsets of the frequent items."""
    common = sorted({i for items in bills.values() for i in items})
    common = [i for i in common if sum(i in s for s in bills.values()) >= least]
    out = {}
    for k in range(1, 6):
        for c in combinations(common, k):
            n = sum(set(c) <= set(s) for s in bills.values())
            if n >= least:
                out[c] = n
    return out


def test_itemsets_and_rules_match_brute_force(spark, bills, lines):
    n = len(bills)
    sets = materialize(basket.frequent_itemsets(lines, "STYLE", min_support=0.05))
    want = supports(bills, int(np.ceil(n * 0.05)))
    assert {tuple(r["items"]): r.freq for r in sets.collect()} == want
    got = {(tuple(r.antecedents), tuple(r.consequents)): r for r in basket.association_rules(sets, 0.2, 1.0).collect()}
    expected = {}
    for items, f in want.items():
        for k in range(1, len(items)):
            for a in combinations(items, k):
                c = tuple(x for x in items if x not in a)
                conf, lift = f / want[a], f * n / (want[a] * want[c])
                if conf >= 0.2 and lift >= 1.0:
                    expected[a, c] = (f / n, conf, lift)
    assert set(got) == set(expected)
    assert any(len(c) == 2 for _, c in got)
    for key, (sup, conf, lift) in expected.items():
        r = got[key]
        assert (r.support, r.confidence, r.lift) == pytest.approx((sup, conf, lift))
        assert r.support <= r.antecedent_support and r.support <= r.consequent_support


@pytest.mark.parametrize("block", [3, 256])
@pytest.mark.parametrize("least", [1, 20])
def test_pairs_match_brute_force(bills, lines, block, least):
    want = {}
    for items in bills.values():
        for p in combinations(items, 2):
            want[p] = want.get(p, 0) + 1
    got = {(r.item1, r.item2): r.frequency for r in basket.common_pairs(lines, "STYLE", min_count=least, block_items=block).collect()}
    assert got == {p: n for p, n in want.items() if n >= least}


@pytest.mark.parametrize("least", [2, 3, 30])
def test_hashes_that_collide_lose_no_pair(bills, lines, least):
    want = {}
    for items in bills.values():
        for p in combinations(items, 2):
            want[p] = want.get(p, 0) + 1
    got = {(r.item1, r.item2): r.frequency for r in basket.common_pairs(lines, "STYLE", min_count=least, block_items=4, pair_hashes=7).collect()}
    assert got == {p: n for p, n in want.items() if n >= least}


def test_one_bill_of_fifty_thousand_items(spark):
    n = 50_000
    huge = spark.range(n).selectExpr("-1L AS BILL_NO", "CAST(id AS STRING) AS SKU")
    small = spark.range(n).selectExpr("id DIV 2 AS BILL_NO", "CAST(id AS STRING) AS SKU")
    twins = spark.range(600).selectExpr("-2L AS BILL_NO", "CAST(id + 100000 AS STRING) AS SKU")
    lines = huge.union(small).union(twins).union(twins.selectExpr("-3L", "SKU"))
    got = basket.common_pairs(lines, "SKU", min_count=2)
    per = {r.frequency: r.n for r in got.groupBy("frequency").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Each pair of a small bill is in the huge one as well; the twins have all their pairs twice.
    assert per == {2: n // 2 + 600 * 599 // 2}
    assert got.where("CAST(item1 AS INT) DIV 2 = CAST(item2 AS INT) DIV 2").count() >= n // 2


def test_basket_sizes_count_lines(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,), (4,)], "BILL_NO int")
    got = dict(rows(basket.basket_sizes(df)))
    assert got["Average items per basket"] == 1.75 and got["Median items per basket"] == 1.5
    assert got["Most common basket size"] == 1.0 and got["Max items in a basket"] == 3.0
    assert got["% single-item baskets"] == 50.0


def test_no_frequent_items(spark):
    df = spark.createDataFrame([], "BILL_NO int, STYLE string")
    assert basket.frequent_itemsets(df).count() == 0


def test_report_with_metadata(lines):
    report = basket_report(lines, 0.1, levels={"style": ("STYLE", ["CATEGORY"])})
    assert set(report) == {"basket_stats", "style_frequent_itemsets", "style_association_rules", "style_common_pairs"}
    r = report["style_association_rules"].first()
    assert r.antecedent_CATEGORY == " + ".join("C" + i for i in r.antecedents)


def test_rules_of_a_long_itemset_grow_by_level(spark):
    import itertools

    from aislebrook.operators.basket import association_rules

    items = [f"i{k:02d}" for k in range(14)]
    rows = [(list(c), 10 if len(c) > 1 else 100, 1000) for n in (1, 2) for c in itertools.combinations(items, n)]
    long = [f"j{k:02d}" for k in range(40)]
    rows += [(long, 5, 1000)] + [([x for x in long if x != y], 50, 1000) for y in long] + [([y], 50, 1000) for y in long]
    table = spark.createDataFrame(rows, "items array<string>, freq bigint, bills bigint")
    got = association_rules(table, min_confidence=0.1, min_lift=0.0).collect()
    assert len(got) == 14 * 13 + 40
