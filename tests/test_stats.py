import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aislebrook.functions import stats
from aislebrook.sources.scratch import materialize


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    # A third of the rows share one key and one value.
    n = 3000
    k = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 7, n).astype(str))
    v = np.where(rng.random(n) < 0.34, 5.0, np.round(rng.normal(0, 40, n), 2))
    return pd.DataFrame({"k": k, "v": v})


def test_quantiles_match_pandas(spark, data):
    df = spark.createDataFrame(data)
    got = stats.quantiles(df, {"a": ("v", 0.3), "b": ("v", 0.5), "c": ("v", 1.0)}, count_as="n").first()
    want = data.v.quantile([0.3, 0.5, 1.0]).tolist()
    assert [got.a, got.b, got.c] == pytest.approx(want) and got.n == len(data)


def test_quantiles_per_key(spark, data):
    got = stats.quantiles(spark.createDataFrame(data), {"q": ("v", 0.25)}, ["k"]).toPandas().set_index("k").q
    want = data.groupby("k").v.quantile(0.25)
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_quantiles_of_nothing(spark):
    got = stats.quantiles(spark.createDataFrame([], "v double"), {"q": ("v", 0.5)}, count_as="n").first()
    assert got.q is None and got.n == 0


def test_percent_and_dense_rank_match_pandas(spark, data):
    df = spark.createDataFrame(data.reset_index())
    got = stats.with_percent_ranks(df, {"v": "p"}, keys=["k"])
    got = stats.with_dense_rank_desc(got, "v", "d").toPandas().set_index("index").sort_index()
    np.testing.assert_allclose(got.p, data.groupby("k").v.rank(pct=True))
    np.testing.assert_array_equal(got.d, data.v.rank(method="dense", ascending=False).astype(int))
    # The mean percent rank of n values is (n + 1) / 2n.
    hot = got[got.k == "hot"]
    assert hot.p.mean() == pytest.approx((len(hot) + 1) / (2 * len(hot)))


def test_constant_column_scores_50(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, 3.0)], "a double, b double")
    ranked = stats.with_percent_ranks(df, {"a": "p"}, constant=0.5).toPandas()
    assert ranked.p.tolist() == [0.5] * 3
    scored = stats.minmax_score(df, {"x": ("a", True), "y": ("b", False)}).toPandas()
    assert scored.x.tolist() == [50.0] * 3 and sorted(scored.y) == [0.0, 50.0, 100.0]


def test_approximate_quantiles_are_close(spark, data):
    got = stats.quantiles(spark.createDataFrame(data), {"q": ("v", 0.9)}, count_as="n", accuracy=10000).first()
    assert got.n == len(data) and abs(got.q - data.v.quantile(0.9)) < 1.0


@pytest.mark.parametrize("sketch", [10_000, 50])
@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_brackets_hold_the_places_of_small_and_large_groups(spark, sketch, p):
    rng = np.random.default_rng(int(10 * p))
    parts = [pd.DataFrame({"k": f"g{n}", "v": np.round(rng.normal(0, 3, n), 1 if n % 2 else 6)}) for n in (1, 2, 3, 4, 7, 10, 99, 1000, 4001)]
    data = pd.concat(parts, ignore_index=True)
    data.loc[::17, "v"] = np.nan
    data.loc[len(data)] = ["empty", np.nan]
    got = stats.quantiles(spark.createDataFrame(data), {"q": ("v", p)}, ["k"], sketch=sketch).toPandas().set_index("k").q
    want = data.dropna().groupby("k").v.quantile(p)
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_only_bracketed_values_are_shuffled(spark):
    df = materialize(spark.range(40_000).selectExpr("CAST(id AS DOUBLE) AS v"))
    out = stats.quantiles(df, {"q": ("v", 0.5)}, written=True, sketch=1000)
    assert out.first().q == 19999.5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2
    # What the exact pass gives: about 4 values in 1000, and one row for each side.
    low, high = df.agg(F.percentile_approx("v", [0.498, 0.502], 1000)).first()[0]
    assert 4 <= df.where(F.col("v").between(low, high)).count() < 40_000 / 100


def test_ranks_over_many_buckets(spark, data):
    df = materialize(spark.createDataFrame(data.reset_index()))
    one = stats.value_ranks(df, ["v"], [], bucket_values=1 << 16)
    many = stats.value_ranks(df, ["v"], [], bucket_values=20)
    key = lambda d: sorted(map(tuple, d.select("__v", "__n", "__below", "__dbelow", "__total", "__distinct").collect()))
    assert key(one) == key(many)


def test_several_columns_are_ranked_in_one_join(spark, data):
    frame = data.reset_index()
    frame["w"] = -frame.v.where(frame.index % 5 > 0)
    frame["x"] = frame.v.abs()
    df = materialize(spark.createDataFrame(frame).withColumn("w", F.when(~F.isnan("w"), F.col("w"))).withColumn("tags", F.array("k")))
    out = stats.with_percent_ranks(df, {"v": "p", "w": "q", "x": "r"}, keys=["k"])
    assert out.columns == [*df.columns, "p", "q", "r"]
    got = out.toPandas().set_index("index").sort_index()
    for column, rank in (("v", "p"), ("w", "q"), ("x", "r")):
        np.testing.assert_allclose(got[rank], frame.groupby("k")[column].rank(pct=True))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1


def test_longest_gap_and_rolling_sum_match_pandas(spark):
    rng = np.random.default_rng(4)
    days = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.choice(900, 300), unit="D")
    frame = pd.DataFrame({"k": rng.choice(["a", "b", "hot", "hot", "hot"], 300), "d": days, "u": rng.integers(-3, 9, 300)})
    frame = frame.groupby(["k", "d"], as_index=False).u.sum()
    df = spark.createDataFrame(frame).withColumn("d", F.col("d").cast("date"))
    want = frame.groupby("k").d.apply(lambda d: max([0, *(d.sort_values().diff().dt.days.dropna() - 1)]))
    assert dict(df.groupBy("k").agg(stats.longest_gap(F.col("d")).alias("g")).collect()) == want.to_dict()
    assert df.where("k = 'none'").agg(stats.longest_gap(F.col("d")).alias("g")).first().g is None
    rolled = frame.set_index("d").sort_index().groupby("k").u.rolling("7D").sum()
    for chunk in (90, 5, 1):
        got = stats.rolling_sum(df, ["k"], "d", "u", "s", chunk_days=chunk).toPandas()
        assert len(got) == len(frame)
        for r in got.itertuples():
            assert r.s == rolled[r.k, pd.Timestamp(r.d)]
    plan = df.groupBy("k").agg(stats.longest_gap(F.col("d")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1
