"""The communication matrix over many partitions, and its clash with columns of the table."""

from pyspark.sql import functions as F

from aislebrook.llm import sharding


def test_many_partitions_fill_every_shard_exactly(spark):
    counts = spark.range(1500).selectExpr("id * 3 AS part", "1 + id % 7 AS n")
    rows = counts.agg(F.sum("n")).first()[0]
    made = sharding.matrix(counts, 7, seed=3).join(counts, "part").collect()
    assert len(made) == 1500 and all(r.ends[-1] == r.n and list(r.ends) == sorted(r.ends) and r.ends[0] >= 0 for r in made)
    per = [sum(r.ends[s] - (r.ends[s - 1] if s else 0) for r in made) for s in range(7)]
    assert per == [rows // 7 + (s < rows % 7) for s in range(7)]
    again = sharding.matrix(counts, 7, seed=3).collect()
    assert {r.part: r.ends for r in again} == {r.part: r.ends for r in made}


def test_one_partition_and_none(spark):
    one = spark.createDataFrame([(0, 5)], "part bigint, n bigint")
    assert sharding.matrix(one, 3, seed=1).first().ends == [2, 4, 5]
    assert sharding.matrix(one.limit(0), 3, seed=1).count() == 0


def test_shuffle_replaces_columns_of_its_names(spark):
    df = spark.range(100).selectExpr("id", "-1 AS shard", "'x' AS SLOT", "id AS part_").repartition(9)
    out = sharding.shuffle(df, 8, seed=2)
    assert out.columns == ["id", "part_", "shard", "slot"]
    got = sorted((r.shard, r.slot) for r in out.collect())
    assert got == sorted((s, i) for s in range(8) for i in range(13 if s < 4 else 12))
