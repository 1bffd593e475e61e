"""What plans write once: the tables they read several times, and what they join by few keys."""

import uuid
from datetime import date

from conftest import rows
from pyspark.sql import functions as F

from aislebrook.operators import plan_steps, priority, replenish_base, replenish_final
from aislebrook.plans.testbed import Testbed
from aislebrook.sources import scratch
from aislebrook.sources.files import Files
from catalog import replenish


class Given:
    """Testbed of own rows that counts how often its facts are asked for."""

    def __init__(self, spark):
        self.spark, self.state, self.asked = spark, (uuid.uuid4().hex,), []

    def table(self, schema, *lines):
        return self.spark.createDataFrame(list(lines), schema)

    @property
    def sales(self):
        self.asked.append("sales")
        lines = [(sku, date(2025, 1, d), 2.0, store, f"name {store}") for d in (1, 5, 9) for sku in "xy" for store in ("A", "B")]
        return self.table("SKU string, DATE date, QUANTITY double, STORE string, STORE_NAME string", *lines, *lines[:1], (None, None, None, None, None))

    @property
    def stock(self):
        self.asked.append("stock")
        lines = [("x", 3.0, "A", "name A"), ("x", 3.0, "A", "name A"), ("z", 0.0, "B", None), (None, None, None, None)]
        return self.table("SKU string, STOCK double, STORE string, STORE_NAME string", *lines)

    @property
    def warehouse(self):
        return self.table("SKU string, WAREHOUSE_STOCK double", ("x", 5.0), ("y", 50.0), ("z", 0.0))

    @property
    def sku_master(self):
        return self.table("SKU string, STYLE string, COLOR string, SIZE string", *[(s, "BRAND#1", "RED", z) for s, z in zip("xyz", ("S", "M", "L"))])

    @property
    def style_master(self):
        return self.table("STYLE string, GENDER string", ("BRAND#1", "WOMEN"))

    @property
    def size_master(self):
        return self.table("SIZE string, SIZE_SET string, MIN_SIZES_REQUIRED int", *[(z, "Regular", 4) for z in ("S", "M", "L")])


def test_plans_ask_for_sales_and_stock_once(spark):
    t = Given(spark)
    for made in (replenish.base_plan(t), replenish.final_needs(t), replenish.final_allocated(t)):
        assert rows(made, "STORE", "SKU") == [("A", "x"), ("A", "y"), ("B", "x"), ("B", "y"), ("B", "z")]
    assert sorted(t.asked) == ["sales", "stock"]


def test_what_is_joined_by_few_keys_is_written(spark):
    """A table read from files has a known size, so the rows it is joined to stay in place."""
    t = Given(spark)
    names = plan_steps.store_names(t.sales, t.stock)
    assert names.inputFiles() and rows(names.where("STORE IS NOT NULL")) == [("A", "name A"), ("B", "name B")]
    bonus = replenish_final.size_set_bonus(replenish.final_needs(t))
    assert bonus.inputFiles() and {r[:3] for r in rows(bonus)} == {("A", "BRAND#1", "RED"), ("B", "BRAND#1", "RED")}
    facts = replenish_base.sku_facts(t.warehouse, t.sku_master, t.style_master)
    assert len(facts.inputFiles()) >= 2 and rows(facts, "SKU", "ALL_SIZES", "GENDER") == [(s, False, "WOMEN") for s in "xyz"]


def test_large_tables_are_dealt_in_pieces_by_their_size(spark, tmp_path, monkeypatch):
    """As many pieces as the files ask for, and no second shuffle for what follows."""
    spark.range(1000).selectExpr("id % 7 AS STORE", "cast(id AS string) AS SKU", "1.0D AS STOCK").write.parquet(f"{tmp_path}/a b")
    stock = spark.read.parquet(f"{tmp_path}/a b")
    size = Files(spark).total(stock.inputFiles())
    assert size == sum(x.stat().st_size for x in (tmp_path / "a b").glob("*.parquet"))
    assert scratch.spread(stock, "SKU") is stock  # small: left to adaptive execution
    monkeypatch.setattr(scratch, "PIECE_BYTES", size // 50)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scratch.spread(stock, "SKU").rdd.getNumPartitions() == max(least, -(-size // (size // 50)))
    vel = stock.where("STORE < 3").select("STORE", "SKU", F.lit(0.5).alias("DAILY_SALES"))
    made = plan_steps.pairs(vel, stock).withColumn("n", F.sum("STOCK").over(plan_steps.per_sku()))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert made.where("n = 1 AND STOCK = 1").count() == 1000 and made.where("DAILY_SALES = 0.5").count() == stock.where("STORE < 3").count()


def test_pairs_add_repeated_stock_and_fill_what_is_missing(spark):
    vel = spark.createDataFrame([("A", "x", 0.5), ("B", "x", None)], "STORE string, SKU string, DAILY_SALES double")
    stock = spark.createDataFrame([("A", "x", 3), ("A", "x", 4), ("C", "y", None), (None, "y", 1), ("C", None, 1)], "STORE string, SKU string, STOCK int")
    assert rows(plan_steps.pairs(vel, stock)) == [("A", "x", 0.5, 7.0), ("B", "x", 0.0, 0.0), ("C", "y", 0.0, 0.0)]


def test_finished_tables_are_written_once(spark, monkeypatch):
    """What a plan has written is read from there, and the second completion pass is not
    written again."""
    written, write = [], scratch.write_scratch
    monkeypatch.setattr(scratch, "write_scratch", lambda df, label="table": written.append(label) or write(df, label))
    t = Given(spark)
    for _ in range(2):
        assert replenish.base_plan(t).count() == replenish.final_needs(t).count() == replenish.final_allocated(t).count() == 5
    both = replenish.final_pairs(t).join(replenish.final_pairs(t), ["STORE", "SKU"])
    assert both.count() == 5
    assert [written.count(x) for x in ("plan", "base_plan", "final_pairs", "final_needs", "allocated", "final_allocated")] == [1, 0, 0, 0, 1, 0]
    assert written.count("needs") == 2 and written.count("pairs") == 2  # the plan's own, and those kept for other queries


def test_lines_are_shuffled_by_order_and_item_only(spark, tmp_path):
    """Orders get their nation before the lines come; stores and duplicates as before."""
    spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0), (9, 1, 8.0), (1, None, 1.0)], "l_orderkey bigint, l_partkey bigint, l_quantity double").selectExpr("*", *["1.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax", "'N' AS l_returnflag"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, date(2025, 1, 1)), (2, 8, date(2025, 1, 2))], "o_orderkey bigint, o_custkey bigint, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 3), (8, 4), (8, 4)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3, "C"), (3, "C"), (4, "D"), (5, "E")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "a b", "Brand#1", "T", 3, 9.0), (2, "c d", "Brand#2", "T", 4, 9.0)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    t = Testbed(spark, str(tmp_path))
    once = [("1", 5.0, "ST003", "C"), ("2", 6.0, "ST003", "C")]
    assert rows(t.sales.select("SKU", "QUANTITY", "STORE", "STORE_NAME"), "SKU", "QUANTITY", "STORE", "STORE_NAME") == sorted([*once, *once, ("1", 7.0, "ST004", "D"), ("1", 7.0, "ST004", "D")])
    assert rows(t.stock.where("SKU IS NOT NULL").select("SKU", "STORE", "STORE_NAME"), "SKU", "STORE", "STORE_NAME") == [("1", "ST003", "C"), ("1", "ST004", "D"), ("2", "ST003", "C")]
    assert "STORE" not in t._lines("l_quantity").columns and "c_nationkey" in t._lines().columns


def test_store_facts_of_a_large_table_are_counted_in_pieces(spark, tmp_path, monkeypatch):
    """Repeated lines, SKUs that are null, figures that are null; the lines dealt by SKU."""
    given = [("A", "x", 0.0), ("A", "x", 0.0), ("A", "y", 2.0), ("A", None, 0.0), ("B", "x", None), ("B", None, None), (None, "x", 5.0)]
    spark.createDataFrame(given, "STORE string, SKU string, STOCK double").write.parquet(f"{tmp_path}/stock")
    stock = spark.read.parquet(f"{tmp_path}/stock")
    sales = spark.createDataFrame([("A", date(2025, 1, 1), 4.0)], "STORE string, DATE date, QUANTITY double")
    expected = [("A", 2.0, 2, 2, 4.0), ("B", None, 1, 0, None)]
    dealt = []
    for size in (scratch.PIECE_BYTES, 50):
        monkeypatch.setattr(scratch, "PIECE_BYTES", size)
        monkeypatch.setattr(priority, "spread", lambda df, *keys: dealt.append(keys) or scratch.spread(df, *keys))
        facts = priority._store_facts(sales, stock, 90)
        assert rows(facts, "STORE", "total_stock", "sku_count", "oos_count", "total_sales") == expected
    assert dealt == [("SKU",)] * 2
