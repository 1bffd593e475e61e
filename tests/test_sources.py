import tempfile
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from aislebrook.plans.testbed import Testbed
from aislebrook.sources import readers, sales_store, scratch, snapshots
from aislebrook.sources.sales_store import SalesStore, merge_batches
from aislebrook.streaming.landing import ingest_batch, landing_ingest, stream_origin

HEADER = "Store Code,EBO NAME,SKU,Bill Date,Bill Quantity,Net Amount,Bill No\n"


def lot(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text(HEADER + "".join(line + "\n" for line in lines))


def stored(store):
    return rows(store.rows(), "date", "store", "sku", "quantity", "amount", "bill_no")


def test_csv_scan_reads_text_and_missing_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b c\n007,NA\n"x, y",null\n')
    df = readers.csv_scan(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("a", "string"), ("b c", "string")]
    assert rows(df) == [("007", None), ("x, y", None)]
    assert dict(readers.csv_scan(spark, str(tmp_path / "a.csv"), names=["p", "q"]).dtypes) == {"p": "string", "q": "string"}


def test_path_scan_skips_missing_files(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(" date ,Sku\n2025-01-02, a \nbad,b\n")
    got = readers.path_scan(spark, {"sales": str(tmp_path / "sales.csv"), "stock": str(tmp_path / "none.csv"), "warehouse": ""})
    assert list(got) == ["sales"] and rows(got["sales"]) == [(date(2025, 1, 2), "a"), (None, "b")]


def test_union_of_files_with_different_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert rows(readers.union_files([a, b])) == [(1, 2), (3, None)]


def test_snapshot_round_trip(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshots.read_snapshot(spark, root) == {}
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n int, s string")
    snapshots.write_snapshot({"a": a, "empty": a.where("n > 5")}, root, "t1")
    back = snapshots.read_snapshot(spark, root)
    assert list(back) == ["a"] and rows(back["a"]) == [(1, "x"), (2, "y")]
    info = snapshots.snapshot_info(spark, root).first()
    assert (info.datasets, info.total_rows, info.last_updated) == (1, 2, "t1")
    assert snapshots.snapshot_details(spark, root).first()["bytes"] > 0


def test_a_failing_snapshot_leaves_the_one_before(spark, tmp_path):
    root = str(tmp_path / "snap")
    a = spark.createDataFrame([(1,), (2,)], "n int")
    snapshots.write_snapshot({"a": a, "b": a}, root, "t1")
    reader = snapshots.read_snapshot(spark, root)
    bad = a.select(F.raise_error(F.lit("no")).cast("int").alias("n"))
    with pytest.raises(Exception, match="no"):
        snapshots.write_snapshot({"a": a.where("n = 1"), "b": bad}, root, "t2")
    back = snapshots.read_snapshot(spark, root)
    assert rows(back["a"]) == rows(back["b"]) == [(1,), (2,)] and snapshots.snapshot_info(spark, root).first().last_updated == "t1"
    snapshots.write_snapshot({"a": a.where("n = 1")}, root, "t3")
    assert list(snapshots.read_snapshot(spark, root)) == ["a"] and rows(reader["b"]) == [(1,), (2,)]
    info = snapshots.snapshot_info(spark, root).first()
    assert (info.datasets, info.total_rows, info.last_updated) == (1, 1, "t3")
    assert snapshots.drop_superseded(spark, root) == 1
    assert rows(snapshots.read_snapshot(spark, root)["a"]) == [(1,)]
    snapshots.write_snapshot({"a": a.where("n > 5")}, root, "t4")
    assert snapshots.read_snapshot(spark, root) == {}


def test_empty_store(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path))
    assert rows(store.summary()) == [(0, "N/A", "N/A")] and store.history().count() == 0


def batch(spark, *lines):
    return spark.createDataFrame(list(lines), "DATE date, STORE string, SKU string, QUANTITY double, BILL_NO string")


def test_append_update_dedupe(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path))
    d = date(2025, 1, 2)
    store.append(batch(spark, (d, "A", "x", 1.0, "1"), (d, "A", "x", 1.0, "1"), (d, "A", "y", 1.0, None)), "one", 1)
    second = batch(spark, (d, "A", "x", 5.0, "1"), (d, "A", "y", 1.0, None))
    store.append(second, "two", 2)
    store.append(second, "two", 2)
    quantity = lambda how: rows(store.merged(how), "sku", "quantity")
    assert quantity("append") == [("x", 1.0), ("x", 1.0), ("x", 5.0), ("y", 1.0), ("y", 1.0)]
    assert quantity("update") == [("x", 5.0), ("y", 1.0)]
    assert quantity("dedupe") == [("x", 1.0), ("x", 5.0), ("y", 1.0)]
    assert rows(store.summary()) == [(5, "2025-01-02", "2025-01-02")]
    assert rows(store.latest_uploads()) == [("sales", 2, 5, "two", 2, 5)]
    with pytest.raises(ValueError):
        merge_batches(store.rows(), "other")


def files_of(path):
    return {str(f) for f in path.rglob("*.parquet")}


def test_an_update_of_one_month_rewrites_that_month(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path))
    assert store.merge() == [] and store.merged("update").count() == 0
    days = [date(2025, m, 5) for m in (1, 2, 3)]
    store.append(batch(spark, *[(d, "A", s, 1.0, "1") for d in days for s in "xy"], (None, "A", "x", 9.0, None)), "one", 1)
    before_merge = rows(store.merged("update"), "date", "sku", "quantity")
    assert store.merge() == ["2025-01", "2025-02", "2025-03", "undated"] and store.merge() == []
    assert rows(store.merged("update"), "date", "sku", "quantity") == before_merge
    merged = tmp_path / "merged"
    before = files_of(merged)
    store.append(batch(spark, (days[1], "A", "x", 5.0, "1"), (days[1], "A", "z", 2.0, None), (days[1], "A", "z", 3.0, None)), "two", 2)
    want = rows(merge_batches(store.rows(), "update"), "date", "sku", "quantity")
    assert rows(store.merged("update"), "date", "sku", "quantity") == want  # not merged yet
    assert store.merge() == ["2025-02"]
    new = files_of(merged) - before
    assert before <= files_of(merged) and new and all("sale_month=2025-02" in f for f in new)
    assert rows(store.merged("update"), "date", "sku", "quantity") == want
    # Corrections move a line to another month, and an older batch does not win.
    store.append(batch(spark, (days[2], "A", "x", 6.0, "1")), "two", 2)
    store.append(batch(spark, *[(d, "A", "x", 7.0, "1") for d in days]), "one", 1)
    assert store.merge() == ["2025-01", "2025-02", "2025-03", "undated"]
    want = rows(merge_batches(store.rows(), "update"), "date", "sku", "quantity")
    assert rows(store.merged("update"), "date", "sku", "quantity") == want
    assert [q for _, s, q in want if s == "x"] == [7.0, 7.0, 6.0]


def test_only_months_of_several_uploads_are_matched_by_key(spark, tmp_path, monkeypatch):
    matched = []

    def noted(df, *args):
        matched.extend(r[0] for r in df.select("sale_month").distinct().collect())
        return merge_batches(df, *args)

    monkeypatch.setattr(sales_store, "merge_batches", noted)
    store = SalesStore(spark, str(tmp_path))
    days = [date(2025, m, 5) for m in (1, 2, 3)]
    store.append(batch(spark, *[(d, "A", "x", 1.0, "1") for d in days[:2]] * 2, (None, "A", "x", 9.0, None)), "one", 1)
    store.append(batch(spark, *[(d, "A", "x", 2.0, "1") for d in days[1:]]), "two", 2)
    assert store.merge() == ["2025-01", "2025-02", "2025-03", "undated"] and matched == ["2025-02"]
    got = rows(store.merged("update"), "date", "quantity")
    assert sorted(got, key=str) == sorted([(days[0], 1.0), (days[0], 1.0), (days[1], 2.0), (days[2], 2.0), (None, 9.0)], key=str)
    # The upload that a month was corrected by goes elsewhere: what it had replaced is back.
    store.append(batch(spark, (days[2], "A", "x", 3.0, "1")), "two", 2)
    assert store.merge() == ["2025-02", "2025-03"] and matched == ["2025-02"]
    got = rows(store.merged("update"), "date", "quantity")
    assert sorted(got, key=str) == sorted([(days[0], 1.0), (days[0], 1.0), (days[1], 1.0), (days[1], 1.0), (days[2], 3.0), (None, 9.0)], key=str)


def test_summary_reads_no_rows(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path))
    store.append(batch(spark, (date(2025, 1, 2), "A", "x", 2.0, "1"), (date(2025, 3, 1), "A", "y", 1.0, None), (None, "A", "y", 1.0, None)), "one", 1)
    store.append(batch(spark, (date(2024, 1, 2), "A", "x", 2.0, "1")), "two", 1)
    assert rows(store.summary()) == [(4, "2024-01-02", "2025-03-01")]
    assert [r[:2] for r in rows(store.month_statistics())] == [("2024-01", 1), ("2025-01", 1), ("2025-03", 1), ("undated", 1)]
    for df in (store.summary(), store.month_statistics(), store.history()):
        assert not any("/sales/" in f for f in df.inputFiles())


def test_compaction_bounds_files_and_leaves_readers_theirs(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path))
    assert store.compact() == 0
    one = batch(spark, *[(date(2025, m, 2), "A", "x", 1.0, str(m)) for m in (1, 2, 3)])
    for i in range(10):
        store.append(one.withColumn("QUANTITY", F.lit(float(i))), "same", 1)
        if i == 4:
            store.merge()
    store.append(one, "other", 2)
    reader = store.rows()
    want, told = rows(store.rows(), "date", "quantity", "batch"), rows(store.history(), "batch", "rows_count")
    assert len(files_of(tmp_path / "sales")) == 33
    assert store.compact(grace_seconds=3600) == 0 and len(files_of(tmp_path / "sales")) == 33
    store.merge()
    assert store.compact(grace_seconds=3600) == 0
    assert rows(reader, "date", "quantity", "batch") == want
    assert store.compact(grace_seconds=0) == 9 * 3 + 3
    assert len(files_of(tmp_path / "sales")) == 6 and len(files_of(tmp_path / "commits")) == 1
    assert rows(store.rows(), "date", "quantity", "batch") == want
    assert rows(store.history(), "batch", "rows_count") == told
    assert rows(store.merged("update"), "date", "quantity") == [(date(2025, m, 2), 1.0) for m in (1, 2, 3)]
    assert store.merge() == [] and store.compact(grace_seconds=0) == 0
    store.append(one.limit(1), "other", 2)
    assert store.merge() == ["2025-01", "2025-02", "2025-03"] and store.merged("update").count() == 3


def test_a_write_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    store = SalesStore(spark, str(tmp_path))
    one = batch(spark, (date(2025, 1, 2), "A", "x", 1.0, "1"))
    store.append(one, "same", 1)

    def fails(*_):
        raise RuntimeError("gone")

    monkeypatch.setattr(store, "_commit", fails)
    with pytest.raises(RuntimeError):
        store.append(one.withColumn("QUANTITY", F.lit(5.0)), "same", 1)
    assert rows(store.rows(), "quantity") == [(1.0,)] and rows(store.summary()) == [(1, "2025-01-02", "2025-01-02")]


def test_landing_stream_is_replay_safe(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path / "store"))
    landing, offsets = tmp_path / "landing", str(tmp_path / "offsets")
    names = HEADER.strip().split(",")

    def run():
        query = landing_ingest(spark, str(landing), names, store, offsets)
        query.awaitTermination()
        return query.id

    lot(landing, "a.csv", "s1,Main,x,2025-01-02,2,10,1", "s1,Main,y,bad,2,10,2")
    run()
    once = stored(store)
    assert once == [(date(2025, 1, 2), "S1", "X", 2.0, 10.0, "1")]
    run()
    assert stored(store) == once
    lot(landing, "b.csv", "s2,Side,x,2025-02-02,1,5,3")
    query = run()
    twice = stored(store)
    assert len(twice) == 2 and store.history().count() == 2
    # The second batch is delivered again, as after a failure before its offsets were noted.
    ingest_batch(store, readers.csv_scan(spark, str(landing / "b.csv")), 1, origin=stream_origin(query))
    assert stored(store) == twice and store.history().count() == 2
    # Batch 1 of something else is not this stream's.
    ingest_batch(store, readers.csv_scan(spark, str(landing / "b.csv")), 1, source="upload")
    assert len(stored(store)) == 3 and store.history().count() == 3


def test_plan_file_has_known_columns_first_and_no_giveaways(spark, tmp_path):
    plan = spark.createDataFrame([("k", "extra", "A", "MENS"), ("f", "extra", "A", "Freebies")], "SKU string, OTHER string, STORE string, GENDER string")
    readers.write_plan_csv(plan, str(tmp_path / "plan"))
    back = readers.csv_scan(spark, str(tmp_path / "plan"))
    assert back.columns == ["STORE", "SKU", "GENDER", "OTHER"] and rows(back, "SKU") == [("k",)]


def test_scratch_is_below_the_configured_folder(spark):
    root = scratch.scratch_root(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert root.startswith(named or tempfile.gettempdir())
    df = scratch.materialize(spark.range(3).toDF("n"))
    assert df.count() == 3 and all(root in f for f in df.inputFiles())


class _Session:
    """Just what scratch_root asks of a session without the setting."""

    def __init__(self, warehouse="/shared/warehouse/", master="local[2]"):
        self.conf = self.sparkContext = self
        self.applicationId, self.warehouse, self.master = "app-1", warehouse, master

    def get(self, key, default=None):
        return self.warehouse if key == "spark.sql.warehouse.dir" else default

    def getConf(self):
        return self


def test_without_the_setting_scratch_lies_below_the_warehouse():
    assert scratch.scratch_root(_Session()) == "/shared/warehouse/aislebrook-app-1"
    assert scratch.scratch_root(_Session("hdfs://n/w", "yarn")) == "hdfs://n/w/aislebrook-app-1"


@pytest.mark.parametrize("warehouse", ["/home/x/spark-warehouse", "file:/home/x/spark-warehouse"])
@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_told_so(warehouse, master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(_Session(warehouse, master))


def test_tables_rewritten_at_their_path_are_read_anew(spark, tmp_path):
    t = Testbed(spark, str(tmp_path))
    spark.range(3).write.parquet(f"{tmp_path}/part.parquet")
    assert t.table("part").columns == ["id"]
    before = t.state
    spark.range(2).selectExpr("id AS n", "id AS m").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert t.table("part").columns == ["n", "m"] and t.state != before


def test_csv_numbers_are_typed_whatever_stands_for_missing(spark, tmp_path):
    cells = [c for c in readers.NA_CELLS if c]
    (tmp_path / "a.csv").write_text("whole,some,text\n" + "".join(f"{i},{c},x{i}\n{i},1.5,\n" for i, c in enumerate(cells)))
    df = readers.csv_scan(spark, str(tmp_path / "a.csv"), infer=True)
    assert dict(df.dtypes) == {"whole": "bigint", "some": "double", "text": "string"}
    assert df.where("some is null").count() == len(cells)
    (tmp_path / "s.csv").write_text("date,store,sku,quantity\n2024-01-05,A,k,3\n2024-01-06,B,l,\n")
    got = readers.path_scan(spark, {"sales": str(tmp_path / "s.csv")})["sales"]
    assert sorted(r.QUANTITY for r in got.collect()) == [0.0, 3.0]


def test_uploads_of_different_origins_do_not_meet_and_corrections_replace(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path / "store"))
    lines = spark.createDataFrame([("2024-01-05", "A", "k", 1.0), ("2024-01-06", "A", "l", 2.0)], "date string, store string, sku string, quantity double")
    store.append(lines, "mail.csv", 1)
    store.append(lines.limit(1), "landing-1", 1)
    assert store.rows().count() == 3 and store.history().count() == 2
    # The same upload with its dates moved to another month leaves nothing of the first.
    store.append(lines.selectExpr("'2024-02-01' as date", "store", "sku", "quantity"), "mail.csv", 1)
    assert sorted(str(r.date) for r in store.rows().collect()) == ["2024-01-05", "2024-02-01", "2024-02-01"]
    assert store.history().count() == 2
