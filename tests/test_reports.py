import os

import pytest

from aislebrook.plans.gender_report import gender_report
from aislebrook.plans.style_report import minmax_report, rank_report, style_report
from aislebrook.plans.testbed import Testbed
from aislebrook.sources.readers import write_report

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def t(spark):
    return Testbed(spark, SF)


def test_style_report_writes_six_tables(spark, t, tmp_path):
    tables = {"sales": t.sales, "stock": t.stock, "warehouse": t.warehouse, "sku_master": t.sku_master, "style_master": t.style_master}
    report = style_report(tables, 365, 20)
    assert len(report) == 6
    write_report(report, str(tmp_path))
    recs = spark.read.parquet(str(tmp_path / "Store_Recommendations"))
    assert recs.columns[0] == "STORE_DISPLAY" and recs.count() == 25
    with pytest.raises(ValueError, match="warehouse"):
        style_report({k: v for k, v in tables.items() if k != "warehouse"})


def test_script_reports(t):
    styles = t.sku_master.select("SKU", "STYLE")
    stock, warehouse = t.stock.join(styles, "SKU"), t.warehouse.join(styles, "SKU")
    a = minmax_report(t.style_sales, stock, 365)
    assert a["Summary_Statistics"].first().total_stores == a["Store_Recommendations"].count()
    b = rank_report(t.style_sales, stock, warehouse, 365)
    assert b["Recommended_Portfolio"].count() <= b["Style_Analysis"].count()


def test_gender_report(t):
    report = gender_report(t.bills, t.sku_master, t.style_master, "1998-01-01", top_n=5)
    assert {r.GENDER for r in report["summary"].collect()} == {"WOMEN", "BOYS"}
    assert report["women_reorder_reco"].count() == report["women_demand_forecast"].count() > 0
    assert report["boys_top_skus_by_asp"].count() == 5
    assert "launched_after" in report["boys_raw"].columns
    units = report["women_style_metrics"].agg({"units_sold": "sum"}).first()[0]
    assert units == report["women_raw"].agg({"BILL_QUANTITY": "sum"}).first()[0]
