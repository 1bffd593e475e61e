from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from aislebrook.functions import text
from aislebrook.operators import cleaning, quality


def test_detect_column_prefers_name_order_then_column_order():
    cols = ["EBO NAME", "Store Code", "Store Name"]
    assert cleaning.detect_column(cols, ["store", "ebo"]) == "Store Code"
    assert cleaning.detect_column(cols, ["nothing", "ebo"]) == "EBO NAME"
    assert cleaning.detect_column(cols, ["sku"]) is None


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t a  b \n",), (None,), ("  X ",)], "s string")
    out = df.select(text.clean_text(F.col("s")).alias("a"), text.fast_clean_text(F.col("s")).alias("b"))
    assert rows(out) == [("", ""), ("A B", "A  B"), ("X", "X")]


@pytest.mark.parametrize(
    "raw, want",
    [("12", 12.0), (" 1.5 ", 1.5), ("-3", -3.0), ("1e3", 1000.0), ("12d", 0.0), ("NaN", 0.0), ("abc", 0.0), (None, 0.0), (".5", 0.5)],
)
def test_safe_numeric(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.safe_numeric(F.col("s")).alias("n")).first().n == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2025-10-31", date(2025, 10, 31)),
        ("2025-10-31 12:30:00", date(2025, 10, 31)),
        ("2025/1/5", date(2025, 1, 5)),
        ("10/31/2025", date(2025, 10, 31)),
        ("31/10/2025", date(2025, 10, 31)),
        ("1-2-2025", date(2025, 1, 2)),
        ("10/31/2025 08:00", date(2025, 10, 31)),
        ("31-31-2025", None),
        ("10/31/20255", None),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_as_date(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.as_date(F.col("s")).alias("d")).first().d == want


RAW = "`Store Code` string, `EBO NAME` string, SKU string, `Bill Date` string, Qty string, MRP string"


def test_clean_sales_drops_giveaways_bad_dates_and_quantities(spark):
    df = spark.createDataFrame(
        [
            (" s1 ", "Main  St", " a1", "2025-01-02", "2", "10"),
            ("s1", "Main St", "a1", "bad", "2", "10"),
            ("s1", "Main St", "a1", "2025-01-02", "-1", "10"),
            ("s1", "Main St", "a1", "2025-01-02", "x", "10"),
            ("s1", "Main St", "a1", "2025-01-02", "1", "0"),
            ("s1", "Main St", "a1", "2025-01-02", "1", None),
        ],
        RAW,
    )
    out = cleaning.clean_sales(df)
    assert out.columns == ["SKU", "DATE", "QUANTITY", "STORE", "STORE_NAME"]
    assert rows(out) == [("A1", date(2025, 1, 2), 2.0, "S1", "MAIN  ST")]
    assert rows(cleaning.clean_sales(df, "base"), "STORE_NAME") == [("MAIN ST",)]


def test_clean_sales_uses_amount_when_there_is_no_rate(spark):
    df = spark.createDataFrame(
        [("s1", "a", "2025-01-02", "1", "0"), ("s1", "b", "2025-01-02", "1", "5")],
        "store string, sku string, date string, quantity string, amount string",
    )
    assert rows(cleaning.clean_sales(df), "SKU", "STORE") == [("B", "S1")]


def test_missing_columns_are_named(spark):
    with pytest.raises(cleaning.MissingColumns, match="quantity"):
        cleaning.clean_sales(spark.createDataFrame([("a", "b")], "sku string, date string"))


def test_masters_and_size_master(spark):
    sm = spark.createDataFrame([("a", "Freebies"), ("b ", " mens")], "Style string, Gender string")
    assert rows(cleaning.clean_style_master(sm)) == [("B", "MENS")]
    assert len(rows(cleaning.clean_style_master(sm, drop_freebies=False))) == 2
    size = spark.createDataFrame([("s", "Regular", "x"), ("3xl", "Plus", "3")], "SIZE string, SIZE_SET string, MIN_SIZES_REQUIRED string")
    assert rows(cleaning.clean_size_master(size)) == [("3XL", "PLUS", 3), ("S", "REGULAR", 4)]


def test_coerce_types(spark):
    df = spark.createDataFrame([(" NA", "null", "x", "7")], "SKU string, BILL_DATE string, Stock string, note string")
    assert rows(cleaning.coerce_types(df)) == [("", None, 0.0, "7")]


def test_exclude_promos(spark):
    df = spark.createDataFrame(
        [("a", 5.0, None, "shirt"), ("a", 0.0, None, "shirt"), ("a", 5.0, "Buy1 FREE", "shirt"), ("a", 5.0, "", "Trolley case 20"), ("b", 5.0, "", None)],
        "SKU string, NET_AMOUNT double, ITEM_PROMO_NAME string, ITEM_DESC string",
    )
    master = spark.createDataFrame([("a", None), ("b", "airdopes joy")], "SKU string, DESCRIPTION string")
    assert rows(cleaning.exclude_promos(df, master), "SKU", "ITEM_DESC") == [("a", "shirt")]


def test_enrich_sales_by_icode_and_repeated_master_rows(spark):
    sales = spark.createDataFrame([("1", "S1", "2"), ("9", None, "x")], "ICODE string, STYLE string, BILL_QUANTITY string")
    skus = spark.createDataFrame([("1", "RED"), ("1", "RED")], "SKU string, COLOR string")
    styles = spark.createDataFrame([("S1", "WOMEN"), ("S1", "WOMEN")], "STYLE string, GENDER string")
    out = cleaning.enrich_sales(sales, skus, styles)
    assert rows(out, "ICODE", "BILL_QUANTITY", "COLOR", "GENDER") == [("1", 2.0, "RED", "WOMEN"), ("9", 0.0, None, None)]
    assert len(rows(cleaning.enrich_sales(sales, skus, styles, "inner"))) == 1


def test_required_columns(spark):
    df = spark.createDataFrame([("a", 1)], "SKU string, `Warehouse_Stock now` int")
    assert quality.required_columns(df, "warehouse") == (False, ["WAREHOUSE_STOCK"])
    assert quality.required_columns(df, "warehouse", partial=True) == (True, [])
    ok, gaps = quality.required_tables({"warehouse": df})
    assert not ok and set(gaps) == {"sales", "stock", "warehouse", "sku_master"}


def test_duplicates_and_mixed_types(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("x", None), ("x", None)], "k string, v string")
    assert quality.duplicate_count(df).first().duplicate_rows == 2
    assert rows(quality.mixed_types(df)) == [("k", 2, 2, True), ("v", 0, 2, False)]
