"""The canonical retail tables as views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import Files
from ..sources.scratch import spread

# Sizes in order; a part's size number modulo 9 picks one.
SIZES = ["XS", "S", "M", "L", "XL", "2XL", "3XL", "4XL", "5XL"]


# Schemas by table and what its folder lists: a table rewritten at its path is read anew.
_SCHEMAS: dict[tuple, StructType] = {}


class Testbed:
    """Tables of one scale factor, all of them lazy views: a query reads the columns and
    rows it needs from the given tables."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        key = (path, Files(self.spark).listing(path))
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    @property
    def state(self) -> tuple:
        """What names the tables as they are now."""
        return (self.dir, Files(self.spark).listing(self.dir))

    def _lines(self, *columns: str) -> DataFrame:
        """Line items with the order date and the nation of the bill. Orders get their nation
        first, so that the lines are shuffled by order only, not by customer."""
        li = self.table("lineitem").select("l_orderkey", "l_partkey", *columns)
        o = self.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("BILL_DATE"))
        c = self.table("customer").select("c_custkey", "c_nationkey")
        bills = spread(o, "o_custkey").join(c, o.o_custkey == c.c_custkey)
        return spread(li, "l_orderkey").join(bills, li.l_orderkey == o.o_orderkey)

    def _stores(self) -> DataFrame:
        """The store of each nation. Joined last: a number is shuffled before, no names."""
        return self.table("nation").select("n_nationkey", self._store().alias("STORE"), F.col("n_name").alias("STORE_NAME"))

    @staticmethod
    def _store() -> Column:
        return F.concat(F.lit("ST"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))

    @property
    def sales(self) -> DataFrame:
        return self.bills.select(
            "SKU",
            F.col("BILL_DATE").alias("DATE"),
            F.col("BILL_QUANTITY").alias("QUANTITY"),
            "STORE",
            "STORE_NAME",
        )

    def _item_columns(self) -> list[Column]:
        words = F.split(F.upper("p_name"), " ")
        return [
            F.upper("p_brand").alias("STYLE"),
            words[0].alias("COLOR"),
            F.element_at(F.array(*map(F.lit, SIZES)), (F.col("p_size") % 9 + 1).cast("int")).alias("SIZE"),
            words[1].alias("CATEGORY"),
            F.col("p_type").alias("DEPARTMENT"),
        ]

    @staticmethod
    def _brand_no() -> Column:
        return F.substring_index("p_brand", "#", -1).cast("int")

    @property
    def bills(self) -> DataFrame:
        """Bill lines with item attributes and money columns."""
        p = self.table("part").select(
            "p_partkey",
            F.col("p_partkey").cast("string").alias("SKU"),
            *self._item_columns(),
            F.col("p_retailprice").alias("RSP"),
            (self._brand_no() % 5 == 0).alias("fifth"),
        )
        x = self._lines("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
        x = spread(x, "l_partkey").join(p, x.l_partkey == p.p_partkey)
        x = x.join(self._stores(), F.col("c_nationkey") == F.col("n_nationkey"))

        def money(c: Column) -> Column:
            return c.cast("decimal(18,4)")

        price, disc, flag = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_returnflag")
        void = (flag == "R") | ((flag == "A") & F.col("fifth"))
        return x.select(
            "BILL_DATE",
            F.col("l_orderkey").alias("BILL_NO"),
            "STORE",
            "STORE_NAME",
            "SKU",
            F.col("l_quantity").alias("BILL_QUANTITY"),
            *["STYLE", "COLOR", "SIZE", "CATEGORY", "DEPARTMENT"],
            money(price).alias("GROSS_AMOUNT"),
            money(price * (1 - disc)).alias("NET_AMOUNT"),
            money(price * disc).alias("ITEM_DISCOUNT_AMOUNT"),
            money(price * F.col("l_tax")).alias("PROMO_AMOUNT"),
            "RSP",
            F.when(void, "Y").otherwise("N").alias("VOID_STATUS"),
        )

    @property
    def style_sales(self) -> DataFrame:
        """Sales with STYLE and NET_AMOUNT, the shape of the script analyses."""
        return self.bills.select(
            F.col("BILL_DATE").alias("DATE"),
            "STORE",
            "STORE_NAME",
            "SKU",
            "STYLE",
            "COLOR",
            "SIZE",
            "DEPARTMENT",
            F.col("BILL_QUANTITY").alias("QUANTITY"),
            "NET_AMOUNT",
        )

    @property
    def stock(self) -> DataFrame:
        pairs = spread(self._lines().select("c_nationkey", "l_partkey"), "l_partkey").distinct()
        pairs = pairs.join(self._stores().distinct(), F.col("c_nationkey") == F.col("n_nationkey"))
        v = (F.col("n_nationkey") * 7 + F.col("l_partkey") * 13) % 11
        return pairs.select(
            F.col("l_partkey").cast("string").alias("SKU"),
            F.when(v < 2, 0).otherwise(v).cast("double").alias("STOCK"),
            "STORE",
            "STORE_NAME",
        )

    @property
    def warehouse(self) -> DataFrame:
        v = (F.col("p_partkey") * 37) % 61
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("SKU"),
            F.when(v < 8, 0).otherwise(v).cast("double").alias("WAREHOUSE_STOCK"),
        )

    @property
    def sku_master(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("SKU"), *self._item_columns()[:3])

    @property
    def sku_attributes(self) -> DataFrame:
        """SKU master with CATEGORY and DEPARTMENT."""
        return self.table("part").select(F.col("p_partkey").cast("string").alias("SKU"), *self._item_columns())

    @property
    def style_master(self) -> DataFrame:
        no = self._brand_no()
        gender = (
            F.when(no % 5 == 0, "FREEBIES")
            .when(no % 5 == 1, "WOMEN")
            .when(no % 5 == 2, "BOYS")
            .when(no % 5 == 3, "UNISEX")
            .otherwise("MENS")
        )
        return (
            self.table("part")
            .where(no != 25)
            .select(F.upper("p_brand").alias("STYLE"), gender.alias("GENDER"))
            .distinct()
        )

    @property
    def size_master(self) -> DataFrame:
        return (
            self.table("part")
            .select((F.col("p_size") % 9).alias("i"))
            .where("i > 0")
            .distinct()
            .select(
                F.element_at(F.array(*map(F.lit, SIZES)), (F.col("i") + 1).cast("int")).alias("SIZE"),
                F.when(F.col("i") <= 5, "Regular").otherwise("Plus").alias("SIZE_SET"),
                F.when(F.col("i") <= 5, 4).otherwise(3).alias("MIN_SIZES_REQUIRED"),
            )
        )

    exception_styles = ("BRAND#3",)
