"""Raw files to canonical tables. Columns are found by name on the driver; the data
work is one projection and one filter per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_date, as_number, clean_text, fast_clean_text, na_to_null, safe_numeric, strip
from .plan_steps import one_per_key
from .windows import month

# Header parts that identify a column, in order of preference.
STORE_NAMES = ["store", "store name", "ebo", "channel"]
STORE_CODE_NAMES = ["store code", "store_code", "code", "store id", "store_id"]
STORE_LABEL_NAMES = ["ebo name", "ebo_name", "store name", "store_name"]
SKU_NAMES = ["sku", "ean", "product code"]
DATE_NAMES = ["date", "bill date", "transaction date"]
QUANTITY_NAMES = ["quantity", "qty", "bill quantity"]
RATE_NAMES = ["rate", "price", "mrp", "amount per unit", "unit price"]
AMOUNT_NAMES = ["amount", "total amount", "bill amount", "value"]
STOCK_NAMES = ["stock", "quantity", "qty", "available"]
WAREHOUSE_SKU_NAMES = ["each client sku id", "sku", "ean", "product code", "client sku id"]
WAREHOUSE_STOCK_NAMES = ["total available quantity", "stock", "quantity", "available quantity", "available"]
STYLE_NAMES = ["style", "style code"]
COLOR_NAMES = ["color", "colour"]
SIZE_NAMES = ["size"]
GENDER_NAMES = ["gender", "department"]
SIZE_MASTER_SIZE_NAMES = ["size", "size_code", "size_name"]
SIZE_SET_NAMES = ["size_set", "size_group", "set"]
MIN_SIZES_NAMES = ["min_sizes_required", "min_sizes", "required_sizes"]


class MissingColumns(ValueError):
    """A raw table lacks a column that its type needs."""


def detect_column(columns: list[str], names: list[str]) -> str | None:
    """The first column that contains a name, ignoring case; names in order of preference."""
    for name in names:
        for c in columns:
            if name.lower() in c.lower():
                return c
    return None


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _need(df: DataFrame, table: str, **wanted: list[str]) -> dict[str, str]:
    found = {k: detect_column(df.columns, names) for k, names in wanted.items()}
    missing = [k for k, c in found.items() if c is None]
    if missing:
        raise MissingColumns(f"{table}: no column for {', '.join(missing)}")
    return found


def _store_columns(df: DataFrame, table: str, text, edition: str) -> dict[str, Column]:
    """The code is the STORE and the label its name. Without a code the store column is
    the STORE; the base edition then uses it as the name too."""
    store = detect_column(df.columns, STORE_NAMES)
    code = detect_column(df.columns, STORE_CODE_NAMES)
    label = detect_column(df.columns, STORE_LABEL_NAMES)
    if code is None and store is None:
        raise MissingColumns(f"{table}: no column for store")
    out = {"STORE": text(_c(code or store))}
    if label:
        out["STORE_NAME"] = text(_c(label))
    elif store and (code or edition == "base"):
        out["STORE_NAME"] = text(_c(store))
    return out


def _text_of(edition: str):
    return clean_text if edition == "base" else fast_clean_text


def clean_sales(df: DataFrame, edition: str = "final", keep: dict[str, list[str]] | None = None) -> DataFrame:
    """SKU, DATE, QUANTITY, STORE, STORE_NAME of paid lines with a date and a quantity.
    Lines without a positive rate (or, lacking one, amount) are giveaways. `keep` carries
    further columns along as text: {name: header parts}."""
    text = _text_of(edition)
    found = _need(df, "sales", sku=SKU_NAMES, date=DATE_NAMES, quantity=QUANTITY_NAMES)
    paid_by = detect_column(df.columns, RATE_NAMES) or detect_column(df.columns, AMOUNT_NAMES)
    cols = {
        "SKU": text(_c(found["sku"])),
        "DATE": as_date(_c(found["date"])),
        "QUANTITY": safe_numeric(_c(found["quantity"])),
        **_store_columns(df, "sales", text, edition),
    }
    for name, parts in (keep or {}).items():
        source = detect_column(df.columns, parts)
        cols[name] = strip(_c(source).cast("string")) if source else F.lit(None).cast("string")
    paid = safe_numeric(_c(paid_by)) > 0 if paid_by else F.lit(True)
    return (
        df.where(paid)
        .select(*[c.alias(n) for n, c in cols.items()])
        .where(F.col("DATE").isNotNull() & (F.col("QUANTITY") > 0))
    )


def clean_stock(df: DataFrame, edition: str = "final") -> DataFrame:
    text = _text_of(edition)
    found = _need(df, "stock", sku=SKU_NAMES, stock=STOCK_NAMES)
    cols = {
        "SKU": text(_c(found["sku"])),
        "STOCK": safe_numeric(_c(found["stock"])),
        **_store_columns(df, "stock", text, edition),
    }
    return df.select(*[c.alias(n) for n, c in cols.items()])


def clean_warehouse(df: DataFrame, edition: str = "final") -> DataFrame:
    found = _need(df, "warehouse", sku=WAREHOUSE_SKU_NAMES, stock=WAREHOUSE_STOCK_NAMES)
    return df.select(
        _text_of(edition)(_c(found["sku"])).alias("SKU"), safe_numeric(_c(found["stock"])).alias("WAREHOUSE_STOCK")
    )


def clean_sku_master(df: DataFrame, edition: str = "final") -> DataFrame:
    found = _need(df, "sku_master", SKU=SKU_NAMES, STYLE=STYLE_NAMES, COLOR=COLOR_NAMES, SIZE=SIZE_NAMES)
    return df.select(*[_text_of(edition)(_c(c)).alias(n) for n, c in found.items()])


def clean_style_master(df: DataFrame, edition: str = "final", drop_freebies: bool = True) -> DataFrame:
    found = _need(df, "style_master", STYLE=STYLE_NAMES, GENDER=GENDER_NAMES)
    out = df.select(*[_text_of(edition)(_c(c)).alias(n) for n, c in found.items()])
    return out.where(F.col("GENDER") != "FREEBIES") if drop_freebies else out


def clean_size_master(df: DataFrame) -> DataFrame:
    found = _need(df, "size_master", size=SIZE_MASTER_SIZE_NAMES, size_set=SIZE_SET_NAMES, least=MIN_SIZES_NAMES)
    return df.select(
        fast_clean_text(_c(found["size"])).alias("SIZE"),
        fast_clean_text(_c(found["size_set"])).alias("SIZE_SET"),
        F.coalesce(as_number(_c(found["least"])), F.lit(4.0)).cast("int").alias("MIN_SIZES_REQUIRED"),
    ).dropna(subset=["SIZE", "SIZE_SET"])


# Header parts that decide a column's type.
DATE_LIKE = ["date"]
NUMBER_LIKE = ["quantity", "stock"]
TEXT_LIKE = ["sku", "store", "style", "color", "size", "gender", "department"]


def coerce_types(df: DataFrame) -> DataFrame:
    """Text trimmed and NA tokens to NULL; then by header: dates, numbers (0 when bad),
    and names ('' when missing)."""
    out = []
    for c in df.columns:
        low = c.lower()
        value = na_to_null(_c(c))
        if any(w in low for w in DATE_LIKE):
            value = as_date(value)
        if any(w in low for w in NUMBER_LIKE):
            value = safe_numeric(value)
        if any(w in low for w in TEXT_LIKE):
            value = strip(F.coalesce(value.cast("string"), F.lit("")))
        out.append(value.alias(c))
    return df.select(*out)


# Source columns of the retailer's own files.
SALES_MAP = {
    "DATE": "BILL_DATE",
    "STORE": "store_code",
    "STORE_NAME": "EBO NAME",
    "SKU": "SKU",
    "QUANTITY": "BILL_QUANTITY",
    "STYLE": "STYLE",
    "COLOR": "COLOR",
    "SIZE": "SIZE",
    "DEPARTMENT": "DEPARTMENT",
    "NET_AMOUNT": "NET_AMOUNT",
}
STOCK_MAP = {
    "STORE": "store_code",
    "STORE_NAME": "Store Name",
    "SKU": "SKU",
    "STOCK": "quantity",
    "STYLE": "Style",
    "COLOR": "Colour",
    "SIZE": "Size",
    "DEPARTMENT": "Department",
}
WAREHOUSE_MAP = {
    "SKU": "Each Client SKU ID",
    "WAREHOUSE_STOCK": "Total Available Quantity",
    "STYLE": "Style",
    "COLOR": "Color",
    "SIZE": "Size",
}
_NUMBERS = {"QUANTITY", "STOCK", "WAREHOUSE_STOCK", "NET_AMOUNT"}
_OPTIONAL = {"NET_AMOUNT", "COLOR", "SIZE", "STORE_NAME"}


def map_columns(df: DataFrame, mapping: dict[str, str], *, need_style: bool = False) -> DataFrame:
    """Apply a fixed source-to-canonical mapping and drop unusable rows: no date, no
    positive quantity, no SKU and, with need_style, no style."""
    cols = []
    for name, source in mapping.items():
        if source not in df.columns:
            if name in _OPTIONAL or mapping is WAREHOUSE_MAP:
                continue
            raise MissingColumns(f"no column {source}")
        c = _c(source)
        if name == "DATE":
            c = as_date(c)
        elif name in _NUMBERS:
            c = safe_numeric(c)
        else:
            c = strip(F.coalesce(c.cast("string"), F.lit("nan")))
        cols.append(c.alias(name))
    out = df.select(*cols)
    keep = F.col("SKU") != ""
    if "DATE" in out.columns:
        keep &= F.col("DATE").isNotNull()
    if "QUANTITY" in out.columns:
        keep &= F.col("QUANTITY") > 0
    if need_style:
        keep &= ~F.col("STYLE").isin("", "nan")
    return out.where(keep)


def derive_masters(sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SKU master and style master (DEPARTMENT as GENDER) found in the sales."""
    skus = sales.select("SKU", "STYLE", "COLOR", "SIZE").where(F.col("SKU") != "").distinct()
    styles = sales.select("STYLE", F.col("DEPARTMENT").alias("GENDER")).where(F.col("STYLE") != "").distinct()
    return skus, styles


def normalise_headers(df: DataFrame, upper: bool = True) -> DataFrame:
    names = [c.strip().upper() if upper else c.strip() for c in df.columns]
    return df.toDF(*names)


# Giveaway articles recognised by their description.
PROMO_ITEMS = [
    "POWERBANK 300 LITE",
    "UNISEX GYM BAG",
    "AIRDOPES JOY",
    "TROLLEY CASE",
    "BAMBREW CARRY BAG",
    "BOAT AIRDOPES 192",
]


def exclude_promos(df: DataFrame, sku_master: DataFrame | None = None) -> DataFrame:
    """Lines that were paid for: positive net amount, no promotion text naming a free
    item or gift, and no giveaway article by its own or the master's description."""
    words = "|".join(PROMO_ITEMS)
    if "NET_AMOUNT" in df.columns:
        df = df.where(F.col("NET_AMOUNT") > 0)
    types = dict(df.dtypes)
    for c in df.columns:
        if "PROMO" in c.upper() and types[c] == "string":
            df = df.where(~F.coalesce(_c(c).rlike("(?i)free|gift"), F.lit(False)))
    described = next((c for c in df.columns if "DESC" in c.upper()), None)
    if described and types[described] == "string":
        df = df.where(~F.coalesce(F.upper(_c(described)).rlike(words), F.lit(False)))
    if sku_master is not None and "SKU" in df.columns and "DESCRIPTION" in sku_master.columns:
        given = F.coalesce(F.upper("DESCRIPTION").rlike(words), F.lit(False))
        df = df.join(sku_master.where(~given).select("SKU").distinct(), "SKU", "left_semi")
    return df


def of_genders(style_master: DataFrame, genders: list[str]) -> DataFrame:
    return style_master.where(F.lower(F.trim("GENDER")).isin([g.lower() for g in genders]))


AMOUNTS = ["BILL_QUANTITY", "NET_AMOUNT", "RSP", "ITEM_DISCOUNT_AMOUNT", "PROMO_AMOUNT"]


def _joined(df: DataFrame, master: DataFrame, left: str, right: str, how: str, suffix: str) -> DataFrame:
    """Join that keeps the left names; clashing right columns get the suffix."""
    renamed = master.withColumnsRenamed({c: c + suffix for c in master.columns if c in df.columns and c != right})
    on = renamed[right].alias("k")
    renamed = renamed.withColumn("__key", on).drop(right) if right in df.columns else renamed.withColumn("__key", on)
    return df.join(renamed, F.col(f"`{left}`") == F.col("__key"), how).drop("__key")


def enrich_sales(
    sales: DataFrame, sku_master: DataFrame, style_master: DataFrame, style_join: str = "left", suffixes=("_sku", "_style")
) -> DataFrame:
    """Sales with the SKU master (on SKU, or ICODE = SKU) and the style master (on STYLE).

    The masters are brought to one row per key, so the joins cannot multiply lines;
    their physical form is left to the optimizer, which broadcasts them only when
    their measured size allows it and otherwise splits skewed keys.
    """
    types = dict(sales.dtypes)
    numbers = {c: safe_numeric(F.col(c)) for c in AMOUNTS if c in sales.columns and types[c] == "string"}
    filled = {
        c: F.coalesce(F.col(c), F.lit(0).cast(types[c])) for c in AMOUNTS if c in sales.columns and c not in numbers
    }
    df = sales.withColumns({**numbers, **filled}) if numbers or filled else sales
    left = "SKU" if "SKU" in df.columns else "ICODE" if "ICODE" in df.columns else None
    if left and "SKU" in sku_master.columns:
        df = _joined(df, one_per_key(sku_master, "SKU"), left, "SKU", "left", suffixes[0])
    if "STYLE" in df.columns and "STYLE" in style_master.columns:
        df = _joined(df, one_per_key(style_master, "STYLE"), "STYLE", "STYLE", style_join, suffixes[1])
    return df


def enrich_basket(sales: DataFrame, sku_master: DataFrame, style_master: DataFrame, year_month: str) -> DataFrame:
    """One month of paid lines whose style is known and no giveaway."""
    styles = style_master.where(F.upper(F.trim("GENDER")) != "FREEBIES") if "GENDER" in style_master.columns else style_master
    paid = exclude_promos(sales, sku_master)
    return enrich_sales(month(paid, year_month, "BILL_DATE"), sku_master, styles, "inner", ("_SKU", "_STYLE"))
