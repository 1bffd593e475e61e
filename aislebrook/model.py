"""Canonical table schemas and operator parameters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


SALES = _struct(SKU=_S, DATE=T.DateType(), QUANTITY=_D, STORE=_S, STORE_NAME=_S)
STOCK = _struct(SKU=_S, STOCK=_D, STORE=_S, STORE_NAME=_S)
WAREHOUSE = _struct(SKU=_S, WAREHOUSE_STOCK=_D)
SKU_MASTER = _struct(SKU=_S, STYLE=_S, COLOR=_S, SIZE=_S)
STYLE_MASTER = _struct(STYLE=_S, GENDER=_S)
SIZE_MASTER = _struct(SIZE=_S, SIZE_SET=_S, MIN_SIZES_REQUIRED=T.IntegerType())

# Columns each input type must carry.
REQUIRED_COLUMNS = {
    "sales": ["DATE", "STORE", "SKU", "QUANTITY"],
    "stock": ["STORE", "SKU", "STOCK"],
    "warehouse": ["SKU", "WAREHOUSE_STOCK"],
    "sku_master": ["SKU", "STYLE", "COLOR", "SIZE"],
}

# Sizes that belong to each default size set, and its minimum.
DEFAULT_SIZE_SETS = {
    "Regular": (["S", "M", "L", "XL", "2XL"], 4),
    "Plus": (["3XL", "4XL", "5XL"], 3),
}

# Sizes that make a style-colour a plus-size run.
PLUS_SIZES = ["2XL", "3XL", "4XL", "5XL"]

# UNISEX styles that stay in the plan.
EXCEPTION_STYLES = ("A201", "C101", "A202")

# Words that reveal a giveaway among styles without a gender.
FREEBIE_WORDS = ["GYM BAG", "POWER BANK", "AIRPODS", "BAG", "HEADPHONE", "CHARGER", "EARBUDS", "SPEAKER"]
FINAL_FREEBIE_WORDS = ["GYM BAG", "POWER BANK", "AIRPODS", "BAG", "HEADPHONE", "CHARGER"]


@dataclass(frozen=True)
class ReplenishParams:
    """Replenishment settings.

    method      "simple" or "weighted" demand velocity
    mode        "observed": pairs with sales or stock; "universe": stores x SKUs
    completion  "full", "simple" or "none" size-set completion
    trend       None for a constant factor of 1, "observed" for the sales trend
    as_of       planning date; the latest sale when None
    cap_to_warehouse  completion steps share, by priority, what allocation leaves of a SKU's warehouse stock
    class_limits       "quantile", or "fixed" for the fixed ABC and velocity limits
    quantile_accuracy  None for exact class limits, else as in percentile_approx
    """

    period_days: int = 90
    target_days: int = 20
    safety_days: int = 3
    lead_days: int = 8
    moq: int = 2
    method: str = "simple"
    mode: str = "observed"
    completion: str = "full"
    trend: str | None = None
    as_of: date | None = None
    unit_price: float = 100.0
    exception_styles: tuple[str, ...] = EXCEPTION_STYLES
    cap_to_warehouse: bool = False
    class_limits: str = "quantile"
    quantile_accuracy: int | None = None

    @property
    def cover_days(self) -> int:
        return self.target_days + self.safety_days + self.lead_days
