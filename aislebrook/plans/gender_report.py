"""The merchandising report per gender."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merch, weekly
from ..operators.cleaning import enrich_sales, of_genders
from ..operators.windows import since
from ..sources.scratch import materialize


def enriched_bills(
    sales: DataFrame, sku_master: DataFrame, style_master: DataFrame, start, genders: list[str]
) -> DataFrame:
    """Bill lines from `start` on with master attributes, the style's first sale in the
    whole history and the launch flag."""
    first = merch.first_sale(sales)
    lines = enrich_sales(since(sales, start, "BILL_DATE"), sku_master, of_genders(style_master, genders))
    return merch.with_launch_flag(lines, first, start)


def gender_report(
    sales: DataFrame,
    sku_master: DataFrame,
    style_master: DataFrame,
    start,
    genders: tuple[str, ...] = ("WOMEN", "BOYS"),
    lead_weeks: int = 4,
    service_level: float = 0.95,
    horizon_weeks: int = 12,
    top_n: int = 100,
    key_styles: int = 20,
) -> dict[str, DataFrame]:
    """Named result tables: one set per gender, and the summary over all."""
    lines = materialize(enriched_bills(sales, sku_master, style_master, start, list(genders)), "lines")
    flags = materialize(merch.gender_summary(lines, genders), "flags")
    extremes = merch.revenue_extremes(flags)
    out = {"summary": merch.gender_totals(flags)}
    for gender in genders:
        tag = gender.lower()
        mine = lines.where(F.upper(F.trim("GENDER")) == gender.upper())
        ours = F.col("GENDER") == gender.upper()
        forecast = materialize(weekly.weekly_forecast(mine, horizon_weeks), "forecast")
        out |= {
            f"{tag}_raw": mine,
            f"{tag}_style_metrics": flags.where(ours),
            f"{tag}_top20": extremes.where(ours & (F.col("list") == "top")),
            f"{tag}_bottom20": extremes.where(ours & (F.col("list") == "bottom")),
            f"{tag}_reasons": flags.where(ours).select(
                "STYLE", "reasons_flags", *[c for c in flags.columns if c.startswith("flag_")], "void_rate"
            ),
            f"{tag}_ts_monthly": merch.monthly_series(mine),
            f"{tag}_demand_forecast": forecast,
            f"{tag}_reorder_reco": weekly.reorder_recommendations(forecast, lead_weeks, service_level, horizon_weeks),
            f"{tag}_department": merch.by_attribute(mine, "DEPARTMENT"),
            f"{tag}_category": merch.by_attribute(mine, "CATEGORY"),
            f"{tag}_style_daily": merch.style_daily(mine),
        }
        out |= {f"{tag}_{name}": df for name, df in merch.top_lists(mine, top_n).items()}
        out |= {f"{tag}_monthly_{name}": df for name, df in merch.monthly_key_styles(mine, key_styles).items()}
    return out
