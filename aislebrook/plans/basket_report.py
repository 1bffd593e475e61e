"""The basket report: sizes, and per item level itemsets, rules and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import basket
from ..sources.scratch import materialize

LEVELS = {"sku": ("SKU", ["STYLE", "CATEGORY", "DEPARTMENT"]), "style": ("STYLE", ["CATEGORY", "DEPARTMENT"])}


def basket_report(
    lines: DataFrame,
    min_support: float = 0.01,
    min_confidence: float = 0.1,
    min_lift: float = 1.0,
    levels: dict[str, tuple[str, list[str]]] = LEVELS,
    min_pairs: int = 1,
) -> dict[str, DataFrame]:
    """Named result tables for bill lines that are already cleaned and enriched. Pairs are
    listed from `min_pairs` bills on. Of the lines only the bill and the levels' columns
    are written."""
    columns = dict.fromkeys(["BILL_NO", *[c for item, meta in levels.values() for c in (item, *meta)]])
    lines = materialize(lines.select(*columns), "lines")
    out = {"basket_stats": basket.basket_sizes(lines)}
    for tag, (item, meta) in levels.items():
        sets = materialize(basket.frequent_itemsets(lines, item, min_support=min_support), "itemsets")
        rules = materialize(basket.association_rules(sets, min_confidence, min_lift), "rules")
        out[f"{tag}_frequent_itemsets"] = sets
        out[f"{tag}_association_rules"] = basket.with_rule_metadata(rules, lines, item, meta)
        out[f"{tag}_common_pairs"] = basket.common_pairs(lines, item, min_count=min_pairs)
    return out
