"""Style-efficiency reports: canonical tables in, named result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import stable
from ..operators import efficiency as ef
from ..operators import efficiency_scripts as es
from ..operators import plan_steps as ps
from ..operators.quality import required_tables
from ..operators.windows import recent
from ..sources.scratch import materialize


def style_report(tables: dict[str, DataFrame], days: int = 90, threshold: float = 60.0, as_of=None) -> dict[str, DataFrame]:
    """The six result tables of the scored analysis. Tables: sales, stock, warehouse,
    sku_master and, if there is one, style_master."""
    ok, gaps = required_tables(tables)
    if not ok:
        raise ValueError(f"missing columns: {gaps}")
    sales, stock = tables["sales"], tables["stock"]
    metrics = materialize(
        ef.style_metrics(
            sales, stock, tables["sku_master"], tables["warehouse"], tables.get("style_master"), days, as_of
        ),
        "style_metrics",
    )
    names = ps.store_names(recent(sales, days, as_of=as_of), stock)
    stores = materialize(ef.store_recommendations(metrics, names, threshold), "stores")
    shown = metrics.withColumns({c: F.round(stable(F.col(c)), 2) for c, t in metrics.dtypes if t == "double"})
    label = F.concat("STORE", F.lit(" - "), F.coalesce("STORE_NAME", F.lit("")))
    return {
        "Store_Recommendations": stores.select(label.alias("STORE_DISPLAY"), *stores.columns[1:]),
        "Style_Performance": shown,
        "Top_Performing_Styles": ef.top_store_styles(metrics),
        "Category_Analysis": ef.category_analysis(stores),
        "Detailed_Style_Recs": ef.style_recommendations(metrics, stores),
        "Summary_Statistics": ef.summary_stats(stores),
    }


def minmax_report(sales: DataFrame, stock: DataFrame, days: int = 90, as_of=None) -> dict[str, DataFrame]:
    """Result tables of the min-max analysis. sales carry STYLE and NET_AMOUNT, stock STYLE."""
    styles = materialize(es.minmax_efficiency(sales, stock, days, as_of), "styles")
    stores = materialize(es.minmax_store_plan(styles), "stores")
    top = ["STYLE", "STORE", "STORE_NAME", "TOTAL_QTY", "TOTAL_REVENUE", "EFFICIENCY_SCORE"]
    return {
        "Store_Recommendations": stores.orderBy(F.desc("EFFICIENCY_SCORE"), "STORE"),
        "Style_Performance": styles.orderBy("STORE", F.desc("EFFICIENCY_SCORE"), "STYLE"),
        "Top_Performing_Styles": styles.orderBy(F.desc("EFFICIENCY_SCORE"), "STORE", "STYLE").limit(50).select(*top),
        "Summary_Statistics": es.minmax_summary(stores, styles),
        "Stores_Needing_Attention": es.attention_list(stores),
    }


def rank_report(sales: DataFrame, stock: DataFrame, warehouse: DataFrame, days: int = 90, as_of=None) -> dict[str, DataFrame]:
    """Result tables of the percent-rank analysis."""
    styles = materialize(es.rank_efficiency(sales, stock, warehouse, days, as_of), "styles")
    stores = materialize(es.optimal_style_count(styles), "stores")
    return {
        "Store_Recommendations": stores.orderBy(F.desc("EFFICIENCY_SCORE"), "STORE"),
        "Style_Analysis": styles.orderBy("STORE", F.desc("EFFICIENCY_SCORE"), "STYLE"),
        "Performance_Tiers": es.tier_table(styles),
        "Recommended_Portfolio": es.recommended_portfolio(styles, stores),
        "Summary": es.optimal_summary(stores),
    }
