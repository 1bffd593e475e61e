"""Retail analytics on Spark DataFrames: cleaning, replenishment, style
efficiency, baskets, merchandising KPIs and dashboards as lazy plans."""
