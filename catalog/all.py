"""Importing this module registers every query."""

from . import basket, dashboard, demand, efficiency, forms, ingest, merch, replenish  # noqa: F401
