"""Registered queries, each beside its independent SQL."""
