"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["prices", "trade", "gates", "resolve", "screens", "settled", "flows"]


def load_all():
    """Import every query module and return (queries, check SQL)."""
    from tradeq.plans.registry import CHECK_SQL, QUERIES

    for name in MODULES:
        import_module(f"tradeq.plans.{name}")
    return QUERIES, CHECK_SQL
