"""Queries over the driver's tables, which stand in for the domain's own."""

from __future__ import annotations

from importlib import import_module

#: Modules with a ``catalog`` of queries.
MODULES = ("metric_queries", "matching_queries", "text_queries", "calendar_queries", "run_queries", "bank_queries", "record_queries", "evaluation_queries", "judge_queries")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"skerry.catalog.{name}").catalog.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"skerry.catalog.{name}").catalog.sql
    return found
