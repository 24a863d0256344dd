"""All queries over the test tables, and their SQL, gathered from the modules of ``plans``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("reports", "travel_times", "roads", "marketplace", "routing", "rides", "streams")


def _plans():
    return [import_module(f"ridelake.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for plan in _plans():
        found |= {q.__name__: q for q in plan.QUERIES} | getattr(plan, "NAMED", {})
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _plans() for name, sql in plan.SQL.items()}
