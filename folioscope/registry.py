"""Every registered query of the bibliographic operators with its oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("candidates", "evidence", "extra", "portraits", "resolve", "rollups", "scoring", "text", "topics", "tracking", "usage")


def _modules():
    return [importlib.import_module(f"folioscope.plans.{name}") for name in MODULES]


def queries() -> dict[str, Query]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
