"""Registers every query of the engine with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("audit", "contracts", "corpus", "imports", "loading", "lookup", "modules", "nested", "outlines", "quality", "retrieval", "shown", "state", "store", "text")


def _all() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"fragmenta.plans.{name}").QUERIES
    return out


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _all().items() if v[1]}
