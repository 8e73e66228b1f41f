"""Every operator as a named query over the test tables, next to its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crestline.catalog import alignments, calls, library, model, multi, paired, peaks, tracks
from crestline.catalog.common import reset

MODULES = (tracks, peaks, multi, paired, alignments, library, calls, model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


__all__ = ["oracle_sql", "queries", "reset"]
