"""The text operators as named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crestline.llm import chat, decontamination, html_text, license_scan, ngram_join, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, simhash, toxicity, whitening

MODULES = (packing, toxicity, quality_classifier, decontamination, secret_scan, quality_rules, simhash, chat, license_scan, html_text, whitening, periodic_runs, ngram_join)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
