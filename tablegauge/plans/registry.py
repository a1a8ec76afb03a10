"""All registered queries in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_catalogue, queries_collect, queries_histogram, queries_history, queries_log, queries_report

_MODULES = [queries_collect, queries_catalogue, queries_history, queries_histogram, queries_log, queries_report]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
