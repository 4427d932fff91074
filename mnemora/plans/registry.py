"""Registered queries: a key, a function of the input views, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``f(views) -> DataFrame`` under ``key``; sql may use the views by name."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return f

    return add
