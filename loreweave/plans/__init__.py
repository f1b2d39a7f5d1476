"""Registered queries over the test tables, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loreweave.plans import graph, ingest, maintain, pages, resolve, search, snapshots, streams, text

_MODULES = (search, graph, text, pages, ingest, resolve, maintain, snapshots, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
