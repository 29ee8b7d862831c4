"""The registered queries of the reference's operators, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import building, catalog, chunking, crawl, dedup, evaluation, markup, vector

MODULES: tuple = (vector, catalog, dedup, chunking, building, evaluation, markup, crawl)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query over (spark, sf_dir)."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to the DuckDB SQL of the same rows."""
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
