"""The queries: each module has QUERIES (functions of ``Meets``) and SQL (the same in DuckDB's SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from poolside.plans import clean, column_books, histories, imports, lists, matching, medals, meets, rankings, sheets, swimmers, teams, written
from poolside.sources.tpch import SWIMS_SQL, Meets

MODULES = (rankings, medals, meets, swimmers, teams, clean, lists, histories, matching, written, imports, sheets, column_books)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_folder(f):
        return lambda spark, sf_dir: f(Meets(spark, sf_dir))

    return {name: on_folder(f) for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: SWIMS_SQL + sql for module in MODULES for name, sql in module.SQL.items()}
