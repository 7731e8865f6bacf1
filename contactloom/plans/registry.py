"""The list that query modules add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sql import with_tables
from .tables import Data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: dict[str, str] | None = None):
    """Registers ``f(data)`` under a name, with the SQL of its result."""

    def add(f: Callable[[Data], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the JVM leaves longer methods uncompiled, which takes several times as long as plain iterators
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return f(Data(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(sql, more)
        return f

    return add
