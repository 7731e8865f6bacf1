"""Query op9: documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import packing
from .common import table


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
