"""Query op7: documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import table


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = mixing.mix(spark, docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
SQL: dict[str, str] = {}
