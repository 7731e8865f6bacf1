"""Query op6: toxicity of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import toxicity
from .common import table


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
