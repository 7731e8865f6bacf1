"""Queries op1 and op2: secrets in documents, and their token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets, tokencount
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = secrets.Dictionary.public()
    forest = secrets.train(secrets.labelled_findings(), dictionary)
    found = secrets.scan_documents(table(spark, sf_dir, "documents"), forest, dictionary)
    one = F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.array_join(one, ",").alias("spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secrets": op1_secrets, "op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
