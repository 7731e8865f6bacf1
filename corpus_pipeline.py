"""A corpus from raw documents to packed sequences.

Each stage takes what the stage before it kept and returns documents (the last one pieces of
packed sequences); ``run`` writes each stage's result as Parquet and reads it again.  An empty
table gives an empty result at every stage, texts of any length are read whole, and other
columns travel along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from contactloom.llm import exact_dedup, mixing, packing, shingles, toxicity
from contactloom.llm.common import Workspace, short_batches, shrink_heaps, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows of an Arrow batch at most.  Executors keep some of what the stages before have left in memory, so
#: the pipeline sends fewer rows at a time than an operator alone.
BATCH_ROWS = 250


def lean(stage: Stage) -> Stage:
    """``stage``, begun with short Arrow batches and with heaps that the stages before don't fill, whoever
    calls it."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark, BATCH_ROWS)
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begun


@lean
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.  Null and empty texts, which have no features,
    stay unless most labelled documents are toxic; repeated rows are judged alike; null ids count."""
    return toxicity.keep_clean(docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


@lean
def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays, null ids coming last; a null text
    equals an empty one, and of rows that repeat doc_id and text one stays."""
    return exact_dedup.keep_first(spark, docs)


@lean
def simhash_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that share 0.8 or more of their five-word shingles with one of a smaller doc_id.
    SimHash fingerprints of these shingles, linked by pivot tables, give the first pairs, and the
    shingles decide on them.  Fingerprints within a few bits miss most such pairs, so for what is left
    undecided the shingles themselves are joined.  Null ids come last; of texts without words one stays."""
    return shingles.keep_first(spark, docs, width=5, threshold=0.8)


@lean
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.  A null source is a source; texts without
    words follow their source's whole passes; repeated rows are taken one by one."""
    return mixing.mixed_rows(spark, docs)


@lean
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences.  Null and empty texts are their end id alone; rows
    with one doc_id are documents of their own."""
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_filter),
    ("simhash_dedup", simhash_filter),
    ("mixing", mixture),
    ("packing", packed),
]

#: A fitted classifier, fingerprints and packing aren't for SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has read is removed once its result is written."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.write(stage(spark, docs, sf_dir), name)
        space.keep_only(name)
    return docs
