"""Contact tables on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTACT = T.StructType(
    [T.StructField(n + s, t) for s in "12" for n, t in (("chrms", T.IntegerType()), ("cuts", T.IntegerType()), ("strands", T.BooleanType()))]
)


def read(spark: SparkSession, path: str, in_memory: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.cache() if in_memory else df


#: Open modes and what writing in them does.
MODES = {"w": "overwrite", "w-": "errorifexists", "x": "errorifexists", "a": "append"}


def write(contacts: DataFrame, path: str, mode: str = "w-", metadata: dict | None = None) -> None:
    """Parquet, with the metadata's counters beside it."""
    contacts.write.mode(MODES[mode]).parquet(path)
    if metadata is not None:
        rows = [(k, int(v)) for k, v in sorted(metadata.items())]
        contacts.sparkSession.createDataFrame(rows, "key string, value long").coalesce(1).write.mode("overwrite").parquet(path.rstrip("/") + ".metadata")


def read_metadata(spark: SparkSession, path: str) -> dict[str, int]:
    return {r["key"]: r["value"] for r in spark.read.parquet(path.rstrip("/") + ".metadata").collect()}


def parse(raw: DataFrame, first_chrom: int = 0, names: dict[str, str] | None = None) -> DataFrame:
    """Mapped pairs as contacts: renamed columns, chromosomes from ``first_chrom`` on, and strands.

    Missing strands follow from a hash of the row, the second side's being the opposite.
    """
    df = raw.withColumnsRenamed(names or {})
    base = lambda s: F.when(F.col("chrms" + s) < first_chrom, -1).otherwise(F.col("chrms" + s) - first_chrom).cast("int")
    if "strands1" not in df.columns:
        coin = F.pmod(F.xxhash64("chrms1", "cuts1", "chrms2", "cuts2"), F.lit(2)) == 0
        df = df.withColumns({"strands1": coin, "strands2": ~coin})
    return df.withColumns({"chrms1": base("1"), "chrms2": base("2"), **{"cuts" + s: F.col("cuts" + s).cast("int") for s in "12"}, **{"strands" + s: F.col("strands" + s).cast("boolean") for s in "12"}})


def merge_metadata(tables: DataFrame) -> DataFrame:
    """Counters of several datasets (dataset, key, value) summed by key."""
    return tables.groupBy("key").agg(F.sum("value").alias("value"))


def metadata_report(metadata: DataFrame) -> DataFrame:
    """Lines in key order, indented by how deep a counter is: once if its second digit isn't 0,
    twice if its third isn't."""
    deep = F.when(F.substring("key", 3, 1) != "0", "\t\t").when(F.substring("key", 2, 1) != "0", "\t").otherwise("")
    return metadata.select("key", F.concat(deep, "key", F.lit(":   "), F.col("value").cast("string")).alias("line")).orderBy("key")


def whole_numbers(metadata: DataFrame) -> DataFrame:
    """Counters as whole numbers; what isn't a number goes."""
    return metadata.select("key", F.expr("try_cast(value AS bigint)").alias("value")).filter("value IS NOT NULL")


def metadata_json(counters: DataFrame) -> str:
    return json.dumps({r["key"]: r["value"] for r in counters.orderBy("key").collect()})
