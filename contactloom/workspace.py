"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where that is unset, a local session gets a temporary
    folder (one machine holds everything) and a cluster its warehouse folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="contactloom-"))
            atexit.register(shutil.rmtree, _local[0], True)
        return "file://" + _local[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


class Workspace:
    """A folder of tables.  Writing one cuts the lineage: what follows reads files that every
    executor sees, so a lost executor costs only its running tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))
