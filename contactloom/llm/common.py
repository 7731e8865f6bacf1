"""Folders and small helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators see it: a run of these separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a local session gets a
    temporary folder (one machine holds everything) and a cluster its warehouse folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="contactloom-"))
            atexit.register(shutil.rmtree, _local[0], True)
        return "file://" + _local[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


#: Rows of an Arrow batch at most.  Ten thousand, the usual number, are tens of megabytes of text, which
#: executors then hold several times over.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session send at most ``rows`` rows at a time to Python, unless it sends fewer already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def shrink_heaps(spark: SparkSession) -> None:
    """Have executors collect their heaps, which then give the memory they no longer use back to the system;
    left alone, a heap stays as large as the largest operator made it.  A task for each core, all at once,
    reaches every executor that isn't busy."""
    cores = spark.sparkContext.defaultParallelism
    tasks = spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')").alias("done"))
    tasks.write.format("noop").mode("overwrite").save()


class Workspace:
    """A folder of intermediate tables.  Writing one cuts the lineage: what follows reads files
    that every executor sees, so a lost executor costs only its running tasks.  With ``short``, the
    session's Arrow batches are kept short from then on."""

    def __init__(self, spark: SparkSession, name: str, short: bool = True):
        self.spark = spark
        if short:
            short_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def keep_only(self, *names: str) -> None:
        """Remove all tables but those that the result still reads."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.listStatus(root) if files.exists(root) else ():
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def text_or_empty(column="text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
