"""Exact deduplication with stateful streaming.

Every document becomes an arrival: the SHA-256 digest of its normalised text, its identifier and
the number of its row, which stays for good because arrivals are written once.  Digest and
identifier locate the content.  A streaming
query reads the arrivals and keeps, for each digest, state without expiry in a disk-backed
(RocksDB) store: the smallest identifier with its row, and the number of rows.  Spark combines
the rows of a digest within each task before they are shuffled to the state, so a digest that
holds a third of all rows sends one row per task.  Later arrivals join the same state.

A hit is a row whose digest another row has.  Hits have their full normalised texts compared with
that of the row that stays.  Should a digest ever be shared by different texts, its rows are
grouped again by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Workspace, free_name, text_or_empty

#: State on disk; many small stores shouldn't each reserve megabytes for logs.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Runs of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def sha256(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


class DigestState:
    """The stream's keyed state: digest -> smallest identifier, its row, number of rows.

    ``add`` writes arrivals (digest, first) beside those there are; ``advance`` takes what has been
    added since the last call.  The checkpoint under the workspace makes it continue where an ended
    or lost run stopped, and state has no expiry: a copy is known however late it comes.
    """

    def add(self, arrivals: DataFrame) -> None:
        arrivals.write.mode("append").parquet(self.arrivals)

    def __init__(self, space: Workspace, arrivals: str, schema, files_per_batch: int = 10_000):
        self.space, self.arrivals, self.schema, self.files = space, arrivals, schema, files_per_batch

    def advance(self) -> None:
        spark = self.space.spark
        updates = self.space.path("updates")

        def store(batch: DataFrame, number: int) -> None:
            # a batch that is run again writes the same folder again
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        before = {name: spark.conf.get(name, None) for name in STORE}
        for name, value in STORE.items():
            spark.conf.set(name, value)
        try:
            (
                spark.readStream.schema(self.schema)
                .option("maxFilesPerTrigger", self.files)
                .parquet(self.arrivals)
                .groupBy("digest")
                .agg(F.min("first").alias("first"), F.count("*").alias("n"))
                .writeStream.outputMode("update")
                .foreachBatch(store)
                .option("checkpointLocation", self.space.path("stream"))
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)

    def groups(self) -> DataFrame:
        """Per digest the state's latest values; both only ever move one way."""
        return (
            self.space.spark.read.parquet(self.space.path("updates"))
            .groupBy("digest")
            .agg(F.min("first").alias("first"), F.max("n").alias("n"))
        )


def dedup(
    spark: SparkSession,
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``): doc_id, keep_id, group_size, kept, digest.

    Null texts count as empty; equal texts form one group whatever their length.  The row with the
    smallest doc_id stays; null ids come after all others.  If a doc_id repeats with one text, one
    of its rows stays, the others are copies.  An empty table gives an empty result.  Other
    columns, of any name, are not read.
    """
    space = Workspace(spark, "exact-dedup")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    arrivals = space.write(
        slim.select("doc_id", digest(normalised(F.col("text"))).alias("digest"))
        .withColumn("locator", F.monotonically_increasing_id())
        .select("digest", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator").alias("first")),
        "arrivals",
    )
    state = DigestState(space, space.path("arrivals"), arrivals.schema, files_per_batch)
    state.advance()
    groups = state.groups() if _has_rows(space, "updates") else arrivals.groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    # written first: a join of two tables can split a digest that most rows have
    groups = space.write(groups, "groups")
    members = space.write(
        arrivals.withColumnRenamed("first", "own")
        .join(groups, "digest")
        .select(
            F.col("own.doc_id").alias("doc_id"),
            F.col("first.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("own.locator") == F.col("first.locator")).alias("kept"),
            "digest",
        ),
        "members",
    )
    space.drop("stream", "updates", "arrivals", "groups")
    different = _differing(space, slim, members, digest)
    if different is None:
        return members
    # texts that share a digest: group them by the texts, once more with one row each that stays
    shared = different.select("digest").distinct()
    rows = (
        slim.withColumn("normal", normalised(F.col("text")))
        .withColumn("digest", digest(F.col("normal")))
        .join(shared, "digest", "left_semi")
        .select("doc_id", "digest", "normal", F.monotonically_increasing_id().alias("locator"))
    )
    rows = space.write(rows, "shared").withColumn("own", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator"))
    by_text = rows.groupBy("normal").agg(F.min("own").alias("first"), F.count("*").alias("group_size"))
    again = rows.join(by_text, "normal").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("own.locator") == F.col("first.locator")).alias("kept"),
        "digest",
    )
    return members.join(shared, "digest", "left_anti").select(again.columns).unionByName(again)


def _has_rows(space: Workspace, name: str) -> bool:
    jvm = space.spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(space.path(name))
    return path.getFileSystem(space.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _differing(space: Workspace, slim: DataFrame, members: DataFrame, digest) -> DataFrame | None:
    """Digests of hits whose full text isn't that of the row that stays; None if there are none.

    Identifier and digest locate a hit's content.  Each such pair is listed once, so rows that share
    an identifier, or have none, don't multiply.
    """
    hits = members.filter("group_size > 1").groupBy(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit")).agg(F.max("kept").alias("kept"))
    normal = slim.withColumn("normal", normalised(F.col("text"))).withColumn("digest", digest(F.col("normal")))
    texts = space.write(
        normal.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit"))).select("digest", "kept", "normal"),
        "hits",
    )
    # a table of its own, so that the join below may split a digest that most rows have
    staying = space.write(texts.filter("kept").groupBy("digest").agg(F.min("normal").alias("stays")), "staying")
    found = space.write(
        texts.join(staying, "digest").filter(F.col("normal") != F.col("stays")).select("digest"), "different"
    )
    space.drop("hits", "staying")
    return None if found.isEmpty() else found


def keep_first(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Of rows that share doc_id and
    normalised text, the one whose columns have the smallest hash stays."""
    hold = options.get("digest", sha256)
    kept = dedup(spark, docs, **options).filter("kept")
    own, other, mark, place = (free_name(docs, n) for n in ("_digest", "_kept_id", "_text_digest", "_place"))
    kept = kept.select(F.col("doc_id").alias(other), F.col("digest").alias(own)).distinct()
    rows = docs.withColumn(mark, hold(normalised(text_or_empty())))
    out = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.col(mark) == F.col(own)))
    w = Window.partitionBy(other, mark).orderBy(F.xxhash64(*[F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in docs.dtypes]))
    return out.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).select(docs.columns)
