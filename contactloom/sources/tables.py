"""Small tables: manifests, catalogs, intervals, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Enzymes that names are searched for, in this order.
ENZYMES = ("HindIII", "NcoI", "BglII", "MboI", "DpnII")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, experiment, replica, genome, enzyme of a table separated by white space; # comments."""
    return manifest_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def manifest_lines(lines: DataFrame) -> DataFrame:
    f = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    return lines.select(f.alias("f")).filter(F.size("f") == 5).select(*[F.col("f")[i].alias(c) for i, c in enumerate(("file", "experiment", "replica", "genome", "enzyme"))])


def manifest_groups(rows: DataFrame) -> DataFrame:
    """Files and replicas of each experiment, genome and enzyme."""
    return rows.groupBy("experiment", "genome", "enzyme").agg(F.count("*").alias("files"), F.countDistinct("replica").alias("replicas"))


def resolution_of(name: str):
    """Base pairs from the last ``-<digits>k`` or ``-<digits>M`` of a name, null without one."""
    found = F.try_element_at(F.regexp_extract_all(name, F.lit(r"-(\d{1,5}[kM])"), F.lit(1)), F.lit(-1))
    n = F.regexp_extract(found, r"(\d+)", 1).cast("long")
    return F.when(F.endswith(found, F.lit("k")), n * 1000).when(F.endswith(found, F.lit("M")), n * 1_000_000)


def enzyme_of(name: str):
    return F.coalesce(*[F.when(F.contains(F.col(name), F.lit(e)), F.lit(e)) for e in ENZYMES])


def classify(files: DataFrame) -> DataFrame:
    """Adds kind and resolution to files (name, keys: what a file holds)."""
    has = lambda k: F.array_contains("keys", k)
    tile = F.exists("keys", lambda k: F.size(F.split(k, "_")) == 3)
    kind = F.when(has("chrms1"), "fragments").when(has("heatmap"), "heatmap").when(has("0 0") & has("0 1"), "byChr").when(has("0 0"), "byChrCis").when(tile, "byChrSuper")
    return files.withColumn("kind", kind).withColumn("resolution", resolution_of("name"))


def is_replica(base: str):
    return F.size(F.regexp_extract_all(base, F.lit(r"(-R\d)"), F.lit(1))) == 1


def with_masters(experiments: DataFrame) -> DataFrame:
    """Adds replica and master to experiments (base): a replica is a master unless the combined
    experiment of its name is there."""
    combined = F.regexp_replace("base", r"-R\d.*-", "-all-")
    own = experiments.withColumn("replica", is_replica("base")).withColumn("_combined", combined)
    bases = experiments.select(F.col("base").alias("_base")).distinct()
    own = own.join(bases, F.col("_combined") == F.col("_base"), "left")
    named_all = F.size(F.regexp_extract_all("base", F.lit("(-all)"), F.lit(1))) == 1
    return own.withColumn("master", ~F.col("replica") | named_all | F.col("_base").isNull()).drop("_combined", "_base")


def least_resolution(files: DataFrame) -> DataFrame:
    return files.filter(F.col("kind").isin("heatmap", "byChr", "byChrCis", "byChrSuper")).groupBy("experiment").agg(F.min("resolution").alias("resolution"))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """name, length and modified of files under a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.substring_index("path", "/", -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def intervals(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """chrom, start, end of a tab-separated table of loops (two anchors, taken at their middles) or
    of domains (three columns)."""
    rows = spark.read.csv(path, sep="\t", header=header)
    return interval_columns(rows)


def interval_columns(rows: DataFrame) -> DataFrame:
    c = rows.columns
    if len(c) >= 6:
        middle = lambda a, b: F.expr(f"cast((cast(`{a}` as bigint) + cast(`{b}` as bigint)) div 2 as bigint)")
        return rows.select(F.col(c[0]).alias("chrom"), middle(c[1], c[2]).alias("start"), middle(c[4], c[5]).alias("end"))
    return rows.select(F.col(c[0]).alias("chrom"), F.col(c[1]).cast("long").alias("start"), F.col(c[2]).cast("long").alias("end"))


def centromeres(rows: DataFrame) -> DataFrame:
    """chrom, start, end from features (name, start, end): the extent of all named CEN<number>."""
    n = F.regexp_extract("name", r"^CEN(\d+)", 1)
    return rows.filter(n != "").groupBy(n.cast("int").alias("chrom")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def wiggle(spark: SparkSession, path: str) -> DataFrame:
    """chrom (label), pos, value of fixed- or variable-step wiggle text, or of four-column intervals.

    A declaration holds for the lines after it, so a file is read by one task, in order.
    """
    import pandas as pd

    def scan(batches):
        for files in batches:
            for raw in files["content"]:
                chrom, at, step, kind, out = "", 0, 1, "", []
                for line in bytes(raw).decode().splitlines():
                    f = line.split()
                    if not f or f[0] in ("track", "browser") or line[0] == "#":
                        continue
                    if f[0] in ("fixedStep", "variableStep"):
                        named = dict(x.split("=", 1) for x in f[1:])
                        kind, chrom, at, step = f[0], named["chrom"], int(named.get("start", 0)), int(named.get("step", 1))
                    elif len(f) == 4:
                        out.append((f[0], int(f[1]), float(f[3])))
                    elif kind == "fixedStep":
                        out.append((chrom, at - 1, float(f[0])))
                        at += step
                    else:
                        out.append((chrom, int(f[0]) - 1, float(f[1])))
                yield pd.DataFrame(out, columns=["chrom", "pos", "value"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(scan, "chrom string, pos long, value double")


def eigenvector_text(lines: DataFrame) -> DataFrame:
    """bin, value from text with one value per line after its number (n, value)."""
    f = F.split(F.trim("line"), r"\s+")
    return lines.select(f[0].cast("int").alias("bin"), f[1].cast("double").alias("value")).filter("bin IS NOT NULL AND value IS NOT NULL")


def sample_statistics(counters: DataFrame, sheet: DataFrame) -> DataFrame:
    """A row per sample (dataset, key, value) with ratios, beside its sheet (dataset, ...)."""
    keys = ["100_TotalReads", "200_totalDSReads", "300_ValidPairs", "401_cisReads", "402_transReads"]
    wide = counters.groupBy("dataset").pivot("key", keys).agg(F.sum("value"))
    ratio = lambda a, b: F.col(a) / F.col(b)
    out = wide.withColumns(
        {
            "ds_share": ratio("200_totalDSReads", "100_TotalReads"),
            "valid_share": ratio("300_ValidPairs", "200_totalDSReads"),
            "cis_to_trans": ratio("401_cisReads", "402_transReads"),
        }
    )
    return out.join(sheet, "dataset", "left")


def write_statistics(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)
