"""Contact maps on disk: whole, by chromosome, tiled, and in the column layout of bins and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..genome import Genome, small


def write_heatmap(pixels: DataFrame, bins: DataFrame, path: str, resolution: int) -> None:
    pixels.write.mode("overwrite").parquet(f"{path}/pixels")
    bins.withColumn("resolution", F.lit(resolution)).write.mode("overwrite").parquet(f"{path}/bins")


def read_heatmap(spark: SparkSession, path: str, resolution: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pixels, bins); raises if the map has another resolution."""
    bins = spark.read.parquet(f"{path}/bins")
    if resolution is not None and bins.filter(F.col("resolution") != resolution).limit(1).count():
        raise ValueError(f"the map at {path} isn't of resolution {resolution}")
    return spark.read.parquet(f"{path}/pixels"), bins.drop("resolution")


def write_by_chromosome(blocks: DataFrame, path: str, trans: bool = True) -> None:
    """Blocks (chrom1, chrom2, pos1, pos2, value) in a folder for each pair, so that a reader of some
    pairs opens only those."""
    own = blocks if trans else blocks.filter("chrom1 = chrom2")
    # the hash over positions spreads a large pair over tasks; each task writes few folders
    own.repartition("chrom1", "chrom2", F.expr("pos1 div 4096")).write.mode("overwrite").partitionBy("chrom1", "chrom2").parquet(path)


def read_by_chromosome(spark: SparkSession, path: str, cis_only: bool = False) -> DataFrame:
    own = spark.read.parquet(path)
    return own.filter("chrom1 = chrom2") if cis_only else own


def whole_from_blocks(blocks: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Global pixels from by-chromosome blocks; blocks with chrom1 > chrom2 are turned around."""
    out = blocks
    for s in "12":
        off = genome.bin_offsets(resolution).select(F.col("chrom").alias("_c"), F.col("first_bin").alias("_o"))
        out = out.join(small(off, genome.n_chromosomes), F.col("chrom" + s) == F.col("_c")).withColumn("b" + s, F.col("_o") + F.col("pos" + s)).drop("_c", "_o")
    return out.groupBy(F.least("b1", "b2").alias("bin1"), F.greatest("b1", "b2").alias("bin2")).agg(F.sum("value").alias("value"))


def check_cis(blocks: DataFrame, n_chromosomes: int) -> None:
    found = blocks.filter("chrom1 = chrom2").select("chrom1").distinct().count()
    if found < n_chromosomes:
        raise ValueError(f"{n_chromosomes - found} chromosomes have no cis block")


def write_tiles(tiles: DataFrame, path: str) -> None:
    tiles.repartition("chrom", "tile_start").write.mode("overwrite").partitionBy("chrom").parquet(path)


def pixel_layout(pixels: DataFrame, bins: DataFrame, genome: Genome) -> tuple[DataFrame, DataFrame]:
    """(bins: chrom, start, end; pixels: bin1_id, bin2_id, count), named as common pixel stores do."""
    labels = genome.chromosomes.select(F.col("chrom"), F.col("label"))
    b = bins.join(small(labels, genome.n_chromosomes), "chrom").select(F.col("bin").alias("bin_id"), F.col("label").alias("chrom"), "start", "end")
    return b, pixels.select(F.col("bin1").alias("bin1_id"), F.col("bin2").alias("bin2_id"), F.col("value").alias("count"))


def read_pixel_layout(spark: SparkSession, path: str, genome: Genome, balanced: bool = False) -> DataFrame:
    """Pixels from such a store; with ``balanced``, times both bins' weights, 0 if not finite."""
    from ..operators.pixels import balanced_values

    bins = spark.read.parquet(f"{path}/bins")
    unknown = bins.select("chrom").distinct().join(genome.chromosomes.select(F.col("label").alias("chrom")), "chrom", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("the store has chromosomes that the genome lacks")
    own = spark.read.parquet(f"{path}/pixels").select(F.col("bin1_id").alias("bin1"), F.col("bin2_id").alias("bin2"), F.col("count").alias("value"))
    return balanced_values(own, bins.select(F.col("bin_id").alias("bin"), "weight"), bins.count()) if balanced else own


def write_text(pixels: DataFrame, path: str) -> None:
    """Tab-separated, gzipped."""
    pixels.write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip")


def export(pixels: DataFrame, path: str, kind: str = "all") -> None:
    """A corrected map: all pixels, or cis ones only."""
    (pixels if kind == "all" else pixels.filter("chrom1 = chrom2")).write.mode("overwrite").parquet(path)
