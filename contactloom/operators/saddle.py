"""Saddles: observed over expected by classes of an eigenvector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .pixels import sides
from .scaling import observed_over_expected


def quintiles(track: DataFrame, bins: DataFrame, classes: int = 5) -> DataFrame:
    """bin, chrom, q: the class (from 0) that a bin's value lies strictly within, per chromosome
    with more than ``classes`` bins."""
    own = track.join(bins.select("bin", "chrom"), "bin")
    edges = own.groupBy("chrom").agg(F.percentile("value", F.array(*[F.lit(k / classes) for k in range(classes + 1)])).alias("e"), F.count("*").alias("n")).filter(F.col("n") > classes)
    placed = own.join(F.broadcast(edges), "chrom")
    q = F.coalesce(*[F.when((F.col("value") > F.col("e")[k]) & (F.col("value") < F.col("e")[k + 1]), k) for k in range(classes)])
    return placed.withColumn("q", q.cast("int")).filter("q IS NOT NULL").select("bin", "chrom", "q")


def _class_cells(pixels: DataFrame, bins: DataFrame, track: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """Cells (chrom, q1, q2, value) of both triangles by their bins' classes, and (chrom, q1, q2, n1, n2),
    how many bins pairs of classes have.  Cis pixels are read several times, so they're written first."""
    own = pixels.filter("chrom1 = chrom2").select("bin1", "bin2", "chrom1", "chrom2", "value")
    ooe = observed_over_expected(Workspace(pixels.sparkSession, "saddle").write(own, "pixels"), bins)
    valid = sides(ooe).select("bin").distinct()
    placed = quintiles(track.join(valid, "bin", "left_semi"), bins, classes)
    sizes = placed.groupBy("chrom", "q").agg(F.count("*").alias("n"))
    p = [placed.select(F.col("bin").alias("_b" + s), F.col("q").alias("q" + s)) for s in "12"]
    hit = ooe.join(p[0], F.col("bin1") == F.col("_b1")).join(p[1], F.col("bin2") == F.col("_b2"))
    both = hit.select("chrom", "q1", "q2", "value").unionByName(hit.filter("bin1 <> bin2").select("chrom", F.col("q2").alias("q1"), F.col("q1").alias("q2"), "value"))
    grid = sizes.select("chrom", F.col("q").alias("q1"), F.col("n").alias("n1")).join(sizes.select("chrom", F.col("q").alias("q2"), F.col("n").alias("n2")), "chrom")
    return both, grid


def saddle(pixels: DataFrame, bins: DataFrame, track: DataFrame, classes: int = 5) -> DataFrame:
    """q1, q2 and value: per chromosome the mean cell between two classes, summed over chromosomes.
    Bins without cis reads don't count; cells without reads do."""
    both, grid = _class_cells(pixels, bins, track, classes)
    sums = both.groupBy("chrom", "q1", "q2").agg(F.sum("value").alias("total"))
    means = grid.join(sums, ["chrom", "q1", "q2"], "left").withColumn("mean", F.coalesce("total", F.lit(0.0)) / (F.col("n1") * F.col("n2")))
    return means.groupBy("q1", "q2").agg(F.sum("mean").alias("value"))


def strength(saddle_: DataFrame, classes: int = 5) -> DataFrame:
    """ln(s00 * s44 / s04 ** 2)."""
    z = classes - 1
    at = lambda a, b: F.max(F.when((F.col("q1") == a) & (F.col("q2") == b), F.col("value")))
    return saddle_.agg(F.log(at(0, 0) * at(z, z) / F.pow(at(0, z), 2)).alias("strength"))


def bootstrap(pixels: DataFrame, bins: DataFrame, track: DataFrame, times: int = 100, seed: int = 8, classes: int = 5) -> DataFrame:
    """k, q1, q2, value of ``times`` saddles whose cells are drawn with replacement.

    The cells of a (chromosome, class, class) are first counted by value, so a task draws from a
    table of distinct values, and empty cells are one of them.
    """
    both, grid = _class_cells(pixels, bins, track, classes)
    values = both.groupBy("chrom", "q1", "q2", "value").agg(F.count("*").alias("m"))
    own = values.join(grid, ["chrom", "q1", "q2"])

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("value")
        cells = int(rows["n1"].iloc[0] * rows["n2"].iloc[0])
        m = rows["m"].to_numpy()
        share = np.append(m, cells - m.sum()) / cells
        rng = np.random.default_rng([seed, *map(int, key)])
        got = rng.multinomial(cells, share / share.sum(), size=times)[:, :-1] @ rows["value"].to_numpy() / cells
        return pd.DataFrame({"k": np.arange(times, dtype=np.int32), "q1": key[1], "q2": key[2], "mean": got})

    drawn = own.groupBy("chrom", "q1", "q2").applyInPandas(draw, "k int, q1 int, q2 int, mean double")
    return drawn.groupBy("k", "q1", "q2").agg(F.sum("mean").alias("value"))


def strength_spread(boots: DataFrame, classes: int = 5) -> DataFrame:
    """Standard deviation of the strengths of bootstrap saddles."""
    z = classes - 1
    at = lambda a, b: F.max(F.when((F.col("q1") == a) & (F.col("q2") == b), F.col("value")))
    each = boots.groupBy("k").agg(F.log(at(0, 0) * at(z, z) / F.pow(at(0, z), 2)).alias("s"))
    return each.agg(F.stddev_pop("s").alias("spread"), F.count("*").alias("n"))
