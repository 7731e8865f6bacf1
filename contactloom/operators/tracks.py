"""One value per bin: GC and mapped bases, wiggle tracks, domains, and maps seen along the genome."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import spearman
from ..genome import small
from ..workspace import Workspace
from .pixels import full


def from_signal(signal: DataFrame, offsets: DataFrame, n_chromosomes: int, resolution: int, control: DataFrame | None = None, inner: int = 1000) -> DataFrame:
    """(bin, value): mean over a bin of the log of signal (chrom, pos, value) at an inner resolution,
    divided by a control's where given; empty cells don't count."""

    def cells(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy("chrom", F.expr(f"pos div {inner}").alias("cell")).agg(F.sum("value").alias(name))

    own = cells(signal, "v")
    if control is not None:
        own = own.join(cells(control, "c").filter("c > 0"), ["chrom", "cell"]).withColumn("v", F.col("v") / F.col("c"))
    own = own.filter("v > 0").join(small(offsets, n_chromosomes), "chrom")
    b = (F.col("first_bin") + F.expr(f"cell * {inner} div {resolution}")).cast("int").alias("bin")
    return own.groupBy(b).agg(F.avg(F.log("v")).alias("value"))


def expand_runs(domains: DataFrame) -> DataFrame:
    """Runs (chrom, order, length, name) as one row per unit: chrom, index, name."""
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    own = domains.withColumn("first", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return own.select("chrom", F.explode(F.sequence("first", F.col("first") + F.col("length") - 1)).alias("index"), "name")


def domain_means(track: DataFrame, domains: DataFrame) -> DataFrame:
    """Mean of a track (bin, value) by domain class (bin, name), and the squared correlation of the
    track with its class's mean."""
    own = track.join(domains, "bin")
    means = own.groupBy("name").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    r = own.join(means.select("name", "mean"), "name").agg(F.pow(F.corr("value", "mean"), 2).alias("r2"))
    return means.join(F.broadcast(r))


def with_eigenvector(track: DataFrame, eigenvector: DataFrame) -> DataFrame:
    """Rank correlation of a track with an eigenvector, both (bin, value)."""
    return spearman(track.select("bin", F.col("value").alias("x")).join(eigenvector.select("bin", F.col("value").alias("y")), "bin"), "x", "y")


def eigenvector_correlations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Absolute correlation of each pair of components of two sets (comp, bin, value)."""
    one = a.select(F.col("comp").alias("comp1"), "bin", F.col("value").alias("x"))
    two = b.select(F.col("comp").alias("comp2"), "bin", F.col("value").alias("y"))
    return one.join(two, "bin").groupBy("comp1", "comp2").agg(F.abs(F.corr("x", "y")).alias("r"))


def project(vectors: DataFrame, values: DataFrame, bins: DataFrame, mean: float = 0.0) -> DataFrame:
    """Sum over components of eigenvalue * v(i) * v(j), plus ``mean`` where both are set, for i <= j
    of the bins in ``vectors`` (comp, bin, value).  The result is a dense matrix by nature."""
    own = vectors.join(F.broadcast(values.select("comp", F.col("value").alias("l"))), "comp")
    other = vectors.select("comp", F.col("bin").alias("bin2"), F.col("value").alias("v2"))
    return (
        own.withColumnRenamed("bin", "bin1").join(other, "comp").filter("bin1 <= bin2").groupBy("bin1", "bin2").agg((F.sum(F.col("l") * F.col("value") * F.col("v2")) + mean).alias("value"))
    )


def directionality(pixels: DataFrame, n_bins: int, size: int = 20) -> DataFrame:
    """bin and upstream / (upstream + downstream) on a ring of bins: upstream sums cells (b, b + k)
    for k from 0, downstream (b - k, b) for k from 1, ``size`` cells each."""
    both = full(pixels.select("bin1", "bin2", "value"))
    k = F.pmod(F.col("bin2") - F.col("bin1"), F.lit(n_bins))
    zero, v = F.lit(0.0), F.col("value").cast("double")
    # a cell counts for its row upstream and for its column downstream: both from one pass
    up = F.struct(F.col("bin1").alias("bin"), F.when(k < size, v).otherwise(zero).alias("up"), zero.alias("down"))
    down = F.struct(F.col("bin2").alias("bin"), zero.alias("up"), F.when((k >= 1) & (k <= size), v).otherwise(zero).alias("down"))
    sums = both.filter(k <= size).select(F.explode(F.array(up, down)).alias("c")).select("c.*")
    sums = sums.groupBy("bin").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up + down > 0")
    return sums.select("bin", (F.col("up") / (F.col("up") + F.col("down"))).alias("ratio"))


def diamond(pixels: DataFrame, n_bins: int, size: int = 10) -> DataFrame:
    """bin and the sum of cells (b + i, b - j) with i + j < size, on a ring."""
    both = full(pixels.select("bin1", "bin2", "value"))
    d = F.pmod(F.col("bin1") - F.col("bin2"), F.lit(n_bins))
    # a cell whose sides are d apart lies in the diamonds of the d + 1 bins between them
    own = both.withColumn("d", d).filter(F.col("d") < size)
    own = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d").cast("int"))))
    return own.groupBy(F.pmod(F.col("bin1") - F.col("i"), F.lit(n_bins)).cast("int").alias("bin")).agg(F.sum("value").alias("score"))


def less_gaussian(track: DataFrame, sigma: float, value: str = "score", reach: float = 4.0) -> DataFrame:
    """A track (bin, value, without gaps) minus itself smoothed by a Gaussian, mirrored at its ends.  It is
    read three times, so it's written first."""
    track = Workspace(track.sparkSession, "gaussian").write(track, "track")
    radius = int(reach * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*[F.lit(w / sum(weights)) for w in weights])
    ends = track.agg(F.min("bin").alias("a"), F.max("bin").alias("z"))
    spread = track.join(F.broadcast(ends)).select("a", "z", "bin", F.col(value).alias("v"), F.posexplode(kernel).alias("k", "w"))
    n = F.col("z") - F.col("a") + 1
    target = F.col("bin") + F.col("k") - radius
    # what leaves at an end comes back: place p is mirrored until it's inside
    p = F.pmod(target - F.col("a"), 2 * n)
    inside = F.col("a") + F.when(p < n, p).otherwise(2 * n - 1 - p)
    smooth = spread.groupBy(inside.cast("int").alias("bin")).agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return track.join(smooth, "bin").select("bin", (F.col(value) - F.col("s")).alias(value))


def ring_ready(pixels: DataFrame, n_bins: int) -> DataFrame:
    """A map as directionality takes it: near diagonals out, the top 1e-4 of cells held down,
    balanced, near diagonals filled from the mean of the third, scaled to a mean row sum of 1."""
    from .balance import balance, corrected
    from .pixels import percentile_with_zeros, remove_diagonal, sides

    space = Workspace(pixels.sparkSession, "ring")
    own = space.write(remove_diagonal(pixels, 1), "pixels")
    cut = percentile_with_zeros(own, F.lit(2), n_bins * n_bins, 1 - 1e-4)
    own = own.join(F.broadcast(cut)).select("bin1", "bin2", F.least(F.col("value").cast("double"), F.col("cut")).alias("value"))
    own = space.write(corrected(own, balance(own, n_bins=n_bins), n_bins), "balanced")
    second = own.filter("bin2 - bin1 = 2").agg((F.coalesce(F.sum("value"), F.lit(0.0)) / (n_bins - 2)).alias("second"))
    near = pixels.sparkSession.range(n_bins).select(F.explode(F.array(*[F.struct(F.col("id").cast("int").alias("bin1"), (F.col("id") + k).cast("int").alias("bin2"), F.lit(f).alias("f")) for k, f in ((0, 1.5), (1, 1.2))])).alias("c")).select("c.*")
    near = near.filter(F.col("bin2") < n_bins).join(F.broadcast(second)).select("bin1", "bin2", (F.col("f") * F.col("second")).alias("value"))
    own = own.select("bin1", "bin2", "value").unionByName(near)
    total = sides(own).agg((F.sum("value") / n_bins).alias("mean"))
    return own.join(F.broadcast(total)).select("bin1", "bin2", (F.col("value") / F.col("mean")).alias("value"))
