"""Contact probability by distance, and observed over expected."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..genome import Genome, small


def log_edges(first: float, last: float, ratio: float) -> list[int]:
    """Whole-number edges from ``first`` to ``last``, each about ``ratio`` times the one before."""
    n = max(1, math.ceil(math.log(last / first) / math.log(ratio)))
    raw = [round(first * (last / first) ** (k / n)) for k in range(n + 1)]
    return sorted(set(raw))


def classes(value: Column, edges: list[int]) -> Column:
    """Index of the half-open class [edge, next edge) that a value is in, null outside; by binary
    search in generated code."""

    def pick(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < edges[mid], pick(lo, mid)).otherwise(pick(mid, hi))

    return F.when((value >= edges[0]) & (value < edges[-1]), pick(0, len(edges) - 1))


DIRECTIONS = {
    "unidir": "strands1 = strands2",
    "convergent": "(mid1 < mid2 AND strands1 AND NOT strands2) OR (mid1 > mid2 AND NOT strands1 AND strands2)",
    "divergent": "(mid1 < mid2 AND NOT strands1 AND strands2) OR (mid1 > mid2 AND strands1 AND NOT strands2)",
}


def observed(contacts: DataFrame, edges: list[int], regions: DataFrame, n_regions: int, exclude_neighbours: int = 1, directions: tuple[str, ...] = ()) -> DataFrame:
    """(class, n): contacts whose fragment middles lie strictly inside one region (chrom, start,
    end), by distance class."""
    own = contacts.filter(f"chrms1 = chrms2 AND chrms1 >= 0 AND abs(rfrag1 - rfrag2) > {exclude_neighbours}")
    if directions:
        own = own.filter(" OR ".join(f"({DIRECTIONS[d]})" for d in directions))
    r = small(regions.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")), n_regions)
    inside = " AND ".join(f"mid{s} > _s AND mid{s} < _e" for s in "12")
    cls = classes(F.abs(F.col("mid1") - F.col("mid2")), edges).alias("class")
    return own.join(r, F.col("chrms1") == F.col("_c")).filter(inside).select(cls).filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n"))


def expected(genome: Genome, edges: list[int], regions: DataFrame, n_regions: int, exclude_neighbours: int = 1) -> DataFrame:
    """(class, n): ordered pairs of fragments of a region by distance, without close neighbours.

    One sorted array of middles per region answers all classes by binary search: n log n work
    instead of all pairs.  A region is at most a chromosome's fragments, so a task holds it.
    """
    r = small(regions.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")), n_regions)
    own = genome.fragments.join(r, F.col("chrom") == F.col("_c")).filter("mid > _s AND mid < _e").select("chrom", F.col("_s").alias("start"), "abs_idx", "mid")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("abs_idx")
        p = np.sort(rows["mid"].to_numpy(np.int64))
        mids = rows["mid"].to_numpy(np.int64)
        n = np.zeros(len(edges) - 1, np.int64)
        for k in range(len(edges) - 1):
            lo, hi = edges[k], edges[k + 1]
            below = np.searchsorted(p, p - lo) - np.searchsorted(p, p - hi)
            above = np.searchsorted(p, p + hi) - np.searchsorted(p, p + lo)
            n[k] = below.sum() + above.sum()
        for step in range(0, exclude_neighbours + 1):  # pairs of neighbours, both ways
            d = np.abs(mids[step:] - mids[: len(mids) - step])
            for k in range(len(edges) - 1):
                near = int(((d > edges[k]) & (d < edges[k + 1])).sum()) * (1 if step == 0 else 2)
                n[k] -= min(near, n[k])
        return pd.DataFrame({"class": np.arange(len(n), dtype=np.int32), "n": n})

    each = own.groupBy("chrom", "start").applyInPandas(count, "class int, n long")
    return each.groupBy("class").agg(F.sum("n").alias("n"))


def curve(seen: DataFrame, pairs: DataFrame, edges: list[int], normalise: bool = True) -> DataFrame:
    """class, low, high and value: observed over expected, with the integral over distance 1."""
    e = F.array(*[F.lit(x) for x in edges])
    own = pairs.withColumnRenamed("n", "expected").join(seen.withColumnRenamed("n", "observed"), "class", "left").filter("expected > 0")
    own = own.select("class", F.element_at(e, F.col("class") + 1).alias("low"), F.element_at(e, F.col("class") + 2).alias("high"), (F.coalesce("observed", F.lit(0)) / F.col("expected")).alias("value"))
    if not normalise:
        return own
    total = own.agg(F.sum((F.col("high") - F.col("low")) * F.col("value")).alias("total")).filter("total > 0")
    return own.join(F.broadcast(total)).withColumn("value", F.col("value") / F.col("total")).drop("total")


def arm_regions(genome: Genome) -> DataFrame:
    """chrom, start, end of chromosome arms, the centromere left out."""
    arms = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("cntr_start").alias("end")), F.struct(F.col("cntr_end").alias("start"), F.col("len").alias("end")))
    return genome.chromosomes.select("chrom", F.explode(arms).alias("a")).select("chrom", "a.start", "a.end")


def by_diagonal(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """(distance in bins, mean cell), empty cells included, over cis cells (chrom1 = chrom2)."""
    n = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    cells = n.select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("d"), "n").groupBy("d").agg(F.sum(F.col("n") - F.col("d")).alias("cells"))
    sums = pixels.filter("chrom1 = chrom2").groupBy((F.col("bin2") - F.col("bin1")).alias("d")).agg(F.sum("value").alias("total"))
    return cells.join(sums, "d", "left").select("d", (F.coalesce("total", F.lit(0)) / F.col("cells")).alias("mean"))


def by_band(pixels: DataFrame, bins: DataFrame, ratio: float = 1.17, first: int = 2) -> DataFrame:
    """Mean cell by log-spaced band of distances, within chromosome arms: class, low, high, mean."""
    lens = bins.groupBy("arm").agg(F.count("*").alias("n"))
    longest = int(lens.agg(F.max("n")).first()[0])
    edges = log_edges(first, max(first + 1, longest), ratio)
    arms = [bins.select(F.col("bin").alias("_b" + s), F.col("arm").alias("arm" + s)) for s in "12"]
    own = pixels.join(arms[0], F.col("bin1") == F.col("_b1")).join(arms[1], F.col("bin2") == F.col("_b2")).filter("arm1 = arm2")
    d = F.col("bin2") - F.col("bin1")
    sums = own.select(classes(d, edges).alias("class"), "value").filter("class IS NOT NULL").groupBy("class").agg(F.sum("value").alias("total"))
    cells = lens.select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("d"), "n").select(classes(F.col("d"), edges).alias("class"), (F.col("n") - F.col("d")).alias("c"))
    cells = cells.filter("class IS NOT NULL").groupBy("class").agg(F.sum("c").alias("cells"))
    e = F.array(*[F.lit(x) for x in edges])
    return cells.join(sums, "class", "left").select("class", F.element_at(e, F.col("class") + 1).alias("low"), F.element_at(e, F.col("class") + 2).alias("high"), (F.coalesce("total", F.lit(0)) / F.col("cells")).alias("mean"))


def observed_over_expected(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """Cis pixels over their chromosome's mean cell at that distance: bin1, bin2, chrom, d, value."""
    n = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    own = pixels.filter("chrom1 = chrom2").select("bin1", "bin2", F.col("chrom1").alias("chrom"), (F.col("bin2") - F.col("bin1")).alias("d"), "value")
    sums = own.groupBy("chrom", "d").agg(F.sum("value").alias("total"))
    means = sums.join(F.broadcast(n), "chrom").select("chrom", "d", (F.col("total") / (F.col("n") - F.col("d"))).alias("mean"))
    return own.join(means, ["chrom", "d"]).select("bin1", "bin2", "chrom", "d", (F.col("value") / F.col("mean")).alias("value"))


def renormalised(curve_: DataFrame, nth: int = 4) -> DataFrame:
    """A curve (class, value) over its nth finite point."""
    from pyspark.sql import Window

    ok = curve_.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    one = ok.withColumn("k", F.row_number().over(Window.orderBy("class"))).filter(F.col("k") == nth).select(F.col("value").alias("_at"))
    return curve_.join(F.broadcast(one)).withColumn("value", F.col("value") / F.col("_at")).drop("_at")


def inter_arm_map(pixels: DataFrame, bins: DataFrame, genome: Genome, size: int = 80, least: int = 10) -> DataFrame:
    """Mean trans cell by place on both arms, from centromere (0) to end (size - 1), of arms with
    at least ``least`` bins; arms are rescaled to ``size``."""
    arms = bins.groupBy("arm").agg(F.count("*").alias("n"), F.min("bin").alias("a"), F.max("bin").alias("z")).filter(F.col("n") >= least)
    placed = bins.join(F.broadcast(arms), "arm").select("bin", "chrom", "arm", F.when(F.col("arm") % 2 == 0, F.col("z") - F.col("bin")).otherwise(F.col("bin") - F.col("a")).alias("k"), "n")
    placed = placed.select("bin", "chrom", F.floor((F.col("k") + 0.5) * size / F.col("n")).cast("int").alias("x"))
    per = placed.groupBy("chrom", "x").agg(F.count("*").alias("m"))
    cells = per.select(F.col("chrom").alias("c1"), F.col("x").alias("x"), F.col("m").alias("m1")).join(per.select(F.col("chrom").alias("c2"), F.col("x").alias("y"), F.col("m").alias("m2")), F.col("c1") != F.col("c2"))
    cells = cells.groupBy("x", "y").agg(F.sum(F.col("m1") * F.col("m2")).alias("cells"))
    p = [placed.select(F.col("bin").alias("_b" + s), F.col("chrom").alias("_c" + s), F.col("x").alias("_x" + s)) for s in "12"]
    own = pixels.join(p[0], F.col("bin1") == F.col("_b1")).join(p[1], F.col("bin2") == F.col("_b2")).filter("_c1 <> _c2")
    both = own.select(F.explode(F.array(F.struct(F.col("_x1").alias("x"), F.col("_x2").alias("y")), F.struct(F.col("_x2").alias("x"), F.col("_x1").alias("y")))).alias("p"), "value")
    sums = both.groupBy("p.x", "p.y").agg(F.sum("value").alias("total"))
    return cells.join(sums, ["x", "y"], "left").select("x", "y", (F.coalesce("total", F.lit(0)) / F.col("cells")).alias("mean"))


