"""Pile-ups of map windows around loops and domains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..genome import Genome, small
from .pixels import full


def loop_windows(loops: DataFrame, genome: Genome, resolution: int, pad: int, least_bins: int = 10) -> DataFrame:
    """chrom, s and e (bins of both anchors) and m, how often they occur, of loops (chrom, start, end)
    at least ``least_bins`` bins long whose windows stay on the chromosome."""
    n = genome.chromosomes.select("chrom", F.expr(f"cast((len - 1) div {resolution} + 1 as int)").alias("n"))
    own = loops.join(small(n, genome.n_chromosomes), "chrom").filter(F.abs(F.col("start") - F.col("end")) >= least_bins * resolution)
    own = own.select("chrom", "n", F.expr(f"cast(start div {resolution} as int)").alias("s"), F.expr(f"cast(end div {resolution} as int)").alias("e"))
    return own.filter((F.col("s") - pad >= 0) & (F.col("e") + pad <= F.col("n"))).groupBy("chrom", "s", "e").agg(F.count("*").alias("m"))


def loop_pileup(blocks: DataFrame, windows: DataFrame, pad: int) -> DataFrame:
    """x, y (0 .. 2 * pad - 1) and the sum of cells at that place of all windows.

    ``blocks`` are cis maps (chrom, pos1 <= pos2, value).  Windows are listed by row (their rows
    are 2 * pad), which turns the interval join into an equi-join; columns are a filter.
    """
    both = full(blocks.select("chrom", "pos1", "pos2", "value"), "pos1", "pos2")
    rows = windows.select("chrom", "s", "e", "m", F.explode(F.sequence(F.lit(0), F.lit(2 * pad - 1))).alias("x"))
    rows = rows.withColumn("pos1", F.col("s") - pad + F.col("x"))
    hit = rows.join(both, ["chrom", "pos1"]).filter(f"pos2 >= e - {pad} AND pos2 < e + {pad}")
    return hit.groupBy("x", (F.col("pos2") - F.col("e") + pad).alias("y")).agg(F.sum(F.col("value") * F.col("m")).alias("value"))


def coverage_pileup(coverage: DataFrame, windows: DataFrame, pad: int) -> DataFrame:
    """k, cov1 and cov2: summed coverage (chrom, pos, n) at place k of both anchors' windows."""
    own = windows.select("chrom", "m", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("s").alias("b")), F.struct(F.lit(2).alias("side"), F.col("e").alias("b")))).alias("a"))
    own = own.select("chrom", "m", "a.side", "a.b", F.explode(F.sequence(F.lit(0), F.lit(2 * pad - 1))).alias("k")).withColumn("pos", F.col("b") - pad + F.col("k"))
    got = own.join(coverage, ["chrom", "pos"], "left").withColumn("c", F.coalesce("n", F.lit(0)) * F.col("m"))
    return got.groupBy("k").agg(F.sum(F.when(F.col("side") == 1, F.col("c")).otherwise(0)).alias("cov1"), F.sum(F.when(F.col("side") == 2, F.col("c")).otherwise(0)).alias("cov2"))


def normalised_pileup(pile: DataFrame, cov: DataFrame) -> DataFrame:
    """A pile-up over its coverage product + 1, that scaled to mean 1.  Windows are small tables."""
    one = cov.select(F.col("k").alias("x"), F.col("cov1"))
    two = cov.select(F.col("k").alias("y"), F.col("cov2"))
    # as doubles: the product of two sums of counts may be more than a long holds
    grid = one.join(F.broadcast(two)).withColumn("c", F.col("cov1").cast("double") * F.col("cov2").cast("double") + 1.0)
    mean = grid.agg(F.avg("c").alias("mean"))
    out = grid.join(F.broadcast(mean)).join(pile, ["x", "y"], "left")
    return out.select("x", "y", (F.coalesce("value", F.lit(0)) / (F.col("c") / F.col("mean"))).alias("value"))


def shifted(loops: DataFrame, times: int = 20, step: int = 100_000, seed: int = 4) -> DataFrame:
    """Control loops: each one moved ``times`` times, to alternating sides and ever farther, by
    amounts that follow from the seed."""
    own = loops.select("chrom", "start", "end", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("k"))
    jump = F.lit(step) + (F.col("k") * 7919 + seed * 104_729) % step
    by = F.when(F.col("k") % 2 == 0, 1).otherwise(-1) * F.col("k") * jump
    return own.select("chrom", (F.col("start") + by).alias("start"), (F.col("end") + by).alias("end"), "k")


def loop_strength(loops_pile: DataFrame, control_pile: DataFrame, times: int, middle: int, radius: int = 1) -> DataFrame:
    """Mean of a pile-up's middle over that of its controls, ``times`` as many."""
    near = f"abs(x - {middle}) <= {radius} AND abs(y - {middle}) <= {radius}"
    a = loops_pile.filter(near).agg(F.sum("value").alias("a"))
    b = control_pile.filter(near).agg(F.sum("value").alias("b"))
    return a.join(F.broadcast(b)).select((F.col("a") * times / F.col("b")).alias("strength"))


def domain_pileup(blocks: DataFrame, domains: DataFrame, resolution: int, size: int = 20, least: int = 100_000, most: int = 1_000_000) -> DataFrame:
    """x, y of a 3 * size square, the summed windows of three times a domain's length around
    domains, each rescaled by area so that its sum stays."""
    own = domains.filter((F.col("end") - F.col("start")).between(least, most)).select("chrom", F.expr(f"cast(start div {resolution} as int)").alias("s"), F.expr(f"cast(end div {resolution} as int)").alias("e"))
    own = own.filter("e > s").groupBy("chrom", "s", "e").agg(F.count("*").alias("m")).withColumn("a", 2 * F.col("s") - F.col("e")).withColumn("z", 2 * F.col("e") - F.col("s"))
    both = full(blocks.select("chrom", "pos1", "pos2", "value"), "pos1", "pos2")
    rows = own.filter("a >= 0").select("*", F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("pos1"))
    hit = rows.join(both, ["chrom", "pos1"]).filter("pos2 >= a AND pos2 < z")
    hit = hit.select((F.col("z") - F.col("a")).alias("n"), (F.col("pos1") - F.col("a")).alias("i"), (F.col("pos2") - F.col("a")).alias("j"), (F.col("value") * F.col("m")).alias("value"))
    hit = hit.groupBy("n", "i", "j").agg(F.sum("value").alias("value"))
    out = 3 * size

    def share(k: str):
        lo, hi = F.col(k) * out / F.col("n"), (F.col(k) + 1) * out / F.col("n")
        cells = F.sequence(F.floor(lo).cast("int"), (F.ceil(hi) - 1).cast("int"))
        return F.explode(F.transform(cells, lambda c: F.struct(c.alias("c"), ((F.least(hi, c + 1.0) - F.greatest(lo, c.cast("double"))) / (hi - lo)).alias("w"))))

    spread = hit.withColumn("x", share("i")).withColumn("y", share("j"))
    return spread.groupBy(F.col("x.c").alias("x"), F.col("y.c").alias("y")).agg(F.sum(F.col("value") * F.col("x.w") * F.col("y.w")).alias("value"))


def near_domains(loops: DataFrame, domains: DataFrame, within: int = 80_000) -> DataFrame:
    """Loops (chrom, start, end) with |start - s| + |end - e| < ``within`` for some domain of their
    chromosome.

    In u = start + end and v = start - end, such a domain lies in the open square of side 2 * within
    around the loop.  That takes in the loop's own cell of a grid of ``within`` wholly, the four cells
    beside it up to a bound on one axis, and those at the corners up to a bound on both.  So the first
    five are told by the extremes of the domains of a cell.  For a corner, each cell keeps the least v
    of the domains before each u (axes turned the corner's way), found by a running minimum: the work
    grows with loops and domains, not with their pairs, and a cell has ``within`` places u at most.
    """
    at = lambda x: F.floor(F.col(x) / within).cast("long")
    turned = lambda df: df.withColumn("u", F.col("start").cast("long") + F.col("end")).withColumn("v", F.col("start").cast("long") - F.col("end")).withColumn("i", at("u")).withColumn("j", at("v"))
    d = turned(domains.select("chrom", "start", "end").distinct()).filter("u IS NOT NULL AND chrom IS NOT NULL")
    own = turned(loops.select("chrom", "start", "end")).filter("u IS NOT NULL AND chrom IS NOT NULL")
    cells = d.groupBy("chrom", "i", "j").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    sides = [(0, 0, "here", F.col("u0")), (-1, 0, "left", F.col("u1")), (1, 0, "right", F.col("u0")), (0, -1, "below", F.col("v1")), (0, 1, "above", F.col("v0"))]
    told = cells.select("chrom", F.explode(F.array(*[F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), *[(x if n == m else F.lit(None).cast("long")).alias(m) for *_, m, _ in sides]) for di, dj, n, x in sides])).alias("t"))
    told = told.groupBy("chrom", "t.i", "t.j").agg(*[F.max(f"t.{n}").alias(n) for *_, n, _ in sides])
    told = told.select(F.col("chrom").alias("_c"), F.col("i").alias("_i"), F.col("j").alias("_j"), *[n for *_, n, _ in sides])
    found = F.expr(f"here IS NOT NULL OR left > u - {within} OR right < u + {within} OR below > v - {within} OR above < v + {within}")
    own = own.join(told, F.expr("chrom = _c AND i = _i AND j = _j"), "left").withColumn("found", F.coalesce(found, F.lit(False))).select("chrom", "start", "end", "u", "v", "found")
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 1) for b in (-1, 1)]))
    place = [F.col("a") * F.col("u"), F.col("b") * F.col("v")]
    keys = ["chrom", "i", "j", "a", "b"]
    steps = d.select("chrom", "i", "j", "u", "v", corners.alias("t")).select("chrom", "i", "j", "t.*", "u", "v").select(*keys, place[0].alias("p"), place[1].alias("q"), F.lit(False).alias("asked"))
    asks = own.filter("NOT found").select("chrom", "start", "end", "u", "v").distinct().select("*", corners.alias("t")).select("chrom", "start", "end", "t.*", "u", "v")
    asks = asks.withColumns({"u": F.col("u") + F.col("a") * within, "v": F.col("v") + F.col("b") * within}).withColumns({"i": at("u"), "j": at("v")})
    asks = asks.select(*keys, place[0].alias("p"), place[1].alias("q"), "start", "end")
    both = steps.unionByName(asks.select(*keys, "p", F.lit(None).cast("long").alias("q"), F.lit(True).alias("asked")))
    both = both.groupBy(*keys, "p").agg(F.min("q").alias("q"), F.max("asked").alias("asked"))
    least = F.min("q").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    best = both.withColumn("least", least).filter("asked AND least IS NOT NULL").select(*keys, "p", "least")
    cornered = asks.join(best, [*keys, "p"]).filter("least < q").select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")).distinct().withColumn("_near", F.lit(True))
    own = own.join(cornered, F.expr("NOT found AND chrom = _c AND start = _s AND end = _e"), "left")
    return own.filter("found OR _near").select("chrom", "start", "end")


def reads_in_intervals(contacts: DataFrame, intervals: DataFrame, width: int = 10_000) -> DataFrame:
    """Number of cuts in each interval (chrom, start, end), bounds start < cut <= end, without those
    that have none.  One that is listed several times counts its cuts as often.

    Cuts and bounds are first made one row a position, so a stretch of ``width`` has no more rows than
    that.  The cuts up to a bound are those of the stretches before and of its own up to there, and an
    interval holds the difference of two such numbers: nothing is listed for each cut in an interval.
    """
    cuts = contacts.select(F.explode(F.array(*[F.struct(F.col("chrms" + s).alias("chrom"), F.col("cuts" + s).cast("long").alias("pos")) for s in "12"])).alias("c")).select("c.*")
    cuts = cuts.filter("chrom >= 0 AND pos IS NOT NULL").groupBy("chrom", "pos").agg(F.count("*").alias("k"))
    own = intervals.filter("start < end").groupBy("chrom", "start", "end").agg(F.count("*").alias("m"))
    bounds = own.select("chrom", F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long"))).alias("pos"))
    each = cuts.withColumn("asked", F.lit(False)).unionByName(bounds.select("chrom", "pos", F.lit(0).cast("long").alias("k"), F.lit(True).alias("asked")))
    each = each.groupBy("chrom", "pos").agg(F.sum("k").alias("k"), F.max("asked").alias("asked")).withColumn("stretch", F.floor(F.col("pos") / width))
    before = Window.partitionBy("chrom").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("chrom", "stretch").agg(F.sum("k").alias("s")).select("chrom", "stretch", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("chrom", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = each.withColumn("own", F.sum("k").over(within)).filter("asked").join(sums, ["chrom", "stretch"])
    upto = upto.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), (F.col("before") + F.col("own")).alias("upto"))
    for side in ("start", "end"):
        own = own.join(upto, (F.col("chrom") == F.col("_c")) & (F.col(side) == F.col("_p"))).withColumnRenamed("upto", "_" + side).drop("_c", "_p")
    return own.select("chrom", "start", "end", (F.col("m") * (F.col("_end") - F.col("_start"))).alias("n")).filter("n > 0")


def resampled(blocks: DataFrame, share: float = 1.0, seed: int = 6) -> DataFrame:
    """Blocks (chrom, pos1, pos2, value) with values drawn anew from Poisson distributions of mean
    share * value, seeded by place."""

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # one generator for a stretch of rows, whose cells are drawn in order of their place
        rows = rows.sort_values(["pos1", "pos2"])
        drawn = np.random.default_rng([seed, *map(int, key)]).poisson(share * rows["value"].to_numpy())
        return rows[["chrom", "pos1", "pos2"]].assign(value=drawn)

    own = blocks.select("chrom", "pos1", "pos2", F.col("value").cast("double").alias("value"), F.expr("pos1 div 64").alias("stretch"))
    return own.groupBy("chrom", "stretch").applyInPandas(draw, "chrom int, pos1 int, pos2 int, value long").filter("value > 0")
