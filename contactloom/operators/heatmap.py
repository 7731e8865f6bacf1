"""Contact maps from contacts: sparse upper-triangular pixel tables (bin1 <= bin2, value).

A pixel holds how many contacts fall in it, counted once on the diagonal.  ``diagonal="twice"``
doubles the diagonal, as a symmetric dense matrix built from both triangles would have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..genome import Genome, small


def with_bins(contacts: DataFrame, genome: Genome, resolution: int, at: str = "mid") -> DataFrame:
    """b1 and b2, the global bins of both sides, from ``mid`` or ``cuts``."""
    out = contacts.filter("chrms1 >= 0 AND chrms2 >= 0")
    for s in "12":
        off = genome.bin_offsets(resolution).select(F.col("chrom").alias("_c"), F.col("first_bin").alias("_o"))
        out = out.join(small(off, genome.n_chromosomes), F.col("chrms" + s) == F.col("_c"))
        # a middle equal to the chromosome's length would start a bin that isn't there
        out = out.withColumn("b" + s, (F.col("_o") + F.expr(f"{at}{s} div {resolution}")).cast("int")).drop("_c", "_o")
    return out


def _pixels(binned: DataFrame, *keys: str) -> DataFrame:
    a, b = F.least("b1", "b2").alias("bin1"), F.greatest("b1", "b2").alias("bin2")
    return binned.groupBy(*keys, a, b).agg(F.count("*").alias("value"))


def diagonal_twice(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("value", F.when(F.col("bin1") == F.col("bin2"), 2 * F.col("value")).otherwise(F.col("value")))


def all_by_all(contacts: DataFrame, genome: Genome, resolution: int, diagonal: str = "once", keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """The whole map, by fragment middles; ``weight`` sums a column in place of counting."""
    binned = with_bins(contacts, genome, resolution)
    if weight is None:
        out = _pixels(binned, *keys)
    else:
        out = binned.groupBy(*keys, F.least("b1", "b2").alias("bin1"), F.greatest("b1", "b2").alias("bin2")).agg(F.sum(weight).alias("value"))
    return diagonal_twice(out) if diagonal == "twice" else out


def by_fragment(contacts: DataFrame) -> DataFrame:
    """The map whose bins are fragments."""
    own = contacts.filter("rfrag1 >= 0 AND rfrag2 >= 0").select(F.col("rfrag1").alias("b1"), F.col("rfrag2").alias("b2"))
    return _pixels(own)


def by_chromosome(contacts: DataFrame, genome: Genome, resolution: int, trans: bool = True, diagonal: str = "once") -> DataFrame:
    """chrom1 <= chrom2 and bins counted from each chromosome's start; trans blocks aren't symmetric."""
    own = contacts.filter("chrms1 >= 0 AND chrms2 >= 0" + ("" if trans else " AND chrms1 = chrms2"))
    # place by place as (chrom, pos) pairs: least and greatest write each position's code once
    one, two = [F.struct(F.col("chrms" + s).alias("chrom"), F.expr(f"cast(mid{s} div {resolution} as int)").alias("pos")) for s in "12"]
    if trans:
        sides = own.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
        out = sides.groupBy(F.col("a.chrom").alias("chrom1"), F.col("b.chrom").alias("chrom2"), F.col("a.pos").alias("pos1"), F.col("b.pos").alias("pos2")).agg(F.count("*").alias("value"))
    else:
        p = own.select("chrms1", *[F.expr(f"cast(mid{s} div {resolution} as int)").alias("p" + s) for s in "12"])
        out = p.groupBy(F.col("chrms1").alias("chrom1"), F.least("p1", "p2").alias("pos1"), F.greatest("p1", "p2").alias("pos2")).agg(F.count("*").alias("value"))
        out = out.select("chrom1", F.col("chrom1").alias("chrom2"), "pos1", "pos2", "value")
    if diagonal == "twice":
        same = F.expr("chrom1 = chrom2 AND pos1 = pos2")
        out = out.withColumn("value", F.when(same, 2 * F.col("value")).otherwise(F.col("value")))
    return out


def fragment_region(contacts: DataFrame, first: int, last: int) -> DataFrame:
    """Fragment by fragment map of the fragments ``first`` up to (not with) ``last``."""
    inside = " AND ".join(f"rfrag{s} >= {first} AND rfrag{s} < {last}" for s in "12")
    own = contacts.filter(inside).select((F.col("rfrag1") - first).alias("b1"), (F.col("rfrag2") - first).alias("b2"))
    return _pixels(own)


def region(contacts: DataFrame, chrom: int, start: int, end: int, resolution: int) -> DataFrame:
    """A cis region by cuts, bins counted from its start, which is a multiple of the resolution."""
    if start % resolution:
        raise ValueError("a region starts at a multiple of its resolution")
    inside = " AND ".join(f"chrms{s} = {chrom} AND cuts{s} >= {start} AND cuts{s} < {end}" for s in "12")
    own = contacts.filter(inside)
    return _pixels(own.select(*[F.expr(f"cast((cuts{s} - {start}) div {resolution} as int)").alias("b" + s) for s in "12"]))


def _overlaps(s: str, resolution: int, offset: Column) -> Column:
    """Bins that a fragment spans with the share of it in each."""
    lo, hi = F.col("fs" + s) / resolution, F.col("fe" + s) / resolution
    first, last = F.floor(lo).cast("int"), (F.ceil(hi) - 1).cast("int")
    bins = F.sequence(first, F.greatest(first, last))
    share = lambda b: (F.least(hi, b + 1.0) - F.greatest(lo, b.cast("double"))) / (hi - lo)
    return F.transform(bins, lambda b: F.struct((b + offset).alias("b"), share(b).alias("w")))


def overlap(contacts: DataFrame, genome: Genome, resolution: int, longest_span: int = 10) -> DataFrame:
    """The map in which a contact is spread over the bins that its fragments overlap, by exact
    shares, so the map's sum is the number of contacts."""
    own = contacts.filter("chrms1 >= 0 AND chrms2 >= 0")
    for s in "12":
        off = genome.bin_offsets(resolution).select(F.col("chrom").alias("_c"), F.col("first_bin").alias("_o" + s))
        own = own.join(small(off, genome.n_chromosomes), F.col("chrms" + s) == F.col("_c")).drop("_c")
    own = own.filter(" AND ".join(f"(fe{s} - fs{s}) / {resolution} <= {longest_span}" for s in "12"))
    # contacts of one fragment pair spread alike: count them first
    pairs = own.groupBy("fs1", "fe1", "_o1", "fs2", "fe2", "_o2").agg(F.count("*").alias("n"))
    one = pairs.select("n", "fs2", "fe2", "_o2", F.explode(_overlaps("1", resolution, F.col("_o1"))).alias("x"))
    two = one.select("n", "x", F.explode(_overlaps("2", resolution, F.col("_o2"))).alias("y"))
    return two.groupBy(F.least("x.b", "y.b").alias("bin1"), F.greatest("x.b", "y.b").alias("bin2")).agg(F.sum(F.col("n") * F.col("x.w") * F.col("y.w")).alias("value"))


def overlap_region(contacts: DataFrame, chrom: int, start: int, end: int, resolution: int, longest_span: int = 10) -> DataFrame:
    """Cis region with overlaps: contacts whose fragments lie wholly in [start, end)."""
    inside = " AND ".join(f"chrms{s} = {chrom} AND fs{s} >= {start} AND fe{s} <= {end} AND (fe{s} - fs{s}) / {resolution} <= {longest_span}" for s in "12")
    pairs = contacts.filter(inside).groupBy("fs1", "fe1", "fs2", "fe2").agg(F.count("*").alias("n"))
    off = F.lit(-(start // resolution))
    one = pairs.select("n", "fs2", "fe2", F.explode(_overlaps("1", resolution, off)).alias("x"))
    two = one.select("n", "x", F.explode(_overlaps("2", resolution, off)).alias("y"))
    return two.groupBy(F.least("x.b", "y.b").alias("bin1"), F.greatest("x.b", "y.b").alias("bin2")).agg(F.sum(F.col("n") * F.col("x.w") * F.col("y.w")).alias("value"))


def tiles(genome: Genome, size: int, step: int) -> DataFrame:
    """chrom, tile_start, tile_end of overlapping tiles along chromosomes."""
    own = genome.chromosomes.select("chrom", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("len") - 1, F.lit(0).cast("long")), F.lit(step).cast("long"))).alias("tile_start"))
    return own.select("chrom", "tile_start", F.least(F.col("tile_start") + size, F.col("len")).alias("tile_end"))


def tiled(contacts: DataFrame, genome: Genome, size: int, step: int, resolution: int) -> DataFrame:
    """Cis maps of overlapping tiles, by cuts.  A cut's tiles are found by arithmetic: a contact
    is in those that both cuts are in."""
    own = contacts.filter("chrms1 = chrms2 AND chrms1 >= 0").selectExpr("chrms1 AS chrom", "least(cuts1, cuts2) AS lo", "greatest(cuts1, cuts2) AS hi")
    first = F.expr(f"greatest(0L, cast(ceil((hi - {size} + 1) / {step}) as bigint))")
    last = F.expr(f"cast(lo div {step} as bigint)")
    in_tiles = own.withColumn("a", first).withColumn("z", last).filter("a <= z").withColumn("k", F.explode(F.sequence("a", "z"))).withColumn("tile_start", F.col("k") * step)
    p = [F.expr(f"cast(({x} - tile_start) div {resolution} as int)").alias(n) for x, n in (("lo", "bin1"), ("hi", "bin2"))]
    return in_tiles.groupBy("chrom", "tile_start", *p).agg(F.count("*").alias("value"))


def coarsegrain(pixels: DataFrame, by: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums over blocks of ``by`` x ``by`` pixels."""
    return pixels.groupBy(*keys, F.expr(f"bin1 div {by}").cast("int").alias("bin1"), F.expr(f"bin2 div {by}").cast("int").alias("bin2")).agg(F.sum("value").alias("value"))


def smart_coarsegrain(pixels: DataFrame, by: int) -> DataFrame:
    """Each pixel replaced by its block's mean, a block having by * by cells (the diagonal's blocks
    hold both triangles)."""
    blocks = pixels.withColumns({"c1": F.expr(f"bin1 div {by}"), "c2": F.expr(f"bin2 div {by}")})
    full = F.when((F.col("c1") == F.col("c2")) & (F.col("bin1") != F.col("bin2")), 2 * F.col("value")).otherwise(F.col("value"))
    means = blocks.groupBy("c1", "c2").agg((F.sum(full) / (by * by)).alias("mean"))
    return blocks.join(means, ["c1", "c2"]).select("bin1", "bin2", "mean")
