"""Filters and sums on pixel tables (bin1 <= bin2, value), possibly with more keys (dataset).

Zero cells aren't stored.  What a statistic over a dense matrix would count, and that is most of
it, is worked out from the number of bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..genome import Genome, small
from ..workspace import Workspace


def with_chroms(pixels: DataFrame, bins: DataFrame, n_bins: int) -> DataFrame:
    """chrom1 and chrom2 from a bins table."""
    out = pixels
    for s in "12":
        b = bins.select(F.col("bin").alias("_b"), F.col("chrom").alias("chrom" + s))
        out = out.join(small(b, n_bins), F.col("bin" + s) == F.col("_b")).drop("_b")
    return out


def remove_diagonal(pixels: DataFrame, m: int = 1) -> DataFrame:
    return pixels.filter(F.col("bin2") - F.col("bin1") > m)


def remove_cis(pixels: DataFrame) -> DataFrame:
    return pixels.filter("chrom1 <> chrom2")


def remove_chromosome(pixels: DataFrame, chrom: int) -> DataFrame:
    return pixels.filter(f"chrom1 <> {chrom} AND chrom2 <> {chrom}")


def sides(pixels: DataFrame, value: Column | str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """bin and value of both sides of each pixel, the diagonal once."""
    v = F.col(value) if isinstance(value, str) else value
    each = F.when(F.col("bin1") == F.col("bin2"), F.array(F.col("bin1"))).otherwise(F.array("bin1", "bin2"))
    return pixels.select(*keys, v.alias("value"), F.explode(each).alias("bin"))


def full(pixels: DataFrame, a: str = "bin1", b: str = "bin2") -> DataFrame:
    """Both triangles of a map, each row read once: other columns travel along."""
    rest = [c for c in pixels.columns if c not in (a, b)]
    one, two = F.struct(F.col(a).alias(a), F.col(b).alias(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b))
    own = pixels.select(*rest, F.explode(F.when(F.col(a) == F.col(b), F.array(one)).otherwise(F.array(one, two))).alias("_p"))
    return own.select(*[F.col(f"_p.{c}").alias(c) if c in (a, b) else F.col(c) for c in pixels.columns])


def marginals(pixels: DataFrame, keys: tuple[str, ...] = (), trans: bool = False, count_cells: bool = False) -> DataFrame:
    """Row sums of the symmetric matrix, by bin; of trans pixels only, or of cells that aren't zero."""
    own = pixels.filter("chrom1 <> chrom2") if trans else pixels
    v = F.lit(1).cast("long") if count_cells else F.col("value")
    return sides(own, v, keys).groupBy(*keys, "bin").agg(F.sum("value").alias("total"))


def on_bins(pixels: DataFrame, bins: DataFrame, n_bins: int) -> DataFrame:
    """Pixels with both bins in ``bins``."""
    out = pixels
    for s in "12":
        out = out.join(small(bins.select(F.col("bin").alias("_b")), n_bins), F.col("bin" + s) == F.col("_b"), "left_semi")
    return out


def without_bins(pixels: DataFrame, bins: DataFrame, n_bins: int) -> DataFrame:
    out = pixels
    for s in "12":
        out = out.join(small(bins.select(F.col("bin").alias("_b")), n_bins), F.col("bin" + s) == F.col("_b"), "left_anti")
    return out


def valid_bins(pixels: DataFrame, datasets: int) -> DataFrame:
    """Bins with a positive row sum in every dataset."""
    own = marginals(pixels, ("dataset",)).filter("total > 0")
    return own.groupBy("bin").agg(F.count("*").alias("n")).filter(F.col("n") == datasets).select("bin")


def poor_bins(pixels: DataFrame, cutoff: float = 2.0, trans: bool = False, count_cells: bool = False) -> DataFrame:
    """Bins whose row sum (or count of cells) is below the percentile of positive ones, in any
    dataset.  Bins without pixels are in no pixel anyway."""
    own = marginals(pixels, ("dataset",), trans, count_cells).filter("total > 0")
    cut = own.groupBy("dataset").agg(F.percentile("total", F.lit(cutoff / 100)).alias("cut"))
    return own.join(F.broadcast(cut), "dataset").filter("total < cut").select("bin").distinct()


def remove_poor(pixels: DataFrame, n_bins: int, cutoff: float = 2.0, **options) -> DataFrame:
    pixels = Workspace(pixels.sparkSession, "poor").write(pixels, "pixels")  # row sums, cutoffs and the rest read them
    return without_bins(pixels, poor_bins(pixels, cutoff, **options), n_bins)


def standalone_bins(bins: DataFrame, valid: DataFrame, offset: int = 3) -> DataFrame:
    """Valid bins in runs of at most ``offset`` valid neighbours on a chromosome."""
    own = bins.join(valid, "bin", "left_semi").select("bin", "chrom")
    run = own.withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy("chrom").orderBy("bin")))
    short = run.groupBy("chrom", "run").agg(F.count("*").alias("n"), F.min("bin").alias("a"), F.max("bin").alias("z")).filter(F.col("n") <= offset)
    return short.select(F.explode(F.sequence("a", "z")).alias("bin"))


def unsequenced_bins(bins: DataFrame, resolution: int, share: float = 0.5) -> DataFrame:
    """Bins with fewer mapped bases than the share of their resolution."""
    return bins.filter(F.col("mapped_bases") < int(resolution * share)).select("bin")


def percentile_with_zeros(values: DataFrame, weight: Column, total: int, p: float) -> DataFrame:
    """One row, ``cut``: the linear percentile of non-negative values with weights, in a population
    of ``total`` cells of which the rest are zero.

    Distinct values are summed first, and the window runs over what one value's rank needs.
    """
    each = values.groupBy("value").agg(F.sum(weight).alias("w")).filter("value > 0")
    rank = p * (total - 1)
    low, high = int(rank), min(int(rank) + 1, total - 1)
    upto = each.withColumn("above", F.sum("w").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)))
    # the value at rank r (from 0, ascending) is the largest with total - above <= r
    at = lambda r: F.coalesce(F.max(F.when(F.lit(total) - F.col("above") <= r, F.col("value"))), F.lit(0))
    both = upto.agg(at(low).cast("double").alias("a"), at(high).cast("double").alias("b"))
    return both.select((F.col("a") + (F.col("b") - F.col("a")) * (rank - low)).alias("cut"))


def truncate_trans(pixels: DataFrame, trans_cells: int, high: float = 0.0005) -> DataFrame:
    """Trans values held to their percentile over all cells of the full matrix's trans part."""
    trans = pixels.filter("chrom1 <> chrom2")
    cut = percentile_with_zeros(trans, F.lit(2), trans_cells, 1 - high)
    return pixels.join(F.broadcast(cut)).withColumn(
        "value", F.when(F.col("chrom1") != F.col("chrom2"), F.least(F.col("value").cast("double"), F.col("cut"))).otherwise(F.col("value").cast("double"))
    ).drop("cut")


def compact(pixels: DataFrame, bins: DataFrame, n_bins: int, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels with bins renumbered without gaps, and the table (bin, new_bin)."""
    kept = bins.join(keep, "bin", "left_semi").withColumn("new_bin", (F.row_number().over(Window.orderBy("bin")) - 1).cast("int")).select("bin", "new_bin")
    out = pixels
    for s in "12":
        m = small(kept.select(F.col("bin").alias("_b"), F.col("new_bin").alias("_n")), n_bins)
        out = out.join(m, F.col("bin" + s) == F.col("_b")).withColumn("bin" + s, F.col("_n")).drop("_b", "_n")
    return out, kept


def restore(values: DataFrame, bins: DataFrame, mapping: DataFrame, fill: float | None = float("nan")) -> DataFrame:
    """A track on compacted bins (new_bin, value) put back on all bins."""
    own = values.join(mapping, "new_bin").select("bin", "value")
    return bins.select("bin").join(own, "bin", "left").select("bin", F.coalesce("value", F.lit(fill)).alias("value"))


def mad_max_bins(totals: DataFrame, bins: DataFrame, n_bins: int, k: float = 3.0) -> DataFrame:
    """Bins whose chromosome-normalised log row sum is within k median absolute deviations below
    the median: bin, x."""
    own = totals.filter("total > 0").join(small(bins.select("bin", "chrom"), n_bins), "bin")
    middle = own.groupBy("chrom").agg(F.median("total").alias("m"))
    x = own.join(F.broadcast(middle), "chrom").select("bin", (F.col("total") / F.col("m")).alias("x"), F.log(F.col("total") / F.col("m")).alias("lx"))
    med = x.agg(F.median("lx").alias("med"))
    dev = x.join(F.broadcast(med)).agg(F.first("med").alias("med"), F.median(F.abs(F.col("lx") - F.col("med"))).alias("mad"))
    cut = dev.select(F.exp(F.col("med") - k * F.col("mad") / 0.6745).alias("cut"))
    return x.join(F.broadcast(cut)).filter("x >= cut").select("bin", "x")


def raw_counts(pixels: DataFrame, biases: DataFrame, n_bins: int) -> DataFrame:
    """value * bias * bias of a corrected map."""
    return with_biases(pixels, biases, n_bins).select("bin1", "bin2", (F.col("value") * F.col("w1") * F.col("w2")).alias("value"))


def with_biases(pixels: DataFrame, biases: DataFrame, n_bins: int) -> DataFrame:
    """w1 and w2 from a table (bin, bias)."""
    out = pixels
    for s in "12":
        b = small(biases.select(F.col("bin").alias("_b"), F.col("bias").alias("w" + s)), n_bins)
        out = out.join(b, F.col("bin" + s) == F.col("_b")).drop("_b")
    return out


def balanced_values(pixels: DataFrame, weights: DataFrame, n_bins: int) -> DataFrame:
    """value * weight * weight, 0 where that isn't finite (weights may be missing)."""
    out = pixels
    for s in "12":
        b = small(weights.select(F.col("bin").alias("_b"), F.col("weight").alias("w" + s)), n_bins)
        out = out.join(b, F.col("bin" + s) == F.col("_b"), "left").drop("_b")
    v = F.col("value") * F.col("w1") * F.col("w2")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out.select("bin1", "bin2", F.when(finite, v).otherwise(0.0).alias("value"))


def check_coverage(pixels: DataFrame, integers: bool = True, n_bins: int = 0) -> list[str]:
    """Warnings about a map that is too thin to balance; raises if it's hopeless."""
    own = marginals(pixels, count_cells=not integers)
    least = own.filter("total > 0").agg(F.min("total")).first()[0]
    if least is None:
        return ["the map is empty"]
    if least < (5 if integers else 4):
        raise ValueError(f"a bin has only {least} {'reads' if integers else 'cells'}; filter poor bins first")
    return [f"a bin has only {least}"] if least < (100 if integers else min(100, n_bins / 2)) else []


def chromosome_pair_means(pixels: DataFrame, genome_bins: DataFrame) -> DataFrame:
    """chrom1 <= chrom2 and the mean cell of their block, zeros included."""
    n = genome_bins.groupBy("chrom").agg(F.count("*").alias("n"))
    sums = pixels.groupBy("chrom1", "chrom2").agg(
        F.sum(F.when((F.col("chrom1") == F.col("chrom2")) & (F.col("bin1") != F.col("bin2")), 2 * F.col("value")).otherwise(F.col("value"))).alias("total")
    )
    a, b = n.select(F.col("chrom").alias("chrom1"), F.col("n").alias("n1")), n.select(F.col("chrom").alias("chrom2"), F.col("n").alias("n2"))
    blocks = a.join(b, F.col("chrom1") <= F.col("chrom2"))  # of two chromosome tables
    return blocks.join(sums, ["chrom1", "chrom2"], "left").select("chrom1", "chrom2", (F.coalesce("total", F.lit(0)) / (F.col("n1") * F.col("n2"))).alias("mean"))


def over_chromosome_means(pixels: DataFrame, genome_bins: DataFrame) -> DataFrame:
    means = chromosome_pair_means(pixels, genome_bins)
    return pixels.join(F.broadcast(means), ["chrom1", "chrom2"]).select("bin1", "bin2", (F.col("value") / F.col("mean")).alias("value"))


def cis_to_total(pixels: DataFrame, singles: DataFrame | None = None) -> DataFrame:
    """bin and the cis share of its row sum, of the map or with single-sided reads (bin, n)."""
    own = pixels.withColumn("c", F.when(F.col("chrom1") == F.col("chrom2"), F.col("value")).otherwise(0))
    sums = sides(own, F.struct("value", "c")).groupBy("bin").agg(F.sum("value.c").alias("cis"), F.sum("value.value").alias("total"))
    if singles is not None:
        sums = sums.join(singles, "bin", "left").withColumn("total", F.col("total") + F.coalesce("n", F.lit(0)))
    return sums.select("bin", (F.col("cis") / F.col("total")).alias("ratio"))


def emulate_cis(pixels: DataFrame, scale: float = 300.0) -> DataFrame:
    """Cis values times scale / (distance + 0.5)."""
    v = F.when(F.col("chrom1") == F.col("chrom2"), F.col("value") * scale / (F.col("bin2") - F.col("bin1") + 0.5)).otherwise(F.col("value").cast("double"))
    return pixels.withColumn("value", v)


def coverage_fraction(pixels: DataFrame, n_bins: int) -> DataFrame:
    """Covered bins and their share of all."""
    return sides(pixels).agg(F.countDistinct("bin").alias("covered")).withColumn("share", F.col("covered") / n_bins)


def smooth(pixels: DataFrame, bins: DataFrame, n_bins: int, radius: int = 9) -> DataFrame:
    """Cells of each chromosome block averaged with weights 1 / (1 + |a| + |b|) over a square of
    2 * radius + 1, relative to the weights of the cells that exist: pos1 <= pos2."""
    own = with_chroms(pixels, bins, n_bins).filter("chrom1 = chrom2")
    lens = bins.groupBy("chrom").agg(F.count("*").alias("n"), F.min("bin").alias("first"))
    own = own.join(F.broadcast(lens), F.col("chrom1") == F.col("chrom")).select("chrom", "n", (F.col("bin1") - F.col("first")).alias("p1"), (F.col("bin2") - F.col("first")).alias("p2"), "value")
    both = own.unionByName(own.filter("p1 <> p2").select("chrom", "n", F.col("p2").alias("p1"), F.col("p1").alias("p2"), "value"))
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = both.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
    spread = spread.select("chrom", "n", (F.col("p1") + F.col("a")).alias("pos1"), (F.col("p2") + F.col("b")).alias("pos2"), (F.col("value") / (1 + F.abs("a") + F.abs("b"))).alias("v"))
    spread = spread.filter("pos1 >= 0 AND pos1 <= pos2 AND pos2 < n")
    sums = spread.groupBy("chrom", "n", "pos1", "pos2").agg(F.sum("v").alias("v"))
    span = lambda p: F.sequence(F.greatest(F.lit(-radius), -F.col(p)), F.least(F.lit(radius), F.col("n").cast("int") - 1 - F.col(p)))
    weight = F.aggregate(span("pos1"), F.lit(0.0), lambda acc, a: acc + F.aggregate(span("pos2"), F.lit(0.0), lambda x, b: x + 1.0 / (1 + F.abs(a) + F.abs(b))))
    return sums.select("chrom", "pos1", "pos2", (F.col("v") / weight).alias("value"))
