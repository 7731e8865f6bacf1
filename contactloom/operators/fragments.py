"""Counts over restriction fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..genome import Genome, small


def sides(contacts: DataFrame, which: str = "12") -> DataFrame:
    """rfrag of each mapped side."""
    return contacts.select(F.explode(F.array(*["rfrag" + s for s in which])).alias("rfrag")).filter("rfrag >= 0")


def fragment_sum(contacts: DataFrame, genome: Genome, which: str = "12") -> DataFrame:
    """Reads of every fragment, from one side or both."""
    n = sides(contacts, which).groupBy("rfrag").agg(F.count("*").alias("n"))
    return genome.fragments.select("abs_idx").join(n, F.col("abs_idx") == F.col("rfrag"), "left").select("abs_idx", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_fragment_sum(contacts: DataFrame, genome: Genome, weights: DataFrame, which: str = "12") -> DataFrame:
    """As ``fragment_sum``, each read counting 1 / (w1 * w2); ``weights`` has abs_idx and w."""
    w = [small(weights.select(F.col("abs_idx").alias(f"_i{s}"), F.col("w").alias(f"_w{s}")), genome.n_fragments) for s in "12"]
    own = contacts.join(w[0], F.col("rfrag1") == F.col("_i1")).join(w[1], F.col("rfrag2") == F.col("_i2"))
    own = own.select(F.explode(F.array(*["rfrag" + s for s in which])).alias("rfrag"), (1 / (F.col("_w1") * F.col("_w2"))).alias("x"))
    sums = own.groupBy("rfrag").agg(F.sum("x").alias("n"))
    return genome.fragments.select("abs_idx").join(sums, F.col("abs_idx") == F.col("rfrag"), "left").select("abs_idx", F.coalesce("n", F.lit(0.0)).alias("n"))


def to_bins(counts: DataFrame, genome: Genome, resolution: int) -> DataFrame:
    """Sums of fragment counts (abs_idx, n) over bins, by the fragments' middles."""
    f = genome.fragments.select(F.col("abs_idx").alias("_f"), "chrom", "mid")
    own = counts.join(small(f, genome.n_fragments), F.col("abs_idx") == F.col("_f")).join(small(genome.bin_offsets(resolution), genome.n_chromosomes), "chrom")
    return own.groupBy((F.col("first_bin") + F.expr(f"mid div {resolution}")).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def rsite_distribution(contacts: DataFrame, offset: int = 5, length: int = 200) -> DataFrame:
    """Reads by side, strand and distance of their start from the site behind them."""
    each = [F.struct(F.lit(int(s)).alias("side"), F.col("strands" + s).alias("strand"), F.col("chrms" + s).alias("chrom"), (F.col("fraglen" + s) - F.col("dists" + s) + offset).alias("value")) for s in "12"]
    own = contacts.select(F.explode(F.array(*each)).alias("s")).select("s.*").filter(f"chrom >= 0 AND value >= 0 AND value < {length}")
    return own.groupBy("side", "strand", "value").agg(F.count("*").alias("n"))


def cis_ratio_by_count(contacts: DataFrame, genome: Genome, ratio: float = 1.08) -> DataFrame:
    """Mean cis share of fragments by logarithmic classes of their counts."""
    both = contacts.select(F.explode(F.array("rfrag1", "rfrag2")).alias("rfrag"), (F.col("chrms1") == F.col("chrms2")).cast("long").alias("cis")).filter("rfrag >= 0")
    each = both.groupBy("rfrag").agg(F.count("*").alias("n"), F.sum("cis").alias("cis"))
    cls = F.floor(F.round(F.log("n") / F.log(F.lit(ratio)), 9)).cast("int").alias("class")
    return each.groupBy(cls).agg(F.count("*").alias("fragments"), F.avg(F.col("cis") / F.col("n")).alias("cis_share"))
