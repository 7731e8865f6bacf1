"""Genomes: chromosomes, restriction fragments and bins as dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dimension tables of at most this many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count, which the caller knows, is within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


@dataclass(frozen=True)
class Genome:
    """``chromosomes`` (chrom, label, len, cntr_start, cntr_end, cntr_mid) and ``fragments``
    (abs_idx, chrom, fs, fe, len, mid, frag_id), with their row counts.

    Fragment i of a chromosome covers the positions over fs up to fe.
    """

    chromosomes: DataFrame
    fragments: DataFrame
    n_chromosomes: int
    n_fragments: int
    max_len: int

    @property
    def spark(self) -> SparkSession:
        return self.chromosomes.sparkSession

    @property
    def frag_mult(self) -> int:
        """What a chromosome's number is multiplied by in a global fragment id."""
        return self.max_len + 1000

    @staticmethod
    def of(chromosomes: DataFrame, fragments: DataFrame) -> Genome:
        """From two tables; their sizes are looked up once."""
        n, longest = chromosomes.agg(F.count("*"), F.max("len")).first()
        return Genome(chromosomes, fragments, int(n), fragments.count(), int(longest))

    @staticmethod
    def uniform(chromosomes: DataFrame, width: int) -> Genome:
        """Pseudo-fragments of one width, for analyses without an enzyme."""
        n, longest, total = chromosomes.agg(F.count("*"), F.max("len"), F.sum(F.ceil(F.col("len") / width))).first()
        mult = int(longest) + 1000
        parts = chromosomes.select("chrom", F.col("len").alias("chrom_len"), F.explode(F.sequence(F.lit(0), ((F.col("len") - 1) / width).cast("int"))).alias("k"))
        offsets = _running(chromosomes.select("chrom", F.ceil(F.col("len") / width).alias("n")))
        frags = parts.join(small(offsets, int(n)), "chrom").select(
            (F.col("first") + F.col("k")).cast("int").alias("abs_idx"),
            "chrom",
            (F.col("k") * width).cast("long").alias("fs"),
            F.least((F.col("k") + 1) * width, F.col("chrom_len")).cast("long").alias("fe"),
        )
        frags = frags.select("abs_idx", "chrom", "fs", "fe", *derived_fragment_columns(mult))
        return Genome(chromosomes, frags, int(n), int(total), int(longest))

    def bins(self, resolution: int) -> DataFrame:
        """bin, chrom, pos_bin, start, end, arm; bins start anew on each chromosome."""
        own = self.chromosomes.select("chrom", "len", "cntr_mid", F.explode(F.sequence(F.lit(0), F.expr(f"cast((len - 1) div {resolution} as int)"))).alias("pos_bin"))
        start = F.col("pos_bin").cast("long") * resolution
        return own.join(small(self.bin_offsets(resolution), self.n_chromosomes), "chrom").select(
            (F.col("first_bin") + F.col("pos_bin")).cast("int").alias("bin"),
            "chrom",
            "pos_bin",
            start.alias("start"),
            F.least(start + resolution, F.col("len")).alias("end"),
            (2 * F.col("chrom") + (start + resolution / 2 > F.col("cntr_mid")).cast("int")).cast("int").alias("arm"),
        )

    def bin_offsets(self, resolution: int) -> DataFrame:
        """chrom, first_bin."""
        n = self.chromosomes.select("chrom", F.expr(f"(len - 1) div {resolution} + 1").alias("n"))
        return _running(n).select("chrom", F.col("first").cast("int").alias("first_bin"))

    def n_bins(self, resolution: int) -> int:
        return int(self.chromosomes.agg(F.sum(F.expr(f"(len - 1) div {resolution} + 1"))).first()[0])


def _running(counts: DataFrame) -> DataFrame:
    """Per chromosome the sum of n over the chromosomes before it.  A table of chromosomes is tiny
    by nature, so the self-join is."""
    before = counts.select(F.col("chrom").alias("c2"), F.col("n").alias("n2"))
    return counts.join(before, F.col("c2") < F.col("chrom"), "left").groupBy("chrom").agg(F.coalesce(F.sum("n2"), F.lit(0)).alias("first"))


def derived_fragment_columns(frag_mult: int) -> list:
    return [
        (F.col("fe") - F.col("fs")).cast("int").alias("len"),
        F.expr("cast((fs + fe) div 2 as int)").alias("mid"),
        F.expr(f"cast((fs + fe) div 2 + chrom * {frag_mult}L as bigint)").alias("frag_id"),
    ]
