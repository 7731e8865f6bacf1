"""DataFrame forms of the fixtures' tables that queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..genome import Genome
from ..operators import contacts as C
from ..operators import filters as K
from ..operators import heatmap as H
from ..operators import pixels as P
from .sql import NBINS, RES


class Data:
    """What a query starts from: tables are plans, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.genome: Genome = fixtures.genome(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def contacts(self) -> DataFrame:
        return fixtures.contacts(self.spark, self.sf_dir)

    @property
    def assigned(self) -> DataFrame:
        return C.with_distances(C.assign_fragments(self.contacts, self.genome))

    @property
    def valid(self) -> DataFrame:
        return K.valid_pairs(self.assigned)

    @property
    def valid2(self) -> DataFrame:
        own = fixtures.contacts(self.spark, self.sf_dir, dataset=True)
        return K.valid_pairs(C.with_distances(C.assign_fragments(own, self.genome)))

    @property
    def bins(self) -> DataFrame:
        own = self.genome.bins(RES)
        return own.withColumns({"gc": ((F.col("bin") * 37 + 11) % 101) / 101.0, "mapped_bases": ((F.col("bin") * 7919) % 100 * 1000).cast("int")})

    @property
    def pixels(self) -> DataFrame:
        return H.all_by_all(self.valid, self.genome, RES)

    @property
    def pixels2(self) -> DataFrame:
        return H.all_by_all(self.valid2, self.genome, RES, keys=("dataset",))

    @property
    def pixels_chrom(self) -> DataFrame:
        return P.with_chroms(self.pixels, self.bins, NBINS)

    @property
    def pixels2_chrom(self) -> DataFrame:
        return P.with_chroms(self.pixels2, self.bins, NBINS)

    @property
    def blocks(self) -> DataFrame:
        """Cis maps (chrom, pos1, pos2, value)."""
        own = H.by_chromosome(self.valid, self.genome, RES, trans=False)
        return own.select(F.col("chrom1").alias("chrom"), "pos1", "pos2", "value")

    @property
    def loops(self) -> DataFrame:
        return self.table("part").selectExpr("cast(p_partkey % 5 as int) as chrom", "(p_partkey * 7919) % 1500000 as start", "(p_partkey * 7919) % 1500000 + (p_partkey * 131) % 500000 as end")

    @property
    def domains(self) -> DataFrame:
        return self.table("part").selectExpr(
            "cast(p_partkey % 5 as int) as chrom", "(p_partkey * 104729) % 1200000 as start", "(p_partkey * 104729) % 1200000 + 100000 + (p_partkey * 17) % 300000 as end"
        )

    @property
    def track(self) -> DataFrame:
        return self.bins.select("bin", F.col("gc").alias("value"))
