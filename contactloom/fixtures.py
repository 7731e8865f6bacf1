"""A made-up genome and contacts derived from the ``lineitem`` table, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .genome import Genome, derived_fragment_columns

N_CHROM, LENGTH, PER_CHROM = 5, 2_000_000, 500
FRAG_MULT = LENGTH + 1000


def genome(spark: SparkSession) -> Genome:
    c = spark.range(N_CHROM).select(
        F.col("id").cast("int").alias("chrom"),
        F.concat(F.lit("chr"), F.col("id") + 1).alias("label"),
        F.lit(LENGTH).cast("long").alias("len"),
        F.lit(900_000).cast("long").alias("cntr_start"),
        F.lit(1_000_000).cast("long").alias("cntr_end"),
        F.lit(950_000).cast("long").alias("cntr_mid"),
    )
    k = spark.range(N_CHROM * PER_CHROM).selectExpr("cast(id as int) as abs_idx", f"cast(id div {PER_CHROM} as int) as chrom", f"id % {PER_CHROM} as k")
    edge = "({k} * 4000 + ({k} * {k} * 37 + chrom * 101) % 1500)"
    frags = k.selectExpr(
        "abs_idx",
        "chrom",
        f"if(k = 0, 0L, {edge.format(k='k')}) as fs",
        f"if(k = {PER_CHROM - 1}, {LENGTH}L, {edge.format(k='(k + 1)')}) as fe",
    ).select("abs_idx", "chrom", "fs", "fe", *derived_fragment_columns(FRAG_MULT))
    return Genome(c, frags, N_CHROM, N_CHROM * PER_CHROM, LENGTH)


_P, _Q = "CAST(floor(l_extendedprice) AS BIGINT)", "CAST(floor(l_quantity) AS BIGINT)"
CHRMS1 = "CAST(CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN -1 ELSE l_suppkey % 5 END AS INT)"
CHRMS2 = "CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 5 ELSE l_suppkey % 5 END AS INT)"
CUTS1 = f"CAST(CASE WHEN l_linenumber = 5 THEN (l_partkey * 7919) % 2000000 ELSE (l_orderkey * 7919 + {_P} * 31) % 2000000 END AS INT)"
CUTS2 = (
    f"CAST(CASE WHEN l_linenumber = 5 THEN (l_suppkey * 104729) % 2000000 WHEN l_linenumber = 1 THEN (l_orderkey * 7919 + {_P} * 31 + {_Q} * 17) % 2000000 "
    f"ELSE (l_partkey * 104729 + {_P} * 13) % 2000000 END AS INT)"
)
CONTACTS = [
    f"{CHRMS1} AS chrms1", f"{CUTS1} AS cuts1", "l_returnflag = 'A' AS strands1",
    f"{CHRMS2} AS chrms2", f"{CUTS2} AS cuts2", "l_linestatus = 'O' AS strands2",
]


def contacts(spark: SparkSession, sf_dir: str, dataset: bool = False) -> DataFrame:
    """Contacts, one per line item; with ``dataset``, also which of two datasets each is in."""
    more = ["CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset"] if dataset else []
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*CONTACTS, *more)
