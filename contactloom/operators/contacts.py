"""Contact tables: canonical order, fragment assignment and the columns derived from it.

A contact has chrms, cuts and strands for both sides; chrms is -1 for a side that isn't mapped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..genome import Genome, small

SIDE = ("chrms", "cuts", "strands")


def canonical(contacts: DataFrame) -> DataFrame:
    """Sides in order of (chrms, cuts); all columns of a side swap together."""
    swap = (F.col("chrms1") > F.col("chrms2")) | ((F.col("chrms1") == F.col("chrms2")) & (F.col("cuts1") > F.col("cuts2")))
    sided = [c[:-1] for c in contacts.columns if c.endswith("1") and c[:-1] + "2" in contacts.columns]
    new = {}
    for c in sided:
        new[c + "1"] = F.when(swap, F.col(c + "2")).otherwise(F.col(c + "1"))
        new[c + "2"] = F.when(swap, F.col(c + "1")).otherwise(F.col(c + "2"))
    return contacts.withColumns(new)


def assign_fragments(contacts: DataFrame, genome: Genome, columns: tuple[str, ...] = ("abs_idx", "len", "mid", "frag_id", "fs", "fe"), width: int | None = None) -> DataFrame:
    """Adds rfrag, fraglen, mid, fragid, fs and fe of both sides (those asked for).

    A side's key is ``cut + 7 * strand - 3``, held to 1 .. chromosome length: a forward read cuts at
    the next site, a reverse read at the one before.  Unmapped sides get rfrag -1, length 0.

    The dimension is broadcast while its checked row count allows; beyond that each side is a
    shuffled join on (chromosome, bucket), where no bucket holds more than a few fragments.  A
    chromosome's last fragment is listed in all buckets behind it, so that keys needn't be held to the
    length row by row: one join a side, and generated code short enough to be compiled.
    """
    names = {"abs_idx": "rfrag", "len": "fraglen", "mid": "mid", "frag_id": "fragid", "fs": "fs", "fe": "fe"}
    absent = {"abs_idx": -1, "len": 0, "mid": -1, "frag_id": -1, "fs": 0, "fe": 0}
    types = dict(genome.fragments.dtypes)
    width = width or max(1, genome.max_len * genome.n_chromosomes // max(1, genome.n_fragments))
    cap = genome.max_len // width
    longest = genome.chromosomes.select(F.col("chrom").alias("_c"), F.col("len").alias("_len"))
    held = genome.fragments.join(small(longest, genome.n_chromosomes), F.col("chrom") == F.col("_c"), "left").filter("_len IS NULL OR fs < _len")
    at_end = F.expr("_len IS NOT NULL AND fe >= _len")
    last = F.when(at_end, F.lit(cap)).otherwise(F.expr(f"least(fe div {width}, {cap})"))
    out = contacts
    for side in "12":
        chrom, cut, strand = F.col("chrms" + side), F.col("cuts" + side), F.col("strands" + side)
        key = F.greatest(F.lit(1), F.coalesce(cut + 7 * strand.cast("int") - 3, F.lit(2**31 - 1))).cast("long")
        listed = held.select(
            F.col("chrom").cast("long").alias("_fc"),
            F.col("fs").alias("_fs"),
            F.when(at_end, F.lit(2**63 - 1)).otherwise(F.col("fe")).alias("_fe"),
            *[F.col(c).alias(names[c] + side) for c in columns],
            F.explode(F.sequence(F.expr(f"least(fs div {width}, {cap})"), last)).alias("_fb"),
        ).withColumn("_fk", F.col("_fc") * (cap + 1) + F.col("_fb")).drop("_fc", "_fb")
        keyed = out.withColumn("_v", key).withColumn("_k", chrom.cast("long") * (cap + 1) + F.expr(f"least(_v div {width}, {cap})"))
        on = (F.col("_k") == F.col("_fk")) & (F.col("_v") > F.col("_fs")) & (F.col("_v") <= F.col("_fe"))
        out = keyed.join(small(listed, 2 * genome.n_fragments), on, "left").drop("_fs", "_fe", "_fk", "_v", "_k")
        out = out.withColumns({names[c] + side: F.coalesce(F.col(names[c] + side), F.lit(absent[c]).cast(types[c])) for c in columns})
    return out


def with_distances(contacts: DataFrame) -> DataFrame:
    """dists1/2, from the cut to the site that the read points to (0 if unmapped), and distance
    between fragment middles (-1 between chromosomes or if unmapped)."""
    new: dict[str, Column] = {}
    for s in "12":
        cut = F.col("cuts" + s).cast("long")
        d = F.when(F.col("strands" + s), F.col("fe" + s) - cut).otherwise(cut - F.col("fs" + s))
        new["dists" + s] = F.when(F.col("chrms" + s) < 0, 0).otherwise(F.abs(d)).cast("int")
    cis = (F.col("chrms1") == F.col("chrms2")) & (F.col("chrms1") >= 0)
    new["distance"] = F.when(cis, F.abs(F.col("mid1") - F.col("mid2"))).otherwise(-1).cast("int")
    return contacts.withColumns(new)


def decode_fragment_id(frag_id: Column, frag_mult: int) -> tuple[Column, Column]:
    """(chromosome, middle) of a global fragment id."""
    return F.floor(frag_id / frag_mult).cast("int"), F.pmod(frag_id, F.lit(frag_mult)).cast("int")


def with_expression(contacts: DataFrame, name: str, sql: str) -> DataFrame:
    """A column from a SQL expression over the others."""
    return contacts.withColumn(name, F.expr(sql))


def with_arms(contacts: DataFrame, genome: Genome) -> DataFrame:
    """arm1/2: 2 * chromosome, and one more right of the centromere's middle."""
    out = contacts
    for s in "12":
        dim = genome.chromosomes.select(F.col("chrom").alias("_c"), F.col("cntr_mid").alias("_m"))
        out = out.join(small(dim, genome.n_chromosomes), F.col("chrms" + s) == F.col("_c"), "left")
        out = out.withColumn("arm" + s, F.coalesce(2 * F.col("chrms" + s) + (F.col("cuts" + s) > F.col("_m")).cast("int"), F.lit(-1))).drop("_c", "_m")
    return out


def merge(*datasets: DataFrame) -> DataFrame:
    """All rows of several datasets."""
    return reduce(DataFrame.unionByName, datasets)


def sorted_layout(contacts: DataFrame, partitions: int) -> DataFrame:
    """Canonical contacts laid out by (chrms1, cuts1), so that readers can skip row groups.  The
    ranges are cut on all four position columns: a much-hit position can't fill one of them."""
    own = canonical(contacts)
    return own.repartitionByRange(partitions, "chrms1", "cuts1", "chrms2", "cuts2").sortWithinPartitions("chrms1", "cuts1", "chrms2", "cuts2")


def consistency(contacts: DataFrame, genome: Genome) -> DataFrame:
    """One row: the largest chromosome number, and by how much the farthest cut exceeds its
    chromosome's end, over all rows."""
    sides = contacts.select(F.explode(F.array(*[F.struct(F.col("chrms" + s).alias("chrom"), F.col("cuts" + s).alias("cut")) for s in "12"])).alias("s")).select("s.*")
    dim = genome.chromosomes.select("chrom", "len")
    return sides.filter("chrom >= 0").join(small(dim, genome.n_chromosomes), "chrom", "left").agg(
        F.max("chrom").cast("int").alias("max_chrom"),
        F.max(F.col("cut") - F.col("len")).cast("long").alias("max_over"),
        F.count(F.when(F.col("len").isNull(), 1)).alias("unknown_chrom"),
    )


def check_consistency(contacts: DataFrame, genome: Genome, tolerance: int = 100) -> None:
    found = consistency(contacts, genome).first()
    if found["unknown_chrom"]:
        raise ValueError(f"{found['unknown_chrom']} sides lie on chromosomes that the genome lacks")
    if (found["max_over"] or 0) > tolerance:
        raise ValueError(f"a position lies {found['max_over']} behind its chromosome's end")
