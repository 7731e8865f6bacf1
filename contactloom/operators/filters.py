"""Filters on contacts.  Each says which rows stay; counters come from one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..genome import Genome, small
from ..workspace import Workspace

DOUBLE_SIDED = "chrms1 >= 0 AND chrms2 >= 0"
SAME_FRAGMENT = "chrms1 >= 0 AND chrms2 >= 0 AND rfrag1 = rfrag2"


def by_mask(contacts: DataFrame, keep: Column | str) -> DataFrame:
    return contacts.filter(keep)


def double_sided(contacts: DataFrame) -> DataFrame:
    return contacts.filter(DOUBLE_SIDED)


def different_fragments(contacts: DataFrame) -> DataFrame:
    return contacts.filter("rfrag1 <> rfrag2 OR chrms1 < 0 OR chrms2 < 0")


def same_fragment_class() -> Column:
    """What a pair within one fragment is: self_circle, dangling_end or error."""
    return F.expr("CASE WHEN strands1 = strands2 THEN 'error' WHEN (cuts2 > cuts1) = strands2 THEN 'self_circle' ELSE 'dangling_end' END")


def is_molecule(longest: int, with_strands: bool = True) -> Column:
    """Pairs that may be one short unligated molecule."""
    if not with_strands:
        return F.expr(f"chrms1 = chrms2 AND chrms1 >= 0 AND abs(cuts1 - cuts2) <= {longest}")
    span = "(-cuts1 * (2 * cast(strands1 as int) - 1) - cuts2 * (2 * cast(strands2 as int) - 1))"
    return F.expr(f"chrms1 = chrms2 AND chrms1 >= 0 AND strands1 <> strands2 AND {span} BETWEEN 0 AND {longest}")


def not_molecules(contacts: DataFrame, longest: int = 500, with_strands: bool = True) -> DataFrame:
    return contacts.filter(~is_molecule(longest, with_strands))


def valid_pairs(contacts: DataFrame, longest: int = 500, single_sided: bool = False, same_fragment: bool = False, molecules: bool = False) -> DataFrame:
    """Double-sided pairs of different fragments that aren't molecules; flags keep a kind.

    What is left to test behind the fragments' join is one condition in two steps: its parts apart
    would be moved before the join, where each computes the positions again."""
    out = contacts if single_sided else double_sided(contacts)
    apart = F.expr("rfrag1 <> rfrag2 OR chrms1 < 0 OR chrms2 < 0")
    if same_fragment:
        return out if molecules else not_molecules(out, longest)
    return out.filter(apart if molecules else F.when(apart, ~is_molecule(longest)).otherwise(F.lit(False)))


def parse_counters(contacts: DataFrame, longest: int = 500) -> DataFrame:
    """key, value of the counters of ``valid_pairs``, from one pass over its input."""
    ds, same = F.expr(DOUBLE_SIDED), F.expr(SAME_FRAGMENT)
    kind, molecule = same_fragment_class(), is_molecule(longest)
    counts = {
        "100_TotalReads": F.lit(True),
        "150_ReadsWithoutUnusedChromosomes": F.lit(True),
        "152_removedUnusedChromosomes": F.lit(False),
        "200_totalDSReads": ds,
        "201_DS+SS": F.lit(True),
        "202_SSReadsRemoved": ~ds,
        "210_sameFragmentReadsRemoved": same,
        "212_Self-Circles": same & (kind == "self_circle"),
        "214_DandlingEnds": same & (kind == "dangling_end"),
        "216_error": same & (kind == "error"),
        "220_extraDandlingEndsRemoved": ds & ~same & molecule,
        "300_ValidPairs": ds & ~same & ~molecule,
    }
    return _counters(contacts, counts)


def _counters(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    one = rows.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for k in counts])
    return one.select(F.explode(pairs).alias("p")).select("p.key", "p.value")


def final_counters(contacts: DataFrame) -> DataFrame:
    cis = F.expr("chrms1 = chrms2")
    return _counters(contacts, {"400_TotalReads": F.lit(True), "401_cisReads": cis, "402_transReads": ~cis})


def rsite_start(contacts: DataFrame, offset: int = 5) -> DataFrame:
    """Reads that don't start at a restriction site, on either side."""
    return contacts.filter(f"abs(dists1 - fraglen1) >= {offset} AND abs(dists2 - fraglen2) >= {offset}")


def fragment_size(contacts: DataFrame, large: int = 100_000, small_: int = 100) -> DataFrame:
    return contacts.filter(" AND ".join(f"fraglen{s} < {large} AND fraglen{s} > {small_}" for s in "12"))


def too_close(contacts: DataFrame, least: int = 2) -> DataFrame:
    """Without cis pairs of fragments that are closer than ``least`` fragments."""
    return contacts.filter(f"NOT (chrms1 = chrms2 AND abs(rfrag1 - rfrag2) < {least})")


def orientation(contacts: DataFrame, mode: str = "same") -> DataFrame:
    """Pairs of equal strands; mode ``different`` keeps the others."""
    return contacts.filter("strands1 = strands2" if mode == "same" else "strands1 <> strands2")


def dedup_pairs(contacts: DataFrame, survivor: tuple[str, ...] = ("strands1", "strands2")) -> DataFrame:
    """One row per unordered pair of positions; strands don't count.

    Survivors are the first rows by ``survivor`` and then all other columns, sides in canonical
    order.  The aggregate combines copies within tasks, so much-repeated pairs don't pile up.
    """
    own = [c for c in contacts.columns]
    a, b = F.struct(F.col("chrms1").alias("c"), F.col("cuts1").alias("p")), F.struct(F.col("chrms2").alias("c"), F.col("cuts2").alias("p"))
    rest = [c for c in own if c not in survivor]
    row = F.struct(*survivor, *rest)
    return contacts.groupBy(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).agg(F.min(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in own])


def pair_multiplicity(contacts: DataFrame) -> DataFrame:
    """n rows of each unordered pair of positions, and of how many pairs that is so."""
    a, b = F.struct(F.col("chrms1").alias("c"), F.col("cuts1").alias("p")), F.struct(F.col("chrms2").alias("c"), F.col("cuts2").alias("p"))
    each = contacts.groupBy(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).agg(F.count("*").alias("n"))
    return each.groupBy("n").agg(F.count("*").alias("pairs"))


def unique_interactions(contacts: DataFrame) -> DataFrame:
    """One read per pair of fragments, the first by position and strand."""
    keys = ["cuts1", "cuts2", "strands1", "strands2"]
    rest = [c for c in contacts.columns if c not in keys]
    best = contacts.groupBy(F.least("rfrag1", "rfrag2").alias("_a"), F.greatest("rfrag1", "rfrag2").alias("_b")).agg(F.min(F.struct(*keys, *rest)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in contacts.columns])


def fragment_counts(contacts: DataFrame, genome: Genome) -> DataFrame:
    """abs_idx and n reads of every fragment, both sides counted, zeros included."""
    from .fragments import sides

    n = sides(contacts).groupBy("rfrag").agg(F.count("*").alias("n"))
    return genome.fragments.select("abs_idx").join(n, F.col("abs_idx") == F.col("rfrag"), "left").select("abs_idx", F.coalesce("n", F.lit(0)).alias("n"))


def on_fragments(contacts: DataFrame, keep: DataFrame, rows: int | None = None) -> DataFrame:
    """Contacts with both fragments in ``keep`` (abs_idx), of which there are at most ``rows``."""
    keep = keep.select("abs_idx")
    out = contacts
    for s in "12":
        ids = small(keep, rows) if rows is not None else keep
        out = out.join(ids.withColumnRenamed("abs_idx", "_k"), F.col("rfrag" + s) == F.col("_k"), "left_semi")
    return out


def extreme_counts(counts: DataFrame, high: float = 0.005, low: float = 0.0) -> DataFrame:
    """Fragments whose count is within the percentiles of positive counts, bounds included."""
    bounds = counts.filter("n > 0").agg(F.percentile("n", F.lit(low)).alias("vl"), F.percentile("n", F.lit(1 - high)).alias("vh"))
    return counts.join(F.broadcast(bounds)).filter("n >= vl AND n <= vh").select("abs_idx", "n")


def extreme(contacts: DataFrame, genome: Genome, high: float = 0.005, low: float = 0.0) -> DataFrame:
    counts = Workspace(contacts.sparkSession, "extreme").write(fragment_counts(contacts, genome), "counts")
    return on_fragments(contacts, extreme_counts(counts, high, low), genome.n_fragments)


def cis_to_total_ratios(contacts: DataFrame, genome: Genome) -> DataFrame:
    """abs_idx and ratio of cis reads to reads of every fragment, 0 if it has none."""
    both = contacts.select(F.explode(F.array("rfrag1", "rfrag2")).alias("rfrag"), (F.col("chrms1") == F.col("chrms2")).cast("long").alias("cis"))
    sums = both.filter("rfrag >= 0").groupBy("rfrag").agg((F.sum("cis") / F.count("*")).alias("ratio"))
    return genome.fragments.select("abs_idx").join(sums, F.col("abs_idx") == F.col("rfrag"), "left").select("abs_idx", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def cis_to_total_kept(ratios: DataFrame, n: int, high: float = 0.02, low: float = 0.02) -> DataFrame:
    """Fragments within the rank cutoffs.  The ratios' distinct values are ranked, not the rows."""
    each = ratios.groupBy("ratio").agg(F.count("*").alias("m"))
    upto = each.withColumn("last", F.sum("m").over(Window.orderBy("ratio")) - 1)
    empty = F.coalesce(F.max(F.when(F.col("ratio") == 0, F.col("m"))), F.lit(0))
    e = upto.agg(empty.alias("e"))
    at_low = F.col("e") + F.ceil((F.lit(n) - F.col("e")) * low)
    at_high = F.lit(n) - 1 - F.ceil((F.lit(n) - F.col("e")) * high)
    cut = upto.join(F.broadcast(e)).agg(
        F.min(F.when(F.col("last") >= at_low, F.col("ratio"))).alias("rl"), F.min(F.when(F.col("last") >= at_high, F.col("ratio"))).alias("rh")
    )
    return ratios.join(F.broadcast(cut)).filter("ratio >= rl AND ratio <= rh").select("abs_idx", "ratio")


def by_cis_to_total(contacts: DataFrame, genome: Genome, high: float = 0.02, low: float = 0.02) -> DataFrame:
    ratios = Workspace(contacts.sparkSession, "cis-to-total").write(cis_to_total_ratios(contacts, genome), "ratios")
    kept = cis_to_total_kept(ratios, genome.n_fragments, high, low)
    return on_fragments(contacts, kept, genome.n_fragments)


def low_count_fragments(contacts: DataFrame, genome: Genome, below: int = 9) -> DataFrame:
    return on_fragments(contacts, fragment_counts(contacts, genome).filter(F.col("n") < below), genome.n_fragments)


def hot_fragments(contacts: DataFrame, genome: Genome, quantile: float = 0.996) -> DataFrame:
    """Contacts with a fragment on either side whose count is above the quantile of all counts."""
    counts = Workspace(contacts.sparkSession, "hot").write(fragment_counts(contacts, genome), "counts")
    hot = counts.join(F.broadcast(counts.agg(F.percentile("n", F.lit(quantile)).alias("v")))).filter("n > v").select(F.col("abs_idx").alias("_h"))
    hot = small(hot, genome.n_fragments)
    one = contacts.join(hot.withColumnRenamed("_h", "_h1"), F.col("rfrag1") == F.col("_h1"), "left")
    return one.join(hot.withColumnRenamed("_h", "_h2"), F.col("rfrag2") == F.col("_h2"), "left").filter("_h1 IS NOT NULL OR _h2 IS NOT NULL").drop("_h1", "_h2")


def update_genome(contacts: DataFrame, mapping: DataFrame, rows: int = 1000, drop_single_sided: bool = False) -> DataFrame:
    """Chromosomes renumbered by ``mapping`` (old, new).  A contact that touches a chromosome that
    the mapping lacks goes, single-sided or not; -1 stays -1."""
    out = contacts
    for s in "12":
        m = mapping.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        out = out.join(small(m, rows), F.col("chrms" + s) == F.col("_o"), "left").filter(f"chrms{s} < 0 OR _n IS NOT NULL")
        out = out.withColumn("chrms" + s, F.coalesce("_n", F.lit(-1)).cast("int")).drop("_o", "_n")
    return double_sided(out) if drop_single_sided else out


def random_breaks(contacts: DataFrame, longest: int = 500) -> DataFrame:
    """Without pairs whose way to the sites is longer than a molecule."""
    return contacts.filter(f"dists1 + dists2 <= {longest}")


def cis_only(contacts: DataFrame) -> DataFrame:
    return contacts.filter("chrms1 = chrms2 AND chrms1 >= 0")


def without_chromosome(contacts: DataFrame, chrom: int) -> DataFrame:
    return contacts.filter(f"chrms1 <> {chrom} AND chrms2 <> {chrom}")


def down_sample(contacts: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """The rows whose seeded hash over all columns is below ``share``; rows that are alike go or
    stay together unless the table has a read_id."""
    return contacts.filter(F.pmod(F.xxhash64(F.lit(seed), *contacts.columns), F.lit(1_000_000)) < int(share * 1_000_000))


def quasi_duplicates_binned(contacts: DataFrame, size: int = 500, step: int = 100) -> DataFrame:
    """One row per cell of a grid, again for each of the grid's shifts along the diagonal."""
    out = contacts
    for shift in range(0, size, step):
        cell = [F.expr(f"(cuts{s} + {shift}) div {size}").alias(f"_g{s}") for s in "12"]
        keys = ["chrms1", "chrms2", "strands1", "strands2"]
        rest = [c for c in out.columns if c not in keys]
        got = out.groupBy(*[F.col(k).alias(f"_k{k}") for k in keys], *cell).agg(F.min(F.struct(*[c for c in ("cuts1", "cuts2")], *keys, *[c for c in rest if c not in ("cuts1", "cuts2")])).alias("_r"))
        out = got.select(*[F.col(f"_r.{c}").alias(c) for c in contacts.columns])
    return out

