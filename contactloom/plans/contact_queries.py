"""Queries on contacts: assignment, filters, counters, fragment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FRAG_MULT
from ..genome import Genome
from ..operators import contacts as C
from ..operators import filters as K
from ..operators import fragments as R
from ..sources import contacts as S
from .registry import query
from .sql import MOLECULE, PER, RES, VALID

COLUMNS = ["chrms1", "cuts1", "strands1", "chrms2", "cuts2", "strands2"]
LIST = ", ".join(COLUMNS)
#: Sums that tell two sets of contacts apart, by chromosome pair.
SUMS_SQL = "count(*) AS n, CAST(sum(cuts1) AS BIGINT) AS s1, CAST(sum(cuts2) AS BIGINT) AS s2, count(CASE WHEN strands1 THEN 1 END) AS f1, count(CASE WHEN strands2 THEN 1 END) AS f2"


def by_pair(df):
    sums = [F.sum(F.col(c).cast("long")).alias(n) for c, n in (("cuts1", "s1"), ("cuts2", "s2"))]
    flags = [F.count(F.when(F.col("strands" + s), 1)).alias("f" + s) for s in "12"]
    return df.groupBy("chrms1", "chrms2").agg(F.count("*").alias("n"), *sums, *flags)


def by_pair_sql(source: str, where: str = "TRUE") -> str:
    return f"SELECT chrms1, chrms2, {SUMS_SQL} FROM {source} WHERE {where} GROUP BY chrms1, chrms2"


@query("contact_summary", "SELECT chrms1, chrms2, count(*) AS n, count(CASE WHEN chrms1 = chrms2 THEN 1 END) AS cis FROM contacts GROUP BY ALL")
def contact_summary(d):
    return d.contacts.groupBy("chrms1", "chrms2").agg(F.count("*").alias("n"), F.count(F.when(F.expr("chrms1 = chrms2"), 1)).alias("cis"))


@query("contact_consistency", "SELECT CAST(max(c.chrom) AS INTEGER) AS max_chrom, CAST(max(c.cut - 2000000) AS BIGINT) AS max_over, CAST(0 AS BIGINT) AS unknown_chrom FROM (SELECT chrms1 AS chrom, cuts1 AS cut FROM contacts UNION ALL SELECT chrms2, cuts2 FROM contacts) c WHERE c.chrom >= 0")
def contact_consistency(d):
    return C.consistency(d.contacts, d.genome)


@query("parse_pairs", f"SELECT {LIST} FROM contacts")
def parse_pairs(d):
    raw = d.contacts.withColumns({"chrms1": F.col("chrms1") + 1, "chrms2": F.col("chrms2") + 1})
    return S.parse(raw, first_chrom=1).select(*COLUMNS)


@query(
    "canonical_pairs",
    "SELECT CASE WHEN s THEN chrms2 ELSE chrms1 END AS chrms1, CASE WHEN s THEN cuts2 ELSE cuts1 END AS cuts1, CASE WHEN s THEN strands2 ELSE strands1 END AS strands1, "
    "CASE WHEN s THEN chrms1 ELSE chrms2 END AS chrms2, CASE WHEN s THEN cuts1 ELSE cuts2 END AS cuts2, CASE WHEN s THEN strands1 ELSE strands2 END AS strands2 "
    "FROM (SELECT *, chrms1 > chrms2 OR (chrms1 = chrms2 AND cuts1 > cuts2) AS s FROM contacts)",
)
def canonical_pairs(d):
    return C.canonical(d.contacts)


@query("sorted_layout", "SELECT least(chrms1, chrms2) AS chrms1, count(*) AS n FROM contacts GROUP BY ALL")
def sorted_layout(d):
    return C.sorted_layout(d.contacts, 8).groupBy("chrms1").agg(F.count("*").alias("n"))


@query("fragment_assignment", f"SELECT {LIST}, rfrag1, rfrag2 FROM cf")
def fragment_assignment(d):
    return C.assign_fragments(d.contacts, d.genome, ("abs_idx",)).select(*COLUMNS, "rfrag1", "rfrag2")


@query("derived_columns", f"SELECT {LIST}, fragid1, fragid2, fraglen1, fraglen2, mid1, mid2, dists1, dists2, distance FROM cf")
def derived_columns(d):
    return d.assigned.select(*COLUMNS, *[c + s for c in ("fragid", "fraglen", "mid", "dists") for s in "12"], "distance")


@query("fragment_id_decode", f"SELECT abs_idx, CAST(frag_id // {FRAG_MULT} AS INTEGER) AS chrom, CAST(frag_id % {FRAG_MULT} AS INTEGER) AS mid FROM frag")
def fragment_id_decode(d):
    chrom, mid = C.decode_fragment_id(F.col("frag_id"), d.genome.frag_mult)
    return d.genome.fragments.select("abs_idx", chrom.alias("chrom"), mid.alias("mid"))


@query("uniform_fragments", "SELECT CAST(i AS INTEGER) AS abs_idx, CAST(i // 2000 AS INTEGER) AS chrom, CAST((i % 2000) * 1000 AS BIGINT) AS fs, CAST((i % 2000 + 1) * 1000 AS BIGINT) AS fe FROM range(10000) t(i)")
def uniform_fragments(d):
    return Genome.uniform(d.genome.chromosomes, 1000).fragments.select("abs_idx", "chrom", "fs", "fe")


@query("genome_bins", 'SELECT bin, chrom, pos_bin, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", arm FROM bins')
def genome_bins(d):
    return d.genome.bins(RES)


@query("global_bins", f"SELECT {LIST}, CAST(chrms1 * {PER} + mid1 // {RES} AS INTEGER) AS b1, CAST(chrms2 * {PER} + mid2 // {RES} AS INTEGER) AS b2 FROM cf WHERE chrms1 >= 0 AND chrms2 >= 0")
def global_bins(d):
    from ..operators.heatmap import with_bins

    return with_bins(d.assigned, d.genome, RES).select(*COLUMNS, "b1", "b2")


@query("arm_counts", "SELECT CASE WHEN chrms1 < 0 THEN -1 ELSE 2 * chrms1 + CAST(cuts1 > 950000 AS INTEGER) END AS arm1, 2 * chrms2 + CAST(cuts2 > 950000 AS INTEGER) AS arm2, count(*) AS n FROM contacts GROUP BY ALL")
def arm_counts(d):
    return C.with_arms(d.contacts, d.genome).groupBy("arm1", "arm2").agg(F.count("*").alias("n"))


@query("expression_column", "SELECT abs(cuts1 - cuts2) // 1000 AS k, count(*) AS n FROM contacts WHERE chrms1 = chrms2 GROUP BY ALL")
def expression_column(d):
    own = C.with_expression(d.contacts.filter("chrms1 = chrms2"), "k", "cast(abs(cuts1 - cuts2) div 1000 as int)")
    return own.groupBy("k").agg(F.count("*").alias("n"))


@query("single_sided_filter", by_pair_sql("contacts", "chrms1 >= 0 AND chrms2 >= 0"))
def single_sided_filter(d):
    return by_pair(K.double_sided(d.contacts))


@query("same_fragment_filter", by_pair_sql("cf", "chrms1 < 0 OR chrms2 < 0 OR rfrag1 <> rfrag2"))
def same_fragment_filter(d):
    return by_pair(K.different_fragments(d.assigned))


@query(
    "same_fragment_classes",
    "SELECT CASE WHEN strands1 = strands2 THEN 'error' WHEN (cuts2 > cuts1) = strands2 THEN 'self_circle' ELSE 'dangling_end' END AS kind, count(*) AS n FROM cf WHERE chrms1 >= 0 AND chrms2 >= 0 AND rfrag1 = rfrag2 GROUP BY ALL",
)
def same_fragment_classes(d):
    return d.assigned.filter(K.SAME_FRAGMENT).groupBy(K.same_fragment_class().alias("kind")).agg(F.count("*").alias("n"))


@query("molecule_filter", by_pair_sql("contacts", f"NOT {MOLECULE}"))
def molecule_filter(d):
    return by_pair(K.not_molecules(d.contacts))


@query("molecule_filter_no_strands", by_pair_sql("contacts", "NOT (chrms1 = chrms2 AND chrms1 >= 0 AND abs(cuts1 - cuts2) <= 500)"))
def molecule_filter_no_strands(d):
    return by_pair(K.not_molecules(d.contacts, with_strands=False))


@query("valid_pairs", f"SELECT {LIST}, rfrag1, rfrag2 FROM vp")
def valid_pairs(d):
    return d.valid.select(*COLUMNS, "rfrag1", "rfrag2")


_DS = "chrms1 >= 0 AND chrms2 >= 0"
_COUNTERS = {
    "100_TotalReads": "TRUE", "150_ReadsWithoutUnusedChromosomes": "TRUE", "152_removedUnusedChromosomes": "FALSE", "200_totalDSReads": _DS, "201_DS+SS": "TRUE",
    "202_SSReadsRemoved": f"NOT ({_DS})", "210_sameFragmentReadsRemoved": f"{_DS} AND rfrag1 = rfrag2",
    "212_Self-Circles": f"{_DS} AND rfrag1 = rfrag2 AND strands1 <> strands2 AND (cuts2 > cuts1) = strands2",
    "214_DandlingEnds": f"{_DS} AND rfrag1 = rfrag2 AND strands1 <> strands2 AND (cuts2 > cuts1) <> strands2",
    "216_error": f"{_DS} AND rfrag1 = rfrag2 AND strands1 = strands2", "220_extraDandlingEndsRemoved": f"{_DS} AND rfrag1 <> rfrag2 AND {MOLECULE}", "300_ValidPairs": VALID,
}


@query("parse_counters", " UNION ALL ".join(f"SELECT '{k}' AS key, count(CASE WHEN {v} THEN 1 END) AS value FROM cf" for k, v in _COUNTERS.items()))
def parse_counters(d):
    return K.parse_counters(d.assigned)


@query("final_counters", "SELECT '400_TotalReads' AS key, count(*) AS value FROM vp UNION ALL SELECT '401_cisReads', count(*) FROM vp WHERE chrms1 = chrms2 UNION ALL SELECT '402_transReads', count(*) FROM vp WHERE chrms1 <> chrms2")
def final_counters(d):
    return K.final_counters(d.valid)


@query(
    "metadata_report",
    "SELECT key, CASE WHEN substr(key, 3, 1) <> '0' THEN chr(9) || chr(9) WHEN substr(key, 2, 1) <> '0' THEN chr(9) ELSE '' END || key || ':   ' || value AS line FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS key, count(CASE WHEN {v} THEN 1 END) AS value FROM cf" for k, v in _COUNTERS.items())
    + ")",
)
def metadata_report(d):
    return S.metadata_report(K.parse_counters(d.assigned))


@query("rsite_start_filter", by_pair_sql("vp", "abs(dists1 - fraglen1) >= 5 AND abs(dists2 - fraglen2) >= 5"))
def rsite_start_filter(d):
    return by_pair(K.rsite_start(d.valid))


@query(
    "dedup_pairs",
    "SELECT least(struct_pack(c := chrms1, p := cuts1), struct_pack(c := chrms2, p := cuts2)).c AS chrms1, least(struct_pack(c := chrms1, p := cuts1), struct_pack(c := chrms2, p := cuts2)).p AS cuts1, "
    "greatest(struct_pack(c := chrms1, p := cuts1), struct_pack(c := chrms2, p := cuts2)).c AS chrms2, greatest(struct_pack(c := chrms1, p := cuts1), struct_pack(c := chrms2, p := cuts2)).p AS cuts2 FROM vp GROUP BY ALL",
)
def dedup_pairs(d):
    return C.canonical(K.dedup_pairs(d.valid)).select("chrms1", "cuts1", "chrms2", "cuts2")


_A, _B = "chrms1 * 4000000 + cuts1", "chrms2 * 4000000 + cuts2"


@query("pair_multiplicity", f"SELECT n, count(*) AS pairs FROM (SELECT count(*) AS n FROM contacts GROUP BY least({_A}, {_B}), greatest({_A}, {_B})) GROUP BY n")
def pair_multiplicity(d):
    return K.pair_multiplicity(d.contacts)


@query("unique_interactions", "SELECT DISTINCT least(rfrag1, rfrag2) AS a, greatest(rfrag1, rfrag2) AS b FROM vp")
def unique_interactions(d):
    return K.unique_interactions(d.valid).select(F.least("rfrag1", "rfrag2").alias("a"), F.greatest("rfrag1", "rfrag2").alias("b"))


@query("fragment_size_filter", by_pair_sql("vp", "fraglen1 < 5000 AND fraglen1 > 3000 AND fraglen2 < 5000 AND fraglen2 > 3000"))
def fragment_size_filter(d):
    return by_pair(K.fragment_size(d.valid, 5000, 3000))


@query("fragment_counts", "SELECT abs_idx, n FROM fc")
def fragment_counts(d):
    return R.fragment_sum(d.valid, d.genome)


@query("fragment_counts_side1", "SELECT f.abs_idx, count(v.rfrag1) AS n FROM frag f LEFT JOIN vp v ON v.rfrag1 = f.abs_idx GROUP BY f.abs_idx")
def fragment_counts_side1(d):
    return R.fragment_sum(d.valid, d.genome, "1")


_W = "(1 + abs_idx % 4)"


@query(
    "weighted_fragment_counts",
    f"SELECT f.abs_idx, round(coalesce(sum(x.w), 0), 6) AS n FROM frag f LEFT JOIN (SELECT rfrag1 AS r, 1.0 / ((1 + rfrag1 % 4) * (1 + rfrag2 % 4)) AS w FROM vp UNION ALL SELECT rfrag2, 1.0 / ((1 + rfrag1 % 4) * (1 + rfrag2 % 4)) FROM vp) x ON x.r = f.abs_idx GROUP BY f.abs_idx",
)
def weighted_fragment_counts(d):
    w = d.genome.fragments.select("abs_idx", F.expr(f"cast({_W} as double)").alias("w"))
    return R.weighted_fragment_sum(d.valid, d.genome, w).select("abs_idx", F.round("n", 6).alias("n"))


@query("fragment_counts_to_bins", f"SELECT CAST(f.chrom * {PER} + f.mid // {RES} AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n FROM fc JOIN frag f USING (abs_idx) GROUP BY ALL")
def fragment_counts_to_bins(d):
    return R.to_bins(R.fragment_sum(d.valid, d.genome), d.genome, RES)


_EXTREME = {
    "vlim": "SELECT quantile_cont(n, 0.02) AS vl, quantile_cont(n, 0.98) AS vh FROM fc WHERE n > 0",
    "xk": "SELECT abs_idx, n FROM fc, vlim WHERE n >= vl AND n <= vh",
}


@query("extreme_fragments", "SELECT abs_idx, n FROM xk", _EXTREME)
def extreme_fragments(d):
    return K.extreme_counts(K.fragment_counts(d.valid, d.genome), 0.02, 0.02)


@query("extreme_filter", by_pair_sql("vp", "rfrag1 IN (SELECT abs_idx FROM xk) AND rfrag2 IN (SELECT abs_idx FROM xk)"), _EXTREME)
def extreme_filter(d):
    return by_pair(K.extreme(d.valid, d.genome, 0.02, 0.02))


_CIS = {
    "rat": "SELECT f.abs_idx, coalesce(s.ratio, 0) AS ratio FROM frag f LEFT JOIN (SELECT rfrag, count(CASE WHEN cis THEN 1 END) / count(*) AS ratio FROM sides GROUP BY rfrag) s ON s.rfrag = f.abs_idx",
    "ranked": "SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS k FROM rat",
    "en": "SELECT count(*) AS n, count(CASE WHEN ratio = 0 THEN 1 END) AS e FROM rat",
    "rcut": "SELECT max(CASE WHEN k = e + CAST(ceil((n - e) * 0.02) AS BIGINT) THEN ratio END) AS rl, max(CASE WHEN k = n - 1 - CAST(ceil((n - e) * 0.02) AS BIGINT) THEN ratio END) AS rh FROM ranked, en",
    "ck": "SELECT abs_idx, ratio FROM rat, rcut WHERE ratio >= rl AND ratio <= rh",
}


@query("cis_to_total_fragments", "SELECT abs_idx, round(ratio, 9) AS ratio FROM ck", _CIS)
def cis_to_total_fragments(d):
    kept = K.cis_to_total_kept(K.cis_to_total_ratios(d.valid, d.genome), d.genome.n_fragments)
    return kept.select("abs_idx", F.round("ratio", 9).alias("ratio"))


@query("cis_to_total_filter", by_pair_sql("vp", "rfrag1 IN (SELECT abs_idx FROM ck) AND rfrag2 IN (SELECT abs_idx FROM ck)"), _CIS)
def cis_to_total_filter(d):
    return by_pair(K.by_cis_to_total(d.valid, d.genome))


@query("too_close_filter", by_pair_sql("vp", "NOT (chrms1 = chrms2 AND abs(rfrag1 - rfrag2) < 2)"))
def too_close_filter(d):
    return by_pair(K.too_close(d.valid))


@query("orientation_filter", by_pair_sql("vp", "strands1 = strands2"))
def orientation_filter(d):
    return by_pair(K.orientation(d.valid))


@query("orientation_as_coded", by_pair_sql("vp", "strands1 <> strands2"))
def orientation_as_coded(d):
    return by_pair(K.orientation(d.valid, "different"))


@query("fragment_filter", by_pair_sql("vp", "rfrag1 % 3 = 0 AND rfrag2 % 3 = 0"))
def fragment_filter(d):
    return by_pair(K.on_fragments(d.valid, d.genome.fragments.filter("abs_idx % 3 = 0"), d.genome.n_fragments))


@query("genome_update", "SELECT chrms1, chrms2, " + SUMS_SQL + " FROM (SELECT CASE WHEN chrms1 < 0 THEN -1 ELSE chrms1 - 1 END AS chrms1, CASE WHEN chrms2 < 0 THEN -1 ELSE chrms2 - 1 END AS chrms2, cuts1, cuts2, strands1, strands2 FROM contacts WHERE chrms1 <> 0 AND chrms2 <> 0) GROUP BY chrms1, chrms2")
def genome_update(d):
    mapping = d.genome.chromosomes.filter("chrom > 0").select(F.col("chrom").alias("old"), (F.col("chrom") - 1).alias("new"))
    return by_pair(K.update_genome(d.contacts, mapping))


@query("cis_only", by_pair_sql("contacts", "chrms1 = chrms2 AND chrms1 >= 0"))
def cis_only(d):
    return by_pair(K.cis_only(d.contacts))


@query("exclude_chromosome", by_pair_sql("contacts", "chrms1 <> 2 AND chrms2 <> 2"))
def exclude_chromosome(d):
    return by_pair(K.without_chromosome(d.contacts, 2))


@query("random_breaks", by_pair_sql("vp", "dists1 + dists2 <= 3000"))
def random_breaks(d):
    return by_pair(K.random_breaks(d.valid, 3000))


@query("low_count_fragments", by_pair_sql("vp", "rfrag1 IN (SELECT abs_idx FROM fc WHERE n < 40) AND rfrag2 IN (SELECT abs_idx FROM fc WHERE n < 40)"))
def low_count_fragments(d):
    return by_pair(K.low_count_fragments(d.valid, d.genome, 40))


@query("hot_fragments", by_pair_sql("vp", "rfrag1 IN (SELECT abs_idx FROM fc, hv WHERE n > v) OR rfrag2 IN (SELECT abs_idx FROM fc, hv WHERE n > v)"), {"hv": "SELECT quantile_cont(n, 0.996) AS v FROM fc"})
def hot_fragments(d):
    return by_pair(K.hot_fragments(d.valid, d.genome))


@query("quasi_duplicates_one_grid", "SELECT count(*) AS n FROM (SELECT DISTINCT chrms1, chrms2, strands1, strands2, cuts1 // 500, cuts2 // 500 FROM vp)")
def quasi_duplicates_one_grid(d):
    return K.quasi_duplicates_binned(d.valid, 500, 500).agg(F.count("*").alias("n"))


@query("quasi_duplicates_binned")
def quasi_duplicates_binned(d):
    return by_pair(K.quasi_duplicates_binned(d.valid.select(*COLUMNS)))


@query("quasi_duplicates_greedy")
def quasi_duplicates_greedy(d):
    from ..operators.dedup import quasi_duplicates

    return by_pair(quasi_duplicates(C.canonical(d.contacts)))


@query("down_sample")
def down_sample(d):
    return by_pair(K.down_sample(d.contacts, 0.3))


@query("merge_datasets", by_pair_sql("contacts"))
def merge_datasets(d):
    both = d.valid2.sparkSession
    from ..fixtures import contacts

    own = contacts(both, d.sf_dir, dataset=True)
    return by_pair(C.merge(own.filter("dataset = 'even'"), own.filter("dataset = 'odd'")))


@query("merge_metadata", "SELECT key, CAST(sum(value) AS BIGINT) AS value FROM (SELECT '400_TotalReads' AS key, count(*) AS value FROM vp2 GROUP BY dataset UNION ALL SELECT '401_cisReads', count(CASE WHEN chrms1 = chrms2 THEN 1 END) FROM vp2 GROUP BY dataset) GROUP BY key")
def merge_metadata(d):
    own = d.valid2.groupBy("dataset").agg(F.count("*").alias("400_TotalReads"), F.count(F.when(F.expr("chrms1 = chrms2"), 1)).alias("401_cisReads"))
    return S.merge_metadata(own.unpivot("dataset", ["400_TotalReads", "401_cisReads"], "key", "value"))


@query(
    "rsite_distribution",
    "SELECT side, strand, value, count(*) AS n FROM (SELECT 1 AS side, strands1 AS strand, chrms1 AS c, fraglen1 - dists1 + 5 AS value FROM cf UNION ALL SELECT 2, strands2, chrms2, fraglen2 - dists2 + 5 FROM cf) WHERE c >= 0 AND value >= 0 AND value < 200 GROUP BY ALL",
)
def rsite_distribution(d):
    return R.rsite_distribution(d.assigned)


@query(
    "cis_ratio_by_count",
    "SELECT CAST(floor(round(ln(n) / ln(1.08), 9)) AS INTEGER) AS class, count(*) AS fragments, round(avg(cis / n), 6) AS cis_share FROM (SELECT rfrag, count(*) AS n, count(CASE WHEN cis THEN 1 END) AS cis FROM sides GROUP BY rfrag) GROUP BY ALL",
)
def cis_ratio_by_count(d):
    return R.cis_ratio_by_count(d.valid, d.genome).withColumn("cis_share", F.round("cis_share", 6))


@query("cis_far_fraction", "SELECT round(avg(CASE WHEN distance > 20000 THEN 1.0 ELSE 0.0 END), 9) AS share FROM vp WHERE chrms1 = chrms2")
def cis_far_fraction(d):
    return K.cis_only(d.valid).agg(F.round(F.avg((F.col("distance") > 20000).cast("double")), 9).alias("share"))


@query("top_fragments", "SELECT abs_idx, n FROM fc ORDER BY n DESC, abs_idx LIMIT 10")
def top_fragments(d):
    from ..functions.stats import largest

    return largest(R.fragment_sum(d.valid, d.genome), "n", 10, "abs_idx")
