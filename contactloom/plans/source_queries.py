"""Queries on mapped reads and small tables, from lines of text made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as K
from ..sources import reads as R
from ..sources import tables as T
from ..workspace import Workspace
from .registry import query
from .sql import VALID

_MD = "CASE l_linenumber % 3 WHEN 0 THEN '50' WHEN 1 THEN '20A29' ELSE '10^AC38' END"
_SPAN = "CASE l_linenumber % 3 WHEN 0 THEN 49 WHEN 1 THEN 49 ELSE 48 END"


def _line(side: str) -> str:
    """A SAM line of one side, the same text in both engines."""
    from ..fixtures import CHRMS1, CHRMS2, CUTS1, CUTS2

    chrom, cut = (CHRMS1, CUTS1) if side == "1" else (CHRMS2, CUTS2)
    reverse = "l_returnflag = 'A'" if side == "1" else "l_linestatus = 'O'"
    fields = [
        f"concat('q', CAST(l_orderkey * 8 + l_linenumber AS STRING), '/{side}')",
        f"CASE WHEN {reverse} THEN '0' ELSE '16' END",
        f"concat('chr', CAST({chrom} + 1 AS STRING))",
        f"CAST({cut} + 1 AS STRING)",
        "CAST(l_linenumber % 4 * 10 AS STRING)",
        "'50M'", "'*'", "'0'", "'0'", "repeat('ACGTT', 10)", "repeat('I', 50)",
        f"concat('MD:Z:', {_MD})",
    ]
    return "concat_ws('\\t', " + ", ".join(fields) + ", CASE WHEN l_partkey % 11 = 0 THEN 'XS:i:3' END)"


def _lines(d, side: str):
    return d.table("lineitem").select(F.expr(_line(side)).alias("line"))


_GOOD = "l_linenumber % 4 > 0 AND l_partkey % 11 <> 0"


def _both() -> dict[str, str]:
    from ..fixtures import CONTACTS

    own = "l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, " + ", ".join(CONTACTS)
    out = {"li": f"SELECT {own} FROM lineitem"}
    for s, rev in (("1", "l_returnflag = 'A'"), ("2", "l_linestatus = 'O'")):
        out[f"rd{s}"] = (
            f"SELECT 'q' || (l_orderkey * 8 + l_linenumber) AS id, chrms{s} AS chrom, CAST(CASE WHEN {rev} THEN cuts{s} ELSE cuts{s} + {_SPAN} END AS INTEGER) AS cut, {rev} AS fwd FROM li WHERE {_GOOD} AND chrms{s} >= 0"
        )
        out[f"sd{s}"] = f"SELECT id, m.a AS chrms, m.b AS cuts, m.c AS strands FROM (SELECT id, max(struct_pack(a := chrom, b := cut, c := fwd)) AS m FROM rd{s} GROUP BY id)"
    return out


@query("sam_mapped", "SELECT chrom, count(*) AS n, count(CASE WHEN fwd THEN 1 END) AS forward FROM rd1 GROUP BY chrom", _both())
def sam_mapped(d):
    own = R.mapped(R.parse_sam(_lines(d, "1")), d.genome)
    return own.groupBy("chrom").agg(F.count("*").alias("n"), F.count(F.when(~R.is_reverse(), 1)).alias("forward"))


@query("md_five_prime", "SELECT id, chrom, cut FROM rd1", _both())
def md_five_prime(d):
    own = R.mapped(R.parse_sam(_lines(d, "1")), d.genome)
    return own.select(R.bare_id(F.col("qname")).alias("id"), "chrom", R.five_prime().alias("cut"))


@query("five_prime_by_length", "SELECT chrom, CAST(sum(CASE WHEN fwd THEN cuts1 ELSE cuts1 + 50 END) AS BIGINT) AS total FROM (SELECT chrms1 AS chrom, cuts1, l_returnflag = 'A' AS fwd FROM li WHERE l_linenumber % 4 > 0 AND l_partkey % 11 <> 0 AND chrms1 >= 0) GROUP BY chrom", _both())
def five_prime_by_length(d):
    own = R.mapped(R.parse_sam(_lines(d, "1")), d.genome)
    return own.groupBy("chrom").agg(F.sum(R.five_prime(with_seq=True).cast("long")).alias("total"))


_PAIRED = "SELECT id, coalesce(a.chrms, -1) AS chrms1, coalesce(a.cuts, -1) AS cuts1, coalesce(a.strands, FALSE) AS strands1, coalesce(b.chrms, -1) AS chrms2, coalesce(b.cuts, -1) AS cuts2, coalesce(b.strands, FALSE) AS strands2 FROM sd1 a FULL JOIN sd2 b USING (id)"


def _paired(d):
    return R.pair_sides(*[R.side(R.mapped(R.parse_sam(_lines(d, s)), d.genome)) for s in "12"])


@query("pair_sides", _PAIRED, _both())
def pair_sides(d):
    return _paired(d)


def _site_sql() -> dict[str, str]:
    out = _both() | {"pairs": _PAIRED}
    for s in "12":
        v = f"greatest(1, least(cuts{s}, 1999999))"
        out[f"si{s}"] = (
            f"SELECT p.id, p.strands{s} AS st, CASE WHEN abs(CASE WHEN p.strands{s} THEN f.fe ELSE f.fs END - p.v) <= 3 THEN greatest(f.chrom * 500, least(f.chrom * 500 + 499, f.abs_idx + 2 * CAST(p.strands{s} AS INTEGER) - 1)) ELSE f.abs_idx END AS m "
            f"FROM (SELECT *, {v} AS v FROM pairs WHERE chrms{s} >= 0) p ASOF JOIN frag f ON p.chrms{s} = f.chrom AND p.v > f.fs"
        )
    return out


@query(
    "fill_sites",
    "SELECT p.id, "
    + ", ".join(
        f"CAST(coalesce(g{s}.abs_idx % 500, -1) AS BIGINT) AS rfragIdxs{s}, CAST(coalesce(g{s}.fs, -1) AS BIGINT) AS uprsites{s}, CAST(coalesce(g{s}.fe, -1) AS BIGINT) AS downrsites{s}, CAST(coalesce(CASE WHEN si{s}.st THEN g{s}.fe ELSE g{s}.fs END, -1) AS BIGINT) AS rsites{s}"
        for s in "12"
    )
    + " FROM pairs p "
    + " ".join(f"LEFT JOIN si{s} ON si{s}.id = p.id LEFT JOIN frag g{s} ON g{s}.abs_idx = si{s}.m" for s in "12"),
    _site_sql(),
)
def fill_sites(d):
    own = R.fill_sites(_paired(d), d.genome)
    return own.select("id", *[c + s for s in "12" for c in ("rfragIdxs", "uprsites", "downrsites", "rsites")])


@query("read_statistics", "SELECT CAST(max(length('q' || (l_orderkey * 8 + l_linenumber) || '/1')) AS INTEGER) AS id_len, 50 AS seq_len, count(*) AS num_reads FROM lineitem")
def read_statistics(d):
    return R.read_statistics(R.parse_sam(_lines(d, "1")))


@query("reverse_complement", "SELECT p_partkey, reverse(translate(s, 'ACGT', 'TGCA')) AS rc FROM (SELECT p_partkey, translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ACGTACGTAC') AS s FROM part)")
def reverse_complement(d):
    s = F.translate(F.col("p_partkey").cast("string"), "0123456789", "ACGTACGTAC")
    return d.table("part").select("p_partkey", R.reverse_complement(s).alias("rc"))


@query("unmapped_rest", "SELECT 'q' || (l_orderkey * 8 + l_linenumber) AS id FROM lineitem EXCEPT SELECT id FROM rd1", _both())
def unmapped_rest(d):
    reads = R.parse_sam(_lines(d, "1"))
    good = R.mapped(reads, d.genome).select(R.bare_id(F.col("qname")).alias("id"))
    return reads.select(R.bare_id(F.col("qname")).alias("id")).distinct().join(good, "id", "left_anti")


@query("fastq_chunks", "SELECT CAST(least(n // 400, CASE WHEN total - (total - 1) // 400 * 400 < 400 / 3.0 AND total > 400 THEN (total - 1) // 400 - 1 ELSE (total - 1) // 400 END) AS INTEGER) AS chunk, count(*) AS records FROM (SELECT p_partkey - 1 AS n FROM part), (SELECT count(*) AS total FROM part) GROUP BY ALL")
def fastq_chunks(d):
    own = d.table("part").select((F.col("p_partkey") - 1).alias("n"))
    return R.chunk_numbers(own, own.count(), 400).groupBy("chunk").agg(F.count("*").alias("records"))


@query("fastq_records", "SELECT p_partkey AS n, 'r' || p_partkey || '/1' AS id, repeat('ACGTN', CAST(1 + p_partkey % 9 AS INTEGER)) AS seq, repeat('I', CAST(5 + p_partkey % 9 * 5 AS INTEGER)) AS qual FROM part")
def fastq_records(d):
    """Reads written as several FASTQ files and read again."""
    space = Workspace(d.spark, "fastq")
    own = d.table("part").selectExpr("p_partkey AS n", "concat('r', p_partkey, '/1') AS id", "repeat('ACGTN', cast(1 + p_partkey % 9 AS int)) AS seq", "repeat('I', cast(5 + p_partkey % 9 * 5 AS int)) AS qual")
    R.write_fastq(own, space.path("reads"))
    return R.fastq(d.spark, space.path("reads"))


_NAMES = "'exp' || (s_suppkey % 7) || CASE s_suppkey % 4 WHEN 0 THEN '-R1-' WHEN 1 THEN '-R2-' WHEN 2 THEN '-all-' ELSE '-' END || CASE s_suppkey % 3 WHEN 0 THEN 'HindIII' WHEN 1 THEN 'NcoI' ELSE 'none' END"


def _bases(d):
    return d.table("supplier").select(F.expr(_NAMES).alias("base")).distinct()


@query("enzymes", f"SELECT DISTINCT base, CASE WHEN base LIKE '%HindIII%' THEN 'HindIII' WHEN base LIKE '%NcoI%' THEN 'NcoI' END AS enzyme FROM (SELECT {_NAMES} AS base FROM supplier)")
def enzymes(d):
    return _bases(d).select("base", T.enzyme_of("base").alias("enzyme"))


@query(
    "catalog_masters",
    r"SELECT base, replica, NOT replica OR base LIKE '%-all%' OR regexp_replace(base, '-R\d.*-', '-all-') NOT IN (SELECT base FROM nb) AS master FROM (SELECT base, len(regexp_extract_all(base, '-R\d')) = 1 AS replica FROM nb)",
    {"nb": f"SELECT DISTINCT {_NAMES} AS base FROM supplier"},
)
def catalog_masters(d):
    return T.with_masters(_bases(d))


_FILES = "'exp' || (p_partkey % 5) || '-' || CASE p_partkey % 4 WHEN 0 THEN '10k' WHEN 1 THEN '200k' WHEN 2 THEN '1M' ELSE 'raw' END || CASE WHEN p_partkey % 2 = 0 THEN '.hm' ELSE '-x.hm' END"


@query("catalog_resolutions", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 10000 WHEN 1 THEN 200000 WHEN 2 THEN 1000000 ELSE -1 END::BIGINT AS resolution FROM part")
def catalog_resolutions(d):
    return d.table("part").withColumn("name", F.expr(_FILES)).select("p_partkey", F.coalesce(T.resolution_of("name").cast("long"), F.lit(-1).cast("long")).alias("resolution"))


_KEYS = "CASE p_partkey % 5 WHEN 0 THEN {a}'chrms1'{z} WHEN 1 THEN {a}'heatmap', 'resolution'{z} WHEN 2 THEN {a}'0 0', '0 1'{z} WHEN 3 THEN {a}'0 0', '1 1'{z} ELSE {a}'chr1_0_500'{z} END"


@query("catalog_classes", "SELECT kind, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'fragments' WHEN 1 THEN 'heatmap' WHEN 2 THEN 'byChr' WHEN 3 THEN 'byChrCis' ELSE 'byChrSuper' END AS kind FROM part) GROUP BY kind")
def catalog_classes(d):
    own = d.table("part").select(F.expr(_FILES).alias("name"), F.expr(_KEYS.format(a="array(", z=")")).alias("keys"))
    return T.classify(own).groupBy("kind").agg(F.count("*").alias("n"))


@query("catalog_least_resolution", "SELECT experiment, CAST(min(r) AS BIGINT) AS resolution FROM (SELECT 'exp' || (p_partkey % 5) AS experiment, CASE p_partkey % 4 WHEN 0 THEN 10000 WHEN 1 THEN 200000 WHEN 2 THEN 1000000 END AS r, p_partkey % 5 AS k FROM part) WHERE k > 0 GROUP BY ALL")
def catalog_least_resolution(d):
    own = d.table("part").select(F.expr("concat('exp', p_partkey % 5)").alias("experiment"), F.expr(_FILES).alias("name"), F.expr(_KEYS.format(a="array(", z=")")).alias("keys"))
    return T.least_resolution(T.classify(own))


@query("manifest_groups", "SELECT 'e' || (o_orderkey % 9) AS experiment, 'hg19' AS genome, CASE WHEN o_orderkey % 2 = 0 THEN 'HindIII' ELSE 'MboI' END AS enzyme, count(*) AS files, count(DISTINCT o_orderkey % 3) AS replicas FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY ALL")
def manifest_groups(d):
    line = "concat_ws('\\t', CASE WHEN o_orderkey % 10 = 3 THEN '# left out' END, concat('f', o_orderkey), concat('e', o_orderkey % 9), concat('R', o_orderkey % 3), 'hg19', CASE WHEN o_orderkey % 2 = 0 THEN 'HindIII' ELSE 'MboI' END)"
    return T.manifest_groups(T.manifest_lines(d.table("orders").select(F.expr(line).alias("line"))))


@query("centromeres", "SELECT CAST(s_suppkey % 6 AS INTEGER) AS chrom, min(s_suppkey * 10) AS start, max(s_suppkey * 10 + 7) AS \"end\" FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY ALL")
def centromeres(d):
    own = d.table("supplier").selectExpr("CASE WHEN s_suppkey % 2 = 0 THEN concat('CEN', s_suppkey % 6) ELSE 'ARS' END AS name", "s_suppkey * 10 AS start", "s_suppkey * 10 + 7 AS end")
    return T.centromeres(own)


@query("loop_anchors", "SELECT 'chr' || (p_partkey % 5) AS chrom, (p_partkey * 20 + 1000) // 2 AS start, (p_partkey * 40 + 3000) // 2 AS \"end\" FROM part")
def loop_anchors(d):
    own = d.table("part").selectExpr("concat('chr', p_partkey % 5) AS a", "p_partkey * 10 AS b", "p_partkey * 10 + 1000 AS c", "concat('chr', p_partkey % 5) AS d", "p_partkey * 20 AS e", "p_partkey * 20 + 3000 AS f")
    return T.interval_columns(own)


@query("eigenvector_text", "SELECT CAST(p_partkey AS INTEGER) AS bin, p_size / 4.0 AS value FROM part")
def eigenvector_text(d):
    return T.eigenvector_text(d.table("part").select(F.expr("concat(p_partkey, '  ', cast(p_size / 4 as string))").alias("line")))


@query(
    "sample_statistics",
    "SELECT dataset, total AS \"100_TotalReads\", ds AS \"200_totalDSReads\", valid AS \"300_ValidPairs\", cis AS \"401_cisReads\", trans AS \"402_transReads\", round(ds / total, 6) AS ds_share, round(valid / ds, 6) AS valid_share, round(cis / trans, 6) AS cis_to_trans, upper(dataset) AS cell FROM ("
    f"SELECT dataset, count(*) AS total, count(CASE WHEN chrms1 >= 0 AND chrms2 >= 0 THEN 1 END) AS ds, count(CASE WHEN {VALID} THEN 1 END) AS valid, count(CASE WHEN {VALID} AND chrms1 = chrms2 THEN 1 END) AS cis, count(CASE WHEN {VALID} AND chrms1 <> chrms2 THEN 1 END) AS trans FROM cf2 GROUP BY dataset)",
)
def sample_statistics(d):
    from ..fixtures import contacts
    from ..operators.contacts import assign_fragments

    own = assign_fragments(contacts(d.spark, d.sf_dir, dataset=True), d.genome, ("abs_idx",))
    valid = F.expr(K.DOUBLE_SIDED) & F.expr("rfrag1 <> rfrag2") & ~K.is_molecule(500)
    n = lambda c: F.count(F.when(c, 1))
    wide = own.groupBy("dataset").agg(
        F.count("*").alias("100_TotalReads"), n(F.expr(K.DOUBLE_SIDED)).alias("200_totalDSReads"), n(valid).alias("300_ValidPairs"),
        n(valid & F.expr("chrms1 = chrms2")).alias("401_cisReads"), n(valid & F.expr("chrms1 <> chrms2")).alias("402_transReads"),
    )
    keys = [c for c in wide.columns if c != "dataset"]
    sheet = d.spark.createDataFrame([("even", "EVEN"), ("odd", "ODD")], "dataset string, cell string")
    out = T.sample_statistics(wide.unpivot("dataset", keys, "key", "value"), sheet)
    return out.withColumns({c: F.round(c, 6) for c in ("ds_share", "valid_share", "cis_to_trans")})


@query("nearest_domain", 'SELECT chrom, start, "end", "end" - start AS size FROM domains ORDER BY abs("end" - start - 250000), start, chrom LIMIT 1')
def nearest_domain(d):
    own = d.domains.withColumn("size", F.col("end") - F.col("start"))
    return own.orderBy(F.abs(F.col("size") - 250_000), "start", "chrom").limit(1)


@query("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT rfrag1 FROM vp UNION SELECT rfrag2 FROM vp) UNION ALL SELECT 'intersect', count(*) FROM (SELECT rfrag1 FROM vp INTERSECT SELECT rfrag2 FROM vp) UNION ALL SELECT 'except', count(*) FROM (SELECT rfrag1 FROM vp EXCEPT SELECT rfrag2 FROM vp)")
def set_operations(d):
    # one pass: on which sides each fragment occurs
    each = d.valid.select(F.explode(F.array(*[F.struct(F.col("rfrag" + s).alias("r"), F.lit(s == "1").alias("a"), F.lit(s == "2").alias("b")) for s in "12"])).alias("x")).select("x.*")
    each = each.groupBy("r").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = each.agg(F.count("*").alias("union"), F.count(F.expr("if(a AND b, 1, null)")).alias("intersect"), F.count(F.expr("if(a AND NOT b, 1, null)")).alias("except"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"`{op}`").alias("n")) for op in ("union", "intersect", "except")])).alias("x")).select("x.*")
