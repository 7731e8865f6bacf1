"""Readers, writers and streams, by round trips and against the batch forms."""

import random

import pytest

from contactloom import fixtures
from contactloom.operators import dedup as D
from contactloom.operators import heatmap as H
from contactloom.operators.contacts import assign_fragments
from contactloom.sources import contacts as S
from contactloom.sources import maps as M
from contactloom.sources import reads as R
from contactloom.sources import tables as T
from contactloom.streaming import dedup as Z

SCHEMA = "chrms1 int, cuts1 int, strands1 boolean, chrms2 int, cuts2 int, strands2 boolean"


def _contacts(spark, n=400, seed=7):
    r = random.Random(seed)
    return spark.createDataFrame([(r.randrange(3), r.randrange(2_000_000), r.random() < 0.5, r.randrange(3), r.randrange(2_000_000), r.random() < 0.5) for _ in range(n)], SCHEMA)


def test_contacts_round_trip(spark, tmp_path):
    own = _contacts(spark)
    path = str(tmp_path / "c")
    S.write(own, path, metadata={"100_TotalReads": 400})
    assert sorted(map(tuple, S.read(spark, path).collect())) == sorted(map(tuple, own.collect()))
    assert S.read_metadata(spark, path) == {"100_TotalReads": 400}
    with pytest.raises(Exception, match="(?i)exists"):
        S.write(own, path)


def test_maps_round_trip(spark, tmp_path):
    g = fixtures.genome(spark)
    own = assign_fragments(_contacts(spark), g)
    px = H.all_by_all(own, g, 100_000)
    M.write_heatmap(px, g.bins(100_000), str(tmp_path / "h"), 100_000)
    back, bins = M.read_heatmap(spark, str(tmp_path / "h"), 100_000)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect())) and bins.count() == 100
    with pytest.raises(ValueError):
        M.read_heatmap(spark, str(tmp_path / "h"), 200_000)
    M.write_by_chromosome(H.by_chromosome(own, g, 100_000), str(tmp_path / "b"))
    whole = M.whole_from_blocks(M.read_by_chromosome(spark, str(tmp_path / "b")), g, 100_000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, px.collect()))


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("".join(f"@r{i}/1 x\nACGTN\n+\nII{chr(40 + i % 5)}II\n" for i in range(100)))
    own = R.fastq(spark, str(tmp_path / "r.fastq"))
    rows = own.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(100)) and rows[7]["id"] == "r7/1 x" and rows[7]["seq"] == "ACGTN"
    assert tuple(R.quality_range(own).first()) == (40, 73, 400) and R.phred_offset(40) == 33
    ids = spark.createDataFrame([("r3",), ("r50",)], "id string")
    assert R.filter_fastq(own, ids).count() == 2
    chunks = R.chunk_numbers(own, 100, 45).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in chunks) == [45, 55]
    R.write_chunks(own, str(tmp_path / "out"), 100, 45)
    assert spark.read.text(str(tmp_path / "out")).count() == 400


def test_fastq_in_parts(spark, tmp_path):
    """Records stay whole however files are cut and dealt to tasks."""
    for k, n in enumerate((60, 100)):
        (tmp_path / f"f{k}.fastq").write_text("".join(f"@f{k}r{i}\nACGT{'N' * (i % 7)}\n+\nIIII{'#' * (i % 7)}\n" for i in range(n)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    try:
        rows = R.fastq(spark, str(tmp_path)).orderBy("n").collect()
    finally:
        spark.conf.set(name, before)
    assert [r["id"] for r in rows] == [f"f0r{i}" for i in range(60)] + [f"f1r{i}" for i in range(100)]
    assert all(r["seq"].startswith("ACGT") and set(r["qual"]) <= set("I#") and len(r["seq"]) == len(r["qual"]) for r in rows)


def test_sam_edge_lines(spark):
    lines = ["@HD\tVN:1", "a\t0\tchr1\t11\t30\t5M\t*\t0\t0\tACGTA\tIIIII\tMD:Z:5", "b\t16\tchr1\t11\t30\t5M\t*\t0\t0\tACGTA\tIIIII\tMD:Z:2A2", "c\t16\tchr1\t11\t30\t5M\t*\t0\t0\tACGTA\tIIIII", "d\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI", "e\t0\tchrZ\t5\t30\t1M\t*\t0\t0\tA\tI\tMD:Z:1"]
    own = R.mapped(R.parse_sam(spark.createDataFrame([(x,) for x in lines], "line string")), fixtures.genome(spark))
    got = {r["id"]: r["cuts"] for r in R.side(own).collect()}
    assert got == {"a": 10, "b": 14}


def test_iterative_mapping_retries_what_is_left(spark):
    reads = spark.createDataFrame([(f"r{i}", "A" * 50) for i in range(10)], "id string, seq string")

    def align(df):
        return df.selectExpr("id AS qname", "0 AS flag", "'chr1' AS rname", "1 AS pos", "CASE WHEN length(seq) >= 25 + cast(substr(id, 2) as int) THEN 30 ELSE 0 END AS mapq", "seq", "'5' AS md", "false AS has_xs")

    assert R.iterative_mapping(reads, align, 25, 5, 40).count() == 10
    assert R.truncations(50, 25) == [25, 34, 42, 50] and R.truncations(20, 25) == [20] and len(R.truncations(500, 25)) == 5
    for length, least in ((26, 25), (36, 25), (75, 25), (101, 30)):
        own = R.truncations(length, least)
        assert own[-1] == length and own[0] == least and own == sorted(set(own))


def test_wiggle_and_manifest(spark, tmp_path):
    (tmp_path / "w.wig").write_text("track x\nfixedStep chrom=chr1 start=11 step=10\n1.5\n2.5\nvariableStep chrom=chr2\n5 3\nchr3\t7\t9\t4\n")
    got = sorted(map(tuple, T.wiggle(spark, str(tmp_path / "w.wig")).collect()))
    assert got == [("chr1", 10, 1.5), ("chr1", 20, 2.5), ("chr2", 4, 3.0), ("chr3", 7, 4.0)]
    (tmp_path / "m.tsv").write_text("# c\nf1 e R1 hg19 HindIII\nbad line\nf2 e R2 hg19 HindIII # note\n")
    assert T.manifest_groups(T.manifest(spark, str(tmp_path / "m.tsv"))).first()["files"] == 2


def test_streams_equal_batches(spark, tmp_path):
    r = random.Random(9)
    rows = sorted({(0, r.randrange(20_000), r.random() < 0.5, r.randrange(2), r.randrange(3000), r.random() < 0.5) for _ in range(600)}, key=lambda x: (x[1], x[4]))
    for k in range(3):  # files in order of position
        spark.createDataFrame(rows[k * 200 : (k + 1) * 200], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    got = run(Z.quasi_duplicates(stream, 500), "greedy").select("chrms1", "cuts1", "strands1", "chrms2", "cuts2", "strands2").collect()
    want = D.quasi_duplicates(spark.createDataFrame(rows, SCHEMA), 500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert run(Z.unique_pairs(stream), "pairs").count() == len({tuple(sorted([(a, b), (d, e)])) for a, b, c, d, e, f in rows})
    counts = run(Z.pixel_counts(stream, 1000), "pixels", "complete")
    assert sum(r["value"] for r in counts.collect()) == len(rows)


def test_sides_by_the_farthest_place(spark):
    rows = [("q1/1", 0, 2, -1, "5"), ("q1/1", 16, 2, 7, "5"), ("q2/1", 0, 0, -1, "5"), ("q3/1", 16, 1, 3, None), ("q4/1", 0, 3, 2**31 - 1, "5"), ("q4/1", 0, 1, 9, "5"), ("q5/1", 0, 1, 8, "5"), ("q5/1", 16, 1, 4, "5")]
    own = R.side(spark.createDataFrame(rows, "qname string, flag int, chrom int, pos int, md string"))
    assert sorted(map(tuple, own.collect())) == [("q1", 2, 11, False), ("q2", 0, -1, True), ("q4", 3, 2**31 - 1, True), ("q5", 1, 8, True)]


def test_tags_of_lines(spark):
    head = "a\t0\tchr1\t11\t30\t5M\t*\t0\t0\tMD:Z:9\tXS:i:1"
    lines = [head, head + "\tMD:Z:2A2", head + "\tNM:i:0\tMD:Z:3\tMD:Z:4\tXS:i:3", head + "\tYMD:Z:1\tAXS:i:1", head + "\tMD:Z:\tMD:Z:4", "@HD\tVN:1", ""]
    got = [(r["md"], r["has_xs"]) for r in R.parse_sam(spark.createDataFrame([(x,) for x in lines[:5]], "line string")).collect()]
    assert got == [(None, False), ("2A2", False), ("3", True), (None, False), (None, False)]


def test_lines_are_split_once(spark):
    made = spark.range(3).selectExpr("concat_ws('\t', id, '0', 'chr1', '5', '30', '5M', '*', '0', '0', 'A', 'I', 'MD:Z:5') AS line")
    plan = R.mapped(R.parse_sam(made), fixtures.genome(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
