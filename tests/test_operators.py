"""Operators against brute force, dense numpy and the identities between counters."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactloom import fixtures
from contactloom.functions.stats import spearman
from contactloom.genome import Genome
from contactloom.operators import balance as B
from contactloom.operators import compartments as E
from contactloom.operators import contacts as C
from contactloom.operators import dedup as D
from contactloom.operators import filters as K
from contactloom.operators import heatmap as H
from contactloom.operators import pileup as U
from contactloom.operators import pixels as P
from contactloom.operators import scaling as S
from contactloom.operators import tracks as T
from contactloom.operators.rangejoin import points_in_intervals

SCHEMA = "chrms1 int, cuts1 int, strands1 boolean, chrms2 int, cuts2 int, strands2 boolean"


@pytest.fixture(scope="module")
def genome(spark):
    return fixtures.genome(spark)


@pytest.fixture(scope="module")
def contacts(spark):
    r = random.Random(1)
    rows = []
    for _ in range(3000):
        c = r.choice([-1, 0, 1, 2, 3, 4])
        p = r.randrange(0, 2_000_000)
        rows.append((c, p, r.random() < 0.5, r.choice([c, c, r.randrange(5)]), min(1_999_999, max(0, p + r.randrange(-30_000, 30_000))), r.random() < 0.5))
    rows += rows[:200] + [(d, e, f, a, b, c) for a, b, c, d, e, f in rows[200:300]]
    rows = [(a, b, c, max(0, d), e, f) for a, b, c, d, e, f in rows]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def assigned(contacts, genome):
    return C.with_distances(C.assign_fragments(contacts, genome)).cache()


def test_assignment_is_the_only_fragment_that_holds_the_key(assigned, genome):
    frags = genome.fragments.toPandas()
    for r in assigned.limit(300).collect():
        for s in "12":
            chrom, key = r["chrms" + s], max(1, min(2_000_000, r["cuts" + s] + 7 * int(r["strands" + s]) - 3))
            own = frags[(frags.chrom == chrom) & (frags.fs < key) & (frags.fe >= key)]
            assert r["rfrag" + s] == (own.abs_idx.iloc[0] if len(own) else -1)


def test_range_join_equals_pure_range_predicate(spark):
    r = random.Random(2)
    p = spark.createDataFrame([(r.randrange(2), r.randrange(1000)) for _ in range(200)], "k int, x int")
    i = spark.createDataFrame([(r.randrange(2), a, a + r.randrange(200)) for a in [r.randrange(900) for _ in range(50)]], "k int, a int, z int")
    got = points_in_intervals(p, F.col("x"), i, ["k"], "a", "z", 50).select("k", "x", "a", "z").toPandas()
    one, two = p.toPandas(), i.toPandas()
    want = one.merge(two, on="k").query("x > a and x <= z")
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, want[["k", "x", "a", "z"]].values))


def test_counters_add_up(assigned):
    n = {r["key"]: r["value"] for r in K.parse_counters(assigned).collect()}
    assert n["100_TotalReads"] - n["152_removedUnusedChromosomes"] == n["150_ReadsWithoutUnusedChromosomes"]
    assert n["201_DS+SS"] - n["202_SSReadsRemoved"] == n["200_totalDSReads"]
    assert n["212_Self-Circles"] + n["214_DandlingEnds"] + n["216_error"] == n["210_sameFragmentReadsRemoved"]
    assert n["200_totalDSReads"] - n["210_sameFragmentReadsRemoved"] - n["220_extraDandlingEndsRemoved"] == n["300_ValidPairs"]
    valid = K.valid_pairs(assigned)
    assert valid.count() == n["300_ValidPairs"]
    f = {r["key"]: r["value"] for r in K.final_counters(valid).collect()}
    assert f["401_cisReads"] + f["402_transReads"] == f["400_TotalReads"] == n["300_ValidPairs"]


def test_dedup_ignores_sides_and_strands(contacts):
    want = {tuple(sorted([(r.chrms1, r.cuts1), (r.chrms2, r.cuts2)])) for r in contacts.collect()}
    got = K.dedup_pairs(contacts).collect()
    assert len(got) == len(want)
    assert {tuple(sorted([(r.chrms1, r.cuts1), (r.chrms2, r.cuts2)])) for r in got} == want


def test_dedup_does_not_hang_on_partitions(contacts):
    a = K.dedup_pairs(contacts.repartition(1)).toPandas()
    b = K.dedup_pairs(contacts.repartition(13)).toPandas()
    assert sorted(map(tuple, a.values)) == sorted(map(tuple, b.values))


def _greedy(rows, offset, method):
    gone, out = set(), []
    for i, a in enumerate(rows):
        if i in gone:
            continue
        out.append(a)
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if b[0] != a[0] or b[1] - a[1] >= offset:
                break
            d = [abs(a[1] - b[1]), abs(a[4] - b[4])]
            if (a[2], a[3], a[5]) == (b[2], b[3], b[5]) and (max(d) if method == "max" else sum(d)) < offset:
                gone.add(j)
    return sorted(out)


@pytest.mark.parametrize("method", ["max", "sum"])
def test_greedy_quasi_duplicates(spark, method):
    r = random.Random(5)
    chain = [(0, 1000 + 300 * k, True, 0, 9000 + 10 * k, False) for k in range(6)]
    rows = chain + [(r.randrange(2), r.randrange(5000), r.random() < 0.5, r.randrange(2), r.randrange(5000), r.random() < 0.5) for _ in range(400)]
    rows = sorted(set(rows), key=lambda x: (x[0], x[1], x[4], x[3], x[2], x[5]))
    got = D.quasi_duplicates(spark.createDataFrame(rows, SCHEMA), 500, method).collect()
    assert sorted(map(tuple, got)) == _greedy(rows, 500, method)


def test_map_identities(assigned, genome):
    valid = K.valid_pairs(assigned)
    once = H.all_by_all(valid, genome, 100_000)
    twice = H.all_by_all(valid, genome, 100_000, "twice")
    diagonal = once.filter("bin1 = bin2").agg(F.sum("value")).first()[0]
    total = once.agg(F.sum("value")).first()[0]
    assert twice.agg(F.sum("value")).first()[0] == total + diagonal
    assert H.by_chromosome(valid, genome, 100_000).agg(F.sum("value")).first()[0] == total == valid.count()
    spread = H.overlap(valid, genome, 20_000)
    assert abs(spread.agg(F.sum("value")).first()[0] - total) < 1e-6
    coarse = H.coarsegrain(once, 5)
    assert coarse.agg(F.sum("value")).first()[0] == total


def _pixels(spark, n=30, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.poisson(20, (n, n))
    m = np.triu(m) + np.triu(m, 1).T
    m[4] = m[:, 4] = 0
    i, j = np.nonzero(np.triu(m))
    rows = [(int(a), int(b), int(m[a, b])) for a, b in zip(i, j, strict=True)]
    return m.astype(float), spark.createDataFrame(rows, "bin1 int, bin2 int, value long")


def _dense_balance(m, passes):
    bias = np.ones(len(m))
    x = m.copy()
    for _ in range(passes):
        s = x.sum(0)
        s = s / s[s != 0].mean()
        s[s == 0] = 1
        x = x / s[:, None] / s[None, :]
        bias *= s
    return x, bias


def test_balancing_equals_dense(spark):
    m, px = _pixels(spark)
    want, bias = _dense_balance(m, 6)
    for got in (B.balance(px, 6, 0.0), B.balance(px, 6, 0.0, in_task=0), B.fixed_passes(px, 6, 30)):
        own = {r["bin"]: r["bias"] for r in got.collect()}
        assert all(abs(own[k] - bias[k]) < 1e-9 for k in own) and len(own) == 29
    own = B.corrected(px, B.balance(px), 30).toPandas()
    sums = np.zeros(30)
    for a, b, v in own.itertuples(index=False):
        sums[a] += v
        sums[b] += v if a != b else 0
    assert sums[sums > 0].var() < 1e-4


def test_observed_over_expected_and_percentile(spark):
    m, px = _pixels(spark)
    bins = spark.range(30).selectExpr("cast(id as int) as bin", "0 as chrom")
    own = S.observed_over_expected(P.with_chroms(px, bins, 30), bins).collect()
    for r in own:
        assert abs(r["value"] - m[r["bin1"], r["bin2"]] / np.diagonal(m, r["d"]).mean()) < 1e-9
    for p in (0.01, 0.05, 0.3, 0.9, 0.999, 1.0):
        weight = F.when(F.col("bin1") == F.col("bin2"), 1).otherwise(2)
        got = P.percentile_with_zeros(px.withColumn("value", F.col("value").cast("double")), weight, 900, p).first()[0]
        assert abs(got - np.percentile(m, 100 * p)) < 1e-9


def test_spearman_with_ties(spark):
    r = random.Random(4)
    f = pd.DataFrame({"x": [r.randrange(8) for _ in range(200)], "y": [r.randrange(8) for _ in range(200)]})
    want = np.corrcoef(f.x.rank(), f.y.rank())[0, 1]
    assert abs(spearman(spark.createDataFrame(f), "x", "y").first()["rho"] - want) < 1e-9


def test_scaling_has_the_slope_it_was_made_with(spark):
    """Separations are log-uniform, so the probability falls as 1 / distance."""
    chroms = spark.createDataFrame([(0, "c", 4_000_000, 1_990_000, 2_010_000, 2_000_000)], "chrom int, label string, len long, cntr_start long, cntr_end long, cntr_mid long")
    g = Genome.uniform(chroms, 500)
    own = spark.range(60_000).select(
        F.lit(0).alias("chrms1"), (F.rand(1) * 2_000_000 + 500_000).cast("int").alias("cuts1"), F.lit(True).alias("strands1"),
        F.lit(0).alias("chrms2"), F.exp(F.rand(2) * np.log(100) + np.log(5000)).alias("d"), F.lit(False).alias("strands2"),
    ).withColumn("cuts2", (F.col("cuts1") + F.col("d")).cast("int"))
    edges = S.log_edges(6000, 400_000, 2.0)
    region = spark.createDataFrame([(0, 0, 4_000_000)], "chrom int, start long, end long")
    seen = S.observed(C.assign_fragments(own, g), edges, region, 1)
    curve = S.curve(seen, S.expected(g, edges, region, 1), edges).orderBy("class").toPandas()
    mid = np.sqrt(curve.low.astype(float) * curve.high)
    slope = np.polyfit(np.log(mid), np.log(curve.value), 1)[0]
    assert abs(slope + 1) < 0.1


def test_expected_pairs_by_brute_force(spark, genome):
    edges = [5000, 9000, 20_000, 60_000]
    region = spark.createDataFrame([(1, 100_000, 300_000)], "chrom int, start long, end long")
    got = {r["class"]: r["n"] for r in S.expected(genome, edges, region, 1).collect()}
    f = genome.fragments.filter("chrom = 1 AND mid > 100000 AND mid < 300000").toPandas().sort_values("abs_idx")
    want = [0, 0, 0]
    for (i, a), (j, b) in itertools.product(zip(f.abs_idx, f.mid, strict=True), repeat=2):
        d = abs(a - b)
        for k in range(3):
            inside = edges[k] < d <= edges[k + 1] if b < a else edges[k] <= d < edges[k + 1]
            want[k] += i != j and inside
            want[k] -= abs(i - j) <= 1 and edges[k] < d < edges[k + 1]
    assert [got[k] for k in range(3)] == want


def test_eigenvectors_find_a_checkerboard(spark):
    n = 40
    sign = np.where((np.arange(n) // 5) % 2 == 0, 1, -1)
    d = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    m = 2000 / (1 + d) * (1 + 0.5 * sign[:, None] * sign[None, :])
    i, j = np.nonzero(np.triu(m))
    px = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "bin1 int, bin2 int, value double")
    bins = spark.range(n).selectExpr("cast(id as int) as bin", "0 as chrom", "0 as arm")
    track = spark.createDataFrame([(int(k), float(sign[k])) for k in range(n)], "bin int, value double")
    for method in ("cis", "complete", "default", "lieberman"):
        v = E.eigenvectors(px, bins, track, method).filter("comp = 0").orderBy("bin").toPandas().value.to_numpy()
        assert (np.sign(v) == sign).mean() > 0.9, method
    v = E.whole_eigenvectors(px, bins).filter("comp = 0").count()
    assert v == n


def test_adaptive_smoothing_keeps_the_sum():
    rng = np.random.default_rng(0)
    m = rng.poisson(3, (20, 20)).astype(float)
    m = np.triu(m) + np.triu(m, 1).T
    valid = np.ones(20, bool)
    valid[7] = False
    x = E.adaptive_smoothing(m, valid, 10)
    assert abs(x.sum() - m[np.ix_(valid, valid)].sum()) < 1e-6
    assert not x[7].any() and np.allclose(x, x.T)


def test_directionality_and_diamond_on_a_ring(spark):
    m, px = _pixels(spark)
    t = np.tile(m, (3, 3))
    up = [t[b, b : b + 5].sum() for b in range(30, 60)]
    down = [t[b - 5 : b, b].sum() for b in range(30, 60)]
    got = {r["bin"]: r["ratio"] for r in T.directionality(px, 30, 5).collect()}
    for b in range(30):
        if up[b] + down[b]:
            assert abs(got[b] - up[b] / (up[b] + down[b])) < 1e-9
    got = {r["bin"]: r["score"] for r in T.diamond(px, 30, 5).collect()}
    for b in range(30):
        want = sum(t[30 + b + i, 30 + b - j] for i in range(5) for j in range(5) if i + j < 5)
        assert got.get(b, 0) == want


def test_empty_contacts(spark, genome):
    none = spark.createDataFrame([], SCHEMA)
    own = C.with_distances(C.assign_fragments(none, genome))
    assert K.valid_pairs(own).count() == 0
    assert H.all_by_all(own, genome, 100_000).count() == 0
    assert K.fragment_counts(own, genome).count() == 2500


def test_reads_in_intervals(spark):
    r = random.Random(6)
    cuts = [(r.choice([-1, 0, 1]), r.randrange(300), True, r.randrange(2), r.randrange(300), False) for _ in range(400)]
    iv = [(r.randrange(2), a, a + r.randrange(-5, 120)) for a in [r.randrange(-20, 300) for _ in range(80)]]
    iv += iv[:10] + [(5, 0, 300), (0, None, 10), (1, 400, 500)]
    got = U.reads_in_intervals(spark.createDataFrame(cuts, SCHEMA), spark.createDataFrame(iv, "chrom int, start long, end long"), 32).collect()
    points = [(c, p) for a in cuts for c, p in (a[:2], a[3:5]) if c >= 0]
    n = {i: iv.count(i) * sum(c == i[0] and i[1] < p <= i[2] for c, p in points) for i in set(iv) if None not in i}
    assert sorted(map(tuple, got)) == sorted((*i, k) for i, k in n.items() if k)


def test_reads_in_long_intervals(spark):
    """No row for each cut in an interval: 20,000 intervals that hold most of 20,000 positions."""
    cuts = spark.range(20_000).selectExpr("0 AS chrms1", "cast(id * 50 AS int) AS cuts1", "true AS strands1", "-1 AS chrms2", "0 AS cuts2", "true AS strands2")
    iv = spark.range(20_000).selectExpr("0 AS chrom", "id AS start", "1000000 - id AS end")
    own = U.reads_in_intervals(cuts, iv)
    assert own.agg(F.sum("n")).first()[0] == sum((1_000_000 - i) // 50 - i // 50 - (i == 0) for i in range(20_000))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join .*(pos|cut|_at)#\d+L? [<>]", plan)


def test_loops_near_domains(spark):
    r = random.Random(9)
    place = lambda: (r.randrange(2), r.randrange(-100, 600), r.randrange(-100, 600))
    loops = [place() for _ in range(600)]
    loops += loops[:20] + [(0, None, 5), (7, 1, 1)]
    domains = [place() for _ in range(25)]
    domains += domains[:3] + [(0, 3, None)]
    near = lambda a, b: None not in (*a, *b) and a[0] == b[0] and abs(a[1] - b[1]) + abs(a[2] - b[2]) < 60
    got = U.near_domains(spark.createDataFrame(loops, "chrom int, start long, end long"), spark.createDataFrame(domains, "chrom int, start long, end long"), 60).collect()
    assert sorted(map(tuple, got)) == sorted(a for a in loops if any(near(a, b) for b in domains))


def test_near_domains_makes_no_pairs(spark):
    plan = U.near_domains(*[spark.range(10).selectExpr("0 AS chrom", "id AS start", "id AS end")] * 2)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join .*abs\(", plan)


def test_normalised_pileup_of_large_sums(spark):
    pile = spark.createDataFrame([(0, 0, 5), (1, 1, 7)], "x int, y int, value long")
    cov = spark.createDataFrame([(0, 6 * 10**11, 6 * 10**11), (1, 3 * 10**11, 3 * 10**11)], "k int, cov1 long, cov2 long")
    got = {(a["x"], a["y"]): a["value"] for a in U.normalised_pileup(pile, cov).collect()}
    mean = (6e11 + 3e11) ** 2 / 4
    assert got == {(0, 0): pytest.approx(5 * mean / 36e22), (0, 1): 0, (1, 0): 0, (1, 1): pytest.approx(7 * mean / 9e22)}


def _longest_method(spark, df):
    """Bytes of the longest method that stages of a plan are compiled to."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set(name, before)
    return max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_code_is_short_enough_to_be_compiled(spark, tmp_path, genome):
    """The JVM interprets methods of over 8000 bytes for ever: maps took several times as long."""
    line = "1L AS l_orderkey, 2L AS l_partkey, 3L AS l_suppkey, 1 AS l_linenumber, 4.0D AS l_quantity, 5.0D AS l_extendedprice, 'A' AS l_returnflag, 'O' AS l_linestatus"
    spark.range(3).selectExpr(*line.split(", ")).withColumn("l_orderkey", F.when(F.rand() < 2, F.col("l_orderkey"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    valid = K.valid_pairs(C.with_distances(C.assign_fragments(fixtures.contacts(spark, str(tmp_path)), genome)))
    for own in (valid, H.all_by_all(valid, genome, 100_000)):
        assert _longest_method(spark, own) <= 8000


def test_maps_are_read_once(spark):
    """One scan of the map, both triangles and both directions from it."""
    px = spark.range(40).selectExpr("cast(id % 7 AS int) AS bin1", "cast(id AS int) AS bin2", "id AS value").filter("bin1 <= bin2")
    for own in (T.directionality(px, 40, 5), T.diamond(px, 40, 5)):
        assert own._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_cuts_at_and_behind_a_chromosomes_end(spark):
    chroms = spark.createDataFrame([(0, "chr1", 1000, 400, 500, 450), (1, "chr2", 250, 100, 120, 110)], "chrom int, label string, len long, cntr_start long, cntr_end long, cntr_mid long")
    g = Genome.uniform(chroms, 100)
    rows = [(c, p, f, 0, 50, True) for c in (0, 1, -1) for p in (0, 1, 3, 99, 100, 103, 247, 250, 400, 999, 1000, 5000) for f in (True, False)]
    for r in C.assign_fragments(spark.createDataFrame(rows, SCHEMA), g).collect():
        v = max(1, min({0: 1000, 1: 250}.get(r["chrms1"], 0), r["cuts1"] + 7 * r["strands1"] - 3))
        assert r["rfrag1"] == (-1 if r["chrms1"] < 0 else 10 * r["chrms1"] + (v - 1) // 100)


def test_greedy_scan_over_many_batches(spark):
    r = random.Random(11)
    rows = sorted({(0, 7 * k + r.randrange(7), True, 0, r.randrange(3000), True) for k in range(1500)})
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "13")
    try:
        got = D.quasi_duplicates(spark.createDataFrame(rows, SCHEMA), 500).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got)) == _greedy(rows, 500, "max")


def test_a_long_chain_is_not_copied_batch_by_batch(spark):
    """120,000 reads of one chain come in batches of 500: what is held is what may still meet others."""
    own = spark.range(120_000).selectExpr("0 AS chrms1", "cast(id * 10 AS int) AS cuts1", "true AS strands1", "0 AS chrms2", "cast(id * 10 AS int) AS cuts2", "true AS strands2")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "500")
    try:
        assert D.quasi_duplicates(own, 500).count() == 2400
    finally:
        spark.conf.set(name, before)
