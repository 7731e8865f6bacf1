import functools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contactloom.llm import exact_dedup, shingles, simhash
from contactloom.llm.common import Workspace
from contactloom.llm.components import components


def _normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _groups(rows):
    by = {}
    for i, text, *_ in rows:
        by.setdefault(_normal(text), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_by_brute_force(spark, edge, rows, weak):
    """A weak digest, which many texts share, must not change anything but itself."""
    options = {"digest": lambda t: F.concat(F.lit("d"), F.length(t) % 3)} if weak else {}
    got = exact_dedup.dedup(spark, edge, **options).collect()
    want = _groups(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size) for r in got) == sorted(
        (i is None, i or 0, want[_normal(t)][0] or 0, want[_normal(t)][1]) for i, t, *_ in rows
    )
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_one_row_each(spark, edge, rows):
    got = exact_dedup.keep_first(spark, edge)
    assert got.columns == edge.columns
    assert sorted(_normal(r.text) for r in got.collect()) == sorted(_groups(rows))


def test_exact_dedup_goes_on_with_later_arrivals(spark):
    space = Workspace(spark, "test-state")
    row = lambda ids: spark.createDataFrame([(f"d{i % 3}", (False, i, i)) for i in ids], "digest string, first struct<no_id: boolean, doc_id: long, locator: long>")
    row(range(5, 9)).write.parquet(space.path("arrivals"))
    state = exact_dedup.DigestState(space, space.path("arrivals"), row([1]).schema)
    state.advance()
    row(range(0, 2)).write.mode("append").parquet(space.path("arrivals"))
    again = exact_dedup.DigestState(space, space.path("arrivals"), row([1]).schema)
    again.advance()
    got = {r.digest: (r["first"].doc_id, r.n) for r in again.groups().collect()}
    assert got == {"d0": (0, 2), "d1": (1, 2), "d2": (5, 2)}


def test_empty_tables(spark, nothing):
    assert exact_dedup.dedup(spark, nothing).count() == 0
    assert exact_dedup.keep_first(spark, nothing).count() == 0
    assert simhash.near_dedup(spark, nothing).count() == 0


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in set(shingles):
        h, n = xxhash.xxh64_intdigest(s, 42), shingles.count(s) if len(shingles) < 1000 else None
        n = n if n is not None else COUNTS.setdefault(id(text), _counts(shingles))[s]
        for b in range(64):
            ones[b] += n * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


COUNTS = {}


def _counts(shingles):
    from collections import Counter

    return Counter(shingles)


def _components(fps):
    ids = sorted(fps, key=lambda i: (i[0] is None, i[0] or 0))
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and label[a] != label[b]:
                    low = min(label[a], label[b], key=lambda i: (i[0] is None, i[0] or 0))
                    label[a] = label[b] = low
                    changed = True
    return label


def test_simhash_by_brute_force(spark, edge, rows):
    fps = {(i, k): _fingerprint(t) for k, (i, t, *_) in enumerate(rows)}
    label = _components(fps)
    want = sorted(((i is None, i or 0, f"{fps[(i, k)]:016x}", label[(i, k)][0]) for k, (i, *_) in enumerate(rows)), key=repr)
    got = simhash.near_dedup(spark, edge).select("doc_id", simhash.hex_digits().alias("h"), "component_id").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.h, r.component_id) for r in got), key=repr) == want
    assert simhash.keep_one(spark, edge).columns == edge.columns


@pytest.mark.parametrize(("blocks", "list_rows"), [(6, 20_000), (7, 20_000), (6, 30)])
def test_links_lose_none(spark, blocks, list_rows):
    """Families of near fingerprints, and lists cut into parts."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    r = random.Random(2)
    fps = set()
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(r.randrange(9)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, 1) for x in fps], "fp long, least long")
    space = Workspace(spark, "test-links")
    edges = simhash.links(spark, space, nodes, len(fps), 4, blocks=blocks, list_rows=list_rows).distinct()
    got = {r.node: r.root for r in components(space, edges).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in zip(fps, signed, strict=True):
        for b, y in zip(fps, signed, strict=True):
            if bin(a ^ b).count("1") <= 4 and root(x) != root(y):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    assert {x: got.get(x, x) for x in signed} == {x: root(x) for x in signed}


def test_components_of_a_long_chain_and_a_star(spark):
    space = Workspace(spark, "test-components")
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5001)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in components(space, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{k: 1000 for k in range(1000, 1400)}, 5000: 5000, 5001: 5000}


def test_rows_without_or_with_one_id(spark):
    """Null and repeated ids: rows are judged one by one, and no id's rows are joined with each other."""
    rows = [(None, "copy of three words here"), (3, "copy of three words here"), (7, "copy of three words here"), (7, "something else entirely said"), (8, "twice the same row said"), (8, "twice the same row said"), (None, "nobody numbered this text"), (None, "nor that other one here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.monotonically_increasing_id())
    want = sorted([(3, "copy of three words here"), (7, "something else entirely said"), (8, "twice the same row said"), (None, "nobody numbered this text"), (None, "nor that other one here")], key=repr)
    for keep in (simhash.keep_one, exact_dedup.keep_first, shingles.keep_first):
        got = keep(spark, df)
        assert got.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == want, keep
    many = spark.range(60_000).selectExpr("cast(null AS long) AS doc_id", "concat('text ', id % 30000) AS text")
    assert exact_dedup.dedup(spark, many).filter("kept").count() == exact_dedup.keep_first(spark, many).count() == 30_000


def test_state_goes_on(spark):
    """Arrivals of a later call meet the state of earlier ones."""
    space = Workspace(spark, "test-state")
    row = lambda k: F.struct(F.lit(False).alias("no_id"), F.lit(k).cast("long").alias("doc_id"), F.lit(k).cast("long").alias("locator")).alias("first")
    arrivals = lambda pairs: functools.reduce(lambda a, b: a.union(b), [spark.range(1).select(F.lit(d).alias("digest"), row(k)) for d, k in pairs])
    state = exact_dedup.DigestState(space, space.path("arrivals"), arrivals([("a", 1)]).schema)
    state.add(arrivals([("a", 5), ("b", 2)]))
    state.advance()
    state.add(arrivals([("a", 3), ("a", 9), ("c", 4)]))
    state.advance()
    assert sorted((r.digest, r.first.doc_id, r.n) for r in state.groups().collect()) == [("a", 3, 3), ("b", 2, 1), ("c", 4, 1)]
