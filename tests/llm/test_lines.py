import random

import pytest

from contactloom.llm import linededup as L


def _digest(own):
    import numpy as np

    flat = sorted(own)
    d0, _ = L.digests(np.arange(len(flat)), np.zeros(1, np.int64), L._hashes(flat))
    return int(d0[0])


def _brute(rows, t=0.8):
    """For each row the places of its lines that go: every line with words is compared with all
    lines before it, by doc_id, place, the words' digest, then text hash; of equal rows one is first."""
    import xxhash

    lines = []
    for k, (i, text, *_) in enumerate(rows):
        for place, x in enumerate([] if text is None else text.split("\n")):
            if own := frozenset(L.words(x)):
                lines.append(((i is None, i or 0), place, _digest(own), xxhash.xxh64_intdigest((text or "").encode()), k, own))
    lines.sort(key=lambda x: x[:5])
    gone = [set() for _ in rows]
    for n, (_, place, _, _, k, s) in enumerate(lines):
        if any(len(s & o[-1]) >= t * len(s | o[-1]) - 1e-9 for o in lines[:n]):
            gone[k].add(place)
    return gone


def _check(spark, rows, **options):
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    expected = []
    for (i, text, *_), gone in zip(rows, _brute(rows), strict=True):
        own = [] if text is None else text.split("\n")
        kept = [x for k, x in enumerate(own) if k not in gone]
        expected.append((i, len(own), len(own) - len(kept), None if text is None else "\n".join(kept)))
    got = [tuple(r) for r in L.dedup_lines(spark, df, **options).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_null_and_repeated_ids(spark):
    """Rows without an id, or with one id and different texts, lose only their own copies; a row
    that repeats id and text keeps its lines once."""
    plate = "alpha beta gamma delta epsilon zeta"
    rows = [
        (None, f"first unrelated words stand here\n{plate}"),
        (None, f"{plate}\nvery precious unrelated content kept"),
        (4, f"one thing that nobody else says\n{plate}"),
        (4, "a different text under the same number\nand its own second line of words"),
        (5, "said two times over by two rows\n \nsecond line of it is here"),
        (5, "said two times over by two rows\n \nsecond line of it is here"),
        (5, "said two times over by two rows\n \nsecond line of it is here"),
    ]
    _check(spark, rows)


def test_edges(spark, rows, edge, nothing):
    _check(spark, rows)
    plain, clash = (sorted(map(tuple, L.dedup_lines(spark, d).collect()), key=repr) for d in (edge.select("doc_id", "text"), edge))
    assert plain == clash and len(clash) == len(rows)
    assert L.dedup_lines(spark, nothing).count() == 0


def test_heaps_are_collected(spark, nothing):
    """Before the lines are read, before they are read again and before the texts travel, executors collect
    their heaps."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    L.dedup_lines(spark, nothing)
    assert full() >= before + 3


@pytest.mark.parametrize("options", [{}, {"best": 1}, {"best": 1, "list_rows": 5, "buckets": 64}, {"best": 2, "bundle_words": 40}])
def test_families_near_the_threshold(spark, options):
    """Variants of a few lines, many of them just below or above the threshold; with one candidate
    kept at a time, and with every list cut into parts."""
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [r.sample(vocabulary, n) for n in (5, 10, 14, 25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(2):
            line = list(r.choice(base))
            for _ in range(r.randrange(4)):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            r.shuffle(line)
            text.append(" ".join(line))
        rows.append((r.randrange(10_000), "\n".join(text)))
    _check(spark, list(dict(rows).items()), **options)


def test_needed_words():
    for n in range(1, 60):
        for m in range(n, 80):
            k = L.need(n, m, 0.8)
            assert k >= 0.8 * (n + m - k) and not (k - 1) >= 0.8 * (n + m - k + 1)
