"""The pipeline's near-duplicate stage against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from contactloom.llm import shingles, simhash
from contactloom.llm.common import Workspace


def grams(text):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def kept_by_pairs(rows, threshold=0.8):
    out, before = set(), []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        own = grams(text)
        alike = any(len(own & g) >= threshold * len(own | g) - 1e-12 if own or g else True for g in before)
        before.append(own)
        if not alike:
            out.add((doc, text))
    return out


def families(seed=1):
    """Texts with edits that leave similarities on both sides of 0.8, and a passage that many share."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    texts = []
    for k in range(25):
        base = [r.choice(words) for _ in range(r.choice([4, 9, 40, 150, 400]))]
        if k % 3 == 0:
            base += passage
        for _ in range(8):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 35))):
                own[r.randrange(len(own))] = r.choice(words)
            texts.append(" ".join(own))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("options", [{}, {"sample": 1}])
def test_near_copies_by_all_pairs(spark, options):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in shingles.keep_first(spark, docs, **options).collect()}
    assert kept == kept_by_pairs(rows) and 25 < len(kept) < len(rows) - 25


def test_the_stage_finds_pairs_far_apart_in_bits(spark):
    rows = families(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in corpus_pipeline.simhash_filter(spark, docs, "").collect()}
    assert kept == kept_by_pairs(rows)


def test_edges(spark, edge, rows, nothing):
    found = corpus_pipeline.simhash_filter(spark, edge, "")
    assert found.columns == edge.columns
    assert {r.doc_id for r in found.collect()} == {1, 3, 6, 7, 8, None, 10, 11}
    assert found.filter("doc_id = 8").count() == 1
    assert corpus_pipeline.simhash_filter(spark, nothing, "").count() == 0


def test_low_thresholds_by_all_pairs(spark):
    """Sets of very different sizes may be similar enough."""
    r = np.random.default_rng(6)
    base = [f"w{i}" for i in r.integers(0, 10_000, 600)]
    rows = [(i, " ".join(base[:n])) for i, n in enumerate((600, 540, 250, 245, 130, 60, 25, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (0.4, 0.2):
        kept = {tuple(r) for r in shingles.keep_first(spark, docs, threshold=threshold).collect()}
        assert kept == kept_by_pairs(rows, threshold)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_bitmaps_lose_no_similar_pair():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 63, 64, 65, 300, 1000, 5000):
        for changed in (0, 1, n // 20, n // 5, n):
            own = np.unique(r.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
            other = np.unique(np.concatenate([own[changed:], r.integers(0, 1 << 63, changed // 2, dtype=np.int64).view(np.uint64)]))
            a, b = sorted((shingles._parities(own), shingles._parities(other)), key=len)
            while len(b) > len(a):
                b = b[: len(b) // 2] ^ b[len(b) // 2 :]
            apart = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(own, other))
            if n >= 300 and changed == n:
                assert apart > (len(own) + len(other)) / 9


def test_only_sets_of_possible_pairs_are_sent(spark, monkeypatch):
    """Texts that share a few shingles are told apart before their sets go anywhere."""
    rows = families(3)
    own = {i: grams(t) for i, t in rows}
    near = {i for i in own for j in own if i != j and jaccard(own[i], own[j]) >= 0.65}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.id: r.doc_id for r in docs.select("doc_id", shingles._id().alias("id")).collect()}
    sent, write = set(), Workspace.write

    def spy(self, df, name):
        out = write(self, df, name)
        if name.startswith("sets-"):
            sent.update(ids[r.id] for r in out.select("id").collect())
        return out

    monkeypatch.setattr(Workspace, "write", spy)
    kept = {tuple(r) for r in shingles.keep_first(spark, docs).collect()}
    assert kept == kept_by_pairs(rows)
    assert sent and sent <= near


def test_first_pairs_come_from_fingerprints(spark, monkeypatch):
    """The stage links fingerprints of five-word shingles by pivot tables; an exact check decides."""
    rows = families(4)
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows}
    near = {(b, a) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.id: r.doc_id for r in docs.select("doc_id", shingles._id().alias("id")).collect()}
    found, linked, links = [], [], simhash.links
    write = Workspace.write

    def spy(self, df, name):
        out = write(self, df, name)
        if name == "pairs-0":
            found.extend((ids[r.id], ids[r.to]) for r in out.collect())
        return out

    def linking(*args, **options):
        linked.append(args)
        return links(*args, **options)

    monkeypatch.setattr(Workspace, "write", spy)
    monkeypatch.setattr(simhash, "links", linking)
    kept = {tuple(r) for r in corpus_pipeline.simhash_filter(spark, docs, "").collect()}
    assert kept == kept_by_pairs(rows)
    assert linked and found and set(found) <= near

    def group(pairs):
        root = {i: i for i in prints}
        for _ in prints:
            for b, a in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert group(found) == group(near)
