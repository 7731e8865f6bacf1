import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from contactloom.llm import packing, tokencount


def _greedy(word, initial, continuing):
    i = n = 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in (continuing if i else initial):
                break
        else:
            return -1
        i, n = j, n + 1
    return n


def test_automaton_by_brute_force():
    r = random.Random(1)
    for _ in range(400):
        piece = lambda: bytes(r.choice(b"abc") for _ in range(r.randint(1, 5)))
        initial, continuing = {piece() for _ in range(r.randint(1, 8))}, {piece() for _ in range(r.randint(1, 8))}
        own = tokencount.Automaton(initial, continuing)
        for _ in range(20):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(0, 12)))
            assert own.count(word) == _greedy(word, initial, continuing)


def test_counts(edge, rows, nothing):
    pieces = tokencount.word_pieces()
    got = [tuple(r) for r in tokencount.counts(edge).collect()]
    want = []
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        memo = {w: _greedy(w, *pieces) for w in set(words) if len(w) < 1000}
        long_ = {w: tokencount.Automaton(*pieces).count(w) for w in set(words) if len(w) >= 1000}
        want.append((i, len(words), sum((memo | long_)[w] for w in words), 0))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tokencount.counts(nothing).count() == 0
    few = tokencount.counts(edge, pieces=({b"one"}, {b"x"}))
    assert {r.doc_id: (r.n_tokens, r.n_unknown) for r in few.collect()}[10] == (1, 0)


def test_lower_bound_is_one_and_packing_is_whole():
    rng = np.random.default_rng(2)
    for _ in range(200):
        cap = int(rng.integers(4, 14))
        own = rng.integers(1, cap + 1, int(rng.integers(0, 7)))
        best = _fewest(sorted(own.tolist(), reverse=True), cap)
        assert packing.lower_bound(own, cap) <= best
        where, at, n = packing.best_fit_decreasing(own, cap)
        assert best <= n and sorted(set(where.tolist())) == list(range(n))
        for s in range(n):
            inside = sorted((int(a), int(z)) for a, z in zip(at[where == s], own[where == s], strict=True))
            assert [a for a, _ in inside] == [sum(z for _, z in inside[:k]) for k in range(len(inside))]
            assert sum(z for _, z in inside) <= cap


def _fewest(sizes, cap, room=()):
    if not sizes:
        return len(room)
    best = _fewest(sizes[1:], cap, (*room, cap - sizes[0]))
    for k in {r: i for i, r in enumerate(room) if r >= sizes[0]}.values():
        best = min(best, _fewest(sizes[1:], cap, (*room[:k], room[k] - sizes[0], *room[k + 1 :])))
    return best


@pytest.mark.parametrize("group_rows", [65536, 8])
def test_pack_round_trip(spark, edge, rows, nothing, group_rows):
    import public_tokenizers as P

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack(spark, edge, capacity=64, group_rows=group_rows, with_ids=True).toPandas()
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(i, []).append(own.encode(text or "", add_special_tokens=False).ids + [0])
    for i, many in ids.items():
        mine = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        whole = sum(len(m) for m in many)
        assert mine.length.sum() == whole
        if len(many) == 1:
            mine = mine.sort_values("piece")
            assert [x for part in mine["ids"] for x in part] == many[0]
            assert mine.length[1:].eq(64).all() and list(mine.start) == list(np.cumsum(mine.length) - mine.length)
    for r in got.itertuples():
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(np.cumsum(s.length) - s.length) and s.length.sum() <= 64
    assert packing.pack(spark, nothing).count() == 0


def test_exchange_saves_sequences(spark):
    """Small parts with gaps come near the bound of all items after they have exchanged."""
    from contactloom.llm.common import Workspace

    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1500, 3000)
    items = spark.createDataFrame([(k, k, 0, int(s)) for k, s in enumerate(sizes)], "doc_id long, row_id long, piece int, length long")
    one = packing.assign(Workspace(spark, "t1"), items, group_rows=60, rounds=0).select("sequence_id").distinct().count()
    own = packing.assign(Workspace(spark, "t2"), items, group_rows=60, rounds=4)
    n = own.select("sequence_id").distinct().count()
    assert own.count() == 3000 and packing.lower_bound(sizes) <= n < one
