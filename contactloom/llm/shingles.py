"""Near copies by an exact similarity join of word shingles.

A document is the set of its shingles of ``width`` words, each known by 64 bits of a hash.  It goes
if an earlier document (by doc_id) has the same set, or one whose Jaccard similarity reaches
``threshold``, whether the earlier one stays itself or not.

1. SimHash fingerprints of the shingles, linked by pivot distance tables (``simhash``), give the
   first pairs; what they show to be near copies is decided.  Similar documents may lie farther
   apart in bits than any radius that fingerprints can be searched with, hence the next steps.
2. Shingles have one order: those that a sample of documents shows to be common come last, then
   by hash.  Any one order makes the next steps exact; the sample only makes them short.
3. A document of n shingles is listed under its first n - ceil(threshold * n) + 1 ones.  Similar
   documents share such a shingle.  Lists of one are left out; ranks in a list go by age.
4. Undecided documents meet the first one of each of their lists, then the next 8, 64 and so on,
   until none has an earlier one left.  Pairs are tested by length and position.

All pairs are verified in two steps.  Bitmaps of about a bit a shingle hold the parity of the shingles
that fall on each bit; two of them differ in no more bits than the sets do in shingles, so they rule
out most pairs without loss.  The sets decide the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import blocks, by_bundle, frugal, runs, unblocked
from .common import WORD, Workspace, free_name, text_or_empty
from .linededup import LAST, prefix_length
from .simhash import candidates, words


#: Columns of a block of entries.
ENTRY = (("key", "<u8"), ("doc", "<i8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4"))


def shingles(text: str | None, width: int = 5, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle."""
    import xxhash

    own = words(text)
    known = {} if known is None else known
    if not own:
        return np.zeros(0, np.uint64)
    for w in set(own):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    each = np.fromiter((known[w] for w in own), np.uint64, len(own))
    wide = min(width, len(own))
    n = len(own) - wide + 1
    out = np.full(n, wide, np.uint64)
    for i in range(wide):
        out = (out ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _id(doc_id="doc_id", text="text"):
    """A row's id: rows that repeat a doc_id and its text have one."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), text_or_empty(text))


def _hashed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Some rows at a time, with the sets of their last column."""
    known: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            own = []
            for text in part.column(part.num_columns - 1):
                if len(known) > 50_000:
                    known.clear()
                own.append(shingles(text.as_py(), width, known))
            yield part, own


def _common(texts: DataFrame, width: int, one_in: int, least: int, most: int) -> np.ndarray:
    """Sorted hashes of shingles that at least ``least`` texts of a sample have, ``most`` of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _hashed(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["key"])

    sample = texts.filter(F.pmod("id", F.lit(one_in)) == 0).select("text").mapInArrow(frugal(scan), "key long")
    found = sample.groupBy("key").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(most)
    return np.sort(found.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def _entries(texts: DataFrame, common, width: int, threshold: float, bundles: int, flush: int = 400_000) -> DataFrame:
    """Blocks of entries (ENTRY) for bundles of lists: a row for each listed shingle of a text, with its
    place in the set's order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        held: list[dict[str, np.ndarray]] = []

        def poured() -> Iterator[pa.RecordBatch]:
            e = {c: np.concatenate([h[c] for h in held]) for c, _ in ENTRY} if held else {"key": ()}
            held.clear()
            if len(e["key"]):
                # the high bits of a hash, times the bundles, deal keys out evenly
                for bundle, made in blocks(e, ENTRY, ((e["key"] >> np.uint64(32)).astype(np.int64) * bundles) >> 32):
                    yield pa.RecordBatch.from_arrays([pa.array(bundle, pa.int32()), pa.array(made, pa.binary())], names=["bundle", "block"])

        for part, sets in _hashed(batches, width):
            keys = []
            for own in sets:
                late = np.zeros(len(own), bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                keys.append(np.concatenate([own[~late], own[late]])[: prefix_length(len(own), threshold) if len(own) else 0])
            sizes = np.array([len(k) for k in keys])
            spread = np.repeat(np.arange(len(keys)), sizes)
            n = np.repeat(np.array([len(own) for own in sets], np.int64), sizes)
            pos = np.arange(len(spread)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held.append({"key": np.concatenate(keys), "doc": part.column(0).to_numpy()[spread], "id": part.column(1).to_numpy()[spread], "n": n, "pos": pos})
            if sum(len(h["key"]) for h in held) >= flush:
                yield from poured()
        yield from poured()

    return texts.mapInArrow(frugal(scan), "bundle int, block binary")


def _lists(entries: DataFrame) -> DataFrame:
    """Entries of lists of two or more, each with its rank (by doc, then id) in its list."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in by_bundle(batches):
            e = unblocked(packed, ENTRY)
            order = np.argsort(e["key"], kind="stable")
            same = e["key"][order][1:] == e["key"][order][:-1]
            order = order[np.r_[False, same] | np.r_[same, False]] if len(order) > 1 else order[:0]
            order = order[np.lexsort((e["id"][order], e["doc"][order], e["key"][order]))]
            key, own = e["key"][order], e["id"][order]
            order = order[np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])][: len(order)]]  # rows may repeat
            first, sizes = runs(e["key"][order])
            rank = np.arange(len(order)) - np.repeat(first, sizes)
            take = np.flatnonzero(np.repeat(sizes, sizes) > 1)
            e = {c: v[order[take]] for c, v in e.items()}
            for a in range(0, len(take), 100_000):
                cols = [pa.array(e["key"][a : a + 100_000].view(np.int64)), *(pa.array(e[c][a : a + 100_000]) for c in ("doc", "id", "n", "pos"))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(rank[take[a : a + 100_000]].astype(np.int32))], names=["key", "doc", "id", "n", "pos", "rank"])

    return entries.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(frugal(scan), "key long, doc long, id long, n int, pos int, rank int")


def _parities(own: np.ndarray) -> np.ndarray:
    """A bitmap, as longs, of the parity of the hashes on each of its bits.  It has the least power of two
    of bits that the set has hashes, 64 at least; one of half the size is its halves' exclusive or."""
    bits = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _possible(pairs: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (id, to) that their sizes and bitmaps leave possible.  Bitmaps of one size or twice the
    other are compared; others, which a threshold of 0.5 or less may leave, rule out nothing."""
    other = maps.select(F.col("id").alias("to"), F.col("n").alias("m"), F.col("own").alias("theirs"))
    wide = F.least(F.size("own"), F.size("theirs"))

    def folded(c: str):
        return F.when(F.size(c) > wide, F.zip_with(F.slice(c, F.lit(1), wide), F.slice(c, wide + 1, wide), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))

    apart = F.aggregate(F.zip_with(folded("own"), folded("theirs"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-6
    both = pairs.join(maps, "id").join(other, "to").filter(near)
    far = apart > (1 - threshold) / (1 + threshold) * (F.col("n") + F.col("m")) + 1e-6
    return both.filter(~((F.greatest(F.size("own"), F.size("theirs")) <= 2 * wide) & far)).select("id", "to")


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ids of pairs (id, to) whose sets are similar."""
    other = sets.select(F.col("id").alias("to"), F.col("own").alias("theirs"))
    both = F.size(F.array_intersect("own", "theirs"))
    alike = both >= threshold * (F.size("own") + F.size("theirs") - both) - 1e-9
    return pairs.join(sets.drop("n"), "id").join(other, "to").filter(alike).select("id").distinct()


def _sets(texts: DataFrame, wanted: DataFrame, width: int, form: Callable[[np.ndarray], np.ndarray], bits: int = 1 << 24) -> tuple[DataFrame, Broadcast]:
    """(id, n, own) of the wanted texts: the set's size and what ``form`` makes of it.  Tasks get a bit
    set of fixed size that tells most other texts apart, to be destroyed later; the join that follows
    is exact."""
    place = F.pmod("id", F.lit(bits))
    view = np.zeros(bits // 32, np.uint32)
    # 32 bits a row, so at most bits / 32 rows come to the driver
    groups = wanted.select(place.alias("p")).groupBy((F.col("p") / 32).cast("long").alias("g")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 AS int))")).alias("w")).toPandas()
    view[groups["g"].to_numpy(np.int64)] = groups["w"].to_numpy(np.int64).astype(np.uint32)
    held = texts.sparkSession.sparkContext.broadcast(view)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column(0).to_numpy() % bits
                yield batch.take(pa.array(np.flatnonzero(held.value[p // 32] >> (p % 32).astype(np.uint32) & 1)))

        for part, own in _hashed(some(), width):
            made = pa.array([form(s) for s in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in own], pa.int32()), made], names=["id", "n", "own"])

    made = texts.select("id", "text").mapInArrow(frugal(scan), "id long, n int, own array<long>")
    return made.join(wanted, "id", "left_semi").dropDuplicates(["id"]), held


def _verified(space: Workspace, texts: DataFrame, pairs: DataFrame, width: int, threshold: float, number: int) -> DataFrame:
    """The ids of pairs (id, to) whose sets are similar; what it leaves in ``space`` is ``sets-number``
    and ``possible-number``, which the result reads."""
    forms = (("maps", _parities), ("sets", lambda own: own.view(np.int64)))
    for name, form in forms:
        wanted = space.write(pairs.select("id").unionByName(pairs.select(F.col("to").alias("id"))).distinct(), f"wanted-{number}")
        own, held = _sets(texts, wanted, width, form)
        own = space.write(own, f"{name}-{number}")
        held.destroy()
        if name == "maps":
            pairs = space.write(_possible(pairs, own, threshold), f"possible-{number}")
            space.drop(f"maps-{number}")
    space.drop(f"wanted-{number}")
    return _alike(pairs, own, threshold)


def keep_first(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8, sample: int = 16, least: int = 3, most: int = 200_000, bundle_bytes: int = 8 << 20, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that are no near copy of an earlier document, with all
    their columns.

    Of texts without words one stays.  A null doc_id comes after all others, a null text is an
    empty one.  Of rows that repeat a doc_id and its text, only the one whose columns have the
    smallest hash may stay.  An empty table gives an empty result.  ``radius`` is that of the
    fingerprints; the result is the same for any.
    """
    space = Workspace(spark, "shingles")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), _id().alias("id"), text_or_empty().alias("text"))
    common = spark.sparkContext.broadcast(_common(texts, width, sample, least, most))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lists = space.write(_lists(_entries(texts, common, width, threshold, int(min(1 + size // bundle_bytes, 1 << 30)))), "lists")
    common.destroy()
    blank = texts.filter(~F.col("text").rlike(WORD)).select("doc", "id")
    first = blank.agg(F.min(F.struct("doc", "id")).alias("first")).first()["first"]
    gone = blank.filter(F.col("id") != F.lit(first["id"] if first else 0)).select("id").distinct()
    pairs = space.write(candidates(spark, texts.filter(F.col("text").rlike(WORD)), width, radius), "pairs-0")
    gone = space.write(gone.unionByName(_verified(space, texts, pairs, width, threshold, 0)), "gone-0")
    space.drop("pairs-0", "possible-0", "sets-0")
    low, high, number = 0, 1, 1
    while (lists.join(gone, "id", "left_anti").agg(F.max("rank")).first()[0] or 0) > low:
        asks = lists.join(gone, "id", "left_anti").filter(F.col("rank") > low)
        to = lists.filter((F.col("rank") >= low) & (F.col("rank") < high))
        to = to.select("key", F.col("id").alias("to"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("rank").alias("older"))
        # of the first shingle that two share, those behind it must suffice
        share = threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-6
        able = (F.col("older") < F.col("rank")) & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= share)
        pairs = space.write(asks.join(to, "key").filter(able).select("id", "to").distinct(), f"pairs-{number}")
        gone = space.write(gone.unionByName(_verified(space, texts, pairs, width, threshold, number)), f"gone-{number}")
        space.drop(f"pairs-{number}", f"possible-{number}", f"sets-{number}")
        low, high, number = high, high * 8 + 1, number + 1
    other = free_name(docs, "_gone")
    left = docs.join(gone.select(F.col("id").alias(other)), _id() == F.col(other), "left_anti")
    twice = space.write(texts.groupBy("id").count().filter("count > 1").select(F.col("id").alias(other)), "twice")
    space.keep_only(f"gone-{number - 1}", "twice")
    if twice.isEmpty():
        return left
    place = free_name(docs, "_place")
    w = Window.partitionBy(_id()).orderBy(F.xxhash64(*[F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in docs.dtypes]))
    once = left.join(twice, _id() == F.col(other), "left_semi").withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).drop(place)
    return left.join(twice, _id() == F.col(other), "left_anti").unionByName(once)
