"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  A line goes if an earlier line (by doc_id, then by place in the
text) has the same words, or words so alike that Jaccard similarity reaches ``threshold``, whether
the earlier one stays itself or not.

1. Word counts over all texts go to ``buckets`` sums by a hash, a table of fixed size that every
   task gets.  Words are ordered by their bucket's sum, then by hash: rare words first.  Any one
   order makes the next steps exact; a good one makes them short.
2. Lines with equal sets are one class, known by a digest; the earliest line stands for it.
3. A class of n words is listed under its first n - ceil(threshold * n) + 1 words.  Similar classes
   share such a word.  A word whose bucket sum is above ``list_rows`` is split into parts, and
   every two parts meet in a list of their own.  A task sends its entries as column blocks, one
   for each bundle of lists.
4. In a list, pairs are tested by length, by position (words behind the shared one must suffice)
   and by parity bitmaps (bits that differ can't outnumber words that differ).  A later class
   keeps its ``best`` nearest earlier ones; a list in which some class had more is kept whole.
5. The kept pairs are verified on the lines themselves, read again, word by word (64 bits of each).  Classes that no pair decides and that had
   more meet all their earlier candidates in the lists that were kept, which decides them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import PIECE, blocks, byte_sizes, byte_strings, pieces, runs, unblocked
from .common import WORD, Workspace, shrink_heaps, text_or_empty

LAST = (1 << 63) - 1
#: Columns of a block of entries, in its order of bytes.
ENTRY = (("token", "<u4"), ("cls", "<i8"), ("low", "<u8"), ("high", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("side", "<i1"))


def need(n: int, m: int, threshold: float) -> int:
    """Words that sets of n and m must share: the least k with k / (n + m - k) >= threshold."""
    k = math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    while k > 0 and (k - 1) >= threshold * (n + m - k + 1):
        k -= 1
    while k < threshold * (n + m - k):
        k += 1
    return k


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased.  For bytes, white space is the space and the controls 9 to
    13, and upper case is A-Z, no more."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _texts(docs: DataFrame) -> DataFrame:
    """doc, the doc_id with null last; uid, which tells texts of one doc_id apart; text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.select(doc.alias("doc"), F.xxhash64(doc, text_or_empty()).alias("uid"), F.col("text").cast("string").alias("text"))


class Lines:
    """The lines of some texts that have words, with their words as columns."""

    def __init__(self, row: np.ndarray, place: np.ndarray, line: np.ndarray, code: np.ndarray, hashes: np.ndarray):
        self.row, self.place = row, place  # of each line: its text and its place there
        self.line, self.code, self.hashes = line, code, hashes  # of each word: its line and number; by number, two hashes


def lines_of(texts: pa.Array) -> Iterator[Lines]:
    """Lines of texts, some at a time; a line is never cut."""
    import pyarrow.compute as pc

    sizes = byte_sizes(texts)
    for first, last in pieces(sizes):
        some = texts.slice(first, last - first)
        split = pc.split_pattern(pc.ascii_lower(some), "\n")
        every, row = split.flatten(), pc.list_parent_indices(split).to_numpy()
        place = np.arange(len(row)) - np.repeat(*runs(row))
        for a, b in pieces(pc.binary_length(every).to_numpy(zero_copy_only=False)):
            parts = pc.ascii_split_whitespace(every.slice(a, b - a))
            flat = parts.flatten().dictionary_encode()
            line, code = pc.list_parent_indices(parts).to_numpy(), flat.indices.to_numpy()
            own = byte_strings(flat.dictionary)
            if b"" in own:  # white space at a line's ends
                some_word = code != own.index(b"")
                line, code = line[some_word], code[some_word]
            yield Lines(row[a:b] + first, place[a:b], line, code, _hashes(own))


def _hashes(own: list[bytes]) -> np.ndarray:
    """Two rows of 64-bit hashes of the words."""
    import xxhash

    return np.ascontiguousarray(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, own)), "<u8").reshape(-1, 2).T)


def _word_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first hashes, counts) of the words of some texts at a time."""
    import pyarrow.compute as pc

    sizes = byte_sizes(texts)
    for first, last in pieces(sizes):
        some = texts.slice(first, last - first)
        if last - first == 1 and sizes[first] > PIECE:
            for lines in lines_of(some):
                yield lines.hashes[0], np.bincount(lines.code, minlength=lines.hashes.shape[1])
            continue
        flat = pc.ascii_split_whitespace(pc.ascii_lower(some)).flatten().dictionary_encode()
        own = byte_strings(flat.dictionary)
        counts = np.bincount(flat.indices.to_numpy(), minlength=len(own))
        if b"" in own:  # white space at a text's ends
            counts[own.index(b"")] = 0
        yield _hashes(own)[0], counts


def rarity(texts: DataFrame, buckets: int, chunks: int = 64) -> np.ndarray:
    """Sums of word counts by bucket.  A task sends its sums in ``chunks`` blocks."""
    size = -(-buckets // chunks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(chunks * size, np.int64)
        for batch in batches:
            for one, counts in _word_counts(batch.column(0)):
                at = (one % np.uint64(buckets)).astype(np.int64)
                sums += np.bincount(at, counts, len(sums)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([part.tobytes() for part in sums.reshape(chunks, size)])], names=["chunk", "block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(block, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "block"])

    schema = "chunk int, block binary"
    out = np.zeros((chunks, size), np.int64)
    for r in texts.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():
        out[r["chunk"]] = np.frombuffer(r["block"], np.int64)
    return out.reshape(-1)[:buckets]


def sets_of(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, code, first): a line's distinct words in one run, and where the runs begin."""
    many = max(1, lines.hashes.shape[1])
    key = np.sort(lines.line.astype(np.int64) * many + lines.code)
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    line = key // many
    return line, key - line * many, runs(line)[0]


def digests(code: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a set of words: sums of the words' hashes, whatever the order."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.add.reduceat(h[code], first).view(np.int64) for h in hashes)


def _ordered(lines: Lines, sums: np.ndarray, shift: int) -> tuple[Lines, np.ndarray]:
    """The same with words numbered by rank, rare ones first, and their sums."""
    one = lines.hashes[0]
    own = sums[(one % np.uint64(len(sums))).astype(np.int64)]
    order = np.argsort((own >> shift << 44) | (one >> np.uint64(20)).astype(np.int64))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Lines(lines.row, lines.place, lines.line, rank[lines.code], lines.hashes[:, order]), own[order]


def _scan(texts: DataFrame, sums, threshold: float, list_rows: int, bundles: int, flush: int = 400_000) -> DataFrame:
    """Rows of two kinds: lines with words (doc, uid, line, d0, d1, lead: the text's first), and
    blocks of entries for a bundle of lists."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own = sums.value
        shift = max(0, int(own.max(initial=0)).bit_length() - 19)  # the largest sum in 19 bits
        kinds = {"bundle": pa.int32(), "block": pa.binary(), "doc": pa.int64(), "uid": pa.int64(), "line": pa.int32(), "d0": pa.int64(), "d1": pa.int64(), "lead": pa.bool_()}
        held: list[dict[str, np.ndarray]] = []
        seen: dict[int, tuple[int, int]] = {}  # classes that this task has listed, with their age there

        def rows(size: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in kinds.items()], names=list(kinds))

        def poured() -> Iterator[pa.RecordBatch]:
            e = {c: np.concatenate([h[c] for h in held]) for c, _ in ENTRY} if held else {"token": ()}
            held.clear()
            if len(e["token"]):
                for bundle, made in blocks(e, ENTRY, (e["token"].astype(np.int64) * bundles) >> 32):
                    yield rows(len(made), bundle=bundle, block=made)

        for batch in batches:
            ids, uids = (batch.column(i).to_numpy() for i in (0, 1))
            last_row = -1
            for lines in lines_of(batch.column(2)):
                lines, own_sums = _ordered(lines, own, shift)
                line, code, first = sets_of(lines)
                hashes = lines.hashes
                if not len(first):
                    continue
                d0, d1 = digests(code, first, hashes)
                n = np.diff(np.r_[first, len(line)])
                row, place = lines.row[line[first]], lines.place[line[first]].astype(np.int32)
                doc, uid = ids[row], uids[row]
                lead = np.r_[row[0] != last_row, row[1:] != row[:-1]]
                last_row = int(row[-1])
                yield rows(len(n), bundle=(uid + place) % bundles, doc=doc, uid=uid, line=place, d0=d0, d1=d1, lead=lead)
                # list classes that a different set can be similar to, once unless an earlier line comes
                fresh = n / (n + 1) >= threshold
                for i, cls, age in zip(np.flatnonzero(fresh).tolist(), d0[fresh].tolist(), zip(doc[fresh].tolist(), place[fresh].tolist(), strict=True), strict=True):
                    if cls in seen and seen[cls] <= age:
                        fresh[i] = False
                    else:
                        if len(seen) > 300_000:
                            seen.clear()
                        seen[cls] = age
                bit, half = np.uint64(1) << (hashes[1] & np.uint64(63)), hashes[1] >> np.uint64(6) & np.uint64(1)
                low, high = (np.bitwise_xor.reduceat((bit * (half == k))[code], first) for k in (0, 1))
                at = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(line)) - first[at]
                use = np.flatnonzero(fresh[at] & (pos < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[at]))
                at, pos, word = at[use], pos[use], code[use]
                parts = 1 + own_sums[word] // list_rows
                token = (hashes[0] >> np.uint64(16) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[word]
                side = np.full(len(at), 2, np.int8)
                if (parts > 1).any():
                    again = np.repeat(np.arange(len(at)), parts)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
                    at, pos, token, parts = at[again], pos[again], token[again], parts[again]
                    part = d0.view(np.uint64)[at] % parts.astype(np.uint64)
                    part = part.astype(np.int64)
                    side = np.where(part == other, 2, part > other).astype(np.int8)
                    for i in np.flatnonzero(parts > 1):
                        token[i] = xxhash.xxh32_intdigest(b"%d %d %d" % (token[i], min(part[i], other[i]), max(part[i], other[i])))
                held.append({"token": token, "cls": d0[at], "low": low[at], "high": high[at], "doc": doc[at], "line": place[at], "n": n[at], "pos": pos, "side": side})
                if sum(len(h["token"]) for h in held) >= flush:
                    yield from poured()
        yield from poured()

    return texts.mapInArrow(scan, "bundle int, block binary, doc long, uid long, line int, d0 long, d1 long, lead boolean")


def _nearest(e: dict[str, np.ndarray], threshold: float, best: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, more) of entries sorted by token and n: for each later entry that asks its
    ``best`` nearest earlier candidates, all if None; more: entries that had others."""
    token, n, pos, side, doc, line, cls = (e[c] for c in ("token", "n", "pos", "side", "doc", "line", "cls"))
    low, high, asks = e["low"], e["high"], e.get("asks")
    size = len(token)
    count = np.zeros(size, np.int64)
    top = np.full((size if best else 0, best or 0), LAST, np.int64)
    none = np.zeros(0, np.int64)
    at, step = np.arange(size - 1), 1
    while len(at := at[at < size - step]):
        # sorted by word and size: once the other is too large, all behind it are
        at = at[(token[at] == token[at + step]) & (n[at] >= threshold * n[at + step] - 1e-9)]
        a, b = at, at + step
        if asks is not None:
            ok = asks[a] | asks[b]
            a, b = a[ok], b[ok]
        share = np.ceil(threshold / (1 + threshold) * (n[a] + n[b]) - 1e-9).astype(np.int64)
        ok = (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= share) & ((side[a] != side[b]) | (side[a] == 2)) & (cls[a] != cls[b])
        a, b, share = a[ok], b[ok], share[ok]
        apart = (np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])).astype(np.int64)
        ok = apart <= n[a] + n[b] - 2 * share
        a, b, apart = a[ok], b[ok], apart[ok]
        if len(a):
            first = (doc[a] < doc[b]) | ((doc[a] == doc[b]) & ((line[a] < line[b]) | ((line[a] == line[b]) & (cls[a] < cls[b]))))
            for later, earlier, d in ((b[first], a[first], apart[first]), (a[~first], b[~first], apart[~first])):
                if asks is not None:
                    use = asks[later]
                    later, earlier, d = later[use], earlier[use], d[use]
                if len(later) and best is None:
                    yield later, earlier, none
                elif len(later):  # at one step an entry is later once at most
                    count[later] += 1
                    worst = top[later].argmax(1)
                    key = d << 40 | earlier
                    closer = key < top[later, worst]
                    top[later[closer], worst[closer]] = key[closer]
        step += 1
    if best:
        y, k = np.nonzero(top != LAST)
        yield y, top[y, k] & ((1 << 40) - 1), np.flatnonzero(count > best)


_PAIR = "doc long, line long, cls long, to_doc long, to_line long, to_cls long"


def _pairs(e: dict[str, np.ndarray], later: np.ndarray, earlier: np.ndarray) -> list[pa.Array]:
    return [pa.array(e[c][rows].astype(np.int64)) for rows in (later, earlier) for c in ("doc", "line", "cls")]


def _meet(scanned: DataFrame, threshold: float, best: int) -> DataFrame:
    """Lines as they came; candidate pairs (doc, line, cls, to_doc, to_line, to_cls); and entries of
    lists in which a class had more candidates than it kept (token, n, more ...)."""
    columns = {"kind": pa.int8(), "doc": pa.int64(), "line": pa.int64(), "cls": pa.int64(), "to_doc": pa.int64(), "to_line": pa.int64(), "to_cls": pa.int64(), "uid": pa.int64(), "d1": pa.int64(), "lead": pa.bool_()}
    columns |= {"token": pa.int64(), "n": pa.int32(), "pos": pa.int32(), "side": pa.int8(), "low": pa.int64(), "high": pa.int64(), "more": pa.bool_()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(size: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(size, t) for c, t in columns.items()], names=list(columns))

        def done(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
            e = unblocked(packed, ENTRY)
            # words of one list only once: alone they have no partner
            key = np.sort(e["token"].astype(np.uint64) << np.uint64(32) | np.arange(len(e["token"]), dtype=np.uint64))
            t, order = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            same = t[1:] == t[:-1]
            order = order[np.r_[False, same] | np.r_[same, False]] if len(order) > 1 else order[:0]
            order = order[np.lexsort((e["cls"][order], e["token"][order].astype(np.int64) << 31 | e["n"][order]))]
            # a class comes once for each task that has it: the earliest line counts
            same = np.ones(len(order), bool)
            same[:1] = False
            for c in ("token", "cls", "low", "high", "side"):
                v = e[c][order]
                same[1:] &= v[1:] == v[:-1]
            if same.any():
                run = np.cumsum(~same)
                often = np.flatnonzero(same | np.r_[same[1:], False])
                its = order[often]
                order[often] = its[np.lexsort((e["line"][its], e["doc"][its], run[often]))]
            e = {c: v[order[~same]] for c, v in e.items()}
            e |= {c: e[c].astype(np.int64) for c in ("n", "pos", "line")}
            for later, earlier, more in _nearest(e, threshold, best):
                if len(later):
                    found = dict(zip(("doc", "line", "cls", "to_doc", "to_line", "to_cls"), _pairs(e, later, earlier), strict=True))
                    yield rows(len(later), kind=pa.array(np.ones(len(later), np.int8)), **found)
                if len(more):
                    flag = np.zeros(len(e["n"]), bool)
                    flag[more] = True
                    kept = np.flatnonzero(np.isin(e["token"], e["token"][more]))
                    cols = {c: pa.array(e[c][kept]).cast(columns[c]) for c in ("doc", "line", "cls", "token", "n", "pos", "side")}
                    cols |= {c: pa.array(e[c][kept].view(np.int64)) for c in ("low", "high")}
                    yield rows(len(kept), kind=pa.array(np.full(len(kept), 2, np.int8)), more=pa.array(flag[kept]), **cols)

        bundle, held = None, []
        for batch in batches:
            is_line = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            if is_line.any():
                own = batch.take(pa.array(np.flatnonzero(is_line)))
                yield rows(
                    own.num_rows, kind=pa.array(np.zeros(own.num_rows, np.int8)), doc=own.column(2), uid=own.column(3),
                    line=own.column(4).cast(pa.int64()), cls=own.column(5), d1=own.column(6), lead=own.column(7),
                )
            for i in np.flatnonzero(~is_line).tolist():
                if bundle != (now := batch.column(0)[i].as_py()):
                    if held:
                        yield from done(held)
                    bundle, held = now, []
                held.append(batch.column(1)[i].as_py())
        if held:
            yield from done(held)

    schema = "kind byte, " + _PAIR + ", uid long, d1 long, lead boolean, token long, n int, pos int, side byte, low long, high long, more boolean"
    return scanned.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(scan, schema)


def _meet_rest(entries: DataFrame, threshold: float) -> DataFrame:
    """All earlier candidates of the entries that ask, within their lists."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            e = {c: t.column(c).to_numpy() for c in t.column_names}
            e |= {c: e[c].view(np.uint64) for c in ("low", "high")}
            e |= {"asks": e["asks"].astype(bool), "n": e["n"].astype(np.int64), "pos": e["pos"].astype(np.int64)}
            for later, earlier, _ in _nearest(e, threshold, None):
                yield pa.RecordBatch.from_arrays(_pairs(e, later, earlier), names=["doc", "line", "cls", "to_doc", "to_line", "to_cls"])

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            first = int(np.searchsorted(rows.column("token").to_numpy(), rows.column("token")[-1].as_py()))
            held = rows.slice(first)
            if first:
                yield from done(rows.slice(0, first))
        if held is not None and held.num_rows:
            yield from done(held)

    return entries.repartition("token").sortWithinPartitions("token", "n").mapInArrow(scan, _PAIR)


def _word_sets(texts: DataFrame, wanted: DataFrame, bits: int = 1 << 24, few: int = 20_000) -> DataFrame:
    """(doc, line, cls, d1, words) of the wanted classes' lines, words as 64-bit hashes.  Tasks get a bit set of fixed size that
    tells most other lines apart, and the documents' ids if there are few lines; the join that
    follows is exact."""
    import pyarrow.compute as pc

    # a line's bit: its document's place, moved on by the line's
    place, move = F.pmod(F.xxhash64("doc"), F.lit(bits)), 7919
    view = np.zeros(bits // 32, np.uint32)
    # 32 bits a row, so at most bits / 32 rows come to the driver
    own = wanted.select(((place + F.col("line") * move) % bits).alias("p"))
    groups = own.groupBy((F.col("p") / 32).cast("long").alias("g")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 AS int))")).alias("w")).toPandas()
    view[groups["g"].to_numpy(np.int64)] = groups["w"].to_numpy(np.int64).astype(np.uint32)
    held = texts.sparkSession.sparkContext.broadcast(view)

    def sets(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        own = [sorted(set(line.lower().split())) for _, _, line in found]
        flat = [w for ws in own for w in ws]
        first = np.cumsum([0, *map(len, own)])
        full = np.flatnonzero(np.diff(first))
        hashes = _hashes(flat)
        d0, d1 = digests(np.arange(len(flat)), first[full], hashes)
        out = [pa.array([found[i][k] for i in full.tolist()], pa.int64()) for k in (0, 1)]
        listed = pa.ListArray.from_arrays(pa.array(np.r_[0, first[1:][full]], pa.int32()), pa.array(hashes[1].view(np.int64)))
        return pa.RecordBatch.from_arrays([*out, pa.array(d0), pa.array(d1), listed], names=["doc", "line", "cls", "d1", "words"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = held.value
        found: list[tuple[int, int, bytes]] = []
        for batch in batches:
            # every line of the batch at once: its text and its place there
            many = pc.count_substring(batch.column(2), "\n").to_numpy().astype(np.int64) + 1
            row = np.repeat(np.arange(len(many)), many)
            line = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = (batch.column(1).to_numpy()[row] + line * move) % bits
            hit = np.flatnonzero(view[at >> 5] >> (at & 31).astype(np.uint32) & 1)
            row, line, docs = row[hit], line[hit].tolist(), batch.column(0)
            for a, n in zip(*map(np.ndarray.tolist, runs(row)), strict=True):
                k = int(row[a])
                doc, lines = docs[k].as_py(), batch.column(2)[k].as_buffer().to_pybytes().split(b"\n")
                found += [(doc, i, lines[i]) for i in line[a : a + n]]
                if len(found) > 4096:
                    yield sets(found)
                    found = []
        if found:
            yield sets(found)

    if wanted.count() <= few:
        texts = texts.join(F.broadcast(wanted.select("doc").distinct()), "doc", "left_semi")
    lines = texts.select("doc", place.alias("p"), text_or_empty().alias("text"))
    found = lines.mapInArrow(scan, "doc long, line long, cls long, d1 long, words array<long>")
    return found.join(wanted, ["doc", "line", "cls"], "left_semi").dropDuplicates(["doc", "line", "cls", "d1"])


def _verified(space: Workspace, texts: DataFrame, pairs: DataFrame, threshold: float, name: str) -> DataFrame:
    """(doc, line, cls, d1) of later classes of pairs that are similar."""
    ids = ["doc", "line", "cls"]
    wanted = space.write(pairs.select(*ids).unionByName(pairs.select(*[F.col(f"to_{c}").alias(c) for c in ids])).distinct(), f"wanted-{name}")
    sets = space.write(_word_sets(texts, wanted), f"sets-{name}")
    other = sets.select(*[F.col(c).alias(f"to_{c}") for c in ids], F.col("words").alias("to_words"))
    both = F.size(F.array_intersect("words", "to_words"))
    alike = both >= threshold * (F.size("words") + F.size("to_words") - both) - 1e-9
    found = space.write(pairs.join(sets, ids).join(other, [f"to_{c}" for c in ids]).filter(alike).select(*ids, "d1").distinct(), f"found-{name}")
    space.drop(f"wanted-{name}", f"sets-{name}")
    return found


def dedup_lines(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, buckets: int = 1 << 18, list_rows: int = 50_000, best: int = 2, bundle_words: int = 1 << 20) -> DataFrame:
    """``doc_id``, n_lines, n_removed and the text left of each row of ``docs`` (doc_id, text).

    Lines end at line feeds and have their words as elsewhere: separated by the space and the
    controls 9 to 13, A-Z lower-cased.  Lines without words stay.  A null text has no line and
    stays null; an empty one has one line.  Null doc_ids come after all others.  Rows that repeat
    a doc_id with another text are documents of their own, lines at one place ordered by their
    words' digests and then by the texts' hashes.  Of rows that repeat doc_id and text, one is the
    first, and lines with words go from all others.  An empty table gives an empty result.  Other
    columns, of any name, are not read.
    """
    # texts are cut into pieces of bounded size, so batches may be long
    space = Workspace(spark, "line-dedup", short=False)
    # a heap that an earlier query made large would come on top of the workers' memory
    shrink_heaps(spark)
    texts = _texts(docs)
    counted = rarity(texts, buckets)
    bundles = int(min(max(1, counted.sum() // bundle_words), 1 << 30))
    sums = spark.sparkContext.broadcast(counted)
    met = space.write(_meet(_scan(texts, sums, threshold, list_rows, bundles), threshold, best), "met")
    ids = ["doc", "line", "cls"]
    # before texts are read again, as at the beginning
    shrink_heaps(spark)
    found = _verified(space, texts, met.filter("kind = 1").select(*ids, "to_doc", "to_line", "to_cls").distinct(), threshold, "first")
    entries = met.filter("kind = 2")
    asking = space.write(entries.filter("more").select(*ids).distinct().join(found, ids, "left_anti"), "asking")
    if not asking.isEmpty():
        asks = asking.select(*ids, F.lit(True).alias("asks"))
        tokens = space.write(entries.filter("more").join(asking, ids, "left_semi").select("token").distinct(), "tokens")
        rest = entries.join(tokens, "token", "left_semi").join(asks, ids, "left").select(*ids, "token", "n", "pos", "side", "low", "high", F.coalesce("asks", F.lit(False)).alias("asks"))
        again = space.write(_meet_rest(rest, threshold).distinct(), "again")
        found = found.unionByName(_verified(space, texts, again, threshold, "rest"))

    lines = met.filter("kind = 0").select("doc", "line", "uid", F.col("cls").alias("d0"), "d1", "lead")
    gone = found.select(F.col("cls").alias("d0"), "d1").distinct().withColumn("gone", F.lit(True))
    classes = lines.groupBy("d0", "d1").agg(F.count("*").alias("n")).filter("n > 1")
    # written before they are joined: a join of two tables can split a class that most lines are in
    decided = space.write(classes.join(gone, ["d0", "d1"], "full").select("d0", "d1", F.coalesce("gone", F.lit(False)).alias("gone")), "decided")
    members = space.write(lines.join(decided, ["d0", "d1"]).select("doc", "line", "uid", "d0", "d1", "gone"), "members")
    firsts = space.write(members.filter("NOT gone").groupBy("d0", "d1").agg(F.min(F.struct("doc", "line", "uid")).alias("first")), "firsts")
    out = members.join(firsts, ["d0", "d1"], "left").filter(F.col("gone") | (F.col("first") != F.struct("doc", "line", "uid")))
    out = out.groupBy("doc", "uid").agg(F.collect_set("line").alias("dropped"))
    # rows with one doc_id and text are alike: the first keeps what the class leaves it
    twice = lines.filter("lead").groupBy("doc", "uid").agg(F.count("*").alias("times")).filter("times > 1")
    out = space.write(out.join(twice, ["doc", "uid"], "full"), "dropped")
    twice = out.filter("times IS NOT NULL")
    space.keep_only("dropped")
    # what follows sorts whole texts, beside workers that still hold what the lists took
    shrink_heaps(spark)

    def rest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, left = [], [], []
            for text, dropped in zip(batch.column(1), batch.column(2), strict=True):
                text, dropped = text.as_py(), set(dropped.as_py() or ())
                own = [] if text is None else text.split("\n")
                kept = [line for i, line in enumerate(own) if i not in dropped]
                n.append(len(own))
                m.append(len(own) - len(kept))
                left.append(None if text is None else "\n".join(kept))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(left, pa.string()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_lines", "n_removed", "text", "times"])

    schema = "doc_id long, n_lines long, n_removed long, text string, times long"
    doc_id = F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id")
    every = texts.join(out, ["doc", "uid"], "left")
    once = every.filter("times IS NULL").select(doc_id, "text", "dropped", F.lit(1).cast("long").alias("times")).mapInArrow(rest_of, schema)
    if twice.isEmpty():
        return once.drop("times")
    # of rows that repeat doc_id and text one travels on, with their number
    alike = texts.join(out.filter("times IS NOT NULL").select("doc", "uid"), ["doc", "uid"], "left_semi").groupBy("doc", "uid").agg(F.first("text").alias("text"))
    alike = space.write(alike.join(out, ["doc", "uid"]), "alike")
    firsts = alike.select(doc_id, "text", "dropped", F.lit(1).cast("long").alias("times")).mapInArrow(rest_of, schema)
    blank = F.transform(F.split("text", "\n", -1), lambda x: ~x.rlike(WORD))
    every_line = F.filter(F.sequence(F.lit(0), F.size(blank) - 1), lambda i: ~F.get(blank, i)).cast("array<long>")
    copies = alike.select(doc_id, "text", every_line.alias("dropped"), (F.col("times") - 1).alias("times")).mapInArrow(rest_of, schema)
    copies = copies.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return once.unionByName(firsts).unionByName(copies).drop("times")
