"""Best-fit packing of token sequences with certified bin counts.

1. Tokens: each document becomes ids, is closed by an end id, and is cut into pieces only if it is
   longer than a sequence.  Full pieces fill a sequence each; the others are items.
2. Items are dealt to partitions of about ``group_rows`` by a seeded hash and packed by best-fit
   decreasing.  Dual feasible functions give a lower bound for each partition; a partition that
   needs no more sequences than its bound is certified and final.
3. Partitions with a gap keep the sequences that are full and give up the items of the others.
   Those are exchanged (dealt anew, with another seed, to fewer partitions) and packed again.  It
   ends when no partition has a gap or a round saves nothing (``rounds`` is a guard).  Every round
   lets each partition's emptiest sequence exchange its items as well.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import frugal
from .common import Workspace

CAPACITY = 2048
PIECES = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a byte-level BPE vocabulary.  The rank file of the same vocabulary gives the same ids
    in a fraction of the time; texts that hold an added token's string go to the JSON file, which
    is only read for them."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None, added: list[str] | None = None):
        import base64

        self.json_path, self.whole, self.fast = json_path, None, None
        self.added = added_tokens(json_path) if added is None else added
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    @property
    def slow(self):
        from tokenizers import Tokenizer

        self.whole = self.whole or Tokenizer.from_file(self.json_path)
        return self.whole


def added_tokens(json_path: str) -> list[str]:
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(json_path).get_added_tokens_decoder().values()]


def public_vocabulary() -> dict:
    import public_tokenizers as p

    return {"json_path": p.path("byte_bpe_50k.json"), "ranks_path": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter, the rest are full."""
    first = length % capacity
    starts = ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]
    return starts


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: dict | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, row_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece."""
    import public_tokenizers  # noqa: F401  the default vocabulary's place, found again on executors

    chosen = vocabulary
    added = added_tokens((chosen or public_vocabulary())["json_path"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encoder = Encoder(**(chosen or public_vocabulary()), added=added)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            out: list[tuple] = []
            held: list[np.ndarray] = []
            for k in range(batch.num_rows):
                ids = np.array(encoder.ids(batch.column(2)[k].as_py() or "") + [end_id], dtype="<u4")
                doc, row = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    out.append((doc, row, n, start, length, zlib.crc32(own.tobytes())))
                    if with_ids:
                        held.append(own.astype(np.int32))
            columns = list(zip(*out, strict=True)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    # row_id tells rows with the same doc_id apart; the pieces are written once, so it stays
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(frugal(scan), PIECES + (", ids array<int>" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most sequences that the total or a dual feasible function shows to be needed.

    For 0 < e <= capacity / 2, counting items over capacity - e as whole sequences, dropping
    items under e and leaving the others as they are is dual feasible; so is rounding sizes
    (k + 1) * size / capacity down to multiples of 1 / k, for any k, where it isn't whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - np.where(e > 0, total[e - 1], 0)
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence, offset of each item, and the number of sequences.

    Sequences with the same room stand in one pile; the bits of an integer say which piles aren't
    empty, so finding the least room that suffices takes no search.
    """
    piles: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = opened = 0
    where, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = bits >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            own = piles[room].pop()
            if not piles[room]:
                bits &= ~(1 << room)
        else:
            room, own = capacity, opened
            opened += 1
        where[i], at[i] = own, capacity - room
        left = room - size
        if left:
            piles[left].append(own)
            bits |= 1 << left
    return where, at, opened


PACKED = "doc_id long, row_id long, piece int, length long, part int, sequence long, offset long, room long, gap int, last boolean"


def _pack(items: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Items packed within parts: their sequence's room, the part's gap, and whether the sequence
    is the emptiest of its part."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "row_id", "piece"], ascending=[False, True, True, True], na_position="last")
        lengths = rows["length"].to_numpy(np.int64)
        where, at, opened = best_fit_decreasing(lengths, capacity)
        room = capacity - np.bincount(where, weights=lengths, minlength=opened).astype(np.int64)
        return rows[["doc_id", "row_id", "piece", "length"]].assign(
            part=key[0], sequence=where, offset=at, room=room[where], gap=opened - lower_bound(lengths, capacity), last=where == int(room.argmax())
        )

    part = F.pmod(F.xxhash64(F.lit(seed), "row_id", "piece"), F.lit(parts)).cast("int")
    return items.select("doc_id", "row_id", "piece", "length", part.alias("part")).groupBy("part").applyInPandas(pack, PACKED)


def assign(space: Workspace, items: DataFrame, capacity: int = CAPACITY, group_rows: int = 65536, rounds: int = 30) -> DataFrame:
    """(row_id, piece, sequence_id, offset) of every item; the sequence ids are no run of numbers.  What the last
    round leaves without a certificate is logged."""
    done: list[DataFrame] = []
    own = F.struct(F.col("round"), F.col("part"), F.col("sequence"))
    count = items.count()
    last_used = None
    for k in range(rounds + 1):
        parts = max(1, -(-count // group_rows))
        packed = space.write(_pack(items, parts, 1000 + k, capacity).withColumn("round", F.lit(k)), f"packed-{k}")
        # full sequences and certified parts are final, but for a part's emptiest sequence
        again = (F.col("room") > 0) & ((F.col("gap") > 0) | F.col("last"))
        used = packed.select(own.alias("s"), again.alias("again")).agg(F.countDistinct("s"), F.countDistinct(F.when(F.col("again"), F.col("s"))), F.count(F.when(F.col("again"), 1))).first()
        total, open_, count = (int(x) for x in used)
        saved = last_used is None or total < last_used
        if last_used is not None and not saved:
            # the round before was no worse: its sequences stand
            done.append(previous)
            break
        if k == rounds or parts == 1 or not count:
            done.append(packed)
            break
        done.append(packed.filter(~again))
        previous, last_used = packed.filter(again), open_
        items = previous
    last = done[-1].agg(F.countDistinct(F.when(F.col("gap") > 0, F.col("part"))).alias("parts"), F.max("gap").alias("gap")).first()
    if last["parts"]:
        logging.getLogger(__name__).warning("packing: %d parts stay up to %d sequences over their bounds", last["parts"], last["gap"])
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    number = F.col("round").cast("long") * (1 << 58) + F.col("part").cast("long") * (1 << 30) + F.col("sequence")
    return out.select("row_id", "piece", number.alias("sequence_id"), "offset")


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: dict | None = None, group_rows: int = 65536, rounds: int = 30, with_ids: bool = False) -> DataFrame:
    """A row per piece of ``docs`` (``doc_id``, ``text``): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset and, if asked for, ids.

    Null and empty texts are their end id alone.  Rows with the same doc_id, null or not, are
    documents of their own.  Texts of any length are encoded whole.  An empty table gives an empty
    result.  Other columns, of any name, are not read.
    """
    space = Workspace(spark, "packing")
    made = space.write(pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces")
    items = made.filter(F.col("length") < capacity).select("doc_id", "row_id", "piece", "length")
    placed = space.write(assign(space, items, capacity, group_rows, rounds), "placed")
    space.keep_only("pieces", "placed")
    full = made.filter(F.col("length") == capacity)
    # a full piece is a sequence; negative numbers keep clear of the others
    alone = full.withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = made.filter(F.col("length") < capacity).join(placed, ["row_id", "piece"])
    return rest.select(alone.columns).unionByName(alone).drop("row_id")
