"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has 64 bits, from the XXH64 hashes of its word shingles.  Two fingerprints
link if they differ in at most ``radius`` bits; a component is what links reach.

1. Documents with one fingerprint become one node (with the smallest doc_id and a count).
2. Node fingerprints are cut into ``blocks`` blocks of bits.  Fingerprints within ``radius`` agree
   in at least ``blocks - radius`` whole blocks, so each node is listed once for each choice of
   so many blocks, and every linked pair meets in a list.  Distances to pivots alone can't make
   such lists: the distances of unrelated fingerprints all lie around 32, and the pivot test alone
   would have to see every pair.
3. In a list, a table of Hamming distances to ``pivots`` reference fingerprints is precomputed.  By
   the triangle inequality, a pair with a coordinate difference over ``radius`` is no link; what
   survives is verified.  A list gives a spanning forest of its links, not all its pairs.
4. Lists longer than ``list_rows`` are cut into parts, and every two parts meet in a task.
5. Components come from rounds of star contraction on the forests' edges (``components``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import frugal
from .common import Workspace
from .components import components

BITS = 64


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased.  For bytes, white space is the space and the
    controls 9 to 13, and upper case is A-Z, no more."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; a text without words has 0."""
    import xxhash

    own = words(text)
    if not own:
        return 0
    n = max(1, len(own) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, 65536):  # a very long text takes bounded memory
        count = min(65536, n - start)
        hashes = np.fromiter((digest(join(own[i : i + width]), seed) for i in range(start, start + count)), np.uint64, count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``others`` (as longs) and fp, the fingerprint's bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *ids, texts = batch.columns
            made = np.fromiter((fingerprint(t.as_py(), width, seed) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*ids, pa.array(made.view(np.int64))], names=[*names, "fp"])

    names = ["doc_id", *others]
    slim = docs.select(*[F.col(c).cast("long").alias(c) for c in names], F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(frugal(scan), ", ".join(f"{c} long" for c in [*names, "fp"]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask of bits for each choice of ``blocks - radius`` of the blocks."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(BITS), blocks)]
    return [_signed(sum(chosen)) for chosen in itertools.combinations(parts, blocks - radius)]


def blocks_for(nodes: int, radius: int) -> int:
    """Blocks so that unrelated fingerprints rarely share a list: 64 bits give a list key of
    64 * (blocks - radius) / blocks bits, which should exceed log2(nodes) by 3 or more."""
    blocks = radius + 2
    while blocks < radius + 5 and BITS * (blocks - radius) / blocks < np.log2(max(nodes, 2)) + 3:
        blocks += 1
    return blocks


def references(count: int, seed: int = 7) -> np.ndarray:
    """Pivots: random fingerprints, the same for the same seed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.random.default_rng(seed + 1).integers(0, 2, count).astype(np.uint64)


def _forest(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, pivots: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows that are sorted by ``key``; of a list cut in parts
    only links across the sides count (side 2: any).

    Compares each row with the next one, then the one after, and so on while keys are equal.
    Pairs that the forest already joins are left out before anything is compared, so memory stays
    in proportion to the rows however many pairs link.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    parent = np.arange(len(key))
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = np.arange(len(key) - 1)
    step = 1
    while len(at := at[at < len(key) - step]):
        at = at[key[at] == key[at + step]]
        a = at[parent[at] != parent[at + step]]
        b = a + step
        for p in range(table.shape[1]):  # coordinate by coordinate, on the pairs left
            keep = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[keep], b[keep]
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & ((side[a] != side[b]) | (side[a] == 2))
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
        if near.any():
            while (parent != (up := parent[parent])).any():
                parent = up
        step += 1
    return out


def links(spark: SparkSession, space: Workspace, nodes: DataFrame, count: int, radius: int = 4, blocks: int | None = None, pivots: int = 16, list_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``nodes.fp`` within ``radius`` bits."""
    masks = block_masks(blocks or blocks_for(count, radius), radius)
    listed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits"))
    long = listed.groupBy("choice", "bits").count().filter(F.col("count") > list_rows)
    long = space.write(long.select("choice", "bits", F.ceil(F.col("count") / list_rows).cast("int").alias("parts")), "long")
    if long.isEmpty():
        met = listed.select("choice", "bits", F.lit(0).alias("pair"), F.lit(2).alias("side"), "fp")
    else:
        # part i of a long list meets part j in the pair (i, j), whose side says which part it is
        cut = listed.join(long, ["choice", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        cut = cut.select("choice", "bits", "fp", "parts", "own", other)
        met = cut.select(
            "choice",
            "bits",
            (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("pair"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
            "fp",
        )
    reference = references(pivots)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of a list that may go on in the next batch

        def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            key = np.zeros(len(rows), np.int64)
            key[1:] = np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1))
            fp = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            if edges := _forest(key, rows[:, 3], fp, radius, reference):
                own = fp.view(np.int64)
                pairs = np.array([(own[x], own[y]) for x, y in edges], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if held:
                rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            same = (rows[:, :3] == rows[-1, :3]).all(1)
            first = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [rows[first:]]
            if first:
                yield from done(rows[:first])
        if held:
            yield from done(held[0])

    keys = ["choice", "bits", "pair"]
    return met.repartition(*keys).sortWithinPartitions(*keys, "side", "fp").mapInArrow(frugal(scan), "a long, b long")


def near_dedup(spark: SparkSession, docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, space: Workspace | None = None, **options) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``): doc_id, fp, component_id.

    component_id is the smallest doc_id of the component.  Null texts, empty texts and texts of
    white space have fingerprint 0, which links like any other.  Null doc_ids keep their rows and
    never name a component unless it has no other.  Repeated rows are members like any others.  An
    empty table gives an empty result.  Other columns, of any name, are not read.
    """
    space = space or Workspace(spark, "simhash")
    members = space.write(fingerprints(docs, width, seed), "members")
    nodes = space.write(members.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = space.write(links(spark, space, nodes, nodes.count(), radius, **options).distinct(), "edges")
    roots = components(space, edges)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = space.write(named, "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = space.write(named.join(ids, "root").select("fp", "component_id"), "classes")
    space.keep_only("members", "classes")
    return members.join(classes, "fp").select("doc_id", "fp", "component_id")


def candidates(spark: SparkSession, texts: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, **options) -> DataFrame:
    """Pairs (id, to) of rows of ``texts`` (doc, id, text) whose fingerprints are near, ``to`` being the
    earlier one by doc, then id: every row with the first one of its fingerprint, and the first ones of
    two fingerprints for each edge of the forest of links."""
    space = Workspace(spark, "simhash-candidates")
    made = fingerprints(texts.withColumnRenamed("doc", "doc_id"), width, seed, ("id",))
    members = space.write(made.withColumnRenamed("doc_id", "doc"), "members")
    nodes = space.write(members.groupBy("fp").agg(F.min(F.struct("doc", "id")).alias("first")), "nodes")
    edges = space.write(links(spark, space, nodes, nodes.count(), radius, **options).distinct(), "edges")
    same = members.join(nodes, "fp").filter(F.col("id") != F.col("first.id")).select("id", F.col("first.id").alias("to"))
    ends = edges.join(nodes.select(F.col("fp").alias("a"), F.col("first").alias("one")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("first").alias("two")), "b")
    near = ends.select(F.greatest("one", "two")["id"].alias("id"), F.least("one", "two")["id"].alias("to"))
    found = space.write(same.unionByName(near).distinct(), "found")
    space.keep_only("found")
    return found


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: that of the smallest doc_id, null
    ids last; of rows that share it, the first as they were read.  Rows are told apart by a number of
    their own, so rows without an id, or with one id and other texts, are judged one by one."""
    from .common import free_name

    space = Workspace(spark, "simhash-keep")
    own = free_name(docs, "_row")
    rows = space.write(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    found_in = Workspace(spark, "simhash")
    found = near_dedup(spark, rows.select(F.col(own).alias("doc_id"), "text"), space=found_in, **options)
    ids = rows.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("id"))
    named = found.join(ids, F.col("doc_id") == F.col("row"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    kept = space.write(first.select(F.col("first.row").alias("_kept_row")), "kept")
    found_in.keep_only()
    return rows.join(kept, F.col(own) == F.col("_kept_row"), "left_semi").drop(own)


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
