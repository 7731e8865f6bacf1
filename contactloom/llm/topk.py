"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of ``lists`` partial scores, one for each group of dimensions.  For a block of
queries at a time:

1. Every partition gathers, for each query and each list, its local highest partial scores, and
   resolves these candidates.  The k-th highest score found anywhere is a safe cutoff: at least k
   vectors reach it.
2. The cutoffs are broadcast (one number for each query of the block).  A vector that reaches its
   query's cutoff has a partial score of at least cutoff / lists in some list; each partition
   collects the entries that do.  They suffice.
3. Their remaining partial scores are resolved exactly; a partition passes on the k best that
   reach the cutoff, ties by the smaller id, and the best of these are the answer.

A block has ``block_rows`` queries whatever the table's size, so what is broadcast is bounded, and
each block reads all vectors once per phase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

SCORES = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v: each component x as floor(scale * x).  Rows whose vector or id is null, or whose
    vector is empty or has a null or non-finite component, are left out."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull()).filter(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _groups(d: int, lists: int) -> list[np.ndarray]:
    return [g for g in np.array_split(np.arange(d), lists) if len(g)]


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length d as a matrix, and which rows they are."""
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.nonzero(sizes == d)[0]
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(rows) == len(sizes):
        return flat.reshape(len(sizes), d), rows
    starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    return np.array([flat[starts[r] : starts[r] + d] for r in rows], dtype=np.int64).reshape(len(rows), d), rows


def _partial(q: np.ndarray, v: np.ndarray, groups: list[np.ndarray]) -> list[np.ndarray]:
    """Exact partial scores: as doubles where they can't exceed 2**53, else as long integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if top < 2.0**52 else np.int64
    return [q[:, g].astype(kind) @ v[:, g].astype(kind).T for g in groups]


def _best(score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    return np.lexsort((vec, -score))[:k]


def _rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q, v, s = (np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])


def _search_block(space: Workspace, vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, lists: int, name: str) -> DataFrame:
    spark, d = space.spark, queries.shape[1]
    block = spark.sparkContext.broadcast((query_ids, queries))
    chunk = max(1, 4_000_000 // max(1, len(query_ids)))  # entries of a score matrix held at a time

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: the best of each list, and only those, resolved; the k best scores of a partition."""
        ids, q = block.value
        groups = _groups(d, lists)
        kept = np.full((len(ids), 0), 0)
        for batch in batches:
            matrix, rows = _matrix(batch.column(1), d)
            vec = batch.column(0).to_numpy()[rows]
            for s in range(0, len(vec), chunk):
                part = _partial(q, matrix[s : s + chunk], groups)
                own = ids[:, None] == vec[None, s : s + chunk]
                take = min(k + 1, own.shape[1])
                picked = np.concatenate([np.argpartition(-p, take - 1, axis=1)[:, :take] for p in part], axis=1)
                picked.sort(axis=1)
                again = np.zeros(picked.shape, bool)
                again[:, 1:] = picked[:, 1:] == picked[:, :-1]
                scores = sum(np.take_along_axis(p, picked, 1) for p in part).astype(np.float64)
                # itself, and the same entry from another list, are no further candidates
                scores[again | np.take_along_axis(own, picked, 1)] = -np.inf
                kept = np.concatenate([kept, scores], axis=1)
                if kept.shape[1] > k:
                    kept = -np.partition(-kept, k - 1, axis=1)[:, :k]
        for i, row in enumerate(kept):
            row = row[np.isfinite(row)]
            row = np.where(np.abs(row) < 2.0**52, row, row - np.abs(row) * 2.0**-50)  # a rounded score stays below
            if len(row):
                yield _rows([(np.full(len(row), ids[i]), np.zeros(len(row)), np.floor(row))])

    # a query that finds fewer than k has no cutoff, and phase 2 resolves all its entries
    gathered = vectors.mapInArrow(local, SCORES).select("query_id", "score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    low = gathered.withColumn("place", place).filter(F.col("place") == k).select("query_id", "score")
    cutoffs = {r["query_id"]: r["score"] for r in low.collect()}
    least = np.iinfo(np.int64).min
    cutoff = spark.sparkContext.broadcast(np.array([cutoffs.get(int(i), least) for i in query_ids], dtype=np.int64))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: entries over the uniform threshold, resolved; a partition's k best."""
        ids, q = block.value
        low = cutoff.value
        groups = _groups(d, lists)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            matrix, rows = _matrix(batch.column(1), d)
            vec = batch.column(0).to_numpy()[rows]
            for s in range(0, len(vec), chunk):
                own = vec[s : s + chunk]
                part = _partial(q, matrix[s : s + chunk], groups)
                entries = np.zeros(part[0].shape, bool)
                for p in part:
                    entries |= p >= low[:, None] / len(groups)
                a, b = np.nonzero(entries & (ids[:, None] != own[None, :]))
                total = sum(p[a, b] for p in part)
                keep = total >= low[a]
                a, b, total = a[keep], b[keep], total[keep].astype(np.int64)
                edges = np.flatnonzero(np.diff(a)) + 1
                for span in np.split(np.arange(len(a)), edges):
                    if len(span):
                        i = int(a[span[0]])
                        score, got = total[span], own[b[span]]
                        if i in best:
                            score, got = np.concatenate([best[i][0], score]), np.concatenate([best[i][1], got])
                        top = _best(score, got, k)
                        best[i] = score[top], got[top]
        if best:
            yield _rows([(np.full(len(v), ids[i]), v, s) for i, (s, v) in best.items()])

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = vectors.mapInArrow(resolve, SCORES).withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
    out = space.write(found.select("query_id", "rank", "vec_id", "score"), name)
    block.destroy()
    cutoff.destroy()
    return out


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products among
    ``vectors`` but rows with its own id; all of them, if fewer.

    Both tables have vec_id and v (array of long, see ``quantised``).  Vectors of another length
    than the query's are no candidates.  Rows that repeat an id are candidates each; a query id
    that repeats counts once, with its smallest vector.  Empty tables give an empty result.
    """
    space = Workspace(spark, "topk")
    vectors = space.write(vectors, "vectors")
    ids = space.write(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")), "queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out, n = [], 0
    lengths = [r["d"] for r in ids.select("d").distinct().collect()]
    for d in sorted(lengths):
        last = None
        while True:
            # the next block by id: a bounded number of rows comes to the driver
            own = ids.filter(F.col("d") == d)
            if last is not None:
                own = own.filter(F.col("vec_id") > last)
            rows = own.orderBy("vec_id").limit(block_rows).collect()
            if not rows:
                break
            last = rows[-1]["vec_id"]
            query_ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
            block = np.array([r["v"] for r in rows], dtype=np.int64)
            out.append(_search_block(space, vectors, query_ids, block, k, lists, f"found-{n}"))
            n += 1
    space.drop("vectors", "queries")
    return spark.read.schema(empty.schema).parquet(*[space.path(f"found-{i}") for i in range(n)]) if out else empty
