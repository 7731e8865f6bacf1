"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met in three steps: whole passes over the source; of what remains, a fixed
share of the documents of each exact length; and a bounded-knapsack dynamic programme over the
lengths for the budget still left.  Its answer is a number of documents for each length, and which
documents these are follows from a seeded hash of the rows.

The corpus is counted by (source, length), so what a source's programme sees is a histogram with
as many rows as there are lengths.  To pick n documents of a length without ranking all of them in
one task, they are dealt to ``salts`` by the seeded hash; the salts are taken whole in order, and
only the rows of the salt in which n falls are ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, free_name, text_or_empty

WEIGHTS = (3, 1, 2)


def word_count(text="text"):
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, none above ``most`` times
    its own; what is above goes to the others by weight until none is above."""
    budget, out = share * sum(sizes), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if budget * weights[i] > most * sizes[i] * total]
        if not over:
            for i in free:
                out[i] = budget * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        budget -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def programme(sizes: list[int], counts: list[int], target: int, unit: int) -> tuple[list[int], int]:
    """Bounded knapsack over bit sets of reachable sums, in steps of ``unit`` (sizes rounded up): how
    many documents of each size come nearest ``target``, and their sum.  For a unit of 1 that is
    the exact optimum, from above or below; else the sum is no larger than the target."""
    steps = [-(-s // unit) for s in sizes]
    usable = [i for i, (s, c) in enumerate(zip(steps, counts, strict=True)) if c and s <= target // unit * (2 if unit == 1 else 1)]
    goal = target // unit
    # nothing at all is as far below as twice the target is above
    limit = goal * (2 if unit == 1 else 1)
    full = (1 << (limit + 1)) - 1
    reached, items = 1, []  # counts split into powers of two; first[sum] is the item that reached it
    first = np.full(limit + 1, -1, np.int32)
    for i in sorted(usable, key=lambda i: -steps[i]):
        left, part = min(counts[i], limit // steps[i]), 1
        while left and not reached >> goal & 1:
            n = min(part, left)
            new = reached << n * steps[i] & full & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits[: limit + 1])] = len(items)
                items.append((i, n))
                reached |= new
            left -= n
            part *= 2
    below = (reached & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reached >> goal
    at = below if not above else min(below, goal + (above & -above).bit_length() - 1, key=lambda x: abs(x - goal))
    taken = [0] * len(sizes)
    while at:  # what a sum was made from had been reached by earlier items
        i, n = items[first[at]]
        taken[i] += n
        at -= n * steps[i]
    return taken, sum(s * t for s, t in zip(sizes, taken, strict=True))


def fit_budget(sizes: list[int], counts: list[int], budget: int, least: int = 1 << 16, sums: int = 1 << 24) -> list[int]:
    """How many documents of each size (distinct, positive) to take, so that their sum comes as
    near ``budget`` as it can.

    A fixed share of each size comes first and keeps the mix of lengths; where the rest can't be met
    then, half the share does, and so on down to none.  Larger sizes fill what is left down to eight times the largest size (``least`` at least), so that the programme always
    has room for several documents of any size and never starts from a dead end.  A rest of more
    than ``sums`` words is stepped through coarsely first, then what that leaves more finely.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return list(counts)
    share, best, apart = [c * budget // total for c in counts], list(counts), total - budget
    while apart:
        taken = _filled(sizes, counts, share, budget, least, sums)
        if (gap := abs(budget - sum(s * t for s, t in zip(sizes, taken, strict=True)))) < apart:
            best, apart = taken, gap
        if not any(share):
            break
        share = [n // 2 for n in share]
    return best


def _filled(sizes: list[int], counts: list[int], share: list[int], budget: int, least: int, sums: int) -> list[int]:
    """``share`` and what else comes nearest the budget."""
    taken = list(share)
    rest = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    while True:
        left = [c - t if s <= rest else 0 for s, c, t in zip(sizes, counts, taken, strict=True)]
        window = max([least, *(8 * s for s, n in zip(sizes, left, strict=True) if n)])
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            more = min(left[i], max(0, rest - window) // sizes[i])
            taken[i], left[i], rest = taken[i] + more, left[i] - more, rest - more * sizes[i]
        unit = -(-rest // sums) or 1
        more, filled = programme(sizes, [c - t for c, t in zip(counts, taken, strict=True)], rest, unit)
        taken = [t + m for t, m in zip(taken, more, strict=True)]
        rest -= filled
        if unit == 1 or not filled:
            return taken


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 11, salts: int = 256) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``) with four more columns: size, source_size,
    target and repeats, the times (0 to ``ceil(most)``) that the mix takes the document.

    Null texts and texts without words have size 0 and follow their source's whole passes.  A null
    source is a source, the last one.  Repeated rows are taken one by one.  Rows that are alike in
    doc_id, text and source may trade places, which leaves the result the same.  An empty table
    gives an empty result.  Clashing column names: the added ones get underscores.
    """
    space = Workspace(spark, "mixing")
    size, salt = free_name(docs, "size"), free_name(docs, "_salt")
    order = free_name(docs, "_order")
    rows = docs.withColumn(size, word_count()).withColumn(order, F.xxhash64(F.lit(seed), "doc_id", "text"))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(salts)).cast("int"))
    slim = rows.select(F.col("source").cast("string").alias("source"), F.col(size).alias("size"), F.col(salt).alias("salt"))
    counts = space.write(slim.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "counts")

    # sources are few rows, one each; code point order is that of UTF-8 bytes
    sums = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    listed = sorted(((r["source"], int(r["source_size"])) for r in sums.toLocalIterator()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    own = [weights[i % len(weights)] for i in range(len(listed))]
    goal = targets([n for _, n in listed], own, share, most)
    plan = spark.createDataFrame([(s, n, float(t)) for (s, n), t in zip(listed, goal, strict=True)], "source string, source_size long, target double")

    def fit(key: tuple, lengths: pd.DataFrame) -> pd.DataFrame:
        source_size, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
        passes = int(target // source_size) if source_size else 0
        lengths = lengths.sort_values("size")
        sizes, n = lengths["size"].astype(int).tolist(), lengths["n"].astype(int).tolist()
        budget = round(target) - passes * source_size
        some = [i for i, s in enumerate(sizes) if s > 0]
        extra = np.zeros(len(sizes), dtype=np.int64)
        extra[some] = fit_budget([sizes[i] for i in some], [n[i] for i in some], budget)
        return pd.DataFrame({"source": lengths["source"], "size": sizes, "source_size": source_size, "target": target, "passes": passes, "extra": extra})

    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    lengths = lengths.join(plan, lengths["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    fitted = space.write(
        lengths.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, passes int, extra long"), "fitted"
    )
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("before", before)
    cut = cut.join(fitted.withColumnRenamed("source", "s2").withColumnRenamed("size", "z2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")))
    cut = space.write(
        cut.select(
            F.col("source").alias("_cut_source"),
            F.col("size").alias("_cut_size"),
            F.col("salt").alias("_cut_salt"),
            F.col("source_size").alias("_cut_source_size"),
            F.col("target").alias("_cut_target"),
            F.col("passes").alias("_cut_passes"),
            F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("_cut_take"),
        ),
        "cut",
    )
    space.keep_only("cut")
    joined = rows.join(
        cut,
        F.col("source").cast("string").eqNullSafe(F.col("_cut_source")) & (F.col(size) == F.col("_cut_size")) & (F.col(salt) == F.col("_cut_salt")),
    )
    place = F.row_number().over(Window.partitionBy("_cut_source", "_cut_size", "_cut_salt").orderBy(order, "doc_id"))
    repeats = (F.col("_cut_passes") + (place <= F.col("_cut_take")).cast("int")).alias(free_name(docs, "repeats"))
    return joined.select(
        *docs.columns,
        F.col(size),
        F.col("_cut_source_size").alias(free_name(docs, "source_size")),
        F.col("_cut_target").alias(free_name(docs, "target")),
        repeats,
    )


def mixed_rows(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    times = free_name(docs, "repeats")
    found = mix(spark, docs, **options)
    copy = free_name(found, "_copy")
    return found.filter(F.col(times) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(docs.columns)
