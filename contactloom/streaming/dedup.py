"""Streams of contacts: exact pair deduplication, greedy quasi-duplicates, and counts.

The greedy scan keeps, per (chrms1, chrms2, strands1, strands2), the reads that a later one could
still be near to.  Reads of a key must come in order of cuts1, as a sorted file has them; a position
plays the part of event time, and state older than ``offset`` behind the last read is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["chrms1", "chrms2", "strands1", "strands2"]
OUT = "chrms1 int, chrms2 int, strands1 boolean, strands2 boolean, cuts1 int, cuts2 int"


def unique_pairs(stream: DataFrame) -> DataFrame:
    """First arrivals of each unordered pair of positions, kept without expiry."""
    a, b = F.struct(F.col("chrms1").alias("c"), F.col("cuts1").alias("p")), F.struct(F.col("chrms2").alias("c"), F.col("cuts2").alias("p"))
    return stream.withColumn("pair", F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))).dropDuplicates(["pair"]).drop("pair")


def pixel_counts(stream: DataFrame, resolution: int) -> DataFrame:
    """Running pixel counts by chromosome pair and bins of cuts; for ``update`` or ``complete``."""
    own = stream.filter("chrms1 >= 0 AND chrms2 >= 0")
    return own.groupBy("chrms1", F.expr(f"cuts1 div {resolution}").alias("pos1"), "chrms2", F.expr(f"cuts2 div {resolution}").alias("pos2")).agg(F.count("*").alias("value"))


def quasi_duplicates(stream: DataFrame, offset: int = 500, method: str = "max") -> DataFrame:
    """The reads that stay; equal to the batch operator on the whole input, chunk by chunk."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        from contactloom.operators.dedup import greedy_keep

        held1, held2 = (np.array(x, dtype=np.int64) for x in state.get) if state.exists else (np.zeros(0, np.int64),) * 2
        rows = pd.concat(list(batches)).sort_values(["cuts1", "cuts2"], kind="stable")
        n = len(held1)
        p1 = np.concatenate([held1, rows["cuts1"].to_numpy(np.int64)])
        p2 = np.concatenate([held2, rows["cuts2"].to_numpy(np.int64)])
        keep = greedy_keep(p1, p2, offset, method)
        keep[:n] = True  # what is held has stayed before
        near = keep & (p1 > p1[-1] - offset)
        state.update((p1[near].tolist(), p2[near].tolist()))
        out = rows[keep[n:]]
        yield pd.DataFrame({**dict(zip(KEYS, key, strict=True)), "cuts1": out["cuts1"].to_numpy(), "cuts2": out["cuts2"].to_numpy()}, index=range(len(out)))

    return stream.groupBy(*KEYS).applyInPandasWithState(step, OUT, "held1 array<bigint>, held2 array<bigint>", "append", "NoTimeout")
