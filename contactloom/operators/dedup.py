"""Quasi-duplicates at one base pair: a greedy scan along a chromosome.

Reads are taken by (chrms1, cuts1) and, for ties, by cuts2 and all else.  One that is still there
removes later reads with equal chrms2 and strands whose cuts1 is less than ``offset`` farther and
whose distance (sum or max over both sides) is less than ``offset``.  Removed reads remove none.

Only reads that agree in chromosomes and strands meet, and none farther apart than ``offset``.  So
positions are cut into blocks of ``offset``; an empty block ends a chain, and chains are worked off on
their own.  Chains are found on the table of blocks that hold reads, not on the reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["chrms1", "chrms2", "strands1", "strands2"]


def greedy_keep(p1: np.ndarray, p2: np.ndarray, offset: int, method: str = "max") -> np.ndarray:
    """Which of the reads, sorted by (p1, p2), stay.  Those with no other read in their cell of a grid of
    ``offset`` or in the eight around it meet none, so they are left out of the scan."""
    keep = np.ones(len(p1), bool)
    met = np.flatnonzero(_crowded(p1, p2, offset))
    p1, p2 = p1[met], p2[met]
    stay, ends = np.ones(len(met), bool), np.searchsorted(p1, p1 + offset, "left")
    for i, end in enumerate(ends.tolist()):
        if end == i + 1 or not stay[i]:
            continue
        d1, d2 = p1[i + 1 : end] - p1[i], np.abs(p2[i + 1 : end] - p2[i])
        stay[i + 1 : end] &= ~((np.maximum(d1, d2) if method == "max" else d1 + d2) < offset)
    keep[met] = stay
    return keep


def _crowded(p1: np.ndarray, p2: np.ndarray, offset: int) -> np.ndarray:
    """Which reads have another one in their cell of the grid or in a cell beside it."""
    if not len(p1):
        return np.zeros(0, bool)
    x, y = p1 // offset, p2 // offset
    x, y = x - x.min() + 1, y - y.min() + 1
    wide = int(y.max()) + 2
    cells, at, n = np.unique(x * wide + y, return_inverse=True, return_counts=True)
    out = n > 1
    for step in (1, wide - 1, wide, wide + 1):
        found = np.searchsorted(cells, cells + step)
        hit = np.flatnonzero((found < len(cells)) & (cells[np.minimum(found, len(cells) - 1)] == cells + step))
        out[hit] = True
        out[found[hit]] = True
    return out[at]


def quasi_duplicates(contacts: DataFrame, offset: int = 500, method: str = "max") -> DataFrame:
    """The reads that stay, of canonical contacts.  The contact schema has no nulls."""
    schema, names = contacts.schema, contacts.columns
    block = F.expr(f"cuts1 div {offset}")
    w = Window.partitionBy(*KEYS).orderBy("_block")
    blocks = contacts.select(*KEYS, block.alias("_block")).distinct()
    blocks = blocks.withColumn("_new", F.coalesce((F.col("_block") - F.lag("_block").over(w) > 1).cast("int"), F.lit(1)))
    chains = blocks.withColumn("_chain", F.sum("_new").over(w)).drop("_new")
    own = contacts.withColumn("_block", block).join(chains, [*KEYS, "_block"]).select(*names, "_chain")
    rest = [c for c in names if c not in (*KEYS, "cuts1", "cuts2")]

    def kept(rows: pd.DataFrame) -> np.ndarray:
        """Which of the rows, in order, stay in their chains."""
        new = np.zeros(len(rows) - 1, bool)
        for c in (*KEYS, "_chain"):
            k = rows[c].to_numpy()
            new |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
        p1, p2 = rows["cuts1"].to_numpy(np.int64), rows["cuts2"].to_numpy(np.int64)
        keep = np.ones(len(rows), bool)
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z - a > 1:
                keep[a:z] = greedy_keep(p1[a:z], p2[a:z], offset, method)
        return keep

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a chain may go on in the next batch: the reads that stayed within the offset of its last one
        # are all that may remove others there, and none of them removes another
        held = None
        for rows in batches:
            if not len(rows):
                continue
            n = 0 if held is None else len(held)
            rows = rows if not n else pd.concat([held, rows], ignore_index=True)
            keep = kept(rows)
            yield rows[n:][keep[n:]][names]
            last = rows.iloc[-1]
            near = keep & (rows["cuts1"].to_numpy(np.int64) > int(last["cuts1"]) - offset)
            for c in (*KEYS, "_chain"):
                near &= rows[c].to_numpy() == last[c]
            held = rows[near]

    placed = own.repartition(*KEYS, "_chain").sortWithinPartitions(*KEYS, "_chain", "cuts1", "cuts2", *rest)
    return placed.mapInPandas(scan, schema)
