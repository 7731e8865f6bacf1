"""Iterative correction of pixel tables.

The state of a run is the bias of each bin; pixels never change.  A pass sums
``value / (bias1 * bias2)`` by bin, divides the sums by their mean over bins that have any, and
multiplies the biases by the result, 1 for bins without reads.

Small maps (``in_task`` pixels or fewer, counted first) are balanced in one task with numpy, as a
pass is far cheaper than a job.  Larger ones take a distributed pass at a time: pixels are laid out
once, biases are a table of bins, and every few passes it's written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..genome import small
from ..workspace import Workspace

IN_TASK = 2_000_000


def _row_sums(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    off = i != j
    return np.bincount(i, v, n) + np.bincount(j[off], v[off], n)


def balance_arrays(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, passes: int = 50, tol: float = 1e-5, counted: np.ndarray | None = None, root: bool = False) -> tuple[np.ndarray, int]:
    """(bias, passes made) of upper-triangular pixels; ``counted`` says which pixels sums take in,
    ``root`` takes square roots of the sums, a slower and steadier way."""
    bias = np.ones(n)
    off = i != j
    for done in range(1, passes + 1):
        x = v / (bias[i] * bias[j])
        if counted is not None:
            x = np.where(counted, x, 0.0)
        m = np.bincount(i, x, n) + np.bincount(j[off], x[off], n)
        some = m != 0
        if not some.any():
            return bias, done
        m /= m[some].mean()
        error = np.abs(m[some] - 1).max()
        m[~some] = 1
        bias *= np.sqrt(m) if root else m
        if error < tol:
            return bias, done
    return bias, passes


def balance(pixels: DataFrame, passes: int = 50, tol: float = 1e-5, trans_only: bool = False, root: bool = False, n_bins: int | None = None, in_task: int = IN_TASK) -> DataFrame:
    """(bin, bias) of every bin that a pixel has.  ``trans_only`` sums trans pixels (chrom1, chrom2)
    and divides all."""
    counted = F.col("chrom1") != F.col("chrom2") if trans_only else F.lit(True)
    own = pixels.select("bin1", "bin2", F.col("value").cast("double").alias("value"), counted.alias("counted"))
    own = Workspace(pixels.sparkSession, "balance").write(own, "all")  # counted, then worked off
    if own.limit(in_task + 1).count() <= in_task:

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            labels, at = np.unique(np.concatenate([rows["bin1"], rows["bin2"]]), return_inverse=True)
            i, j = at[: len(rows)], at[len(rows) :]
            bias, _ = balance_arrays(i, j, rows["value"].to_numpy(), len(labels), passes, tol, rows["counted"].to_numpy() if trans_only else None, root)
            return pd.DataFrame({"bin": labels.astype(np.int32), "bias": bias})

        return own.groupBy(F.lit(0).alias("all")).applyInPandas(run, "bin int, bias double")
    return _distributed(own, passes, tol, root, n_bins)


def _distributed(own: DataFrame, passes: int, tol: float, root: bool, n_bins: int | None) -> DataFrame:
    space = Workspace(own.sparkSession, "balance")
    # by both bins: a bin with very many pixels is spread
    own = space.write(own.repartition("bin1", "bin2"), "pixels")
    bias = space.write(_ends(own).select("bin").distinct().withColumn("bias", F.lit(1.0)), "bias-0")
    rows = n_bins or bias.count()
    for k in range(1, passes + 1):
        m = one_pass(own, bias, rows)
        step = F.sqrt("m") if root else F.col("m")
        both = m.withColumnRenamed("bin", "_b")
        new = bias.join(both, F.col("bin") == F.col("_b"), "left").select(
            "bin", (F.col("bias") * F.coalesce(step, F.lit(1.0))).alias("bias"), F.abs(F.coalesce("m", F.lit(1.0)) - 1).alias("error")
        )
        new = space.write(new, f"bias-{k}")
        bias = new.select("bin", "bias")
        if new.agg(F.max("error")).first()[0] < tol:
            break
    return bias


def _ends(own: DataFrame) -> DataFrame:
    return own.select(F.explode(F.array("bin1", "bin2")).alias("bin"))


def one_pass(own: DataFrame, bias: DataFrame, n_bins: int) -> DataFrame:
    """(bin, m): row sums under the biases, over their mean."""
    x = own if "counted" in own.columns else own.withColumn("counted", F.lit(True))
    for s in "12":
        b = small(bias.select(F.col("bin").alias("_b"), F.col("bias").alias("_w" + s)), n_bins)
        x = x.join(b, F.col("bin" + s) == F.col("_b")).drop("_b")
    x = x.filter("counted").withColumn("x", F.col("value") / (F.col("_w1") * F.col("_w2")))
    each = F.when(F.col("bin1") == F.col("bin2"), F.array(F.col("bin1"))).otherwise(F.array("bin1", "bin2"))
    sums = x.select(F.explode(each).alias("bin"), "x").groupBy("bin").agg(F.sum("x").alias("s")).filter("s <> 0")
    return sums.join(F.broadcast(sums.agg(F.avg("s").alias("mean")))).select("bin", (F.col("s") / F.col("mean")).alias("m"))


def fixed_passes(pixels: DataFrame, passes: int, n_bins: int, trans_only: bool = False) -> DataFrame:
    """(bin, bias) after so many passes.  Each pass reads the biases several times, so they're
    written between passes: one plan for all would grow as a power of their number."""
    space = Workspace(pixels.sparkSession, "passes")
    own = pixels.select("bin1", "bin2", F.col("value").cast("double").alias("value"), *([(F.col("chrom1") != F.col("chrom2")).alias("counted")] if trans_only else []))
    own = space.write(own, "pixels")
    bias = space.write(_ends(own).distinct().withColumn("bias", F.lit(1.0)), "bias-0")
    for k in range(passes):
        m = one_pass(own, bias, n_bins).withColumnRenamed("bin", "_m")
        new = bias.join(small(m, n_bins), F.col("bin") == F.col("_m"), "left").select("bin", (F.col("bias") * F.coalesce("m", F.lit(1.0))).alias("bias"))
        bias = space.write(new, f"bias-{k + 1}")
    return bias


def corrected(pixels: DataFrame, biases: DataFrame, n_bins: int) -> DataFrame:
    """Pixels divided by both biases; other columns stay."""
    out = pixels
    for s in "12":
        b = small(biases.select(F.col("bin").alias("_b"), F.col("bias").alias("_w" + s)), n_bins)
        out = out.join(b, F.col("bin" + s) == F.col("_b")).drop("_b")
    return out.withColumn("value", F.col("value") / (F.col("_w1") * F.col("_w2"))).drop("_w1", "_w2")


def corrected_singles(singles: DataFrame, biases: DataFrame) -> DataFrame:
    """Single-sided reads (bin, n) over the bins' biases."""
    return singles.join(biases, "bin").select("bin", (F.col("n") / F.col("bias")).alias("n"))


def marginal_error(totals: DataFrame, p: float = 0.999) -> DataFrame:
    """One row: the percentile of absolute deviations from the mean row sum, over the mean of those
    that aren't zero; 99999 without any."""
    own = totals.filter("total <> 0")
    mean = own.agg(F.avg("total").alias("mean"))
    return own.join(F.broadcast(mean)).agg(
        F.coalesce(F.percentile(F.abs(F.col("total") - F.col("mean")), F.lit(p)) / F.first("mean"), F.lit(99999.0)).alias("error")
    )


def by_fragments(contacts: DataFrame, least: int = 50, tol: float = 0.01, passes: int = 100) -> DataFrame:
    """(bin, bias) of fragments with more than ``least`` reads."""
    # reads of a pair of fragments stay or go together: counted once, then by their pairs
    space = Workspace(contacts.sparkSession, "by-fragments")
    pairs = space.write(contacts.groupBy("rfrag1", "rfrag2").agg(F.count("*").alias("value")), "pairs")
    each = pairs.select(F.explode(F.array("rfrag1", "rfrag2")).alias("rfrag"), "value").filter("rfrag >= 0")
    some = each.groupBy("rfrag").agg(F.sum("value").alias("n")).filter(F.col("n") > least).select(F.col("rfrag").alias("_k"))
    own = pairs.filter("rfrag1 >= 0 AND rfrag2 >= 0")
    for s in "12":
        own = own.join(some, F.col("rfrag" + s) == F.col("_k"), "left_semi")
    own = own.groupBy(F.least("rfrag1", "rfrag2").alias("bin1"), F.greatest("rfrag1", "rfrag2").alias("bin2")).agg(F.sum("value").alias("value"))
    return balance(own, passes, tol)


def by_reads(contacts: DataFrame, steps: int = 10) -> DataFrame:
    """Contacts with a weight such that weights of a fragment's reads sum to about 1.

    A fragment at a time, in order, would make the result hang on the order; here a step divides
    each weight by the roots of both fragments' sums at once.  Both ways end at the same weights.
    The run works on counts by fragment pair, as reads of a pair share their weight.
    """
    pairs = contacts.groupBy("rfrag1", "rfrag2").agg(F.count("*").alias("value"))
    pixels = pairs.select(F.least("rfrag1", "rfrag2").alias("bin1"), F.greatest("rfrag1", "rfrag2").alias("bin2"), "value")
    pixels = pixels.groupBy("bin1", "bin2").agg(F.sum("value").alias("value"))
    space = Workspace(contacts.sparkSession, "read-weights")
    own = space.write(pixels, "pixels")
    w = _ends(own).distinct().withColumn("w", F.lit(1.0))
    for k in range(steps):
        x = own
        for s in "12":
            x = x.join(w.select(F.col("bin").alias("_b"), F.col("w").alias("_w" + s)), F.col("bin" + s) == F.col("_b")).drop("_b")
        x = x.select(F.explode(F.array("bin1", "bin2")).alias("bin"), (F.col("value") * F.col("_w1") * F.col("_w2")).alias("x"))
        sums = x.groupBy("bin").agg(F.sum("x").alias("s"))
        w = space.write(w.join(sums, "bin").select("bin", (F.col("w") / F.sqrt("s")).alias("w")), f"w-{k}")
    out = contacts
    for s in "12":
        out = out.join(w.select(F.col("bin").alias("_b"), F.col("w").alias("_w" + s)), F.col("rfrag" + s) == F.col("_b")).drop("_b")
    return out.withColumn("weight", (F.col("_w1") * F.col("_w2")).cast("float")).drop("_w1", "_w2")


def fake_cis(pixels: DataFrame, bins: DataFrame, n_bins: int, seed: int = 1, chunk: Callable | None = None) -> DataFrame:
    """Cis cells replaced by trans cells of one of their rows, picked by a seeded hash.

    A cell (i, j) takes the value at (i, k) or (j, k), where k is a bin of another chromosome; zero
    cells count as such.  Every run makes the same choices.
    """
    per_chrom = bins.groupBy("chrom").agg(F.count("*").alias("n"), F.min("bin").alias("first"))
    own = small(per_chrom, n_bins)
    cells = bins.select(F.col("bin").alias("bin1"), "chrom").join(bins.select(F.col("bin").alias("bin2"), "chrom"), "chrom").filter("bin1 <= bin2")
    h = F.xxhash64(F.lit(seed), "bin1", "bin2")
    pick = cells.join(own, "chrom").withColumn("row", F.when(F.pmod(h, F.lit(2)) == 0, F.col("bin1")).otherwise(F.col("bin2")))
    # the k-th bin of all bins but those of this chromosome
    k = F.pmod(F.shiftright(h, 8), F.lit(n_bins) - F.col("n"))
    pick = pick.withColumn("k", (k + F.when(k >= F.col("first"), F.col("n")).otherwise(0)).cast("int"))
    source = pixels.filter("chrom1 <> chrom2").select(F.col("bin1").alias("s1"), F.col("bin2").alias("s2"), F.col("value").cast("double").alias("value"))
    made = pick.join(source, (F.least("row", "k") == F.col("s1")) & (F.greatest("row", "k") == F.col("s2")), "left")
    made = made.select("bin1", "bin2", F.col("chrom").alias("chrom1"), F.col("chrom").alias("chrom2"), F.coalesce("value", F.lit(0.0)).alias("value"))
    trans = pixels.filter("chrom1 <> chrom2").select("bin1", "bin2", "chrom1", "chrom2", F.col("value").cast("double").alias("value"))
    return trans.unionByName(made.filter("value > 0"))


def fake_translocations(pixels: DataFrame, bins: DataFrame, n_bins: int, regions: DataFrame, seed: int = 2) -> DataFrame:
    """Cells of rectangles (a1, z1, a2, z2 in bins, ends included) take the value of a cell in the
    same row outside all rectangles' chromosomes pair, picked by a seeded hash."""
    r = F.broadcast(regions.select("a1", "z1", "a2", "z2"))
    inside = ((F.col("bin1").between(F.col("a1"), F.col("z1"))) & (F.col("bin2").between(F.col("a2"), F.col("z2")))) | (
        (F.col("bin1").between(F.col("a2"), F.col("z2"))) & (F.col("bin2").between(F.col("a1"), F.col("z1")))
    )
    cells = regions.select(F.explode(F.sequence("a1", "z1")).alias("i"), "a2", "z2").select("i", F.explode(F.sequence("a2", "z2")).alias("j"))
    cells = cells.select(F.least("i", "j").alias("bin1"), F.greatest("i", "j").alias("bin2")).distinct()
    rest = pixels.join(r, inside, "left_anti")
    k = F.pmod(F.xxhash64(F.lit(seed), "bin1", "bin2"), F.lit(n_bins)).cast("int")
    source = rest.select(F.col("bin1").alias("s1"), F.col("bin2").alias("s2"), "value")
    made = cells.withColumn("k", k).join(source, (F.least("bin1", "k") == F.col("s1")) & (F.greatest("bin1", "k") == F.col("s2")))
    return rest.select("bin1", "bin2", "value").unionByName(made.select("bin1", "bin2", "value"))


def fake_cis_balanced(pixels: DataFrame, bins: DataFrame, n_bins: int, seed: int = 1) -> DataFrame:
    """Trans cells balanced, then twice: cis cells faked and everything balanced."""
    from .pixels import remove_cis

    space = Workspace(pixels.sparkSession, "fake-cis")
    out = remove_cis(pixels)
    out = space.write(corrected(out, balance(out, n_bins=n_bins), n_bins), "trans")
    for k in range(2):
        faked = space.write(fake_cis(out, bins, n_bins, seed + k), f"faked-{k}")
        out = space.write(corrected(faked, balance(faked, n_bins=n_bins), n_bins), f"balanced-{k}")
    return out


def fake_missing(pixels: DataFrame, bins: DataFrame, n_bins: int, seed: int = 3) -> DataFrame:
    """Empty cis cells between bins that have reads take the value of a cell of their diagonal that
    isn't empty, picked by a seeded hash; one that has no such cell stays empty."""
    from pyspark.sql import Window

    from .pixels import sides, with_chroms

    # read five times
    pixels = Workspace(pixels.sparkSession, "fake-missing").write(pixels, "pixels")
    own = with_chroms(pixels, bins, n_bins).filter("chrom1 = chrom2").withColumn("d", F.col("bin2") - F.col("bin1"))
    valid = bins.join(sides(pixels).select("bin").distinct(), "bin", "left_semi").select("bin", "chrom")
    cells = valid.withColumnRenamed("bin", "bin1").join(valid.withColumnRenamed("bin", "bin2"), "chrom").filter("bin1 <= bin2")
    empty = cells.join(own, ["bin1", "bin2"], "left_anti").withColumn("d", F.col("bin2") - F.col("bin1"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("chrom1", "d").orderBy("bin1")) - 1).select(F.col("chrom1").alias("chrom"), "d", "k", "value")
    sizes = own.groupBy(F.col("chrom1").alias("chrom"), "d").agg(F.count("*").alias("n"))
    picked = empty.join(sizes, ["chrom", "d"]).withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "bin1", "bin2"), F.col("n")).cast("int"))
    made = picked.join(ranked, ["chrom", "d", "k"]).select("bin1", "bin2", "value")
    return pixels.select("bin1", "bin2", "value").unionByName(made)
