"""Eigenvectors of contact maps.  A chromosome (or arm, or a whole coarse map) is one dense block in
one task; its size is bounded by the chromosome's length over the resolution.

A block's rows come as (block, i, j, value) with i <= j, bins counted from 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balance import balance_arrays


def dense(rows: pd.DataFrame, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    i, j, v = rows["i"].to_numpy(), rows["j"].to_numpy(), rows["value"].to_numpy(np.float64)
    m[i, j] = v
    m[j, i] = v
    return m


def clear_diagonals(m: np.ndarray, k: int) -> np.ndarray:
    i = np.arange(len(m))
    return np.where(np.abs(i[:, None] - i[None, :]) <= k, 0.0, m)


def fill_diagonal(m: np.ndarray, value: float, k: int) -> np.ndarray:
    """k-th diagonal (below, if negative) set in place."""
    i = np.arange(max(0, len(m) - abs(k)))
    m[(i, i + k) if k >= 0 else (i - k, i)] = value
    return m


def balance_dense(m: np.ndarray, passes: int = 50, tol: float = 1e-5) -> np.ndarray:
    i, j = np.nonzero(np.triu(m))
    if not len(i):
        return m
    bias, _ = balance_arrays(i, j, m[i, j], len(m), passes, tol)
    return m / bias[:, None] / bias[None, :]


def over_expected(m: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """Each diagonal over its mean, over valid cells if a mask is given."""
    n = len(m)
    ok = np.ones((n, n), bool) if valid is None else valid[:, None] & valid[None, :]
    d = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    sums, cells = np.bincount(d[ok], m[ok], n), np.bincount(d[ok], minlength=n)
    mean = np.where((cells > 0) & (sums > 0), sums / np.maximum(cells, 1), 1.0)
    return np.where(ok, m / mean[d], 0.0)


def top_eigen(m: np.ndarray, k: int, subtract: bool = True, divide: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """k eigenpairs of a symmetric matrix of the largest absolute values; vectors of unit length,
    their largest element positive."""
    x = m.astype(float)
    if divide and x.mean():
        x = x / x.mean()
    if subtract:
        x = x - x.mean()
    w, v = np.linalg.eigh(x)
    order = np.argsort(-np.abs(w), kind="stable")[:k]
    v = v[:, order].T
    v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1, 1)[:, None]
    return v, w[order]


def principal(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k principal components of a matrix's rows."""
    centred = m - m.mean(0)
    return top_eigen(centred.T @ centred / max(1, len(m) - 1), k, False, False)


def zero_eigen(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``top_eigen`` of the rows that have values; zeros elsewhere."""
    some = np.abs(m).sum(0) > 0
    v, w = top_eigen(m[np.ix_(some, some)], k) if some.sum() >= k else (np.zeros((k, int(some.sum()))), np.zeros(k))
    out = np.zeros((k, len(m)))
    out[:, some] = v
    return out, w


def ranks(x: np.ndarray) -> np.ndarray:
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[back]


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) < 2 or x.std() == 0 or y.std() == 0:
        return 0.0
    return float(np.corrcoef(ranks(x), ranks(y))[0, 1])


def complete_balance(m: np.ndarray, least: float = 40.0) -> np.ndarray:
    """Near diagonals and rows with less than ``least`` reads out, the rest balanced."""
    x = clear_diagonals(m, 1)
    some = x.sum(0) >= least
    x = np.where(some[:, None] & some[None, :], x, 0.0)
    return balance_dense(x)


def correlation(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.corrcoef(m))


def prepared(m: np.ndarray) -> np.ndarray:
    """What domain recipes share: near diagonals out, balanced, over expected, the top cells held
    down, near diagonals 1."""
    x = over_expected(balance_dense(clear_diagonals(m, 1)))
    cells = x.size
    x = np.minimum(x, np.percentile(x, 100 * min(0.999, (cells - 10) / cells)))
    for k in (-1, 0, 1):
        fill_diagonal(x, 1.0, k)
    return x


def domains_default(m: np.ndarray, k: int) -> np.ndarray:
    return principal(correlation(balance_dense(prepared(m))), k)[0]


def domains_correlation(m: np.ndarray, k: int) -> np.ndarray:
    return principal(correlation(prepared(m)), k)[0]


def domains_balanced(m: np.ndarray, k: int) -> np.ndarray:
    return top_eigen(balance_dense(prepared(m)), k)[0]


def domains_plain(m: np.ndarray, k: int) -> np.ndarray:
    return principal(correlation(over_expected(clear_diagonals(m, 1))), k)[0]


DOMAINS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "default": domains_default, "lieberman": domains_correlation, "erez": domains_correlation, "lieberman+": domains_default,
    "erez+": domains_default, "metaphasepaper": domains_balanced, "lieberman-": domains_plain, "erez-": domains_plain,
}


def cis_eigenvector(m: np.ndarray, gc: np.ndarray | None, k: int = 3, robust: bool = True, sort_by_gc: bool = False) -> np.ndarray:
    """k eigenvectors of a cis map's excess over expected, scaled by the root of their values;
    NaN with at most 5 valid bins."""
    valid = m.sum(0) > 0
    if valid.sum() <= 5:
        return np.full((k, len(m)), np.nan)
    x = m.copy()
    if robust:
        x = np.clip(x, 0, np.percentile(x, 99.5))
        near = 2 * float(np.mean(np.diagonal(x, 2)))
        for d in (-1, 0, 1):
            fill_diagonal(x, near, d)
        x = np.where(valid[:, None] & valid[None, :], x, 0.0)
    x = np.where(valid[:, None] & valid[None, :], over_expected(x, valid) - 1, 0.0)
    v, w = top_eigen(x[np.ix_(valid, valid)], min(int(valid.sum()), 10 if sort_by_gc else k), False, False)
    v = v * np.sqrt(np.abs(w))[:, None]
    if gc is not None:
        rho = np.array([rank_correlation(a, gc[valid]) for a in v])
        v = v * np.where(rho < 0, -1, 1)[:, None]
        if sort_by_gc:
            v = v[np.argsort(-np.abs(rho), kind="stable")]
    out = np.full((k, len(m)), np.nan)
    out[: min(k, len(v)), valid] = v[:k]
    return out


def complete_eigenvector(m: np.ndarray, gc: np.ndarray, smoothing: Callable | None = None) -> np.ndarray:
    """One eigenvector of a raw cis map by the whole recipe; the second if it fits GC better;
    zeros with fewer than 3 valid bins."""
    x = clear_diagonals(m, 1)
    x = np.clip(x, 0, np.percentile(x, 99.5))
    x = complete_balance(x)
    valid = x.sum(0) > 0
    if valid.sum() < 3:
        return np.zeros(len(m))
    near = 2 * float(np.mean(np.diagonal(x, 2)))
    for d in (-1, 0, 1):
        fill_diagonal(x, near, d)
    x = np.where(valid[:, None] & valid[None, :], x, 0.0)
    if smoothing is not None:
        x = smoothing(x, valid)
    x = over_expected(x, valid)
    x = balance_dense(np.clip(x, 0, np.percentile(x, 99.9)))
    if not np.isfinite(x).all():
        return np.zeros(len(m))
    v, _ = zero_eigen(x, 2)
    rho = [rank_correlation(a[valid], gc[valid]) for a in v]
    best = 1 if abs(rho[1]) > abs(rho[0]) else 0
    return v[best] * (-1 if rho[best] < 0 else 1)


def adaptive_smoothing(m: np.ndarray, valid: np.ndarray, smoothness: float = 10.0) -> np.ndarray:
    """Cells with over 2 * smoothness reads stay as they are; from the others, ever wider Gaussians
    take what is left until a cell's smoothed reads suffice.  The sum of valid cells stays."""
    ok = valid[:, None] & valid[None, :]
    x = np.where(ok, m, 0.0)
    keep = x > 2 * smoothness
    out, rest, done = np.where(keep, x, 0.0), np.where(keep, 0.0, x), keep | ~ok
    radius, n, smooth = 1.0, len(m), out
    while not done.all() and radius < n:
        k = np.arange(-int(4 * radius), int(4 * radius) + 1)
        kernel = np.exp(-0.5 * (k / radius) ** 2)
        band = np.zeros((n, n))
        for d, w in zip(k, kernel, strict=True):
            if abs(d) < n:
                band += w * np.eye(n, k=int(d))
        weight = band @ ok.astype(float) @ band.T
        smooth = np.where(weight > 0, band @ rest @ band.T / np.maximum(weight, 1e-300), 0.0)
        area = (kernel.sum()) ** 2
        enough = ~done & (smooth * area >= smoothness)
        out[enough] = smooth[enough]
        done |= enough
        radius *= 1.5
    out[~done] = smooth[~done]
    out = np.where(ok, (out + out.T) / 2, 0.0)
    return out * (x.sum() / out.sum()) if out.sum() else out


def blocks_of(pixels: DataFrame, bins: DataFrame, by: str = "chrom") -> DataFrame:
    """(block, n, first, i, j, value) of pixels within a chromosome or arm."""
    sizes = bins.groupBy(by).agg(F.count("*").cast("int").alias("n"), F.min("bin").alias("first"))
    own = bins.select(F.col("bin"), F.col(by).alias("block"))
    x = pixels.join(own.select(F.col("bin").alias("_1"), F.col("block").alias("_c1")), F.col("bin1") == F.col("_1"))
    x = x.join(own.select(F.col("bin").alias("_2"), F.col("block").alias("_c2")), F.col("bin2") == F.col("_2")).filter("_c1 = _c2")
    x = x.join(F.broadcast(sizes.withColumnRenamed(by, "block")), F.col("_c1") == F.col("block"))
    return x.select("block", "n", "first", (F.col("bin1") - F.col("first")).alias("i"), (F.col("bin2") - F.col("first")).alias("j"), F.col("value").cast("double").alias("value"))


def eigenvectors(pixels: DataFrame, bins: DataFrame, track: DataFrame | None, method: str = "cis", by: str = "chrom", k: int = 3, least: int = 5) -> DataFrame:
    """(comp, bin, value) of each block with at least ``least`` bins.

    method: ``cis`` (excess over expected), ``complete`` (one component), or a name in DOMAINS.
    ``track`` (bin, value) orients vectors by rank correlation.
    """
    own = blocks_of(pixels, bins, by)
    gc = bins.select("bin", F.col(by).alias("block"))
    gc = gc.join(track.select("bin", F.col("value").alias("g")), "bin", "left") if track is not None else gc.withColumn("g", F.lit(None).cast("double"))

    def run(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"comp": pd.Series(dtype="int32"), "bin": pd.Series(dtype="int32"), "value": pd.Series(dtype="float64")})
        if not len(rows) or int(rows["n"].iloc[0]) < least:
            return empty
        n, first = int(rows["n"].iloc[0]), int(rows["first"].iloc[0])
        m = dense(rows, n)
        g = None
        if marks["g"].notna().any():
            g = np.zeros(n)
            g[marks["bin"].to_numpy() - first] = marks["g"].fillna(0).to_numpy()
        if method == "cis":
            v = cis_eigenvector(m, g, k)
        elif method == "complete":
            v = complete_eigenvector(m, g if g is not None else np.zeros(n))[None, :]
        else:
            v = DOMAINS[method](m, k)
            if g is not None:
                v = v * np.array([-1 if rank_correlation(a, g) < 0 else 1 for a in v])[:, None]
        comp = np.repeat(np.arange(len(v), dtype=np.int32), n)
        return pd.DataFrame({"comp": comp, "bin": np.tile(np.arange(first, first + n, dtype=np.int32), len(v)), "value": v.ravel()})

    return own.groupBy("block").cogroup(gc.groupBy("block")).applyInPandas(run, "comp int, bin int, value double")


def whole_eigenvectors(pixels: DataFrame, bins: DataFrame, k: int = 3, how: str = "eig", most_bins: int = 12_000) -> DataFrame:
    """(comp, bin, value, eigenvalue) of the whole map, for coarse maps that fit in one task."""
    n = bins.count()
    if n > most_bins:
        raise ValueError(f"{n} bins make too large a dense matrix; coarse-grain the map first")
    own = pixels.select(F.lit(0).alias("block"), F.lit(n).alias("n"), F.col("bin1").alias("i"), F.col("bin2").alias("j"), F.col("value").cast("double").alias("value"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = dense(rows, n)
        some = np.flatnonzero(m.sum(0) > 0)
        x = m[np.ix_(some, some)]
        v, w = top_eigen(x, k) if how == "eig" else principal(x, k)
        if how == "eig":
            v = v * np.sqrt(np.abs(w))[:, None]
        comp = np.repeat(np.arange(len(v), dtype=np.int32), len(some))
        return pd.DataFrame({"comp": comp, "bin": np.tile(some.astype(np.int32), len(v)), "value": v.ravel(), "eigenvalue": np.repeat(w, len(some))})

    return own.groupBy("block").applyInPandas(run, "comp int, bin int, value double, eigenvalue double")


def smoothed(pixels: DataFrame, bins: DataFrame, smoothness: float = 10.0) -> DataFrame:
    """(bin1, bin2, value) of every chromosome's block, smoothed adaptively."""
    own = blocks_of(pixels, bins)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, first = int(rows["n"].iloc[0]), int(rows["first"].iloc[0])
        m = dense(rows, n)
        x = np.triu(adaptive_smoothing(m, m.sum(0) > 0, smoothness))
        i, j = np.nonzero(x)
        return pd.DataFrame({"bin1": (i + first).astype(np.int32), "bin2": (j + first).astype(np.int32), "value": x[i, j]})

    return own.groupBy("block").applyInPandas(run, "bin1 int, bin2 int, value double")


def correlation_matrix(pixels: DataFrame, bins: DataFrame, by: str = "chrom") -> DataFrame:
    """(bin1, bin2, r) of the rows of every block."""
    own = blocks_of(pixels, bins, by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, first = int(rows["n"].iloc[0]), int(rows["first"].iloc[0])
        r = correlation(dense(rows, n))
        i, j = np.triu_indices(n)
        return pd.DataFrame({"bin1": (i + first).astype(np.int32), "bin2": (j + first).astype(np.int32), "r": r[i, j]})

    return own.groupBy("block").applyInPandas(run, "bin1 int, bin2 int, r double")


def reordered(pixels: DataFrame, vector: DataFrame, by: int) -> DataFrame:
    """A map with bins in the order of a vector (bin, value), coarse-grained."""
    from pyspark.sql import Window

    from .heatmap import coarsegrain

    place = vector.withColumn("k", (F.row_number().over(Window.orderBy("value", "bin")) - 1).cast("int")).select("bin", "k")
    p = [place.select(F.col("bin").alias("_" + s), F.col("k").alias("k" + s)) for s in "12"]
    own = pixels.join(p[0], F.col("bin1") == F.col("_1")).join(p[1], F.col("bin2") == F.col("_2"))
    return coarsegrain(own.select(F.least("k1", "k2").alias("bin1"), F.greatest("k1", "k2").alias("bin2"), "value"), by)
