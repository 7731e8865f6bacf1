"""Ranks, correlations and other statistics as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(column: str, by: list[str] | None = None) -> Column:
    """Rank from 1 in which ties share the mean of their places."""
    keys = by or []
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(column) if keys else Window.orderBy(column)
    same = Window.partitionBy(*[F.col(k) for k in keys], F.col(column))
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation of two columns (rho, n), one row or one for each group."""
    own = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = own.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    return ranked.groupBy(*(by or [])).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def weighted_spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Groups' rank correlations averaged by their size."""
    each = spearman(df, x, y, [by]).filter(F.col("rho").isNotNull() & ~F.isnan("rho"))
    return each.agg((F.sum(F.col("rho") * F.col("n")) / F.sum("n")).alias("rho"), F.sum("n").alias("n"))


def per_diagonal(a: DataFrame, b: DataFrame, longest: int, n_bins: int) -> DataFrame:
    """Rank correlation (d, rho, n) of two maps of ``n_bins`` bins along each diagonal, over all its
    cells.  Those that both maps lack are one row with their number as its weight."""
    one = a.select("bin1", "bin2", F.col("value").alias("x"))
    two = b.select("bin1", "bin2", F.col("value").alias("y"))
    both = one.join(two, ["bin1", "bin2"], "full").select((F.col("bin2") - F.col("bin1")).alias("d"), F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    both = both.filter(F.col("d") <= longest).groupBy("d", "x", "y").agg(F.count("*").alias("w"))
    seen = both.groupBy("d").agg(F.sum("w").alias("seen"))
    empty = seen.select("d", F.lit(0).alias("x"), F.lit(0).alias("y"), (F.lit(n_bins) - F.col("d") - F.col("seen")).alias("w")).filter("w > 0")
    own = both.unionByName(empty)
    for c in "xy":
        upto = F.sum("w").over(Window.partitionBy("d").orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        same = F.sum("w").over(Window.partitionBy("d", c))
        own = own.withColumn("r" + c, upto - (same - 1) / 2.0)
    mean = lambda e: F.sum(e * F.col("w")) / F.sum("w")
    each = own.groupBy("d").agg(F.sum("w").alias("n"), *[mean(F.col(p) * F.col(q)).alias(p + q) for p, q in (("rx", "rx"), ("ry", "ry"), ("rx", "ry"))], mean(F.col("rx")).alias("mx"), mean(F.col("ry")).alias("my"))
    spread = F.sqrt((F.col("rxrx") - F.col("mx") ** 2) * (F.col("ryry") - F.col("my") ** 2))
    return each.select("d", F.when(spread > 0, (F.col("rxry") - F.col("mx") * F.col("my")) / spread).alias("rho"), "n")


def fill_gaps(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Nulls replaced by the last value before them."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def median_and_mad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    med = df.groupBy(*by).agg(F.median(value).alias("median"))
    dev = df.join(med, by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return dev.groupBy(*by).agg(F.first("median").alias("median"), F.median("_d").alias("mad"))


def largest(df: DataFrame, by: str, n: int, ties: str) -> DataFrame:
    """The n rows with the largest values; a report, so the limit is the point."""
    return df.orderBy(F.desc(by), ties).limit(n)


def nearest(df: DataFrame, by: str, target: float, ties: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(by) - target), ties).limit(1)
