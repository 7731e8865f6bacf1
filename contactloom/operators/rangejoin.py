"""Range joins as equi-joins.

Catalyst plans a pure range predicate as a nested loop.  Cutting the axis into buckets gives it an
equality to hash on, with the range predicate left as a filter: each interval is listed in every
bucket it touches, each point falls in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points_in_intervals(points: DataFrame, at: Column, intervals: DataFrame, keys: list[str], start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points joined to the intervals with ``start < at <= end`` and equal ``keys``.

    ``width`` should be near the intervals' usual length: each is then listed about twice.
    """
    bucketed = points.withColumn("_bucket", F.floor(at / width)).withColumn("_at", at)
    listed = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    listed = listed.withColumnsRenamed({k: f"_i_{k}" for k in keys} | {"_bucket": "_i_bucket"})
    on = (F.col("_bucket") == F.col("_i_bucket")) & (F.col("_at") > F.col(start)) & (F.col("_at") <= F.col(end))
    for k in keys:
        on &= F.col(k) == F.col(f"_i_{k}")
    return bucketed.join(listed, on, how).drop("_bucket", "_at", "_i_bucket", *[f"_i_{k}" for k in keys])
