"""Exact quantiles of many groups at once, read off counts per value.

No task holds a group's values: rows become counts per (group, value) before they are shuffled,
the counts are range-partitioned in (group, value) order, and one sum per (range, group) tells how
many rows of the group come before a range.  A group of any size is cut wherever a range ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.sources.staging import staged


def _place(share: float, n: Column, interpolate: bool) -> tuple[Column, Column, Column]:
    """(lower place, upper place, weight of the upper one) of a quantile among n ordered values."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    if interpolate:
        at = F.lit(float(share)) * (n - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)
    at = F.greatest(F.ceil(F.lit(float(share)) * n - 1e-9) - 1, F.lit(0))
    return at, at, F.lit(0.0)


def quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float], interpolate: bool = True) -> DataFrame:
    """groups, n (values that are not null) and q (array of doubles, one a share).

    With ``interpolate`` a quantile lies between its two neighbours in proportion, else it is the
    least value that so many do not exceed.  Nulls are left out and NaN is the greatest value; null
    is a group of its own; a group of nulls alone has no row.  Without ``groups`` there is one row,
    or none where there is no value.
    """
    key = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    counts = df.where(F.col(value).isNotNull()).groupBy(key.alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = staged(counts.repartitionByRange(ranges, "g", "v").withColumn("p", F.spark_partition_id()))
    of_group = Window.partitionBy("g")
    sums = parted.groupBy("p", "g").agg(F.sum("c").alias("s"))
    sums = sums.select("p", "g", F.sum("s").over(of_group).alias("n"), F.coalesce(F.sum("s").over(of_group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    local = F.coalesce(F.sum("c").over(Window.partitionBy("p", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = parted.withColumn("before", local).join(sums, ["p", "g"]).withColumn("before", F.col("before") + F.col("start"))
    found, between = [F.first("n").alias("n")], []
    for i, share in enumerate(shares):
        low, high, weight = _place(share, F.col("n"), interpolate)
        for side, place in (("l", low), ("h", high)):
            found.append(F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col("v"))).alias(f"{side}{i}"))
        between.append(F.when(F.col(f"l{i}") == F.col(f"h{i}"), F.col(f"l{i}")).otherwise(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * weight))
    out = at.groupBy("g").agg(*found)
    return out.select(*[F.col("g")[c].alias(c) for c in groups], "n", F.array(*between).alias("q"))
