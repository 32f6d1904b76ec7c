"""Filtering, routing and budgeting of rollouts by difficulty, confidence and length."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.sources.staging import joined_by_count, staged


def group_success(df: DataFrame, size: int | None = None, betas: dict[str, float] | None = None) -> DataFrame:
    """Add n_correct, bucket (easy, learnable, unresolved), style and beta per uid.

    ``size``: every group must have exactly so many samples.
    """
    betas = betas or {"easy": 0.2, "learnable": 0.5, "unresolved": 0.5}
    group = Window.partitionBy("uid")
    n, right = F.count(F.lit(1)).over(group), F.sum((F.col("score") > 0.5).cast("int")).over(group)
    if size is not None:
        n = F.when(n == size, n).otherwise(F.raise_error(F.lit("a group has another size")).cast("long"))
    out = df.withColumns({"n_group": n, "n_correct": right})
    bucket = F.when(F.col("n_correct") == F.col("n_group"), "easy").when(F.col("n_correct") == 0, "unresolved").otherwise("learnable")
    out = out.withColumn("bucket", bucket).withColumn("style", F.when(F.col("bucket") == "easy", "concise").otherwise("normal"))
    beta = F.when(F.col("bucket") == "easy", betas["easy"]).when(F.col("bucket") == "unresolved", betas["unresolved"]).otherwise(betas["learnable"])
    return out.withColumn("beta", beta.cast("double"))


def success_histogram(routed: DataFrame) -> DataFrame:
    """Groups by number of correct samples."""
    return routed.groupBy("uid").agg(F.first("n_correct").alias("n_correct")).groupBy("n_correct").agg(F.count("*").alias("n_groups"))


def midrank(df: DataFrame, value: str, out: str = "unit_rank") -> DataFrame:
    """Add the midrank of ``value`` on [0, 1] among all finite values; 0.5 for NaN, null and a single one.

    Ranks come from counts per distinct value over a range partitioning: the rows themselves never
    meet in one task, only one count per partition does.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = df.where(finite).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    counts = staged(counts)
    before = running_total(counts, "__v", "__n")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    rank = (F.col("__before") + (F.col("__n") - 1) / 2) / F.lit(total - 1) if total > 1 else F.lit(0.5)
    ranks = before.select("__v", "__n", rank.alias(out))
    joined = joined_by_count(df.withColumn("__v", F.when(finite, F.col(value))), ranks, "__v", "__n", total, out)
    return joined.withColumn(out, F.coalesce(out, F.lit(0.5))).drop("__v")


def quantile(df: DataFrame, value: str, share: float, interpolate: bool = True) -> float | None:
    """The quantile of all rows, between two values or the least that so many rows do not exceed; null if there are none.

    It is read off the counts per distinct value and their running total, so no task holds them all.
    """
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n")))
    n = counts.agg(F.sum("__n")).first()[0] or 0
    if not n:
        return None
    place = share * (n - 1) if interpolate else max(ceil(share * n - 1e-9) - 1, 0)
    low, high = int(place), ceil(place)
    at = running_total(counts, "__v", "__n")
    found = {p: at.where((F.col("__before") <= p) & (F.col("__before") + F.col("__n") > p)).first()["__v"] for p in {low, high}}
    return found[low] if low == high else found[low] + (found[high] - found[low]) * (place - low)


def running_total(df: DataFrame, order: str, value: str, out: str = "__before") -> DataFrame:
    """Add the sum of ``value`` over all rows before this one in ``order`` (distinct values)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = staged(df.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id()))
    sums = parted.groupBy("__p").agg(F.sum(value).alias("__s"))
    start = F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.coalesce(F.sum(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("__l", local).join(F.broadcast(sums.select("__p", start.alias("__start"))), "__p").withColumn(out, F.col("__start") + F.col("__l")).drop("__p", "__l", "__start")


def two_signal(df: DataFrame, base: float = 0.2, delta: float = 0.1, least: float = 0.1, threshold: float = 0.7) -> DataFrame:
    """Add easy, hard, style and beta from correctness and the midrank of confidence ``logp``."""
    ranked = midrank(df, "logp", "__rank")
    right = (F.col("score") > 0.5).cast("double")
    out = ranked.withColumns({"easy": right * F.col("__rank"), "hard": (F.lit(1.0) - right) * (F.lit(1.0) - F.col("__rank"))}).drop("__rank")
    style = F.when(F.col("easy") > threshold, "concise").when(F.col("hard") > threshold, "budget").otherwise("normal")
    return out.withColumns({"style": style, "beta": F.greatest(F.lit(least), F.least(F.lit(base), F.lit(base) - F.lit(delta) * F.col("easy")))})


def select_candidates(df: DataFrame, order: str = "sample", least: float = 0.0, drop_rejected: bool = False) -> DataFrame:
    """One sample per uid: the shortest correct one (ties: more confident, then first), else the
    most confident one; with a quantile, else the shortest accepted one (logp above that quantile)."""
    if least > 0:
        rows = df.withColumn("accepted", F.col("logp") > F.lit(quantile(df, "logp", least)))
    else:
        rows = df.withColumn("accepted", F.lit(True))
    right = F.col("score") > 0.5
    tier = F.when(right, 0).when(F.col("accepted"), 1).otherwise(2)
    size = F.when(right, F.col("length")).when(F.lit(least > 0) & F.col("accepted"), F.col("length")).otherwise(F.lit(0))
    best = Window.partitionBy("uid").orderBy(tier, size, F.desc("logp"), order)
    out = rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r").withColumn("correct", right)
    return out.where(right | F.col("accepted")) if drop_rejected else out


def percentile_filter(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows at or above the interpolated quantile of all rows."""
    cut = quantile(df, value, share)
    return df.where(F.col(value) >= F.lit(cut))


def length_budget(length: Column, alpha: float, beta: float, least: int = 1, step: int = 1, most: int | None = None) -> tuple[Column, Column]:
    """(budget, supervised length): alpha x length in whole steps (halves to even), then beta of it."""
    budget = F.greatest(F.lit(least), (F.bround(F.lit(alpha) * length / step) * step).cast("long"))
    if most is not None:
        budget = F.least(budget, F.lit(most).cast("long"))
    return budget, F.least(F.bround(F.lit(beta) * budget).cast("long"), length.cast("long"))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to most - buffer, then falling linearly."""
    return F.least(-(length - F.lit(most - buffer)) / F.lit(float(buffer)) * F.lit(factor), F.lit(0.0))


def length_penalty(df: DataFrame) -> DataFrame:
    """Add ``penalty``: max(0, ln(length / lower median length of all rows))."""
    median = quantile(df, "length", 0.5, interpolate=False)
    return df.withColumn("penalty", F.greatest(F.lit(0.0), F.log(F.col("length") / F.lit(median))))


def keep_latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def sessions_by_value(df: DataFrame, key: str, order: str, value: str, which: str) -> DataFrame:
    """Runs of neighbouring rows with ``value`` = ``which`` as one block: block, first, last, n."""
    w = Window.partitionBy(key).orderBy(order)
    start = (F.col(value) == which) & F.coalesce(F.lag(value).over(w) != which, F.lit(True))
    block = F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("block", block).where(F.col(value) == which).groupBy(key, "block").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
