"""Group-relative advantages of rollout scores, as windows over the prompt's uid.

Every function takes a DataFrame with ``uid`` and ``score`` and adds ``advantage``.  A window over
uid needs one shuffle on uid and no join back; a uid's group is the handful of samples of a prompt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Name an estimator; another function under a taken name is an error."""

    def add(f: Callable) -> Callable:
        if ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"{name} names another estimator")
        return f

    return add


def advantage(df: DataFrame, name: str, **options) -> DataFrame:
    return ESTIMATORS[name](df, **options)


def _of_group(x: Column) -> Column:
    return x.over(Window.partitionBy("uid"))


def group_stats(df: DataFrame, floor: float = EPSILON) -> DataFrame:
    """Per uid: mean, std (variance floored before the root) and count; a single sample has 0 and 1."""
    n = F.count("score")
    mean = F.when(n > 1, F.avg("score")).otherwise(F.lit(0.0))
    std = F.when(n > 1, F.sqrt(F.greatest(F.var_samp("score"), F.lit(floor)))).otherwise(F.lit(1.0))
    return df.groupBy("uid").agg(mean.alias("mean"), std.alias("std"), n.alias("n"))


@register("grpo")
def grpo(df: DataFrame, normalise: bool = True, epsilon: float = EPSILON) -> DataFrame:
    n = _of_group(F.count("score"))
    mean = F.when(n > 1, _of_group(F.avg("score"))).otherwise(F.lit(0.0))
    std = F.when(n > 1, _of_group(F.stddev_samp("score"))).otherwise(F.lit(1.0))
    centred = F.col("score") - mean
    return df.withColumn("advantage", centred / (std + F.lit(epsilon)) if normalise else centred)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    n = _of_group(F.count("score"))
    mean = F.when(n > 1, _of_group(F.avg("score"))).otherwise(F.lit(0.0))
    std = F.when(n > 1, F.sqrt(F.greatest(_of_group(F.var_samp("score")), F.lit(epsilon)))).otherwise(F.lit(1.0))
    return df.withColumn("advantage", (F.col("score") - mean) / (std + F.lit(epsilon)))


@register("grpo_passk")
def grpo_passk(df: DataFrame, order: str = "sample", normalise: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """Only a group's best sample counts: by how much it beats the second; a single one is an error."""
    ranked = Window.partitionBy("uid").orderBy(F.desc("score"), order)
    n = _of_group(F.count("score"))
    gap = F.col("score") - F.lead("score").over(ranked)
    gap = gap / (_of_group(F.stddev_samp("score")) + F.lit(epsilon)) if normalise else gap
    gap = F.when(F.row_number().over(ranked) == 1, gap).otherwise(F.lit(0.0))
    return df.withColumn("advantage", F.when(n > 1, gap).otherwise(F.raise_error(F.lit("a group of one has no second best")).cast("double")))


@register("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """Leave one out; a single sample keeps its score."""
    n = _of_group(F.count("score"))
    return df.withColumn("advantage", F.when(n > 1, n / (n - 1) * (F.col("score") - _of_group(F.avg("score")))).otherwise(F.col("score")))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """Leave one out; a single sample has 0."""
    n = _of_group(F.count("score"))
    return df.withColumn("advantage", F.when(n > 1, (n * F.col("score") - _of_group(F.sum("score"))) / (n - 1)).otherwise(F.lit(0.0)))


@register("opo")
def opo(df: DataFrame, length: str = "length") -> DataFrame:
    """Against the length-weighted mean; a single sample, or a group without length, against 0."""
    base = F.coalesce(F.try_divide(_of_group(F.sum(F.col(length) * F.col("score"))), _of_group(F.sum(length))), F.lit(0.0))
    return df.withColumn("advantage", F.col("score") - F.when(_of_group(F.count("score")) > 1, base).otherwise(F.lit(0.0)))


@register("gpg")
def gpg(df: DataFrame, norm: float = 1.0) -> DataFrame:
    """Centred scores times rows over rows with a score other than 0 (1 at least), over ``norm``."""
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("alpha"))
    mean = F.when(_of_group(F.count("score")) > 1, _of_group(F.avg("score"))).otherwise(F.lit(0.0))
    return df.withColumn("__c", F.col("score") - mean).crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("alpha") * F.col("__c") / F.lit(norm)).drop("__c", "alpha")


@register("reinforce_plus_plus_baseline")
def reinforce_baseline(df: DataFrame, length: str = "length", epsilon: float = 1e-8) -> DataFrame:
    """Centred scores, whitened over all tokens: a row counts as often as it has tokens."""
    mean = F.when(_of_group(F.count("score")) > 1, _of_group(F.avg("score"))).otherwise(F.lit(0.0))
    centred = df.withColumn("__c", F.col("score") - mean)
    sums = centred.agg(F.sum(length).alias("__n"), F.sum(F.col(length) * F.col("__c")).alias("__s"), F.sum(F.col(length) * F.col("__c") * F.col("__c")).alias("__q"))
    m = F.col("__s") / F.col("__n")
    var = (F.col("__q") / F.col("__n") - m * m) * F.col("__n") / (F.col("__n") - 1)
    return centred.crossJoin(F.broadcast(sums)).withColumn("advantage", (F.col("__c") - m) / F.sqrt(var + F.lit(epsilon))).drop("__c", "__n", "__s", "__q")


def softmean(df: DataFrame, beta: float) -> DataFrame:
    """Scores against the log mean of exponentials (the mean where beta is 0), over all rows."""
    if not beta:
        base = df.agg(F.avg("score").alias("__b"))
    else:
        top = df.agg(F.max(F.lit(beta) * F.col("score")).alias("__t"))
        base = df.crossJoin(F.broadcast(top)).agg(((F.log(F.avg(F.exp(F.lit(beta) * F.col("score") - F.col("__t")))) + F.first("__t")) / F.lit(beta)).alias("__b"))
    return df.crossJoin(F.broadcast(base)).withColumn("advantage", F.col("score") - F.col("__b")).drop("__b")


def keep_varied_groups(df: DataFrame, metric: str = "score") -> DataFrame:
    """Rows of groups whose metric varies, and of groups of one."""
    spread, n = _of_group(F.stddev_pop(metric)), _of_group(F.count(F.lit(1)))
    return df.withColumns({"__s": spread, "__n": n}).where((F.col("__s") > 0) | (F.col("__n") == 1)).drop("__s", "__n")


def group_accuracy_filter(df: DataFrame, low: float, high: float, longest: int, length: str = "length") -> DataFrame:
    """Add ``passes``: the group's mean score lies in [low, high] and no sample fills the window."""
    fine = _of_group(F.avg("score")).between(low, high) & (_of_group(F.max(length)) < longest - 1)
    return df.withColumn("passes", fine)
