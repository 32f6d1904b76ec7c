"""Evaluation analytics: means, votes and best-of-n per prompt, pass@k, suites and comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.arrays import pass_at_k
from rillmark.operators.quantiles import quantiles


def sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, then n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


def prompt_metrics(df: DataFrame) -> DataFrame:
    """Per (data_source, uid): n, mean, population std, best and worst score."""
    return df.groupBy("data_source", "uid").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.max("score").alias("best"), F.min("score").alias("worst"))


def source_metrics(df: DataFrame) -> DataFrame:
    """Unweighted means over prompts, per data_source."""
    per = prompt_metrics(df)
    return per.groupBy("data_source").agg(F.count("*").alias("n_prompts"), *[F.avg(c).alias(f"{c}_mean") for c in ("mean", "std", "best", "worst")])


def expected_best(df: DataFrame, k: int, order: str = "score") -> DataFrame:
    """Exact mean over draws with replacement of the best and worst of ``k``, per uid.

    E[max] = sum of v(i) x [(i/n)^k - ((i-1)/n)^k] over ascending values; no resampling.
    """
    up = Window.partitionBy("uid").orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy("uid"))
    rows = df.withColumns({"__i": F.row_number().over(up), "__n": n})
    weight = lambda i: F.pow(i / F.col("__n"), F.lit(float(k))) - F.pow((i - 1) / F.col("__n"), F.lit(float(k)))
    return rows.groupBy("uid").agg(F.sum(F.col("score") * weight(F.col("__i"))).alias("best"), F.sum(F.col("score") * weight(F.col("__n") - F.col("__i") + 1)).alias("worst"))


def bootstrap(df: DataFrame, k: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Seeded resampling per uid: mean and std of best and worst of ``k`` draws with replacement.

    A uid's samples are few; each group is one small pandas frame.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample")
        values = rows["score"].to_numpy()
        rng = np.random.default_rng(seed)
        drawn = values[rng.integers(0, len(values), (draws, k))]
        best, worst = drawn.max(axis=1), drawn.min(axis=1)
        return pd.DataFrame([(rows["uid"].iloc[0], best.mean(), best.std(), worst.mean(), worst.std())], columns=["uid", "best", "best_std", "worst", "worst_std"])

    kind = df.schema["uid"].dataType.simpleString()
    return df.select("uid", "sample", F.col("score").cast("double").alias("score")).groupBy("uid").applyInPandas(one, f"uid {kind}, best double, best_std double, worst double, worst_std double")


def majority(df: DataFrame, vote: str = "vote", value: str = "score", order: str = "sample") -> DataFrame:
    """Per uid the most common vote (ties: seen first) and the value of its first sample."""
    votes = df.groupBy("uid", vote).agg(F.count("*").alias("votes"), F.min(order).alias("__first"), F.min_by(value, order).alias("value"))
    best = Window.partitionBy("uid").orderBy(F.desc("votes"), "__first")
    return votes.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__first")


def pass_rates(df: DataFrame, ks: list[int]) -> DataFrame:
    """Mean unbiased pass@k over prompts, for each k that every prompt has samples for (else null)."""
    per = df.groupBy("uid").agg(F.count("*").alias("n"), F.sum((F.col("score") > 0.5).cast("int")).alias("c"))
    return per.agg(*[F.when(F.min("n") >= k, F.avg(pass_at_k(F.col("n"), F.col("c"), k))).alias(f"pass_at_{k}") for k in ks])


def pass_rates_by(df: DataFrame, level: str, ks: list[int]) -> DataFrame:
    """pass@k overall (null level) and for each level, in one pass of grouping sets."""
    per = df.groupBy("uid", level).agg(F.count("*").alias("n"), F.sum((F.col("score") > 0.5).cast("int")).alias("c"))
    return per.rollup(level).agg(F.count("*").alias("n_prompts"), *[F.avg(F.when(F.col("n") >= k, pass_at_k(F.col("n"), F.col("c"), k))).alias(f"pass_at_{k}") for k in ks])


def summarise(df: DataFrame, expected: int) -> DataFrame:
    """Per dataset: micro accuracy, any-correct rate, mean and median length; checks sample counts.

    Columns: dataset, correct array<boolean>, lengths array<long>.
    """
    good = (F.size("correct") == expected) & (F.size("lengths") == expected)
    right = F.when(good, F.aggregate("correct", F.lit(0), lambda a, x: a + x.cast("int"))).otherwise(F.raise_error(F.lit(f"expected {expected} samples")).cast("int"))
    rows = df.select("dataset", F.explode("lengths").alias("length"))
    per = df.withColumn("__c", right).groupBy("dataset").agg(F.count("*").alias("n_problems"), (F.sum("__c") / (F.count("*") * expected)).alias("pass_at_1"), F.avg((F.col("__c") > 0).cast("double")).alias(f"pass_at_{expected}"))
    length = rows.groupBy("dataset").agg(F.avg("length").alias("mean_length"))
    middle = quantiles(rows, ["dataset"], "length", [0.5]).select("dataset", F.col("q")[0].alias("median_length"))
    return per.join(length, "dataset").join(middle, "dataset", "left")


def compare(candidate: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """Differences per dataset; a dataset that one run lacks is an error."""
    both = candidate.select("dataset", *[F.col(m).alias(f"c_{m}") for m in metrics]).join(baseline.select(F.col("dataset").alias("__d"), *[F.col(m).alias(f"b_{m}") for m in metrics]), F.col("dataset") == F.col("__d"), "full")
    name = F.when(F.col("dataset").isNotNull() & F.col("__d").isNotNull(), F.col("dataset")).otherwise(F.raise_error(F.lit("the runs have other datasets")))
    return both.select(name.alias("dataset"), *[(F.col(f"c_{m}") - F.col(f"b_{m}")).alias(f"delta_{m}") for m in metrics])


def variation(df: DataFrame, key: str, value: str) -> DataFrame:
    """Coefficient of variation in percent, per key; null where the mean is 0."""
    return df.groupBy(key).agg((F.lit(100.0) * F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"))


def inclusive_percentile(null_scores: DataFrame, observed: float) -> DataFrame:
    return null_scores.agg(F.avg((F.col("score") <= observed).cast("double")).alias("percentile"))


def reduce_by_name(metrics: DataFrame) -> DataFrame:
    """Long (name, value): the maximum where the name says max, the minimum where min, else the mean."""
    return metrics.groupBy("name").agg(F.when(F.first("name").contains("max"), F.max("value")).when(F.first("name").contains("min"), F.min("value")).otherwise(F.avg("value")).alias("value"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Distinct values and Shannon entropy (nats) of a column."""
    counts = df.groupBy(column).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg(F.count("*").alias("n_values"), (-F.sum(p * F.log(p))).alias("entropy"))
