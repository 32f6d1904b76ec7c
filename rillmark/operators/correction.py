"""Rollout correction: importance weights, rejection, token veto and how far two policies are apart.

Rows are sequences with token arrays ``log_ratio`` (training minus sampling), ``mask`` and, where
named, ``old`` (training) and ``sampled`` log probabilities.  A first step reduces each sequence to a
handful of numbers inside its row; the second is one aggregate, so nothing but partial sums moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.arrays import EPSILON, clip, masked_sum, total
from rillmark.operators.losses import correction_weights, rejection_mask

SAFE = 20.0


def tokens(mask: Column) -> Column:
    return total(F.transform(mask, lambda m: m.cast("double")))


def masked_moments(df: DataFrame, values: str = "values", mask: str = "mask", unbiased: bool = True) -> DataFrame:
    """mean, var over all tokens of all rows that the mask keeps; an error where it keeps none, or one if unbiased.

    The mean has the small constant in its divisor; the variance is about that mean.
    """
    v, m = F.col(values), F.col(mask)
    own = df.select(tokens(m).alias("n"), masked_sum(v, m).alias("s"), masked_sum(F.transform(v, lambda x: x * x), m).alias("q"))
    sums = own.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / (F.col("n") + F.lit(EPSILON))
    about = (F.col("q") - F.lit(2.0) * mean * F.col("s") + mean * mean * F.col("n")) / (F.col("n") + F.lit(EPSILON))
    var = F.greatest(about, F.lit(0.0)) * (F.col("n") / (F.col("n") - 1) if unbiased else F.lit(1.0))
    few = F.raise_error(F.lit("the mask keeps too few tokens")).cast("double")
    return sums.select(mean.alias("mean"), F.when(F.col("n") <= (1 if unbiased else 0), few).otherwise(var).alias("var"))


def whitened(df: DataFrame, values: str = "values", mask: str = "mask", shift: bool = True) -> DataFrame:
    """``values`` less the masked mean, over the masked deviation; without ``shift`` the mean is added again."""
    moments = masked_moments(df, values, mask).select(F.col("mean").alias("__mean"), F.col("var").alias("__var"))
    white = lambda x: (x - F.col("__mean")) / F.sqrt(F.col("__var") + F.lit(EPSILON)) + (F.lit(0.0) if shift else F.col("__mean"))
    return df.crossJoin(F.broadcast(moments)).withColumn(values, F.transform(values, white)).drop("__mean", "__var")  # one row


def weight_metrics(df: DataFrame, weights: str, level: str, high: float, low: float | None = None) -> DataFrame:
    """One row about the weights of tokens: mean, extremes, shares beyond the bounds, spread, effective share, and by sequence.

    At level token the extremes and shares are over tokens; at sequence and geometric level over
    the sequences' log ratios (summed, or their mean).
    """
    low = 1 / high if low is None else low
    w, m = F.col(weights), F.col("mask")
    inside = F.transform(w, lambda x: clip(x, low, high))
    n = F.col("n") + F.lit(EPSILON)
    seq = masked_sum(F.col("log_ratio"), m)
    seq = seq / (tokens(m) + F.lit(EPSILON)) if level == "geometric" else seq
    kept = F.filter(F.arrays_zip(w.alias("w"), m.alias("m")), lambda z: z["m"] != 0)
    beyond = lambda test: masked_sum(F.transform(w, lambda x: test(x).cast("double")), m)
    own = df.select(
        tokens(m).alias("n"), masked_sum(w, m).alias("s"), masked_sum(inside, m).alias("c"), masked_sum(F.transform(inside, lambda x: x * x), m).alias("q"),
        F.array_max(F.transform(kept, lambda z: z["w"])).alias("top"), F.array_min(F.transform(kept, lambda z: z["w"])).alias("least"),
        beyond(lambda x: x > high).alias("above"), beyond(lambda x: x < low).alias("below"), seq.alias("seq"),
    )
    own = own.withColumn("mine", F.col("s") / n)
    flag = lambda c: F.avg(c.cast("double"))
    whole = F.sum("n") + F.lit(EPSILON)
    mean = F.sum("c") / whole
    by_token = level == "token"
    return own.agg(
        (F.sum("s") / whole).alias("mean"),
        (F.max("top") if by_token else F.exp(F.least(F.max("seq"), F.lit(SAFE)))).alias("max"),
        (F.min("least") if by_token else F.exp(F.min("seq"))).alias("min"),
        (F.sum("above") / whole if by_token else flag(F.col("seq") > math.log(high))).alias("share_high"),
        (F.sum("below") / whole if by_token else flag(F.col("seq") < math.log(low))).alias("share_low"),
        F.when(F.sum("n") > 1, F.sqrt(F.greatest(F.sum("q") / whole - mean * mean, F.lit(0.0)))).otherwise(0.0).alias("std"),
        (F.lit(1.0) / (F.sum("q") / whole / ((mean + F.lit(EPSILON)) * (mean + F.lit(EPSILON))))).alias("effective_share"),
        F.avg("mine").alias("seq_mean"),
        F.when(F.count("*") > 1, F.stddev_samp("mine")).otherwise(0.0).alias("seq_std"),
        F.max("mine").alias("seq_max"),
        F.min("mine").alias("seq_min"),
        F.max(F.abs(F.col("mine") - 1)).alias("seq_max_deviation"),
        flag(F.col("mine") > high).alias("seq_share_high"),
        flag(F.col("mine") < low).alias("seq_share_low"),
    )


def vetoed(df: DataFrame, least: float, mask: str = "kept_mask") -> DataFrame:
    """``mask`` is 0 for whole sequences in which a token's ratio is below ``least``; adds ``veto`` and ``catastrophic``."""
    if least <= 0:
        raise ValueError("the least ratio is positive")
    bad = F.zip_with("log_ratio", "mask", lambda x, m: ((x < F.log(F.lit(least))) & (m != 0)).cast("double"))
    out = df.withColumn("catastrophic", total(bad))
    out = out.withColumn("veto", F.col("catastrophic") > 0)
    return out.withColumn(mask, F.transform(mask, lambda m: F.when(F.col("veto"), F.lit(0.0)).otherwise(m)))


def corrected(df: DataFrame, weight_level: str | None = "token", weight_most: float = 2.0, reject_level: str | None = None, reject_high: float = 2.0, reject_low: float | None = None, veto: float | None = None, normalise: bool = False) -> DataFrame:
    """The pipeline: ``weights`` (if a level is named), then ``kept_mask`` by rejection, then the veto."""
    out = correction_weights(df, weight_level, weight_most, normalise) if weight_level else df
    out = rejection_mask(out, reject_level, reject_high, reject_low) if reject_level else out.withColumn("kept_mask", F.transform("mask", lambda m: m.cast("double")))
    return vetoed(out, veto) if veto is not None else out.withColumns({"veto": F.lit(False), "catastrophic": F.lit(0.0)})


def veto_metrics(df: DataFrame) -> DataFrame:
    """Share of sequences that were vetoed and of tokens that were the reason."""
    return df.agg(F.avg(F.col("veto").cast("double")).alias("veto_share"), (F.sum("catastrophic") / (F.sum(tokens(F.col("mask"))) + F.lit(EPSILON))).alias("catastrophic_share"))


def off_policy_metrics(df: DataFrame, old: str = "old", sampled: str = "sampled") -> DataFrame:
    """Perplexities of both policies, their divergence by two estimators, and chi-squared by token and by sequence."""
    m = F.col("mask")
    n = F.col("n") + F.lit(EPSILON)
    ratio = F.zip_with(old, sampled, lambda a, b: a - b)
    own = df.select(
        tokens(m).alias("n"), masked_sum(F.col(old), m).alias("a"), masked_sum(F.col(sampled), m).alias("b"),
        masked_sum(F.transform(ratio, lambda x: F.exp(x) - x - 1), m).alias("k3"),
        masked_sum(F.transform(ratio, lambda x: F.exp(2 * clip(x, -SAFE, SAFE))), m).alias("rho"), masked_sum(ratio, m).alias("d"),
    )
    own = own.withColumns({"train": F.col("a") / n, "roll": F.col("b") / n}).withColumn("gap", F.col("roll") - F.col("train"))
    whole = F.sum("n") + F.lit(EPSILON)
    return own.agg(
        F.avg(F.exp(-F.col("train"))).alias("training_ppl"),
        F.avg(-F.col("train")).alias("training_log_ppl"),
        (-F.sum("d") / whole).alias("kl"),
        (F.sum("k3") / whole).alias("k3_kl"),
        F.avg(F.exp(-F.col("roll"))).alias("rollout_ppl"),
        F.avg(-F.col("roll")).alias("rollout_log_ppl"),
        F.avg("gap").alias("log_ppl_diff"),
        F.avg(F.abs("gap")).alias("log_ppl_abs_diff"),
        F.max("gap").alias("log_ppl_diff_max"),
        F.min("gap").alias("log_ppl_diff_min"),
        F.avg(F.exp("gap")).alias("ppl_ratio"),
        (F.sum("rho") / whole - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * clip(F.col("d"), -SAFE, SAFE))) - 1).alias("chi2_seq"),
    )


def bypassed(df: DataFrame, old: str = "old", sampled: str = "sampled") -> DataFrame:
    """The sampling policy's log probabilities in the place of the training policy's."""
    return df.withColumn(old, F.col(sampled))
