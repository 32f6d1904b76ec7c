"""Policy, value and preference losses of rollouts in sequence layout (token arrays per row).

Row-local arithmetic is higher-order expressions over the arrays; only the last step aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.arrays import EPSILON, clip, masked_sum, total

LOSSES: dict[str, Callable[..., Column]] = {}
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def register(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if LOSSES.setdefault(name, f) is not f:
            raise ValueError(f"{name} names another loss")
        return f

    return add


def aggregate_loss(losses: Column, mask: Column, mode: str = "token-mean", width: int | None = None) -> Column:
    """An aggregate expression over rows with a loss for each token."""
    tokens = total(F.transform(mask, lambda m: m.cast("double")))
    own = masked_sum(losses, mask)
    if mode == "token-mean":
        return F.sum(own) / (F.sum(tokens) + F.lit(EPSILON))
    if mode == "seq-mean-token-sum":
        return F.avg(own)
    if mode == "seq-mean-token-mean":
        return F.avg(own / (tokens + F.lit(EPSILON)))
    if mode == "seq-mean-token-sum-norm":
        return F.sum(own) / (F.lit(float(width)) if width else F.max(F.size(mask)))
    raise ValueError(f"mode is one of {MODES}")


def kl(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """Estimators of the divergence from ``ref``; the value of kinds that end in + is the same."""
    d = logp - ref
    kind = kind.rstrip("+")
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return F.lit(0.5) * d * d
    if kind in ("k3", "low_var_kl"):
        back = clip(-d, -20.0, 20.0)
        return clip(F.exp(back) - back - 1, -10.0, 10.0)
    raise ValueError(f"no estimator {kind}")


def _ratio(new: Column, old: Column) -> Column:
    return F.exp(clip(new - old, -20.0, 20.0))


@register("vanilla")
def clipped(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """The clipped surrogate of one token; a negative advantage costs ``dual`` times itself at most."""
    r = _ratio(new, old)
    worse = F.greatest(-advantage * r, -advantage * clip(r, 1 - low, 1 + high))
    return F.when(advantage < 0, F.least(worse, -advantage * F.lit(dual))).otherwise(worse)


@register("gpg")
def plain(new: Column, old: Column, advantage: Column) -> Column:
    return -new * advantage


def ppo(df: DataFrame, mode: str = "token-mean", low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """One row: loss, clip fractions and mean old-minus-new log probability.

    Arrays: new, old (log probabilities), advantages, mask.
    """
    zipped = F.arrays_zip("new", "old", "advantages")
    losses = F.transform(zipped, lambda z: clipped(z["new"], z["old"], z["advantages"], low, high, dual))

    def above(z: Column) -> Column:
        r = _ratio(z["new"], z["old"])
        return (-z["advantages"] * clip(r, 1 - low, 1 + high) > -z["advantages"] * r).cast("double")

    def beyond(z: Column) -> Column:
        r = _ratio(z["new"], z["old"])
        worse = F.greatest(-z["advantages"] * r, -z["advantages"] * clip(r, 1 - low, 1 + high))
        return ((z["advantages"] < 0) & (worse > -z["advantages"] * F.lit(dual))).cast("double")

    mean = lambda x: aggregate_loss(x, F.col("mask"))
    return df.agg(
        aggregate_loss(losses, F.col("mask"), mode).alias("loss"),
        mean(F.transform(zipped, above)).alias("clip_fraction"),
        mean(F.transform(zipped, beyond)).alias("clip_fraction_lower"),
        mean(F.transform(zipped, lambda z: z["old"] - z["new"])).alias("kl"),
    )


def gspo(df: DataFrame, low: float = 0.0003, high: float = 0.0004) -> DataFrame:
    """The surrogate with one length-normalised ratio (e^10 at most) for all tokens of a sequence."""
    n = F.greatest(total(F.transform("mask", lambda m: m.cast("double"))), F.lit(1.0))
    r = F.exp(F.least(masked_sum(F.zip_with("new", "old", lambda a, b: a - b), F.col("mask")) / n, F.lit(10.0)))
    own = df.withColumn("__r", r)
    losses = F.transform("advantages", lambda a: F.greatest(-a * F.col("__r"), -a * clip(F.col("__r"), 1 - low, 1 + high)))
    return own.agg(aggregate_loss(losses, F.col("mask"), "seq-mean-token-mean").alias("loss"))


def value_loss(df: DataFrame, span: float, mode: str = "token-mean") -> DataFrame:
    """Half the greater of the squared errors of ``predicted`` and of it clipped around ``values``."""
    zipped = F.arrays_zip("predicted", "values", "returns")

    def one(z: Column) -> Column:
        near = F.greatest(z["values"] - span, F.least(z["values"] + span, z["predicted"]))
        return F.lit(0.5) * F.greatest(F.pow(z["predicted"] - z["returns"], F.lit(2.0)), F.pow(near - z["returns"], F.lit(2.0)))

    return df.agg(aggregate_loss(F.transform(zipped, one), F.col("mask"), mode).alias("loss"))


def preference(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    """Direct preference loss of a pair from summed log probabilities."""
    margin = (chosen - rejected) - (ref_chosen - ref_rejected)
    if kind == "ipo":
        return F.pow(margin - F.lit(1 / (2 * beta)), F.lit(2.0))
    down, up = F.log1p(F.exp(-F.lit(beta) * margin)), F.log1p(F.exp(F.lit(beta) * margin))
    return down * F.lit(1 - smoothing) + up * F.lit(smoothing)


def correction_weights(df: DataFrame, level: str = "token", most: float = 2.0, normalise: bool = False) -> DataFrame:
    """Add ``weights``: importance ratios (log ratio within +-20) masked and truncated at ``most``.

    Arrays: log_ratio, mask.  Level sequence: one ratio from the summed log ratio.
    """
    zipped = F.arrays_zip("log_ratio", "mask")
    if level == "token":
        raw = F.transform(zipped, lambda z: F.least(F.exp(clip(z["log_ratio"], -20.0, 20.0)), F.lit(most)) * z["mask"])
    else:
        whole = F.least(F.exp(clip(masked_sum(F.col("log_ratio"), F.col("mask")), -20.0, 20.0)), F.lit(most))
        raw = F.transform("mask", lambda m: whole * m)
    out = df.withColumn("weights", raw)
    if not normalise:
        return out
    tokens = total(F.transform("mask", lambda m: m.cast("double")))
    mean = out.agg((F.sum(total(F.col("weights"))) / F.sum(tokens)).alias("__m")) if level == "token" else out.agg(F.avg(F.array_max("weights")).alias("__m"))
    return out.crossJoin(F.broadcast(mean)).withColumn("weights", F.transform("weights", lambda w: w / F.greatest(F.col("__m"), F.lit(EPSILON)))).drop("__m")


def rejection_mask(df: DataFrame, level: str = "token", high: float = 2.0, low: float | None = None) -> DataFrame:
    """Add ``kept_mask``: the mask where the ratio of the token, the sequence (product) or its
    geometric mean lies in [low, high]; low is 1 / high if not given."""
    low = 1 / high if low is None else low
    inside = lambda r: ((r >= low) & (r <= high)).cast("double")
    if level == "token":
        return df.withColumn("kept_mask", F.zip_with("log_ratio", "mask", lambda x, m: inside(F.exp(clip(x, -20.0, 20.0))) * m))
    whole = masked_sum(F.col("log_ratio"), F.col("mask"))
    if level == "geometric":
        whole = whole / (total(F.transform("mask", lambda m: m.cast("double"))) + F.lit(EPSILON))
    fine = inside(F.exp(clip(whole, -20.0, 20.0)))
    return df.withColumn("kept_mask", F.transform("mask", lambda m: m * fine))


def effective_share(df: DataFrame, weight: str = "weight") -> DataFrame:
    """mean, std, min, max and effective share 1 / E[(w / E w)^2] of a column of weights."""
    w = F.col(weight)
    return df.agg(F.avg(w).alias("mean"), F.stddev_samp(w).alias("std"), F.min(w).alias("min"), F.max(w).alias("max"), (F.avg(w) * F.avg(w) / F.avg(w * w)).alias("ess"))
