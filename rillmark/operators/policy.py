"""Policy losses beyond the clipped surrogate, over token arrays (new, old, advantages, mask).

Where tokens are chosen from the whole batch (by covariance, or at random), they are exploded,
chosen by ``top_rows`` and aggregated as rows; the other losses stay inside their arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.arrays import EPSILON, clip, masked_sum, total
from rillmark.operators.correction import tokens
from rillmark.operators.losses import aggregate_loss
from rillmark.operators.routing import quantile
from rillmark.sources.staging import staged

BUCKETS = 1024


def top_rows(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """Add ``chosen``: the k rows of the greatest ``value``, ties by the further columns; null takes no part.

    Values are counted in equal buckets; those above the bucket that the k-th falls in are all
    chosen, and only that bucket's rows are ranked, so no task sorts the whole table.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or k <= 0:
        return df.withColumn("chosen", F.lit(False))
    width = (high - low) / BUCKETS or 1.0
    place = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(BUCKETS - 1)).cast("int")
    binned = df.withColumn("__bin", F.when(F.col(value).isNotNull(), place))  # least() passes over nulls
    counts = {r["__bin"]: r["n"] for r in binned.where("__bin IS NOT NULL").groupBy("__bin").agg(F.count("*").alias("n")).collect()}  # BUCKETS rows at most
    above, at = 0, max(counts)
    for at in sorted(counts, reverse=True):
        if above + counts[at] >= k:
            break
        above += counts[at]
    place = F.row_number().over(Window.partitionBy("__bin").orderBy(F.desc(value), *ties))
    ranked = binned.where(F.col("__bin") == at).withColumn("chosen", place <= k - above)
    rest = binned.where((F.col("__bin") != at) | F.col("__bin").isNull()).withColumn("chosen", F.coalesce(F.col("__bin") > at, F.lit(False)))
    return ranked.unionByName(rest).drop("__bin")


def drawn_number(*key: str) -> Column:
    """A number in [0, 1) that follows from the key's MD5."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def token_rows(df: DataFrame, key: str = "uid") -> DataFrame:
    """key, pos, new, old, adv, mask: a row a token that the mask keeps."""
    zipped = F.arrays_zip(F.col("new"), F.col("old"), F.col("advantages").alias("adv"), F.col("mask"))
    return df.select(key, F.posexplode(zipped).alias("pos", "z")).select(key, "pos", "z.new", "z.old", "z.adv", "z.mask").where("mask <> 0")


def with_covariance(rows: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Add ``cov``: the product of a token's deviations of advantage and log probability."""
    n = F.sum("mask") + F.lit(epsilon)
    means = rows.agg((F.sum(F.col("adv") * F.col("mask")) / n).alias("__a"), (F.sum(F.col("new") * F.col("mask")) / n).alias("__l"))
    return rows.crossJoin(F.broadcast(means)).withColumn("cov", (F.col("adv") - F.col("__a")) * (F.col("new") - F.col("__l"))).drop("__a", "__l")  # one row


def kl_cov(df: DataFrame, ratio: float = 0.0002, coefficient: float = 1.0, key: str = "uid") -> DataFrame:
    """loss, kl: the plain surrogate, with an absolute-difference penalty on the tokens of greatest covariance."""
    rows = staged(with_covariance(token_rows(df, key)))
    n = rows.count()
    rows = top_rows(rows, "cov", max(1, int(n * ratio)) if n and ratio else 0, key, "pos")
    d = F.col("new") - F.col("old")
    loss = -F.col("adv") * F.exp(d) + F.when(F.col("chosen"), F.lit(coefficient) * F.abs(d)).otherwise(0.0)
    whole = F.sum("mask") + F.lit(EPSILON)
    return rows.agg((F.sum(loss * F.col("mask")) / whole).alias("loss"), (F.sum(F.abs(d) * F.col("mask")) / whole).alias("kl"))


def clip_cov(df: DataFrame, ratio: float = 0.0002, low: float = 1.0, high: float = 5.0, clip_low: float = 0.2, clip_high: float = 0.2, key: str = "uid") -> DataFrame:
    """loss, clip_fraction, kl: the clipped surrogate without a share of the tokens whose covariance lies within bounds.

    The tokens are drawn by a hash of their place, so the draw repeats.
    """
    rows = staged(with_covariance(token_rows(df, key), EPSILON))
    d = F.col("new") - F.col("old")
    first, second = -F.col("adv") * F.exp(d), -F.col("adv") * clip(F.exp(d), 1 - clip_low, 1 + clip_high)
    open_ = (F.col("cov") > low) & (F.col("cov") < high) & ~(second > first)
    n = rows.agg(F.sum("mask")).first()[0] or 0
    rows = top_rows(rows.withColumn("__draw", F.when(open_, drawn_number(key, "pos"))), "__draw", max(int(ratio * n), 1), key, "pos")
    loss = F.when(F.col("chosen"), F.lit(0.0)).otherwise(F.greatest(first, second))
    whole = F.sum("mask") + F.lit(EPSILON)
    return rows.agg((F.sum(loss * F.col("mask")) / whole).alias("loss"), (F.sum(F.col("chosen").cast("double") * F.col("mask")) / whole).alias("clip_fraction"), (-F.sum(d * F.col("mask")) / whole).alias("kl"))


def geometric_mean(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """loss, clip_fraction, clip_fraction_lower, kl: mean advantage times the exponential of the mean clipped log ratio."""
    m = F.col("mask")
    zipped = F.arrays_zip("new", "old", "advantages")
    d = lambda z: z["new"] - z["old"]

    def least(z: Column) -> Column:
        sign = F.signum(z["advantages"])
        return sign * F.least(sign * d(z), sign * clip(d(z), -low, high))

    beyond = lambda z, side: ((d(z) < -low) | (d(z) > high)) & side(z["advantages"])
    flags = lambda side: masked_sum(F.transform(zipped, lambda z: beyond(z, side).cast("double")), m)
    n = tokens(m) + F.lit(EPSILON)
    own = df.select(
        tokens(m).alias("n"), (-masked_sum(F.col("advantages"), m) / n * F.exp(masked_sum(F.transform(zipped, least), m) / n)).alias("l"),
        flags(lambda a: a > 0).alias("up"), flags(lambda a: a < 0).alias("down"), masked_sum(F.transform(zipped, d), m).alias("d"),
    )
    whole = F.sum("n") + F.lit(EPSILON)
    return own.agg(F.avg("l").alias("loss"), (F.sum("up") / whole).alias("clip_fraction"), (F.sum("down") / whole).alias("clip_fraction_lower"), (-F.sum("d") / whole).alias("kl"))


def squared_residual(df: DataFrame, reward: Column, eta: float = 1.0) -> DataFrame:
    """loss: mean square of the summed log ratio less eta times the reward."""
    gap = masked_sum(F.zip_with("new", "old", lambda a, b: a - b), F.col("mask"))
    return df.agg(F.avg(F.pow(gap - F.lit(eta) * reward, F.lit(2.0))).alias("loss"))


def entropy_loss(df: DataFrame, entropy: str = "entropy", weight: Column | None = None, mode: str = "token-mean") -> DataFrame:
    """loss: the aggregated entropy; with a row weight, its weighted negative, 0 where no weight is positive."""
    if weight is None:
        return df.agg(aggregate_loss(F.col(entropy), F.col("mask"), mode).alias("loss"))
    weighted = df.withColumn("__w", weight)
    own = aggregate_loss(F.transform(entropy, lambda e: e * F.col("__w")), F.col("mask"), mode)
    return weighted.agg(F.when(F.max("__w") > 0, -own).otherwise(0.0).alias("loss"))


def weighted_reinforce(df: DataFrame, weights: str = "weights", kept: str = "kept_mask", mode: str = "token-mean", scale: float = 1.0) -> DataFrame:
    """loss: minus log probability times advantage times the importance weight, on the kept tokens."""
    losses = F.transform(F.arrays_zip(F.col("new"), F.col("advantages"), F.col(weights).alias("w")), lambda z: -z["new"] * z["advantages"] * z["w"])
    return df.agg((aggregate_loss(losses, F.col(kept), mode) * F.lit(scale)).alias("loss"))


def distillation(df: DataFrame, drop: float = 0.1, alpha: float = 1.0, beta: float = 1.0, span: float = 0.2) -> DataFrame:
    """loss, kept_share, threshold, weight_mean, kl, clip_fraction: distillation with filtered trajectories and weighted tokens.

    Arrays: new, old, teacher (log probabilities), student_entropy, teacher_entropy, mask.  Rows
    below the ``drop`` quantile of the teacher's mean log probability are left out; a token weighs
    more where the teacher is sure and the student is not, with a mean of 1 over all valid tokens.
    """
    m = F.col("mask")
    valid = lambda c: F.array_max(F.transform(F.filter(F.arrays_zip(F.col(c).alias("e"), m.alias("m")), lambda z: z["m"] != 0), lambda z: z["e"]))
    rows = df.withColumn("__t", masked_sum(F.col("teacher"), m) / F.greatest(tokens(m), F.lit(1.0)))
    limits = rows.agg(F.lit(quantile(rows, "__t", drop)).alias("__least"), F.greatest(F.max(valid("teacher_entropy")), F.lit(1e-6)).alias("__tmax"), F.greatest(F.max(valid("student_entropy")), F.lit(1e-6)).alias("__smax"))
    rows = rows.crossJoin(F.broadcast(limits))  # one row
    weight = F.zip_with("teacher_entropy", "student_entropy", lambda t, s: (1 + F.lit(alpha) * clip(1 - t / F.col("__tmax"), 0.0, 1.0)) * (1 + F.lit(beta) * clip(s / F.col("__smax"), 0.0, 1.0)))
    rows = rows.withColumn("__w", weight)
    mean = rows.agg(F.greatest(F.sum(masked_sum(F.col("__w"), m)) / F.greatest(F.sum(tokens(m)), F.lit(1.0)), F.lit(1e-6)).alias("__mean"))
    rows = rows.crossJoin(F.broadcast(mean)).withColumn("__w", F.transform("__w", lambda w: w / F.col("__mean")))  # one row
    kept = (F.col("__t") >= F.col("__least")).cast("double")
    rows = rows.withColumn("__kept", kept).withColumn("__m", F.transform("mask", lambda x: x * F.col("__kept")))
    zipped = F.arrays_zip("new", "old", "teacher", "__w")
    part = lambda z: (z["__w"] * (z["teacher"] - z["old"]), F.exp(clip(z["new"] - z["old"], -20.0, 20.0)))

    def one(z: Column) -> Column:
        a, r = part(z)
        return F.greatest(-a * r, -a * clip(r, 1 - span, 1 + span))

    def cut(z: Column) -> Column:
        a, r = part(z)
        return (-a * clip(r, 1 - span, 1 + span) > -a * r).cast("double")

    mean_ = lambda x: aggregate_loss(x, F.col("__m"))
    return rows.agg(
        mean_(F.transform(zipped, one)).alias("loss"),
        F.avg("__kept").alias("kept_share"),
        F.max("__least").alias("threshold"),
        (F.sum(masked_sum(F.col("__w"), F.col("__m"))) / F.sum(total(F.col("__m")))).alias("weight_mean"),
        mean_(F.transform(zipped, lambda z: -clip(z["new"] - z["old"], -20.0, 20.0))).alias("kl"),
        mean_(F.transform(zipped, cut)).alias("clip_fraction"),
    )


def flow_balance(df: DataFrame, log_z: Column, beta: float = 15.0, low: float = 0.2, high: float = 0.28) -> DataFrame:
    """loss, dropped_share, weight, kl: squared flow residual of a sequence times its clipped importance weight.

    Arrays: new, old, teacher (log probabilities), token_reward, mask.  Tokens are dropped where the
    ratio is beyond 1 + high and the reward positive, or below 1 - low and the reward negative.
    """
    m = F.col("mask")
    zipped = F.arrays_zip("new", "old", "token_reward", "mask")
    ratio = lambda z: F.exp(z["new"] - z["old"])
    beyond = lambda z: ((z["token_reward"] > 0) & (ratio(z) > 1 + high)) | ((z["token_reward"] < 0) & (ratio(z) < 1 - low))
    rows = df.withColumn("__k", F.transform(zipped, lambda z: F.when(beyond(z), F.lit(0.0)).otherwise(z["mask"].cast("double"))))
    n = total(F.col("__k")) + F.lit(EPSILON)
    mean = lambda c: masked_sum(F.col(c), F.col("__k")) / n
    gap = F.zip_with("new", "old", lambda a, b: a - b)
    own = rows.select(
        (log_z + mean("new") - F.lit(beta) * mean("token_reward") - mean("teacher")).alias("delta"), clip(F.exp(masked_sum(gap, F.col("__k"))), 1 - low, 1 + high).alias("w"),
        tokens(m).alias("n"), total(F.col("__k")).alias("k"), masked_sum(gap, m).alias("d"),
    )
    whole = F.sum("n") + F.lit(EPSILON)
    return own.agg(F.avg(F.col("w") * F.col("delta") * F.col("delta")).alias("loss"), ((F.sum("n") - F.sum("k")) / whole).alias("dropped_share"), F.avg("w").alias("weight"), (-F.sum("d") / whole).alias("kl"))


def penalised(rewards: Column, divergence: Column, coefficient: float) -> Column:
    """Token rewards less the coefficient times the token's divergence."""
    return F.zip_with(rewards, divergence, lambda r, k: r - F.lit(coefficient) * k)


def divergence_of(df: DataFrame, divergence: str = "divergence", mask: str = "mask") -> DataFrame:
    """kl: the batch mean of the sequences' masked means, which the adaptive coefficient follows."""
    return df.agg(F.avg(masked_sum(F.col(divergence), F.col(mask)) / (tokens(F.col(mask)) + F.lit(EPSILON))).alias("kl"))
