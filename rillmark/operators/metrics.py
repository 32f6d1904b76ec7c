"""Training metrics: data, timing, throughput, debug comparisons, preferences and summaries of routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.arrays import EPSILON, masked_sum
from rillmark.operators.correction import tokens


def lengths(df: DataFrame, mask: str = "mask", prompt_mask: str | None = None) -> DataFrame:
    """Add response_length and, from its own mask, prompt_length."""
    out = df.withColumn("response_length", tokens(F.col(mask)))
    return out.withColumn("prompt_length", tokens(F.col(prompt_mask))) if prompt_mask else out


def _three(c: Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]


def data_metrics(df: DataFrame, longest: int, scores: str = "scores", rewards: str = "rewards", critic: bool = True) -> DataFrame:
    """One row: scores and rewards of sequences that are not empty, valid tokens' advantages, returns and values, lengths, clip and abort shares.

    Sums by row carry what a variance needs, so tokens are never exploded.
    """
    m = F.col("mask")
    valid = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("x"), m.alias("m")), lambda z: z["m"] != 0), lambda z: z["x"])
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    own = lengths(df)
    n = F.col("response_length")
    full = F.when(n > 0, F.lit(1))
    cols = [n.alias("n"), *[F.when(n > 0, sums(F.col(c))).alias(k) for c, k in ((scores, "score"), (rewards, "reward"))]]
    for c in ("advantages", "returns", *(["values"] if critic else [])):
        cols += [sums(valid(c)).alias(f"{c}_s"), F.array_max(valid(c)).alias(f"{c}_x"), F.array_min(valid(c)).alias(f"{c}_n")]
    if critic:
        gap = F.zip_with("returns", "values", lambda a, b: a - b)
        cols += [sums(F.transform(valid("returns"), lambda x: x * x)).alias("rq"), masked_sum(gap, m).alias("g"), masked_sum(F.transform(gap, lambda x: x * x), m).alias("gq")]
    own = own.select(*cols, full.alias("full"))
    whole = F.sum("n")
    var = lambda s, q: (F.sum(q) - F.sum(s) * F.sum(s) / whole) / (whole - 1)
    out = [*_three(F.col("score"), "score"), *_three(F.col("reward"), "reward")]
    for c in ("advantages", "returns", *(["values"] if critic else [])):
        out += [(F.sum(f"{c}_s") / whole).alias(f"{c}_mean"), F.max(f"{c}_x").alias(f"{c}_max"), F.min(f"{c}_n").alias(f"{c}_min")]
    if critic:
        out.append((F.lit(1.0) - var("g", "gq") / (var("returns_s", "rq") + F.lit(1e-5))).alias("explained_variance"))
    clipped = (F.col("n") == longest).cast("double")
    return own.agg(*out, *_three(F.col("n"), "length"), F.avg(clipped).alias("clip_share"), F.avg(F.when(F.col("n") > 0, clipped)).alias("clip_share_not_aborted"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("length_not_aborted_mean"), F.avg((F.col("n") == 0).cast("double")).alias("aborted_share"))


#: Sections whose time is spread over prompts and responses; generation over responses only.
BOTH = ("ref", "values", "adv", "update_critic", "update_actor")


def timing_metrics(times: DataFrame, totals: DataFrame) -> DataFrame:
    """section, seconds, per_token_ms: ``times`` (section, seconds) against ``totals`` (one row: prompt_tokens, response_tokens)."""
    n = F.when(F.col("section") == "gen", F.col("response_tokens")).when(F.col("section").isin(*BOTH), F.col("prompt_tokens") + F.col("response_tokens"))
    return times.crossJoin(F.broadcast(totals)).select("section", "seconds", (F.col("seconds") * 1000 / n).alias("per_token_ms"))  # one row


def throughput(df: DataFrame, seconds: float, devices: int, length: str = "length") -> DataFrame:
    """total_tokens, seconds and tokens a second and device."""
    return df.agg(F.sum(length).alias("total_tokens"), F.lit(float(seconds)).alias("seconds"), (F.sum(length) / F.lit(float(seconds) * devices)).alias("throughput"))


def probability_differences(df: DataFrame, a: str = "new", b: str = "old") -> DataFrame:
    """max, mean, std of the absolute differences of probabilities, and their correlation, over kept tokens."""
    rows = df.select(F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"), F.col("mask").alias("m"))).alias("z")).where("z.m <> 0").select(F.exp("z.a").alias("a"), F.exp("z.b").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return rows.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.corr("a", "b").alias("correlation"))


def differing_tokens(a: Column, b: Column, mask: Column) -> Column:
    """How many kept places differ."""
    return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), mask, lambda d, m: (d & (m != 0)).cast("int")), F.lit(0), lambda s, x: s + x)


def dense_rloo(df: DataFrame, key: str = "uid", rewards: str = "rewards", coefficient: float = 1.0) -> DataFrame:
    """Add ``rloo``: token rewards times n / (n - 1) less the group's summed row means over n - 1; masked tokens 0."""
    m = F.col("mask")
    own = df.withColumn("__mean", masked_sum(F.col(rewards), m) / tokens(m))
    w = Window.partitionBy(key)
    own = own.withColumns({"__n": F.count("*").over(w), "__base": F.sum("__mean").over(w)})
    n = F.col("__n")
    out = F.zip_with(rewards, "mask", lambda r, k: F.when(k != 0, F.lit(coefficient) * (r * (n / (n - 1)) - F.col("__base") / (n - 1))).otherwise(F.lit(0.0)))
    return own.withColumn("rloo", out).drop("__mean", "__n", "__base")


def pair_accuracy(df: DataFrame, key: str = "uid", order: str = "sample", score: str = "score", truth: str = "acc") -> DataFrame:
    """accuracy: mean over groups of the pairs that scores order as the truth does, weighted by the truths' distance; 0.5 where all agree.

    The pairs are those of one group, which has the few samples of a prompt.
    """
    a = df.select(key, F.col(order).alias("i"), F.col(score).alias("s"), F.col(truth).alias("t"))
    b = df.select(key, F.col(order).alias("j"), F.col(score).alias("s2"), F.col(truth).alias("t2"))
    pairs = a.join(b, key).where("i < j")
    gap = F.col("t") - F.col("t2")
    right = (((F.col("s") - F.col("s2")) > 0) == (gap > 0)).cast("double")
    groups = pairs.groupBy(key).agg(F.sum(right * F.abs(gap)).alias("r"), F.sum(F.abs(gap)).alias("w"))
    return groups.agg(F.avg(F.when(F.col("w") == 0, 0.5).otherwise(F.col("r") / F.col("w"))).alias("accuracy"))


def sign_accuracy(df: DataFrame, score: str = "score", truth: str = "acc") -> DataFrame:
    """accuracy: how often the score's sign is the truth's (0 or 1)."""
    return df.agg(F.avg((F.signum(F.col(score)) == F.signum(F.col(truth) * 2 - 1)).cast("double")).alias("accuracy"))


def cross_entropy(df: DataFrame, beta: float, score: str = "score", truth: str = "acc") -> DataFrame:
    """loss: binary cross entropy of the sigmoid of beta times the score; logarithms are -100 at least."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(beta) * F.col(score)))
    log = lambda x: F.greatest(F.log(x), F.lit(-100.0))
    return df.agg(F.avg(-(F.col(truth) * log(p) + (1 - F.col(truth)) * log(1 - p))).alias("loss"))


def detached_preference(df: DataFrame, beta: float, key: str = "uid", score: str = "score", truth: str = "acc", best_of: str = "none") -> DataFrame:
    """loss: each row against the mean score of its group's rows of the other truth; optionally weighted by best-of-n chances."""
    w = Window.partitionBy(key)
    s, t = F.col(score), F.col(truth)
    low, high = F.avg(F.when(t <= 0, s)).over(w), F.avg(F.when(t > 0, s)).over(w)
    other = F.coalesce(F.when(t > 0, low).otherwise(high), F.lit(0.0)) * beta
    rows = df.withColumns({"__q": s * beta, "__o": other, "__n": F.count("*").over(w).cast("double")})
    rows = rows.withColumn("__l", F.log1p(F.exp(-(F.col("__q") - F.col("__o")) * F.when(t > 0, 1.0).otherwise(-1.0))))
    if best_of == "none":
        return rows.agg(F.avg("__l").alias("loss"))
    by = score if best_of == "score" else truth
    upto = F.cume_dist().over(Window.partitionBy(key).orderBy(by))
    return rows.withColumn("__c", upto).agg(F.sum(F.col("__l") * F.col("__n") * F.pow(F.col("__c"), F.col("__n") - 1)).alias("loss"))


def preferred(df: DataFrame, key: str = "uid", order: str = "sample", score: str = "score") -> DataFrame:
    """key, chosen, rejected: the samples of the greatest and the least score of groups with several; ties by order."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o")))
    worst = F.min(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o")))
    out = df.groupBy(key).agg(best.alias("b"), worst.alias("w"), F.count("*").alias("n")).where("n > 1")
    return out.select(key, F.col("b.o").alias("chosen"), (-F.col("w.o")).alias("rejected"))


def routing_summary(df: DataFrame, key: str = "uid", length: str = "length") -> DataFrame:
    """bucket, n_correct, row_share, mean_length, groups: a routing's rows and groups by bucket and by number of right samples."""
    total = Window.partitionBy()
    groups = df.groupBy("bucket", "n_correct").agg(F.count("*").alias("rows"), F.sum(length).alias("s"), F.countDistinct(key).alias("groups"))
    return groups.select("bucket", "n_correct", (F.col("rows") / F.sum("rows").over(total)).alias("row_share"), (F.col("s") / F.col("rows")).alias("mean_length"), "groups")  # a row a bucket and number


def signal_summary(df: DataFrame, length: str = "length", correct: str = "graded") -> DataFrame:
    """One row of a two-signal routing: shares of styles, conditional means (0 where a condition never holds)."""
    when = lambda test, c: F.coalesce(F.avg(F.when(test, c)), F.lit(0.0))
    styles = [F.avg((F.col("style") == s).cast("double")).alias(f"{s}_share") for s in ("concise", "budget", "normal")]
    right = F.col(correct) > 0.5
    return df.agg(F.avg("easy").alias("easy_mean"), F.avg("hard").alias("hard_mean"), F.avg("beta").alias("beta_mean"), *styles, when(right, F.col("beta")).alias("beta_right"), when(~right, F.col("beta")).alias("beta_wrong"), when(F.col("style") == "concise", F.col(length)).alias("concise_length"), when(F.col("style") == "budget", F.col(length)).alias("budget_length"))


def penalty_summary(df: DataFrame, gate: Column, coefficient: float, penalty: str = "penalty") -> DataFrame:
    """mean, max, gate_share, gated_mean and applied mean of a length penalty under a gate."""
    p = F.col(penalty)
    g = gate.cast("double")
    return df.agg(F.avg(p).alias("penalty_mean"), F.max(p).alias("penalty_max"), F.avg(g).alias("gate_share"), F.coalesce(F.sum(p * g) / F.sum(g), F.lit(0.0)).alias("gated_mean"), (F.lit(coefficient) * F.avg(p * g)).alias("applied_mean"))


def macro_average(df: DataFrame, by: str, *values: str) -> DataFrame:
    """Means of the groups' means, each group counting once."""
    one = df.groupBy(by).agg(*[F.avg(v).alias(v) for v in values])
    return one.agg(F.count("*").alias("groups"), *[F.avg(v).alias(v) for v in values])


def length_summary(df: DataFrame, by: str, length: str, limit: int, correct: Column) -> DataFrame:
    """by, n, accuracy, mean_length, truncated_share and the mean lengths of right and wrong rows."""
    n = F.col(length)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(n).alias("mean_length"), F.avg((n >= limit).cast("double")).alias("truncated_share"), F.avg(F.when(correct, n)).alias("right_length"), F.avg(F.when(~correct, n)).alias("wrong_length"))


def budget_summary(df: DataFrame, budget: str = "budget", length: str = "length") -> DataFrame:
    """n, mean, least, most, share over budget and mean ratio of lengths to budgets; rows without a budget are counted apart."""
    b, n = F.col(budget), F.col(length)
    return df.agg(F.count(b).alias("n"), F.sum(b.isNull().cast("int")).alias("without"), F.avg(b).alias("budget_mean"), F.min(b).alias("budget_min"), F.max(b).alias("budget_max"), F.avg((n > b).cast("double")).alias("over_share"), F.avg(n / b).alias("ratio_mean"))


def metric_names(df: DataFrame) -> DataFrame:
    """Add ``name``: val-core for mean@N, maj@N and best@N of the greatest N of the core variable (acc, else reward), else val-aux.

    Rows: data_source, variable, metric (such as ``mean@8``), value.
    """
    n = F.coalesce(F.regexp_extract("metric", r"@(\d+)", 1).try_cast("int"), F.lit(-1))
    w = Window.partitionBy("data_source")
    out = df.withColumns({"__n": n, "__acc": F.max((F.col("variable") == "acc").cast("int")).over(w)})
    out = out.withColumn("__most", F.max("__n").over(Window.partitionBy("data_source", "variable")))
    core = (F.col("variable") == F.when(F.col("__acc") == 1, "acc").otherwise("reward")) & F.col("metric").rlike("^(mean|maj|best)") & (F.col("__n") == F.col("__most"))
    section = F.when(core, "val-core").otherwise("val-aux")
    return out.withColumn("name", F.concat_ws("/", section, "data_source", "variable", "metric")).drop("__n", "__acc", "__most")


def masked_share(df: DataFrame, flags: str, mask: str = "mask") -> DataFrame:
    """share of kept tokens that are flagged."""
    return df.agg((F.sum(masked_sum(F.col(flags), F.col(mask))) / (F.sum(tokens(F.col(mask))) + F.lit(EPSILON))).alias("share"))
