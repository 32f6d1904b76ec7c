"""Top-k agreement of a student with its teacher, by position chunks, and metric aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(values: Column, k: int) -> Column:
    """(value, index) of the k greatest; equal values by index."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("m"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["m"]).alias("value"), p["index"].alias("index")))


def log_softmax(values: Column) -> Column:
    top = F.array_max(values)
    total = F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda v: v - top - F.log(total))


def entropy(logits: Column) -> Column:
    logs = log_softmax(logits)
    return -F.aggregate(F.transform(logs, lambda x: F.exp(x) * x), F.lit(0.0), lambda a, x: a + x)


def overlap(student: Column, teacher: Column) -> Column:
    """Share of the student's ids that the teacher's have too."""
    return F.size(F.filter(student, lambda x: F.array_contains(teacher, x))) / F.size(student)


def by_chunk(tokens: DataFrame, chunk: int, metrics: list[str], position: str = "pos") -> DataFrame:
    """Means over all tokens (chunk_start -1) and over runs of ``chunk`` positions, in one pass."""
    start = (F.floor(F.col(position) / chunk) * chunk).cast("long")
    out = tokens.withColumn("chunk_start", start).rollup("chunk_start").agg(F.count("*").alias("n_tokens"), *[F.avg(m).alias(m) for m in metrics])
    return out.withColumn("chunk_start", F.coalesce("chunk_start", F.lit(-1)))


def combine_steps(metrics: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Per name one value over steps (name, step, value, weight) by its rule: last, sum, avg, max, min,
    weighted_avg; names without a rule are averaged."""
    rule = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v))]) if rules else F.create_map().cast("map<string,string>")
    named = metrics.withColumn("__rule", F.coalesce(F.try_element_at(rule, F.col("name")), F.lit("avg")))
    one = F.first("__rule")
    value = F.when(one == "last", F.max_by("value", "step")).when(one == "sum", F.sum("value")).when(one == "max", F.max("value")).when(one == "min", F.min("value"))
    value = value.when(one == "weighted_avg", F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).otherwise(F.avg("value"))
    return named.groupBy("name").agg(value.alias("value"))


def agreement(tokens: DataFrame, left: str, right: str) -> DataFrame:
    """Greatest, mean and deviation of the absolute difference of two probabilities, and their correlation."""
    gap = F.abs(F.col(left) - F.col(right))
    return tokens.agg(F.max(gap).alias("most"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("std"), F.corr(left, right).alias("corr"))
