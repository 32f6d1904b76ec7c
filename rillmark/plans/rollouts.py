"""Rollout views of the star-schema tables, and the training-step plan over them.

An order is a prompt (uid), its line items are sampled responses: quantity is the score, the part
number sets the length, the tax the confidence.  ``order_tokens`` has one row per order with its
lines as tokens.  Sample numbers come from a window inside an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.operators import advantages, losses, routing

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, sample, score, graded (0 or 1), length, logp, data_source."""
    sample = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uid"),
        sample.cast("long").alias("sample"),
        F.col("l_quantity").alias("score"),
        (F.col("l_discount") >= 0.05).cast("double").alias("graded"),
        (F.col("l_partkey") % 97 + 1).alias("length"),
        (-F.col("l_tax")).alias("logp"),
        F.col("l_returnflag").alias("data_source"),
    )


def order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid and token arrays: rewards, values, mask, new, old, advantages, log_ratio."""
    line = F.struct(*LINE_ORDER, "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.array_sort(F.collect_list(line)).alias("t"))
    return lines.select(
        "uid",
        F.transform("t", lambda x: x["l_discount"]).alias("rewards"),
        F.transform("t", lambda x: x["l_tax"]).alias("values"),
        F.transform("t", lambda x: (x["l_linestatus"] == "O").cast("double")).alias("mask"),
        F.transform("t", lambda x: -x["l_tax"]).alias("new"),
        F.transform("t", lambda x: -x["l_discount"]).alias("old"),
        F.transform("t", lambda x: x["l_quantity"] - F.lit(25.0)).alias("advantages"),
        F.transform("t", lambda x: x["l_discount"] - x["l_tax"]).alias("log_ratio"),
    )


def training_step(rolls: DataFrame, estimator: str = "grpo") -> DataFrame:
    """The flagship query: score, route by group success, estimate advantages, select candidates.

    All three steps are windows over uid, so one shuffle serves them.
    """
    routed = routing.group_success(rolls.withColumn("score", F.col("graded")))
    estimated = advantages.advantage(routed, estimator)
    budget, supervised = routing.length_budget(F.col("length"), 0.8, 1.0)
    return estimated.withColumns({"budget": budget, "supervised": supervised})


def step_summary(step: DataFrame) -> DataFrame:
    """Per bucket: rows, groups, mean length, supervised tokens and mean absolute advantage."""
    return step.groupBy("bucket").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("uid").alias("n_groups"),
        F.round(F.avg("length"), 6).alias("mean_length"),
        F.sum("supervised").alias("supervised"),
        F.round(F.avg(F.abs("advantage")), 6).alias("mean_advantage"),
    )


__all__ = ["losses", "order_tokens", "rollouts", "step_summary", "table", "training_step"]
