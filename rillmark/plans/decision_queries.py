"""Registered queries of decision tables, gates and group codes, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators import decisions, labels, projection
from rillmark.operators.decisions import Gate, Range, Rule
from rillmark.plans.queries import register
from rillmark.plans.rollouts import table

#: The bounds of the pilot's decision.
PILOT = [Rule("no_go", {"vendi": Range(high=0.6)}), Rule("no_go", {"coverage": Range(high=0.6)}), Rule("go", {"vendi": Range(0.9), "coverage": Range(0.9), "norm": Range(0.25), "signal": Range(0.25)})]
#: The gates of the main arm.
GATES = (Gate("vendi", 0.95, 0.90, 6), Gate("coverage", 0.50, 0.10, 7), Gate("norm", 0.10), Gate("signal", 0.10))

_METRICS_SQL = "SELECT l_orderkey AS uid, l_linenumber AS line, 0.5 + l_quantity / 100 + l_tax AS vendi, 0.52 + (l_partkey % 50) / 100 + l_discount AS coverage, (l_suppkey % 10) / 12 + l_tax AS norm, (l_partkey % 7) / 10 AS signal FROM lineitem"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("uid"), c("l_linenumber").alias("line"), (0.5 + c("l_quantity") / 100 + c("l_tax")).alias("vendi"), (0.52 + (c("l_partkey") % 50) / 100 + c("l_discount")).alias("coverage"),
        ((c("l_suppkey") % 10) / 12 + c("l_tax")).alias("norm"), ((c("l_partkey") % 7) / 10).alias("signal"),
    )


@register(f"""WITH m AS ({_METRICS_SQL}), r AS (SELECT uid, line, round(vendi, 9) AS vendi, round(coverage, 9) AS coverage, round(norm, 9) AS norm, round(signal, 9) AS signal FROM m)
  SELECT uid, line, CASE WHEN vendi <= 0.6 OR coverage <= 0.6 THEN 'no_go' WHEN vendi >= 0.9 AND coverage >= 0.9 AND norm >= 0.25 AND signal >= 0.25 THEN 'go' ELSE 'borderline' END AS decision FROM r""")
def pilot_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir)
    exact = rows.select("uid", "line", *[F.round(m, 9).alias(m) for m in ("vendi", "coverage", "norm", "signal")])
    return exact.select("uid", "line", decisions.decision(PILOT, otherwise="borderline").alias("decision"))


@register(f"""WITH m AS (SELECT uid % 50 AS arm, (uid // 50) % 8 AS realization, line % 4 AS corner, min(round(vendi, 9)) AS vendi, min(round(coverage, 9)) AS coverage, min(round(norm, 9)) AS norm, max(round(signal, 9)) AS signal FROM ({_METRICS_SQL}) z GROUP BY ALL),
  w AS (SELECT arm, realization, min(vendi) AS vendi, min(coverage) AS coverage, min(norm) AS norm, min(signal) AS signal FROM m GROUP BY arm, realization HAVING count(*) = 4),
  g AS (SELECT arm, quantile_cont(vendi, 0.5) AS vendi_median, count(*) FILTER (vendi >= 0.90) AS vendi_count, quantile_cont(coverage, 0.5) AS coverage_median, count(*) FILTER (coverage >= 0.10) AS coverage_count,
    quantile_cont(norm, 0.5) AS norm_median, count(*) AS norm_count, quantile_cont(signal, 0.5) AS signal_median, count(*) AS signal_count FROM w GROUP BY arm HAVING count(*) = 8),
  p AS (SELECT *, vendi_median >= 0.95 AND vendi_count >= 6 AS vendi_pass, coverage_median >= 0.5 AND coverage_count >= 7 AS coverage_pass, norm_median >= 0.1 AS norm_pass, signal_median >= 0.1 AS signal_pass FROM g)
  SELECT *, vendi_pass AND coverage_pass AND norm_pass AND signal_pass AS all_pass FROM p""")
def arm_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir).select((F.col("uid") % 50).alias("arm"), (F.floor(F.col("uid") / 50) % 8).alias("realization"), (F.col("line") % 4).alias("corner"), *[F.round(m, 9).alias(m) for m in ("vendi", "coverage", "norm", "signal")])
    corners = rows.groupBy("arm", "realization", "corner").agg(*[F.min(m).alias(m) for m in ("vendi", "coverage", "norm")], F.max("signal").alias("signal"))
    full = corners.groupBy("arm", "realization").agg(F.count("*").alias("n")).where("n = 4").drop("n")
    worst = decisions.worst_corners(corners.join(full, ["arm", "realization"]), ["arm", "realization"], ["vendi", "coverage", "norm", "signal"], "corner")
    whole = worst.groupBy("arm").agg(F.count("*").alias("n")).where("n = 8").drop("n")
    return decisions.component_gates(worst.join(whole, "arm"), ["arm"], GATES)


@register("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN '00' || (doc_id % 40) ELSE '' || (doc_id % 40) END AS label FROM documents),
  c AS (SELECT label, row_number() OVER (ORDER BY label NULLS LAST) - 1 AS code FROM (SELECT DISTINCT label FROM l) z) SELECT doc_id, l.label AS label, code AS group_id FROM l JOIN c ON l.label IS NOT DISTINCT FROM c.label""")
def mixed_group_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = (F.col("doc_id") % 40).cast("string")
    label = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("00"), part)).otherwise(part)
    return labels.group_codes(table(spark, sf_dir, "documents").select("doc_id", label.alias("label")), "label")


@register("SELECT o_orderkey AS uid, CAST(o_custkey AS BIGINT) AS group_id FROM orders")
def numeric_group_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" 00"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    return labels.group_codes(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), text.alias("label")), "label").drop("label")


@register(None)  # tested against a plain loop: SQL has no such generator
def projected_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.project(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32, seed=11)
