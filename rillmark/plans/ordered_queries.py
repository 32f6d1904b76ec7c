"""Registered queries of ordered matching; SQL walks the sequences row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators import ordered
from rillmark.plans.queries import register
from rillmark.plans.rollouts import table

_LACKING = "o_custkey % 17 = 0 AND o_orderkey % 3 = 0"
_LEFT = "(o_orderkey * 7 + o_custkey) % 5 <> 0"


@register(f"""WITH RECURSIVE o AS (SELECT o_custkey AS g, o_orderkey AS pos, o_orderpriority AS k FROM orders),
  f0 AS (SELECT o_custkey AS g, CASE WHEN o_custkey % 10 = 0 THEN -o_orderkey ELSE o_orderkey END AS row, CASE WHEN {_LACKING} THEN 'none' ELSE o_orderpriority END AS k FROM orders WHERE {_LEFT}),
  f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY row) AS i, count(*) OVER (PARTITION BY g) AS n FROM f0 WHERE k <> 'none'),
  fw AS (SELECT DISTINCT g, 0::BIGINT AS i, -1::BIGINT AS pos FROM f
    UNION ALL SELECT f.g, f.i, min(o.pos) FROM fw JOIN f ON f.g = fw.g AND f.i = fw.i + 1 JOIN o ON o.g = f.g AND o.k = f.k AND o.pos > fw.pos GROUP BY f.g, f.i),
  bw AS (SELECT DISTINCT g, n + 1 AS i, 9000000000000000000::BIGINT AS pos FROM f
    UNION ALL SELECT f.g, f.i, max(o.pos) FROM bw JOIN f ON f.g = bw.g AND f.i = bw.i - 1 JOIN o ON o.g = f.g AND o.k = f.k AND o.pos < bw.pos GROUP BY f.g, f.i),
  m AS (SELECT f.g, f.row, fw.pos AS earliest, bw.pos AS latest FROM f LEFT JOIN fw ON fw.g = f.g AND fw.i = f.i LEFT JOIN bw ON bw.g = f.g AND bw.i = f.i),
  s AS (SELECT DISTINCT g FROM m WHERE earliest IS NULL OR latest IS NULL)
  SELECT f0.g AS customer, f0.row AS row, CASE WHEN s.g IS NULL THEN earliest END AS earliest, CASE WHEN s.g IS NULL THEN latest END AS latest,
  CASE WHEN f0.k = 'none' THEN 'no original match' WHEN s.g IS NOT NULL THEN 'no ordered original match' WHEN earliest = latest THEN 'matched' ELSE 'ambiguous ordered original match' END AS outcome
  FROM f0 LEFT JOIN m ON m.g = f0.g AND m.row = f0.row LEFT JOIN s ON s.g = f0.g""")
def ordered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    row = F.when(F.col("o_custkey") % 10 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    key = F.when(F.expr(_LACKING), "none").otherwise(F.col("o_orderpriority"))
    filtered = orders.where(_LEFT).select(F.col("o_custkey").alias("customer"), row.alias("row"), key.alias("key"))
    original = orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("key"))
    return ordered.ordered_matches(filtered, original, ["key"], by=["customer"])
