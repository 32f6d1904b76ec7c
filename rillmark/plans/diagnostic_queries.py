"""Registered queries of quantiles, agreement between runs, balance over ranks and covers, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators import agreement, covers, ranks
from rillmark.operators.quantiles import quantiles
from rillmark.plans.queries import register
from rillmark.plans.rollouts import table
from rillmark.sources import publishing

#: Five labellings of the orders: by status, priority, month, a coarse price and the customer.
_LABELS_SQL = """SELECT run, o_orderkey AS row, label FROM (SELECT o_orderkey, unnest([0, 1, 2, 3, 4]) AS run, unnest([o_orderstatus, o_orderpriority, strftime(o_orderdate, '%m'), CAST(CAST(floor(o_totalprice / 20000) AS BIGINT) AS VARCHAR), CAST(o_custkey AS VARCHAR)]) AS label FROM orders) z"""
_CELLS_SQL = f"""l AS ({_LABELS_SQL}), cells AS (SELECT x.run AS "left", y.run AS "right", x.label AS a, y.label AS b, count(*) AS c FROM l x JOIN l y ON x.row = y.row AND x.run < y.run GROUP BY ALL),
  w AS (SELECT "left", "right", sum(c) AS n, sum(c * (c - 1) / 2) AS t, sum(c * ln(c)) AS lt FROM cells GROUP BY ALL),
  ma AS (SELECT "left", "right", a, sum(c) AS m FROM cells GROUP BY ALL), mb AS (SELECT "left", "right", b, sum(c) AS m FROM cells GROUP BY ALL),
  sa AS (SELECT "left", "right", sum(m * (m - 1) / 2) AS s, sum(m * ln(m)) AS lg FROM ma GROUP BY ALL), sb AS (SELECT "left", "right", sum(m * (m - 1) / 2) AS s, sum(m * ln(m)) AS lg FROM mb GROUP BY ALL)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor(F.col("o_totalprice") / 20000).cast("long").cast("string")
    each = F.array("o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "MM"), price, F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.posexplode(each).alias("run", "label"))


@register(f"""WITH {_CELLS_SQL}, ha AS (SELECT "left", "right", m AS p, count(*) AS mp FROM ma GROUP BY ALL), hb AS (SELECT "left", "right", m AS q, count(*) AS mq FROM mb GROUP BY ALL),
  k AS (SELECT "left", "right", n, p, q, mp * mq AS many, unnest(range(greatest(1, p + q - n)::BIGINT, least(p, q)::BIGINT + 1)) AS k FROM ha JOIN hb USING ("left", "right") JOIN w USING ("left", "right")),
  e AS (SELECT "left", "right", sum(many * k / n * ln(n::DOUBLE * k / (p::DOUBLE * q)) * exp(lgamma(p + 1) + lgamma(q + 1) + lgamma(n - p + 1) + lgamma(n - q + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(p - k + 1) - lgamma(q - k + 1) - lgamma(n - p - q + k + 1))) AS emi FROM k GROUP BY ALL),
  z AS (SELECT "left", "right", w.n, t, sa.s AS a, sb.s AS b, sa.s * sb.s / (w.n * (w.n - 1) / 2) AS chance, ln(w.n) - sa.lg / w.n AS ha, ln(w.n) - sb.lg / w.n AS hb, ln(w.n) - lt / w.n AS hab, emi FROM w JOIN sa USING ("left", "right") JOIN sb USING ("left", "right") JOIN e USING ("left", "right"))
  SELECT "left", "right", n::BIGINT AS n, round((t - chance) / ((a + b) / 2 - chance), 6) + 0.0 AS ari, round((ha + hb - hab - emi) / ((ha + hb) / 2 - emi), 6) + 0.0 AS ami FROM z""")
def cross_run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = agreement.agreements(_labels(spark, sf_dir))
    return got.select("left", "right", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("ari", "ami")])


@register(f"""WITH l AS ({_LABELS_SQL}), s AS (SELECT run, row FROM l WHERE label <= '3' OR label = 'F'), n AS (SELECT run, count(*) AS n FROM s GROUP BY run), c AS (SELECT count(*) AS c FROM orders),
  i AS (SELECT x.run AS "left", y.run AS "right", count(*) AS i FROM s x JOIN s y ON x.row = y.row AND x.run < y.run GROUP BY ALL),
  z AS (SELECT x.run AS "left", y.run AS "right", x.n AS n_left, y.n AS n_right, coalesce(i.i, 0) AS intersection, x.n * y.n / c.c AS chance FROM n x JOIN n y ON x.run < y.run CROSS JOIN c LEFT JOIN i ON i."left" = x.run AND i."right" = y.run)
  SELECT "left", "right", n_left, n_right, intersection, round(intersection / (n_left + n_right - intersection), 9) AS jaccard, round(CASE WHEN abs(least(n_left, n_right) - chance) < 1e-12 THEN 0 ELSE (intersection - chance) / (least(n_left, n_right) - chance) END, 9) + 0.0 AS adjusted FROM z""")
def cross_run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _labels(spark, sf_dir).where("label <= '3' OR label = 'F'")
    got = agreement.overlaps(chosen, table(spark, sf_dir, "orders").count())
    return got.select("left", "right", "n_left", "n_right", "intersection", F.round("jaccard", 9).alias("jaccard"), (F.round("adjusted", 9) + 0.0).alias("adjusted"))


@register(f"""WITH s AS (SELECT run, label, count(*) AS n FROM ({_LABELS_SQL}) l GROUP BY ALL) SELECT run, count(*) AS clusters, sum(n)::BIGINT AS rows, min(n) AS least, max(n) AS most, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 9) AS singletons,
  round(quantile_cont(n::DOUBLE, 0.5), 9) AS median, round(quantile_cont(n::DOUBLE, 0.9), 9) AS p90, round(quantile_cont(n::DOUBLE, 0.99), 9) AS p99 FROM s GROUP BY run""")
def run_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = agreement.run_sizes(_labels(spark, sf_dir))
    return got.select("run", "clusters", "rows", "least", "most", *[F.round(c, 9).alias(c) for c in ("singletons", "median", "p90", "p99")])


@register("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(quantile_cont(l_extendedprice, 0.0), 6) AS least, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999,
  round(quantile_cont(l_extendedprice, 1.0), 6) AS most FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL""")
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})
    got = quantiles(rows, ["flag", "status"], "l_extendedprice", [0.0, 0.5, 0.95, 0.999, 1.0])
    return got.select("flag", "status", "n", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("least", "median", "p95", "p999", "most"))])


@register("""SELECT user_id, count(*) AS n, quantile_disc(value, 0.25) AS low, quantile_disc(value, 0.5) AS middle, quantile_disc(value, 0.75) AS high FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def user_value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quantiles(table(spark, sf_dir, "events"), ["user_id"], "value", [0.25, 0.5, 0.75], interpolate=False)
    return got.select("user_id", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("low", "middle", "high"))])


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders")
    return lines.select(F.col("o_orderkey").alias("row_id"), F.floor(F.col("o_totalprice") / 50).cast("long").alias("length"))


@register("""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 50) AS BIGINT) AS n FROM orders), c AS (SELECT count(*) AS n, max(n) AS most FROM o),
  r AS (SELECT unnest(range(8)) AS rank) SELECT CAST(rank AS INT) AS rank, (n + 7) // 8 AS most_rows, true AS whole, true AS even, true AS both_ends FROM r, c""")
def even_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rank: the size it may have, whether positions are gapless, work within one sequence's of the mean, and lengths rise then fall."""
    rows = _numbered(spark, sf_dir)
    n = rows.count()
    size = -(-n // 8)
    got = ranks.balanced_ranks(rows, 8, exact=False).join(rows, "row_id")
    most = rows.agg(F.max(ranks.workload(F.col("length")))).first()[0]
    mean = rows.agg(F.sum(ranks.workload(F.col("length")))).first()[0] / 8
    by = got.groupBy("rank").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.max("position").alias("last"), F.sum(ranks.workload(F.col("length"))).alias("work"))
    longest = got.groupBy("rank").agg(F.max_by("position", F.struct("length", "row_id")).alias("top"))
    middle = F.col("top") == F.floor(F.col("n") / 2)
    whole = (F.col("n") == F.col("d")) & (F.col("last") == F.col("n") - 1) & F.col("n").between(size - 1, size)
    return by.join(longest, "rank").select("rank", F.lit(size).cast("long").alias("most_rows"), whole.alias("whole"), (F.abs(F.col("work") - mean) <= most).alias("even"), middle.alias("both_ends"))


_EDGES_SQL = """e AS (SELECT DISTINCT l_suppkey AS task, l_partkey % 60 AS test, l_returnflag || ':' || strftime(l_shipdate, '%Y%m') AS item FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND l_returnflag IS NOT NULL AND l_shipdate IS NOT NULL)"""
_GREEDY_SQL = """t AS (SELECT task, test, list(item) AS items FROM e GROUP BY ALL),
  g AS (SELECT task, -1 AS place, CAST(NULL AS BIGINT) AS test, CAST(0 AS BIGINT) AS gain, list(DISTINCT item) AS rest FROM e GROUP BY task
    UNION ALL SELECT task, place + 1, test, gain, list_filter(rest, lambda x: NOT list_contains(items, x)) FROM
      (SELECT g.task, g.place, t.test, t.items, g.rest, len(list_intersect(t.items, g.rest)) AS gain, row_number() OVER (PARTITION BY g.task ORDER BY len(list_intersect(t.items, g.rest)) DESC, t.test) AS n FROM g JOIN t USING (task) WHERE len(g.rest) > 0) z WHERE n = 1)"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("test", F.col("l_partkey") % 60)
    return covers.cover_edges(lines, "l_suppkey", "test", "l_returnflag", F.date_format("l_shipdate", "yyyyMM"))


@register(f"WITH RECURSIVE {_EDGES_SQL}, {_GREEDY_SQL} SELECT task, test, place, gain FROM g WHERE place >= 0")
def greedy_test_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.greedy_covers(_shown(spark, sf_dir))


@register("""WITH c AS (SELECT l_suppkey AS task, l_partkey % 60 AS test, min(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END) AS source FROM lineitem GROUP BY ALL),
  f AS (SELECT l_suppkey AS task, l_partkey % 60 AS test, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS source, min(l_linenumber) AS place FROM lineitem GROUP BY ALL) SELECT task, test, source, place FROM c JOIN f USING (task, test, source)""")
def merged_test_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), (F.col("l_partkey") % 60).alias("test"), F.col("l_linenumber").alias("place"), "l_returnflag")
    return covers.merged_covers([lines.where(F.col("l_returnflag") == flag) for flag in "RA"] + [lines.where("l_returnflag NOT IN ('R', 'A')")])


@register("""SELECT round(avg(n_base + coalesce(extra, 0)), 9) AS average, count(*) AS tasks FROM (SELECT s_suppkey AS task, s_nationkey AS n_base FROM supplier) s LEFT JOIN (SELECT l_suppkey AS task, count(*) AS extra FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) c USING (task)""")
def average_test_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").alias("n_base"))
    got = covers.average_tests(base, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("task")))
    return got.withColumn("average", F.round("average", 9))


_WORDS_SQL = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(publishing.WORDS))


@register(f"""WITH h AS (SELECT sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders)
  SELECT substr(h, 1, 2) AS leaf, count(*) AS rows, sha256(concat_ws(',', count(*), {_WORDS_SQL})) AS digest FROM h GROUP BY leaf""")
def order_leaf_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.leaf_digests(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority"))
