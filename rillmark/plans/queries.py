"""Registered queries over the driver's tables, each with the DuckDB SQL that it must equal.

Real numbers are rounded to six places on both sides, since sums differ in their last bits; where
decimal inputs make exact ties of the seventh place, a hair off the tie, since those bits decide it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.functions import arrays, text
from rillmark.operators import advantages, balancing, batch, curation, evaluation, losses, routing
from rillmark.plans import rollouts as plan
from rillmark.plans.rollouts import order_tokens, rollouts, table
from rillmark.sources.staging import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINES = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"
ROLLS = f"""WITH r AS (
  SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES}) AS sample, l_quantity AS score,
    CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS graded, l_partkey % 97 + 1 AS length, -l_tax AS logp, l_returnflag AS data_source
  FROM lineitem
), g AS (
  SELECT uid, count(*) AS n, avg(score) AS m, sum(score) AS s, var_samp(score) AS v, stddev_samp(score) AS sd, sum(length * score) / sum(length) AS wm FROM r GROUP BY uid
)
"""
TOKENS = f"""WITH t AS (
  SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINES}, l_linestatus) AS pos, l_discount AS reward, l_tax AS value,
    CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask, -l_tax AS new, -l_discount AS old, l_quantity - 25.0::DOUBLE AS adv, l_discount - l_tax AS log_ratio
  FROM lineitem
)
"""
WORDS = "regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '(\\\\[A-Za-z]+|[A-Za-z0-9]+)', 1)"


def register(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HAIR = 3.7e-10


def six(c: Column) -> Column:
    return F.round(c, 6)


def _advantage(name: str, sql: str, **options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return advantages.advantage(rollouts(spark, sf_dir), name, **options).select("uid", "sample", six(F.col("advantage")).alias("advantage"))

    query.__name__ = f"advantage_{name}"
    register(f"{ROLLS} SELECT uid, sample, round({sql}, 6) AS advantage FROM r JOIN g USING (uid)")(query)


_advantage("grpo", "CASE WHEN n > 1 THEN (score - m) / (sd + 1e-6) ELSE score / (1 + 1e-6) END")
_advantage("grpo_vectorized", "CASE WHEN n > 1 THEN (score - m) / (sqrt(greatest(v, 1e-6)) + 1e-6) ELSE score / (1 + 1e-6) END")
_advantage("rloo", "CASE WHEN n > 1 THEN n::DOUBLE / (n - 1) * (score - m) ELSE score END")
_advantage("rloo_vectorized", "CASE WHEN n > 1 THEN (n * score - s) / (n - 1) ELSE 0.0::DOUBLE END")
_advantage("opo", "score - CASE WHEN n > 1 THEN wm ELSE 0.0::DOUBLE END")
_advantage("gpg", "(SELECT count(*)::DOUBLE / greatest(count(*) FILTER (score <> 0), 1) FROM r) * (score - CASE WHEN n > 1 THEN m ELSE 0.0::DOUBLE END)")


@register(f"""{ROLLS}, c AS (SELECT uid, sample, length, score - CASE WHEN n > 1 THEN m ELSE 0.0::DOUBLE END AS c FROM r JOIN g USING (uid)),
a AS (SELECT sum(length)::DOUBLE AS n, sum(length * c) AS s, sum(length * c * c) AS q FROM c)
SELECT uid, sample, round((c - s / n) / sqrt((q / n - (s / n) * (s / n)) * n / (n - 1) + 1e-8), 6) AS advantage FROM c, a""")
def advantage_reinforce_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantages.reinforce_baseline(rollouts(spark, sf_dir)).select("uid", "sample", six(F.col("advantage")).alias("advantage"))


@register(f"""{ROLLS}, k AS (SELECT uid, sample, score, n, sd, row_number() OVER w AS rk, lead(score) OVER w AS nxt FROM r JOIN g USING (uid) WINDOW w AS (PARTITION BY uid ORDER BY score DESC, sample))
SELECT uid, sample, round(CASE WHEN rk = 1 THEN (score - nxt) / (sd + 1e-6) ELSE 0.0::DOUBLE END, 6) AS advantage FROM k WHERE n > 1""")
def advantage_grpo_passk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolls = rollouts(spark, sf_dir).withColumn("__n", F.count("*").over(Window.partitionBy("uid"))).where("__n > 1").drop("__n")
    return advantages.grpo_passk(rolls).select("uid", "sample", six(F.col("advantage")).alias("advantage"))


@register(f"{ROLLS} SELECT uid, sample, round(score - (SELECT (ln(avg(exp(0.1 * score - 0.1 * (SELECT max(score) FROM r)))) + 0.1 * (SELECT max(score) FROM r)) / 0.1 FROM r), 6) AS advantage FROM r")
def advantage_softmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantages.softmean(rollouts(spark, sf_dir), 0.1).select("uid", "sample", six(F.col("advantage")).alias("advantage"))


@register(f"{ROLLS} SELECT uid, round(CASE WHEN n > 1 THEN m ELSE 0.0::DOUBLE END, 6) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(v, 1e-6)) ELSE 1.0::DOUBLE END, 6) AS std, n FROM g")
def group_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantages.group_stats(rollouts(spark, sf_dir)).select("uid", six(F.col("mean")).alias("mean"), six(F.col("std")).alias("std"), "n")


@register(f"{ROLLS} SELECT uid, sample, graded FROM r WHERE uid IN (SELECT uid FROM r GROUP BY uid HAVING stddev_pop(graded) > 0 OR count(*) = 1)")
def dynamic_sampling_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advantages.keep_varied_groups(rollouts(spark, sf_dir), "graded").select("uid", "sample", "graded")


@register(f"{ROLLS} SELECT r.uid, r.sample, f.ok AS passes FROM r JOIN (SELECT uid, avg(graded) BETWEEN 0.2 AND 0.8 AND max(length) < 94 AS ok FROM r GROUP BY uid) f ON r.uid = f.uid")
def accuracy_truncation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolls = rollouts(spark, sf_dir).withColumn("score", F.col("graded"))
    return advantages.group_accuracy_filter(rolls, 0.2, 0.8, 95).select("uid", "sample", "passes")


@register(f"""{TOKENS}, d AS (SELECT *, reward + coalesce(lead(value) OVER (PARTITION BY uid ORDER BY pos), 0) - value AS delta FROM t)
SELECT a.uid, a.pos - 1 AS pos, round(sum(power(0.95, b.pos - a.pos) * b.delta) + 3.7e-10, 6) AS advantage FROM d a JOIN d b ON a.uid = b.uid AND b.pos >= a.pos GROUP BY a.uid, a.pos""")
def gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir)
    ones = F.transform("mask", lambda m: F.lit(1.0))
    scan = arrays.gae(F.col("rewards"), F.col("values"), ones, 1.0, 0.95)
    return rows.select("uid", F.posexplode(scan).alias("pos", "a")).select("uid", F.col("pos").cast("long").alias("pos"), six(F.col("a") + HAIR).alias("advantage"))


@register(f"""{TOKENS} SELECT a.uid, a.pos - 1 AS pos, round(sum(power(0.9, b.pos - a.pos) * b.reward) + 3.7e-10, 6) AS ret FROM t a JOIN t b ON a.uid = b.uid AND b.pos >= a.pos GROUP BY a.uid, a.pos""")
def discounted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(arrays.reverse_scan(F.col("rewards"), F.lit(0.9))).alias("pos", "r"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), six(F.col("r") + HAIR).alias("ret"))


@register(f"""{TOKENS} SELECT uid, pos - 1 AS pos, round(sum(reward * mask) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.1, 6) AS ret FROM t""")
def remax_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = arrays.reverse_scan(F.zip_with("rewards", "mask", lambda r, m: r * m), F.lit(1.0))
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(scan).alias("pos", "r"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), six(F.col("r") - 0.1).alias("ret"))


@register(f"{TOKENS} SELECT uid, round(sum(value * mask), 6) AS masked_sum, round(sum(value * mask) / (sum(mask) + 1e-8), 6) AS masked_mean FROM t GROUP BY uid")
def masked_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, m = F.col("values"), F.col("mask")
    return order_tokens(spark, sf_dir).select("uid", six(arrays.masked_sum(v, m)).alias("masked_sum"), six(arrays.masked_mean(v, m)).alias("masked_mean"))


@register(f"""{TOKENS}, s AS (SELECT uid, sum(value * mask) AS s, sum(mask) AS n, count(*) AS w FROM t GROUP BY uid)
SELECT 'token-mean' AS mode, round(sum(s) / (sum(n) + 1e-8), 6) AS loss FROM s UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) FROM s
UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / (n + 1e-8)), 6) FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / max(w), 6) FROM s""")
def loss_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"`{m}`").alias("loss")) for m in losses.MODES])).alias("x")
    one = rows.agg(*[six(losses.aggregate_loss(F.col("values"), F.col("mask"), m)).alias(m) for m in losses.MODES])
    return one.select(each).select("x.*")


@register(f"""{TOKENS}, c AS (SELECT *, exp(greatest(-20, least(20, new - old))) AS ratio FROM t),
l AS (SELECT *, -adv * ratio AS l1, -adv * greatest(0.8, least(1.2, ratio)) AS l2 FROM c)
SELECT round(sum(mask * CASE WHEN adv < 0 THEN least(greatest(l1, l2), -adv * 3) ELSE greatest(l1, l2) END) / (sum(mask) + 1e-8), 6) AS loss,
  round(sum(mask * CASE WHEN l2 > l1 THEN 1 ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clip_fraction,
  round(sum(mask * CASE WHEN adv < 0 AND greatest(l1, l2) > -adv * 3 THEN 1 ELSE 0 END) / (sum(mask) + 1e-8), 6) AS clip_fraction_lower,
  round(sum(mask * (old - new)) / (sum(mask) + 1e-8), 6) AS kl FROM l""")
def ppo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.ppo(order_tokens(spark, sf_dir)).select(*[six(F.col(c)).alias(c) for c in ("loss", "clip_fraction", "clip_fraction_lower", "kl")])


@register(f"""{TOKENS}, q AS (SELECT uid, exp(least(10, sum((new - old) * mask) / greatest(sum(mask), 1))) AS ratio FROM t GROUP BY uid),
l AS (SELECT uid, sum(mask * greatest(-adv * ratio, -adv * greatest(1 - 0.0003, least(1 + 0.0004, ratio)))) / (sum(mask) + 1e-8) AS s FROM t JOIN q USING (uid) GROUP BY uid)
SELECT round(avg(s), 6) AS loss FROM l""")
def gspo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.gspo(order_tokens(spark, sf_dir)).select(six(F.col("loss")).alias("loss"))


@register(f"""{TOKENS} SELECT round(sum(mask * 0.5 * greatest(power(new - reward, 2), power(greatest(value - 0.05, least(value + 0.05, new)) - reward, 2))) / (sum(mask) + 1e-8), 6) AS loss FROM t""")
def value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).withColumns({"predicted": F.col("new"), "returns": F.col("rewards")})
    return losses.value_loss(rows, 0.05).select(six(F.col("loss")).alias("loss"))


@register(f"""{TOKENS} SELECT uid, round(sum(new - old), 6) AS k1, round(sum(abs(new - old)), 6) AS abs, round(sum(0.5 * (new - old) * (new - old)), 6) AS k2,
  round(sum(greatest(-10, least(10, exp(old - new) - (old - new) - 1))), 6) AS k3 FROM t GROUP BY uid""")
def kl_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    def each(kind: str) -> Column:
        return F.zip_with("new", "old", lambda a, b: losses.kl(a, b, kind))

    kinds = [six(arrays.total(each(k))).alias(k) for k in ("k1", "abs", "k2", "k3")]
    return order_tokens(spark, sf_dir).select("uid", *kinds)


@register(f"{TOKENS} SELECT uid, pos - 1 AS pos, round(least(exp(log_ratio), 1.02) * mask, 6) AS weight FROM t")
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = losses.correction_weights(order_tokens(spark, sf_dir), "token", 1.02).select("uid", F.posexplode("weights").alias("pos", "w"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), six(F.col("w")).alias("weight"))


@register(f"""{TOKENS}, q AS (SELECT uid, exp(sum(log_ratio * mask) / (sum(mask) + 1e-8)) AS ratio FROM t GROUP BY uid)
SELECT uid, pos - 1 AS pos, CASE WHEN ratio BETWEEN 1 / 1.0201 AND 1.0201 THEN mask ELSE 0.0::DOUBLE END AS kept FROM t JOIN q USING (uid)""")
def rejection_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = losses.rejection_mask(order_tokens(spark, sf_dir), "geometric", 1.0201).select("uid", F.posexplode("kept_mask").alias("pos", "kept"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), "kept")


@register(f"""{TOKENS}, w AS (SELECT exp(log_ratio) AS w FROM t) SELECT round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS std, round(min(w), 6) AS min, round(max(w), 6) AS max, round(avg(w) * avg(w) / avg(w * w), 6) AS ess FROM w""")
def weight_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").select(F.exp(F.col("l_discount") - F.col("l_tax")).alias("weight"))
    return losses.effective_share(w).select(*[six(F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "ess")])


@register(f"""{ROLLS}, k AS (SELECT uid, count(*) AS n_group, sum(graded)::BIGINT AS n_correct FROM r GROUP BY uid)
SELECT uid, sample, n_correct, CASE WHEN n_correct = n_group THEN 'easy' WHEN n_correct = 0 THEN 'unresolved' ELSE 'learnable' END AS bucket,
  CASE WHEN n_correct = n_group THEN 'concise' ELSE 'normal' END AS style, CASE WHEN n_correct = n_group THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS beta FROM r JOIN k USING (uid)""")
def group_success_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.group_success(rollouts(spark, sf_dir).withColumn("score", F.col("graded"))).select("uid", "sample", "n_correct", "bucket", "style", "beta")


@register(f"""{ROLLS}, k AS (SELECT *, (rank() OVER (ORDER BY logp) - 1 + (count(*) OVER (PARTITION BY logp) - 1) / 2.0) / (count(*) OVER () - 1) AS rk FROM r)
SELECT uid, sample, round(graded * rk, 6) AS easy, round((1 - graded) * (1 - rk), 6) AS hard, round(greatest(0.1, least(0.2, 0.2 - 0.1 * graded * rk)), 6) AS beta,
  CASE WHEN graded * rk > 0.7 THEN 'concise' WHEN (1 - graded) * (1 - rk) > 0.7 THEN 'budget' ELSE 'normal' END AS style FROM k""")
def two_signal_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.two_signal(rollouts(spark, sf_dir).withColumn("score", F.col("graded")))
    return routed.select("uid", "sample", *[six(F.col(c)).alias(c) for c in ("easy", "hard", "beta")], "style")


@register(f"""{ROLLS}, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN graded > 0.5 THEN 0 ELSE 1 END, CASE WHEN graded > 0.5 THEN length ELSE 0 END, logp DESC, sample) AS rk FROM r)
SELECT uid, sample, length, graded > 0.5 AS correct FROM k WHERE rk = 1""")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.select_candidates(rollouts(spark, sf_dir).withColumn("score", F.col("graded"))).select("uid", "sample", "length", "correct")


@register(f"{ROLLS} SELECT uid, sample, logp FROM r WHERE logp >= (SELECT quantile_cont(logp, 0.25) FROM r)")
def percentile_trajectory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.percentile_filter(rollouts(spark, sf_dir), "logp", 0.25).select("uid", "sample", "logp")


@register(f"{ROLLS} SELECT uid, sample, round(greatest(0, ln(length / (SELECT quantile_disc(length, 0.5) FROM r)::DOUBLE)), 6) AS penalty FROM r")
def length_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.length_penalty(rollouts(spark, sf_dir)).select("uid", "sample", six(F.col("penalty")).alias("penalty"))


@register(f"""{ROLLS}, b AS (SELECT uid, sample, length, greatest(1, round_even(0.8::DOUBLE * length / 8, 0)::BIGINT * 8) AS budget FROM r)
SELECT uid, sample, budget, least(round_even(0.9::DOUBLE * budget, 0)::BIGINT, length) AS supervised, least(-(length - 80) / 16.0, 0.0)::DOUBLE AS penalty FROM b""")
def length_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget, supervised = routing.length_budget(F.col("length"), 0.8, 0.9, 1, 8)
    return rollouts(spark, sf_dir).select("uid", "sample", budget.alias("budget"), supervised.alias("supervised"), routing.overlong_penalty(F.col("length"), 96, 16).alias("penalty"))


@register(f"""{ROLLS}, p AS (SELECT data_source, uid, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, max(score) AS best, min(score) AS worst FROM r GROUP BY ALL)
SELECT data_source, count(*) AS n_prompts, round(avg(mean), 6) AS mean_mean, round(avg(std), 6) AS std_mean, round(avg(best), 6) AS best_mean, round(avg(worst), 6) AS worst_mean FROM p GROUP BY ALL""")
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.source_metrics(rollouts(spark, sf_dir))
    return out.select("data_source", "n_prompts", *[six(F.col(f"{c}_mean")).alias(f"{c}_mean") for c in ("mean", "std", "best", "worst")])


@register(f"""{ROLLS}, k AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS n FROM r)
SELECT uid, round(sum(score * (power(i / n, 4) - power((i - 1) / n, 4))), 6) AS best, round(sum(score * (power((n - i + 1) / n, 4) - power((n - i) / n, 4))), 6) AS worst FROM k GROUP BY uid""")
def best_and_worst_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.expected_best(rollouts(spark, sf_dir), 4).select("uid", six(F.col("best")).alias("best"), six(F.col("worst")).alias("worst"))


@register(f"""{ROLLS}, v AS (SELECT uid, data_source AS vote, count(*) AS votes, min(sample) AS f, arg_min(score, sample) AS value FROM r GROUP BY ALL)
SELECT uid, vote, votes, value FROM v QUALIFY row_number() OVER (PARTITION BY uid ORDER BY votes DESC, f) = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.majority(rollouts(spark, sf_dir).withColumnRenamed("data_source", "vote"))


_PASS = "CASE WHEN n - c < {k} THEN 1.0::DOUBLE ELSE 1 - list_aggregate(list_prepend(1.0::DOUBLE, [1 - {k}.0::DOUBLE / i FOR i IN range(n - c + 1, n + 1)]), 'product') END"


@register(f"""{ROLLS}, p AS (SELECT uid, count(*) AS n, sum(graded)::BIGINT AS c FROM r GROUP BY uid HAVING count(*) >= 4)
SELECT round(avg({_PASS.format(k=1)}), 6) AS pass_at_1, round(avg({_PASS.format(k=2)}), 6) AS pass_at_2, round(avg({_PASS.format(k=4)}), 6) AS pass_at_4 FROM p""")
def unbiased_pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolls = rollouts(spark, sf_dir).withColumn("score", F.col("graded")).withColumn("__n", F.count("*").over(Window.partitionBy("uid"))).where("__n >= 4")
    return evaluation.pass_rates(rolls, [1, 2, 4]).select(*[six(F.col(f"pass_at_{k}")).alias(f"pass_at_{k}") for k in (1, 2, 4)])


@register(f"""{ROLLS}, p AS (SELECT uid, data_source, count(*) AS n, sum(graded)::BIGINT AS c FROM r GROUP BY ALL)
SELECT data_source, count(*) AS n_prompts, round(avg({_PASS.format(k=1)}), 6) AS pass_at_1 FROM p GROUP BY ROLLUP (data_source)""")
def pass_at_k_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.pass_rates_by(rollouts(spark, sf_dir).withColumn("score", F.col("graded")), "data_source", [1])
    return out.select("data_source", "n_prompts", six(F.col("pass_at_1")).alias("pass_at_1"))


@register("SELECT l_partkey, round(100 * stddev_pop(l_extendedprice) / avg(l_extendedprice), 6) AS cv FROM lineitem GROUP BY l_partkey")
def variation_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.variation(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice").select("l_partkey", six(F.col("cv")).alias("cv"))


@register("WITH c AS (SELECT p_type, count(*) AS c FROM part GROUP BY p_type) SELECT count(*) AS n_values, round(-sum(c / t * ln(c / t)), 6) AS entropy FROM c, (SELECT sum(c)::DOUBLE AS t FROM c)")
def label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.entropy(table(spark, sf_dir, "part"), "p_type")
    return out.select("n_values", six(F.col("entropy")).alias("entropy"))


@register("""WITH m AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'time/max' WHEN 1 THEN 'len/min' ELSE 'loss' END AS name, l_quantity AS value FROM lineitem)
SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY name""")
def reduce_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(F.when(third == 0, "time/max").when(third == 1, "len/min").otherwise("loss").alias("name"), F.col("l_quantity").alias("value"))
    return evaluation.reduce_by_name(rows).select("name", six(F.col("value")).alias("value"))


# ---- batch algebra over orders, numbered by key


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.number_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


ORDERS = "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_custkey, o_totalprice FROM orders)"


@register(f"{ORDERS} SELECT row_id, o_orderkey, o_custkey, o_totalprice FROM o")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("row_id", "o_orderkey", "o_custkey", "o_totalprice")


@register(f"{ORDERS} SELECT row_id, o_orderkey FROM o WHERE row_id >= 7 AND row_id < 900 AND (row_id - 7) % 3 = 0")
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.slice_rows(numbered(spark, sf_dir), 7, 900, 3).select("row_id", "o_orderkey")


@register(f"{ORDERS}, i AS (SELECT l_linenumber + 10 * l_orderkey AS row_id, (l_orderkey * 7) % (SELECT count(*) FROM orders) AS idx FROM lineitem) SELECT i.row_id, o.o_orderkey FROM i JOIN o ON o.row_id = i.idx")
def take_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") + 10 * F.col("l_orderkey")).alias("row_id"), (F.col("l_orderkey") * 7 % rows.count()).alias("index"))
    return batch.take(rows, wanted).select("row_id", "o_orderkey")


@register(f"{ORDERS} SELECT row_id * 3 + k AS row_id, o_orderkey FROM o, range(3) t(k)")
def repeat_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.repeat(numbered(spark, sf_dir), 3).select("row_id", "o_orderkey")


@register(f"{ORDERS} SELECT row_id + k * (SELECT count(*) FROM o) AS row_id, o_orderkey FROM o, range(2) t(k)")
def repeat_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.repeat(numbered(spark, sf_dir), 2, interleave=False).select("row_id", "o_orderkey")


@register(f"{ORDERS} SELECT row_id, k::INT AS copy FROM o, range(5) t(k) WHERE k < o_custkey % 4")
def repeat_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.repeat_each(numbered(spark, sf_dir), F.col("o_custkey") % 4).select("row_id", "copy")


@register(f"{ORDERS} SELECT row_id // 7 AS group_id, list(o_orderkey ORDER BY row_id)::VARCHAR AS keys FROM o GROUP BY ALL")
def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = batch.fold(numbered(spark, sf_dir), 7, ["o_orderkey"])
    return folded.select("group_id", F.concat(F.lit("["), F.array_join("o_orderkey", ", "), F.lit("]")).alias("keys"))


@register(f"{ORDERS}, n AS (SELECT count(*) AS n FROM o) SELECT row_id, o_orderkey, false AS is_pad FROM o UNION ALL SELECT n + row_id, o_orderkey, true FROM o, n WHERE row_id < (1024 - n % 1024) % 1024")
def pad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pad_to_divisor(numbered(spark, sf_dir), 1024).select("row_id", "o_orderkey", "is_pad")


@register(f"{ORDERS} SELECT row_id // 64 AS block, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY ALL")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.split(numbered(spark, sf_dir), 64).groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register(f"{ORDERS} SELECT row_id, o_orderkey, o_custkey, o_totalprice * 2 AS twice FROM o")
def positional_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    return batch.union_columns(rows.select("row_id", "o_orderkey", "o_custkey"), rows.select("row_id", "o_custkey", (F.col("o_totalprice") * 2).alias("twice")))


@register(f"{ORDERS}, b AS (SELECT row_id // 100 AS block, sum(o_custkey) AS s FROM o GROUP BY ALL) SELECT min(s)::BIGINT AS least, max(s)::BIGINT AS most, (max(s) - min(s))::BIGINT AS spread FROM b")
def block_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balancing.imbalance(numbered(spark, sf_dir), 100, "o_custkey")


# ---- curation and text


@register(f"""WITH d AS (SELECT doc_id, {WORDS} AS w, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS f FROM documents),
b AS (SELECT item_id, {WORDS} AS w, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS f FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+9], '|') FOR i IN range(1, len(w) - 8)]) AS g FROM d),
bg AS (SELECT unnest([array_to_string(w[i:i+9], '|') FOR i IN range(1, len(w) - 8)]) AS g, item_id FROM b),
h AS (SELECT doc_id, min(item_id) AS gram_item FROM dg JOIN bg USING (g) GROUP BY doc_id),
e AS (SELECT doc_id, min(item_id) AS exact_item FROM d JOIN b USING (f) GROUP BY doc_id)
SELECT doc_id, exact_item IS NOT NULL AS exact, least(gram_item, exact_item) AS first_item FROM h FULL JOIN e USING (doc_id)""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_each_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.first_of_each(table(spark, sf_dir, "documents").select("text", "doc_id"), ["text"], "doc_id")


@register("""SELECT coalesce(a.doc_id, e.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem
FROM (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) a FULL JOIN (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id) e ON a.doc_id = e.doc_id WHERE a.doc_id IS NULL OR e.doc_id IS NULL OR a.n > 1 OR e.n > 1""")
def key_coverage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.key_coverage(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), ["doc_id"])


@register("SELECT doc_id, (4 * (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // (SELECT count(*) FROM documents))::INT AS quartile FROM documents")
def length_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return curation.quartiles(docs, docs.count(), ["n_chars", "doc_id"]).select("doc_id", "quartile")


@register("""SELECT count(DISTINCT l) AS n_left, count(DISTINCT r) AS n_right, count(DISTINCT CASE WHEN l = r THEN l END) AS n_both, count(DISTINCT CASE WHEN l = r THEN l END) / count(DISTINCT coalesce(l, r)) AS jaccard
FROM (SELECT DISTINCT doc_id AS l FROM labels WHERE quality = 1) FULL JOIN (SELECT DISTINCT doc_id AS r FROM documents WHERE lang = 'en') ON l = r""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.overlap(table(spark, sf_dir, "labels").where("quality = 1"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@register("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL),
x AS (SELECT sum(s * (s - 1) / 2) AS a FROM (SELECT sum(c) AS s FROM c GROUP BY a)), y AS (SELECT sum(s * (s - 1) / 2) AS b FROM (SELECT sum(c) AS s FROM c GROUP BY b)), t AS (SELECT sum(c * (c - 1) / 2) AS t, sum(c) AS n FROM c)
SELECT round((t - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM x, y, t""")
def partition_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.rand_index(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(six(F.col("ari")).alias("ari"))


@register("""WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
p AS (SELECT a.vec_id, max(list_cosine_similarity(a.e, b.e)) AS best FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT round(avg(best), 6) AS coverage FROM p""")
def facility_coverage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return curation.coverage(v, v, others=True).select(six(F.col("coverage")).alias("coverage"))


@register("""SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) = 1""")
def latest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.keep_latest(table(spark, sf_dir, "conversations"), "conv_id", F.desc("turn"), F.asc("role")).select("conv_id", "turn", "role")


@register("""WITH f AS (SELECT *, role = 'user' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> 'user', true) AS s FROM conversations),
b AS (SELECT *, sum(s::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM f)
SELECT conv_id, block::BIGINT AS block, min(turn) AS first, max(turn) AS last, count(*) AS n FROM b WHERE role = 'user' GROUP BY ALL""")
def role_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.sessions_by_value(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "user")


@register("""WITH w AS (SELECT doc_id, string_split_regex(text, '\\s+') AS w FROM documents), g AS (SELECT doc_id, [w[i:i+3] FOR i IN range(1, len(w) - 2)] AS g FROM w)
SELECT doc_id, round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END, 6) AS repetition FROM g""")
def ngram_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", six(text.ngram_repetition(F.split("text", r"\s+"))).alias("repetition"))


# RE2 knows word borders of ASCII only, so the SQL cuts words from the rest and compares whole ones
@register(r"""WITH p AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[\p{L}\p{M}\p{Nd}]+|[^\p{L}\p{M}\p{Nd}]+') AS w FROM documents)
SELECT doc_id, trim(regexp_replace(array_to_string([CASE WHEN x IN ('a', 'an', 'the') THEN ' ' ELSE x END FOR x IN w], ''), '\s+', ' ', 'g')) AS words FROM p""")
def normalised_words_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise_words(F.col("text")).alias("words"))


# ---- events and the flagship plan


@register("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@register("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL '30 minutes', true) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(s::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@register(f"""{ROLLS}, k AS (SELECT uid, count(*) AS n, sum(graded) AS c, avg(graded) AS m, stddev_samp(graded) AS sd FROM r GROUP BY uid),
s AS (SELECT r.*, CASE WHEN c = n THEN 'easy' WHEN c = 0 THEN 'unresolved' ELSE 'learnable' END AS bucket, CASE WHEN n > 1 THEN (graded - m) / (sd + 1e-6) ELSE graded / (1 + 1e-6) END AS a, greatest(1, round_even(0.8::DOUBLE * length, 0)::BIGINT) AS budget FROM r JOIN k USING (uid))
SELECT bucket, count(*) AS n_rows, count(DISTINCT uid) AS n_groups, round(avg(length), 6) AS mean_length, sum(least(budget, length))::BIGINT AS supervised, round(avg(abs(a)), 6) AS mean_advantage FROM s GROUP BY bucket""")
def training_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.step_summary(plan.training_step(rollouts(spark, sf_dir)))
