"""Registered queries of rollout correction, policy losses and training metrics, each with its DuckDB SQL.

Decimal inputs make exact ties of the seventh place common, and two engines round such a tie by the
last bit; ``six`` and ``R`` therefore round a hair off the tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.functions import arrays
from rillmark.operators import correction, losses, metrics, policy, routing
from rillmark.plans.queries import ROLLS, TOKENS, register
from rillmark.plans.rollouts import order_tokens, rollouts

HAIR = 3.7e-10
HIGH = 1.05


def six(c: Column) -> Column:
    return F.round(c + F.lit(HAIR), 6)


def R(x: str) -> str:
    return f"round(({x}) + {HAIR}, 6)"


def rounded(df: DataFrame) -> DataFrame:
    """Every real column rounded off the tie."""
    return df.select(*[six(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def in_sql(names: dict[str, str]) -> str:
    return ", ".join(f"{R(x)} AS {n}" for n, x in names.items())


N = "(sum(mask) + 1e-8)"
MOMENTS = f"m AS (SELECT sum(value * mask) / {N} AS mu, sum(mask) AS n FROM t), v AS (SELECT sum(mask * (value - mu) * (value - mu)) / {N} * max(n) / (max(n) - 1) AS var FROM t, m)"


@register(f"{TOKENS}, {MOMENTS} SELECT {R('mu')} AS mean, {R('var')} AS var FROM m, v")
def masked_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correction.masked_moments(order_tokens(spark, sf_dir)))


def _flat(df: DataFrame, column: str, name: str) -> DataFrame:
    rows = df.select("uid", F.posexplode(column).alias("pos", "x"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), six(F.col("x")).alias(name))


@register(f"{TOKENS}, {MOMENTS} SELECT uid, pos - 1 AS pos, {R('(value - mu) / sqrt(var + 1e-8)')} AS white FROM t, m, v")
def masked_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(correction.whitened(order_tokens(spark, sf_dir)), "values", "white")


@register(f"{TOKENS}, {MOMENTS} SELECT uid, pos - 1 AS pos, {R('(value - mu) / sqrt(var + 1e-8) + mu')} AS white FROM t, m, v")
def masked_whitening_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(correction.whitened(order_tokens(spark, sf_dir), shift=False), "values", "white")


WEIGHTS = f"w AS (SELECT *, least(exp(log_ratio), {HIGH}) * mask AS w FROM t)"


def _weight_sql(level: str) -> str:
    mean_q = "sum(seq * 1.0)" if level != "geometric" else ""
    seq = "sum(log_ratio * mask)" + (f" / {N}" if level == "geometric" else "")
    own = f"s AS (SELECT uid, sum(mask) AS n, sum(w * mask) AS s, sum(mask * greatest(1 / {HIGH}, least({HIGH}, w))) AS c, sum(mask * power(greatest(1 / {HIGH}, least({HIGH}, w)), 2)) AS q, max(CASE WHEN mask <> 0 THEN w END) AS top, min(CASE WHEN mask <> 0 THEN w END) AS low, sum(mask * (w > {HIGH})::INT) AS above, sum(mask * (w < 1 / {HIGH})::INT) AS below, {seq} AS seq FROM w GROUP BY uid), x AS (SELECT *, s / (n + 1e-8) AS mine FROM s)"
    n = "(sum(n) + 1e-8)"
    token = level == "token"
    out = {
        "mean": f"sum(s) / {n}", "max": "max(top)" if token else "exp(least(max(seq), 20))", "min": "min(low)" if token else "exp(min(seq))",
        "share_high": f"sum(above) / {n}" if token else f"avg((seq > ln({HIGH}))::INT)", "share_low": f"sum(below) / {n}" if token else f"avg((seq < ln(1 / {HIGH}))::INT)",
        "std": f"sqrt(greatest(sum(q) / {n} - power(sum(c) / {n}, 2), 0))", "effective_share": f"1 / (sum(q) / {n} / power(sum(c) / {n} + 1e-8, 2))",
        "seq_mean": "avg(mine)", "seq_std": "stddev_samp(mine)", "seq_max": "max(mine)", "seq_min": "min(mine)", "seq_max_deviation": "max(abs(mine - 1))",
        "seq_share_high": f"avg((mine > {HIGH})::INT)", "seq_share_low": f"avg((mine < 1 / {HIGH})::INT)",
    }
    assert mean_q is not None
    return f"{TOKENS}, {WEIGHTS}, {own} SELECT {in_sql(out)} FROM x"


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.correction_weights(order_tokens(spark, sf_dir), "token", HIGH)


@register(_weight_sql("token"))
def importance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correction.weight_metrics(_weights(spark, sf_dir), "weights", "token", HIGH))


@register(_weight_sql("sequence"))
def importance_metrics_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correction.weight_metrics(_weights(spark, sf_dir), "weights", "sequence", HIGH))


@register(_weight_sql("geometric"))
def rejection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correction.weight_metrics(_weights(spark, sf_dir), "weights", "geometric", HIGH))


VETO = "q AS (SELECT *, max((log_ratio < ln(0.95) AND mask <> 0)::INT) OVER (PARTITION BY uid) AS veto FROM t)"


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.corrected(order_tokens(spark, sf_dir), "token", HIGH, "token", HIGH, None, 0.95)


@register(f"""{TOKENS}, {VETO} SELECT uid, pos - 1 AS pos, {R(f'least(exp(log_ratio), {HIGH}) * mask')} AS weight,
CASE WHEN veto = 0 AND exp(log_ratio) BETWEEN 1 / {HIGH} AND {HIGH} THEN mask ELSE 0.0::DOUBLE END AS kept FROM q""")
def correction_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corrected(spark, sf_dir).select("uid", F.posexplode(F.arrays_zip("weights", "kept_mask")).alias("pos", "z"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), six(F.col("z.weights")).alias("weight"), F.col("z.kept_mask").alias("kept"))


@register(f"""{TOKENS}, {VETO}, g AS (SELECT uid, max(veto) AS v FROM q GROUP BY uid)
SELECT {R('(SELECT avg(v) FROM g)')} AS veto_share, {R(f'sum(((log_ratio < ln(0.95)) AND mask <> 0)::INT) / {N}')} AS catastrophic_share FROM q""")
def veto_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correction.veto_metrics(_corrected(spark, sf_dir)))


_SEQ = f"s AS (SELECT uid, sum(mask) AS n, sum(new * mask) / {N} AS a, sum(old * mask) / {N} AS b, sum(mask * (exp(new - old) - (new - old) - 1)) AS k3, sum(mask * exp(2 * (new - old))) AS rho, sum(mask * (new - old)) AS d FROM t GROUP BY uid)"
_OFF = {
    "training_ppl": "avg(exp(-a))", "training_log_ppl": "avg(-a)", "kl": "-sum(d) / (sum(n) + 1e-8)", "k3_kl": "sum(k3) / (sum(n) + 1e-8)", "rollout_ppl": "avg(exp(-b))", "rollout_log_ppl": "avg(-b)",
    "log_ppl_diff": "avg(b - a)", "log_ppl_abs_diff": "avg(abs(b - a))", "log_ppl_diff_max": "max(b - a)", "log_ppl_diff_min": "min(b - a)", "ppl_ratio": "avg(exp(b - a))", "chi2_token": "sum(rho) / (sum(n) + 1e-8) - 1", "chi2_seq": "avg(exp(2 * d)) - 1",
}


@register(f"{TOKENS}, {_SEQ} SELECT {in_sql(_OFF)} FROM s")
def off_policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correction.off_policy_metrics(order_tokens(spark, sf_dir), "new", "old"))


@register(f"{TOKENS} SELECT uid, pos - 1 AS pos, {R('new')} AS old FROM t")
def bypass_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(correction.bypassed(order_tokens(spark, sf_dir), "old", "new"), "old", "old")


# ---- losses

COV = "k AS (SELECT * FROM t WHERE mask <> 0), c AS (SELECT *, (adv - (SELECT sum(adv * mask) / (sum(mask) + {e}) FROM k)) * (new - (SELECT sum(new * mask) / (sum(mask) + {e}) FROM k)) AS cov FROM k)"


@register(f"""{TOKENS}, {COV.format(e=0)}, r AS (SELECT *, row_number() OVER (ORDER BY cov DESC, uid, pos) AS rk, greatest(1, floor(count(*) OVER () * 0.01)) AS top FROM c)
SELECT {R(f'sum(mask * (-adv * exp(new - old) + CASE WHEN rk <= top THEN abs(new - old) ELSE 0 END)) / {N}')} AS loss, {R(f'sum(mask * abs(new - old)) / {N}')} AS kl FROM r""")
def kl_cov_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.kl_cov(order_tokens(spark, sf_dir), 0.01))


_DRAW = "('0x' || substr(md5(uid || ':' || (pos - 1)), 1, 12))::BIGINT"


@register(f"""{TOKENS}, {COV.format(e=1e-8)}, l AS (SELECT *, -adv * exp(new - old) AS a, -adv * greatest(0.97, least(1.03, exp(new - old))) AS b FROM c),
o AS (SELECT *, (cov > 0.1 AND cov < 0.5 AND NOT b > a) AS open FROM l), r AS (SELECT *, CASE WHEN open THEN row_number() OVER (PARTITION BY open ORDER BY {_DRAW} DESC, uid, pos) END AS rk, greatest(floor(0.01 * sum(mask) OVER ()), 1) AS top FROM o)
SELECT {R(f'sum(mask * CASE WHEN rk <= top THEN 0 ELSE greatest(a, b) END) / {N}')} AS loss, {R(f'sum(mask * CASE WHEN rk <= top THEN 1 ELSE 0 END) / {N}')} AS clip_fraction, {R(f'sum(mask * (old - new)) / {N}')} AS kl FROM r""")
def clip_cov_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.clip_cov(order_tokens(spark, sf_dir), 0.01, 0.1, 0.5, 0.03, 0.03))


@register(f"""{TOKENS}, d AS (SELECT *, new - old AS d, sign(adv) AS g FROM t),
s AS (SELECT uid, sum(mask) AS n, -sum(adv * mask) / {N} * exp(sum(mask * g * least(g * d, g * greatest(-0.03, least(0.03, d)))) / {N}) AS l, sum(mask * ((d < -0.03 OR d > 0.03) AND adv > 0)::INT) AS up, sum(mask * ((d < -0.03 OR d > 0.03) AND adv < 0)::INT) AS down, sum(mask * d) AS d FROM d GROUP BY uid)
SELECT {R('avg(l)')} AS loss, {R('sum(up) / (sum(n) + 1e-8)')} AS clip_fraction, {R('sum(down) / (sum(n) + 1e-8)')} AS clip_fraction_lower, {R('-sum(d) / (sum(n) + 1e-8)')} AS kl FROM s""")
def geometric_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.geometric_mean(order_tokens(spark, sf_dir), 0.03, 0.03))


@register(f"{TOKENS} SELECT {R(f'sum(-new * adv * mask) / {N}')} AS loss FROM t")
def gpg_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir)
    each = F.transform(F.arrays_zip("new", "old", "advantages"), lambda z: losses.plain(z["new"], z["old"], z["advantages"]))
    return rounded(rows.agg(losses.aggregate_loss(each, F.col("mask")).alias("loss")))


@register(f"{TOKENS}, s AS (SELECT uid, sum(mask * (new - old)) AS d, sum(reward) AS r FROM t GROUP BY uid) SELECT {R('avg(power(d - 0.5 * r, 2))')} AS loss FROM s")
def sppo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.squared_residual(order_tokens(spark, sf_dir), arrays.total(F.col("rewards")), 0.5))


@register(f"{TOKENS} SELECT {R(f'sum(value * mask) / {N}')} AS loss FROM t")
def entropy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.entropy_loss(order_tokens(spark, sf_dir), "values"))


@register(f"{TOKENS}, w AS (SELECT uid, (uid % 3)::DOUBLE AS w FROM t GROUP BY uid) SELECT {R(f'CASE WHEN max(w) > 0 THEN -sum(value * w * mask) / {N} ELSE 0 END')} AS loss FROM t JOIN w USING (uid)")
def difficulty_entropy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.entropy_loss(order_tokens(spark, sf_dir), "values", (F.col("uid") % 3).cast("double")))


@register(f"{TOKENS}, {VETO}, k AS (SELECT *, CASE WHEN veto = 0 AND exp(log_ratio) BETWEEN 1 / {HIGH} AND {HIGH} THEN mask ELSE 0 END AS keep FROM q) SELECT {R(f'sum(-new * adv * least(exp(log_ratio), {HIGH}) * mask * keep) / (sum(keep) + 1e-8)')} AS loss FROM k")
def corrected_reinforce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.weighted_reinforce(_corrected(spark, sf_dir)))


@register(f"""{TOKENS}, h AS (SELECT uid, mask, value, reward, new, log_ratio, -sqrt(adv + 26) / 10 AS old FROM t), s AS (SELECT uid, sum(old * mask) / greatest(sum(mask), 1) AS tl FROM h GROUP BY uid), q AS (SELECT quantile_cont(tl, 0.1) AS least FROM s),
x AS (SELECT greatest(max(value) FILTER (mask <> 0), 1e-6) AS tm, greatest(max(reward) FILTER (mask <> 0), 1e-6) AS sm FROM h),
w AS (SELECT h.*, tl >= least AS keep, least, (1 + greatest(0, least(1, 1 - value / tm))) * (1 + greatest(0, least(1, reward / sm))) AS w FROM h JOIN s USING (uid), q, x),
n AS (SELECT *, w / (SELECT greatest(sum(w * mask) / greatest(sum(mask), 1), 1e-6) FROM w) AS nw, mask * keep::INT AS em FROM w),
l AS (SELECT *, -nw * (old - new) * exp(log_ratio - new) AS a, -nw * (old - new) * greatest(0.8, least(1.2, exp(log_ratio - new))) AS b FROM n)
SELECT {R('sum(em * greatest(a, b)) / (sum(em) + 1e-8)')} AS loss, {R('(SELECT avg((tl >= least)::INT) FROM s, q)')} AS kept_share, {R('max(least)')} AS threshold, {R('sum(nw * em) / sum(em)')} AS weight_mean,
{R('sum(em * (new - log_ratio)) / (sum(em) + 1e-8)')} AS kl, {R('sum(em * (b > a)::INT) / (sum(em) + 1e-8)')} AS clip_fraction FROM l""")
def entropy_aware_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", "mask", F.col("log_ratio").alias("new"), F.col("new").alias("old"), F.transform("advantages", lambda a: -F.sqrt(a + 26) / 10).alias("teacher"), F.col("rewards").alias("student_entropy"), F.col("values").alias("teacher_entropy"))
    return rounded(policy.distillation(rows))


@register(f"{TOKENS} SELECT uid, pos - 1 AS pos, {R('reward - 0.2 * (new - old)')} AS reward FROM t")
def kl_penalised_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir)
    kl = F.zip_with("new", "old", lambda a, b: losses.kl(a, b, "k1"))
    return _flat(rows.withColumn("r", policy.penalised(F.col("rewards"), kl, 0.2)), "r", "reward")


@register(f"{TOKENS}, s AS (SELECT uid, sum(mask * greatest(-10, least(10, exp(old - new) - (old - new) - 1))) / {N} AS k FROM t GROUP BY uid) SELECT {R('avg(k)')} AS kl FROM s")
def batch_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).withColumn("divergence", F.zip_with("new", "old", lambda a, b: losses.kl(a, b, "low_var_kl+")))
    return rounded(policy.divergence_of(rows))


@register(f"""{TOKENS}, c AS (SELECT *, exp(new - old) AS ratio FROM t), k AS (SELECT *, CASE WHEN (adv > 0 AND ratio > 1.03) OR (adv < 0 AND ratio < 0.98) THEN 0 ELSE mask END AS keep FROM c),
s AS (SELECT uid, 0.1 + sum(new * keep) / (sum(keep) + 1e-8) - 0.5 * sum(adv * keep) / (sum(keep) + 1e-8) - sum(value * keep) / (sum(keep) + 1e-8) AS delta, greatest(0.98, least(1.03, exp(sum((new - old) * keep)))) AS w, sum(mask) AS n, sum(keep) AS k, sum((new - old) * mask) AS d FROM k GROUP BY uid)
SELECT {in_sql({'loss': 'avg(w * delta * delta)', 'dropped_share': '(sum(n) - sum(k)) / (sum(n) + 1e-8)', 'weight': 'avg(w)', 'kl': '-sum(d) / (sum(n) + 1e-8)'})} FROM s""")
def flow_balance_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).withColumns({"teacher": F.col("values"), "token_reward": F.col("advantages")})
    return rounded(policy.flow_balance(rows, F.lit(0.1), 0.5, 0.02, 0.03))


# ---- metrics


@register(f"""{TOKENS}, s AS (SELECT uid, sum(mask) AS n, sum(reward) AS score, sum(value) AS rew FROM t GROUP BY uid), f AS (SELECT * FROM s WHERE n > 0), k AS (SELECT * FROM t WHERE mask <> 0)
SELECT {in_sql({'score_mean': '(SELECT avg(score) FROM f)', 'score_max': '(SELECT max(score) FROM f)', 'score_min': '(SELECT min(score) FROM f)', 'reward_mean': '(SELECT avg(rew) FROM f)', 'reward_max': '(SELECT max(rew) FROM f)', 'reward_min': '(SELECT min(rew) FROM f)',
'advantages_mean': '(SELECT avg(adv) FROM k)', 'advantages_max': '(SELECT max(adv) FROM k)', 'advantages_min': '(SELECT min(adv) FROM k)', 'returns_mean': '(SELECT avg(reward) FROM k)', 'returns_max': '(SELECT max(reward) FROM k)', 'returns_min': '(SELECT min(reward) FROM k)',
'values_mean': '(SELECT avg(value) FROM k)', 'values_max': '(SELECT max(value) FROM k)', 'values_min': '(SELECT min(value) FROM k)', 'explained_variance': '(SELECT 1 - var_samp(reward - value) / (var_samp(reward) + 1e-5) FROM k)',
'length_mean': 'avg(n)', 'length_max': 'max(n)', 'length_min': 'min(n)', 'clip_share': 'avg((n = 7)::INT)', 'clip_share_not_aborted': '(SELECT avg((n = 7)::INT) FROM f)', 'length_not_aborted_mean': '(SELECT avg(n) FROM f)', 'aborted_share': 'avg((n = 0)::INT)'})} FROM s""")
def data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", "mask", "values", "advantages", F.col("rewards").alias("returns"), F.col("rewards").alias("scores"), F.col("values").alias("rewards"))
    return rounded(metrics.data_metrics(rows, 7))


@register(f"{TOKENS} SELECT uid, sum(mask) AS response_length, count(*)::DOUBLE AS prompt_length FROM t GROUP BY uid")
def response_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).withColumn("all", F.transform("mask", lambda _: F.lit(1)))
    return metrics.lengths(rows, "mask", "all").select("uid", "response_length", "prompt_length")


@register(f"""{ROLLS}, n AS (SELECT sum(length) AS r, sum(sample) AS p FROM r), x AS (SELECT * FROM (VALUES ('gen', 12.5), ('ref', 3.25), ('adv', 0.5), ('step', 20.0)) v(section, seconds))
SELECT section, seconds::DOUBLE AS seconds, round(CASE section WHEN 'gen' THEN seconds * 1000 / r WHEN 'step' THEN NULL ELSE seconds * 1000 / (r + p) END, 9)::DOUBLE AS per_token_ms FROM x, n""")
def timing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rollouts(spark, sf_dir).agg(F.sum("length").alias("response_tokens"), F.sum("sample").alias("prompt_tokens"))
    times = spark.createDataFrame([("gen", 12.5), ("ref", 3.25), ("adv", 0.5), ("step", 20.0)], "section string, seconds double")
    return metrics.timing_metrics(times, totals).withColumn("per_token_ms", F.round("per_token_ms", 9))


@register(f"{ROLLS} SELECT sum(length)::BIGINT AS total_tokens, 20.0::DOUBLE AS seconds, {R('sum(length) / (20.0 * 8)')} AS throughput FROM r")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.throughput(rollouts(spark, sf_dir), 20.0, 8)).withColumn("seconds", F.lit(20.0))


@register(f"{TOKENS}, d AS (SELECT exp(new) AS a, exp(old) AS b FROM t WHERE mask <> 0) SELECT {R('max(abs(a - b))')} AS diff_max, {R('avg(abs(a - b))')} AS diff_mean, {R('stddev_samp(abs(a - b))')} AS diff_std, {R('corr(a, b)')} AS correlation FROM d")
def probability_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.probability_differences(order_tokens(spark, sf_dir)))


@register(f"{TOKENS} SELECT uid, sum((reward <> value AND mask <> 0)::INT)::INT AS differing FROM t GROUP BY uid")
def differing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tokens(spark, sf_dir).select("uid", metrics.differing_tokens(F.col("rewards"), F.col("values"), F.col("mask")).alias("differing"))


@register(f"""{TOKENS}, g AS (SELECT *, uid // 32 AS gid FROM t), m AS (SELECT gid, uid, sum(reward * mask) / sum(mask) AS mean FROM g GROUP BY ALL HAVING sum(mask) > 0),
b AS (SELECT gid, count(*) AS n, sum(mean) AS base FROM m GROUP BY gid HAVING count(*) > 1)
SELECT g.uid, pos - 1 AS pos, {R('CASE WHEN mask <> 0 THEN reward * (n::DOUBLE / (n - 1)) - base / (n - 1) ELSE 0 END')} AS rloo FROM g JOIN m USING (uid) JOIN b ON b.gid = g.gid""")
def dense_reward_rloo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).where(correction.tokens(F.col("mask")) > 0).withColumn("gid", F.floor(F.col("uid") / 32))
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("gid"))).where("__n > 1").drop("__n")
    return _flat(metrics.dense_rloo(rows, "gid"), "rloo", "rloo")


PAIRS = f"{ROLLS}, a AS (SELECT uid, sample, score - 25 AS score, graded AS acc FROM r)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select("uid", "sample", (F.col("score") - 25).alias("score"), F.col("graded").alias("acc"))


@register(f"""{PAIRS}, pr AS (SELECT x.uid, sum(((x.score > y.score) = (x.acc > y.acc))::INT * abs(x.acc - y.acc)) AS r, sum(abs(x.acc - y.acc)) AS w FROM a x JOIN a y ON x.uid = y.uid AND x.sample < y.sample GROUP BY x.uid)
SELECT {R('avg(CASE WHEN w = 0 THEN 0.5 ELSE r / w END)')} AS accuracy FROM pr""")
def preference_pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pair_accuracy(_scored(spark, sf_dir)))


@register(f"{PAIRS} SELECT {R('avg((sign(score) = sign(acc * 2 - 1))::INT)')} AS accuracy FROM a")
def preference_sign_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.sign_accuracy(_scored(spark, sf_dir)))


@register(f"{PAIRS}, p AS (SELECT acc, 1 / (1 + exp(-0.05 * score)) AS p FROM a) SELECT {R('avg(-(acc * ln(p) + (1 - acc) * ln(1 - p)))')} AS loss FROM p")
def reward_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cross_entropy(_scored(spark, sf_dir), 0.05))


_DETACHED = f"{PAIRS}, w AS (SELECT *, count(*) OVER g AS n, cume_dist() OVER (PARTITION BY uid ORDER BY score) AS c, 0.05 * coalesce(CASE WHEN acc > 0 THEN avg(CASE WHEN acc <= 0 THEN score END) OVER g ELSE avg(CASE WHEN acc > 0 THEN score END) OVER g END, 0) AS o FROM a WINDOW g AS (PARTITION BY uid)), l AS (SELECT *, ln(1 + exp(-(0.05 * score - o) * CASE WHEN acc > 0 THEN 1 ELSE -1 END)) AS l FROM w)"


@register(f"{_DETACHED} SELECT {R('avg(l)')} AS loss FROM l")
def detached_preference_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.detached_preference(_scored(spark, sf_dir), 0.05))


@register(f"{_DETACHED} SELECT round(sum(l * n * power(c, n - 1)), 3) AS loss FROM l")
def detached_preference_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detached_preference(_scored(spark, sf_dir), 0.05, best_of="score").select(F.round("loss", 3).alias("loss"))


@register(f"{PAIRS} SELECT uid, arg_min(sample, (-score, sample)) AS chosen, arg_min(sample, (score, -sample)) AS rejected FROM a GROUP BY uid HAVING count(*) > 1")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.preferred(_scored(spark, sf_dir))


@register(f"{PAIRS}, p AS (SELECT uid, max(score) AS c, min(score) AS j, max(acc) AS rc, min(acc) AS rr FROM a GROUP BY uid) SELECT {R('avg(ln(1 + exp(-0.1 * ((c - j) - (rc - rr)))))')} AS sigmoid, {R('avg(power((c - j) - (rc - rr) - 1 / 0.2, 2))')} AS ipo FROM p")
def preference_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _scored(spark, sf_dir).groupBy("uid").agg(F.max("score").alias("c"), F.min("score").alias("j"), F.max("acc").alias("rc"), F.min("acc").alias("rr"))
    four = [F.col(x) for x in ("c", "j", "rc", "rr")]
    return rounded(p.agg(F.avg(losses.preference(*four, 0.1)).alias("sigmoid"), F.avg(losses.preference(*four, 0.1, kind="ipo")).alias("ipo")))


@register(f"""{ROLLS}, k AS (SELECT uid, count(*) AS n, sum(graded)::BIGINT AS n_correct FROM r GROUP BY uid), b AS (SELECT *, CASE WHEN n_correct = n THEN 'easy' WHEN n_correct = 0 THEN 'unresolved' ELSE 'learnable' END AS bucket FROM k)
SELECT bucket, n_correct, {R('count(*) / (SELECT count(*) FROM r)')} AS row_share, {R('avg(length)')} AS mean_length, count(DISTINCT uid) AS groups FROM r JOIN b USING (uid) GROUP BY bucket, n_correct""")
def group_success_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.group_success(rollouts(spark, sf_dir).withColumn("score", F.col("graded")))
    return rounded(metrics.routing_summary(routed))


_SIGNALS = f"""{ROLLS}, k AS (SELECT *, (rank() OVER (ORDER BY logp) - 1 + (count(*) OVER (PARTITION BY logp) - 1) / 2.0) / (count(*) OVER () - 1) AS rk FROM r),
s AS (SELECT *, graded * rk AS easy, (1 - graded) * (1 - rk) AS hard, greatest(0.1, least(0.2, 0.2 - 0.1 * graded * rk)) AS beta, CASE WHEN graded * rk > 0.7 THEN 'concise' WHEN (1 - graded) * (1 - rk) > 0.7 THEN 'budget' ELSE 'normal' END AS style FROM k)"""


@register(f"""{_SIGNALS} SELECT {in_sql({'easy_mean': 'avg(easy)', 'hard_mean': 'avg(hard)', 'beta_mean': 'avg(beta)', 'concise_share': "avg((style = 'concise')::INT)", 'budget_share': "avg((style = 'budget')::INT)", 'normal_share': "avg((style = 'normal')::INT)",
'beta_right': 'coalesce(avg(beta) FILTER (graded > 0.5), 0)', 'beta_wrong': 'coalesce(avg(beta) FILTER (graded <= 0.5), 0)', 'concise_length': "coalesce(avg(length) FILTER (style = 'concise'), 0)", 'budget_length': "coalesce(avg(length) FILTER (style = 'budget'), 0)"})} FROM s""")
def two_signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.signal_summary(routing.two_signal(rollouts(spark, sf_dir).withColumn("score", F.col("graded")))))


@register(f"""{ROLLS}, p AS (SELECT *, greatest(0, ln(length / (SELECT quantile_disc(length, 0.5) FROM r)::DOUBLE)) AS p, (graded <= 0.5)::INT AS g FROM r)
SELECT {in_sql({'penalty_mean': 'avg(p)', 'penalty_max': 'max(p)', 'gate_share': 'avg(g)', 'gated_mean': 'coalesce(sum(p * g) / sum(g), 0)', 'applied_mean': '0.1 * avg(p * g)'})} FROM p""")
def length_penalty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.penalty_summary(routing.length_penalty(rollouts(spark, sf_dir)), F.col("graded") <= 0.5, 0.1))


@register(f"{ROLLS}, m AS (SELECT data_source, avg(score) AS score, avg(graded) AS graded FROM r GROUP BY data_source) SELECT count(*) AS groups, {R('avg(score)')} AS score, {R('avg(graded)')} AS graded FROM m")
def suite_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.macro_average(rollouts(spark, sf_dir), "data_source", "score", "graded"))


@register(f"{ROLLS} SELECT data_source, count(*) AS n, {R('avg(graded)')} AS accuracy, {R('avg(length)')} AS mean_length, {R('avg((length >= 90)::INT)')} AS truncated_share, {R('avg(length) FILTER (graded > 0.5)')} AS right_length, {R('avg(length) FILTER (graded <= 0.5)')} AS wrong_length FROM r GROUP BY data_source")
def run_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.length_summary(rollouts(spark, sf_dir), "data_source", "length", 90, F.col("graded") > 0.5))


@register(f"""{ROLLS}, b AS (SELECT length, CASE WHEN sample % 4 <> 0 THEN greatest(1, round_even(0.8::DOUBLE * length / 8, 0)::BIGINT * 8) END AS b FROM r)
SELECT count(b) AS n, sum((b IS NULL)::INT)::BIGINT AS without, {R('avg(b)')} AS budget_mean, min(b) AS budget_min, max(b) AS budget_max, {R('avg((length > b)::INT)')} AS over_share, {R('avg(length / b)')} AS ratio_mean FROM b""")
def budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget, _ = routing.length_budget(F.col("length"), 0.8, 0.9, 1, 8)
    return rounded(metrics.budget_summary(rollouts(spark, sf_dir).withColumn("budget", F.when(F.col("sample") % 4 != 0, budget))))


@register("""WITH v AS (SELECT DISTINCT l_returnflag AS data_source, CASE l_linenumber % 2 WHEN 0 THEN 'acc' ELSE 'reward' END AS variable, CASE l_linenumber % 3 WHEN 0 THEN 'mean@' WHEN 1 THEN 'best@' ELSE 'std@' END || (1 << (l_linenumber % 4)::INT) AS metric FROM lineitem),
m AS (SELECT *, regexp_extract(metric, '@(\\d+)', 1)::INT AS n, max((variable = 'acc')::INT) OVER (PARTITION BY data_source) AS acc, max(regexp_extract(metric, '@(\\d+)', 1)::INT) OVER (PARTITION BY data_source, variable) AS most FROM v)
SELECT data_source, variable, metric, CASE WHEN variable = CASE WHEN acc = 1 THEN 'acc' ELSE 'reward' END AND regexp_matches(metric, '^(mean|maj|best)') AND n = most THEN 'val-core/' ELSE 'val-aux/' END || data_source || '/' || variable || '/' || metric AS name FROM m""")
def validation_metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    kind = F.when(line % 3 == 0, "mean@").when(line % 3 == 1, "best@").otherwise("std@")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("data_source"), F.when(line % 2 == 0, "acc").otherwise("reward").alias("variable"), F.concat(kind, F.pow(F.lit(2.0), line % 4).cast("int").cast("string")).alias("metric"))
    return metrics.metric_names(rows.distinct())
