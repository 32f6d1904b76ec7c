"""Registered queries of dataset-side operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import text as t
from rillmark.operators import correction, datasets, metrics
from rillmark.plans.queries import ROLLS, TOKENS, numbered, register
from rillmark.plans.rollout_queries import R, rounded, six
from rillmark.plans.rollouts import order_tokens, rollouts, table

WORDS = "len([w FOR w IN string_split_regex(text, '\\s+') IF w <> ''])"


@register(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {WORDS} <= 400")
def overlong_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.within_length(table(spark, sf_dir, "documents"), datasets.word_count(F.col("text")), 400).select("doc_id")


@register(f"SELECT doc_id, coalesce({WORDS}, -1)::INT AS tokens, CASE WHEN text IS NULL THEN 'unreadable' ELSE 'too long' END AS reason FROM documents WHERE text IS NULL OR {WORDS} > 2000")
def context_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.eligibility(table(spark, sf_dir, "documents"), datasets.word_count(F.col("text")), 2000, "doc_id")


@register(f"SELECT doc_id, n_chars FROM documents WHERE NOT (text IS NULL OR {WORDS} > 2000)")
def eligible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    report = datasets.eligibility(docs, datasets.word_count(F.col("text")), 2000, "doc_id")
    return datasets.without(docs, report, "doc_id").select("doc_id", "n_chars")


@register("SELECT user_id, event_type, ts FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events) AND ts <= (SELECT date_trunc('day', max(ts)) FROM events) AND event_type = 'click'")
def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    first, last = events.agg(F.date_add(F.to_date(F.min("ts")), 1).cast("string"), F.to_date(F.max("ts")).cast("string")).first()
    return datasets.dated(events, F.col("ts"), first, last, F.col("event_type"), "click").select("user_id", "event_type", "ts")


@register(f"{ROLLS} SELECT uid, sample, CASE data_source WHEN 'A' THEN logp WHEN 'N' THEN -score ELSE 0.5::DOUBLE END AS teacher FROM r")
def teacher_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select("uid", "sample", datasets.by_teacher(F.col("data_source"), A=F.col("logp"), N=-F.col("score"), other=F.lit(0.5)).alias("teacher"))


@register(f"{TOKENS} SELECT uid, pos - 1 AS pos, mask * (uid % 2) AS mask FROM t")
def row_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).withColumn("m", F.transform("mask", lambda m: m * (F.col("uid") % 2)))
    return rows.select("uid", F.posexplode("m").alias("pos", "mask")).select("uid", F.col("pos").cast("long").alias("pos"), "mask")


@register(f"SELECT l_partkey, count(*) AS n, {R('avg(l_extendedprice)')} AS mean, {R('100 * stddev_pop(l_extendedprice) / avg(l_extendedprice)')} AS cv FROM lineitem GROUP BY l_partkey HAVING count(*) >= 10 AND avg(l_extendedprice) >= 20000 AND 100 * stddev_pop(l_extendedprice) / avg(l_extendedprice) <= 60")
def profiled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(datasets.profiled_tasks(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice", 10, 20000, 60))


@register("SELECT conv_id, turn FROM conversations WHERE contains(text, 'the') ORDER BY turn DESC, conv_id OFFSET 5 LIMIT 30")
def viewed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.viewed(table(spark, sf_dir, "conversations"), F.col("turn").cast("double"), F.col("text"), "the", 5, 30, key="conv_id")
    return rows.select("conv_id", "turn")


@register("SELECT conv_id, turn, regexp_replace(text, '(the)', '**\\1**', 'gi') AS text FROM conversations")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", datasets.masked_text(F.col("text"), "the").alias("text"))


_DRAWN = "('0x' || substr(md5({}::VARCHAR), 1, 12))::BIGINT"


@register(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_DRAWN.format('doc_id')} DESC, doc_id) <= (SELECT count(*) - floor(count(*) * 0.1) FROM documents) THEN 'train' ELSE 'validation' END AS part FROM documents")
def train_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


ORDERS = "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_custkey, o_totalprice FROM orders)"


@register(f"""{ORDERS} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN o_custkey % 100 WHEN row_id % 3 = 1 THEN o_custkey ELSE 64 END::BIGINT AS budget, CASE row_id % 3 WHEN 0 THEN 'record' WHEN 1 THEN 'text' ELSE 'fallback' END AS budget_source FROM o""")
def budget_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir).select("row_id", F.when(F.col("row_id") % 3 == 1, F.concat(F.lit("use [["), F.col("o_custkey").cast("string"), F.lit("]]"))).otherwise("none").alias("prompt"))
    records = numbered(spark, sf_dir).where("row_id % 3 = 0").select("row_id", (F.col("o_custkey") % 100).cast("long").alias("budget"))
    return datasets.with_budgets(rows, records, "row_id", t.parse_budget(F.col("prompt")), 64).select("row_id", F.col("budget").cast("long").alias("budget"), "budget_source")


@register(f"{ORDERS} SELECT row_id, o_orderkey, o_custkey, o_totalprice FROM o WHERE o_custkey % 5 = 1")
def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    return datasets.staged_rows(rows.where("o_custkey % 5 = 1").select("row_id", "o_orderkey", "o_custkey"), rows.select("row_id", "o_orderkey", "o_totalprice"), "row_id", "o_orderkey").select("row_id", "o_orderkey", "o_custkey", "o_totalprice")


@register(f"{ORDERS}, n AS (SELECT count(*) AS n FROM o) SELECT row_id, CASE WHEN row_id < n // 2 THEN 'first' WHEN row_id < n - 100 THEN 'second' WHEN row_id < n - 10 THEN 'third' END AS stage FROM o, n")
def stage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    n = rows.count()
    return rows.select("row_id", datasets.stage_of(F.col("row_id"), {"first": n // 2, "second": n - 100, "third": n - 10}).alias("stage"))


@register(f"""WITH d AS (SELECT doc_id, lang, {_DRAWN.format('doc_id')} AS h FROM documents), k AS (SELECT * FROM d WHERE lang = 'en' ORDER BY h, doc_id LIMIT 50)
SELECT doc_id, (SELECT count(*) FROM d WHERE lang <> 'en' AND h <= (SELECT max(h) FROM k)) AS rejected FROM k""")
def clean_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.clean_scan(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", F.col("lang") == "en", 50).select("doc_id", "rejected")


@register("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN a < 1 OR b > 4 THEN 'out of range' WHEN d < n THEN 'repeated' ELSE 'missing' END AS problem FROM g WHERE a < 1 OR b > 4 OR d < n OR d < 4""")
def capture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.complete_keys(table(spark, sf_dir, "lineitem").withColumn("slot", F.col("l_linenumber") - 1), "l_orderkey", "slot", 4)


@register(f"SELECT vec_id, {R('embedding[1]::DOUBLE')} AS first, len(embedding)::INT AS n FROM embeddings")
def vector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    out = datasets.vectors_of(v.select("vec_id"), v.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return out.select("vec_id", six(F.get("vector", F.lit(0)).cast("double")).alias("first"), F.size("vector").alias("n"))


@register("SELECT vec_id, CASE WHEN len(embedding) <> 63 THEN 'length' END AS problem FROM embeddings")
def vector_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.vector_problems(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 63)


@register("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)")
def large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.large_groups(table(spark, sf_dir, "orders"), "o_custkey", 12).select("o_orderkey")


@register(f"{TOKENS}, n AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n FROM t) SELECT uid, pos - greatest(n - 3, 0) - 1 AS pos, mask FROM n WHERE pos > n - 3")
def response_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(datasets.response_part(F.col("mask"), F.lit(3))).alias("pos", "mask"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), "mask")


@register(f"{TOKENS} SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY pos) - 1 AS pos, reward FROM t WHERE mask <> 0")
def unpadded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(datasets.unpadded(F.col("rewards"), F.col("mask"))).alias("pos", "reward"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), "reward")


@register(f"{TOKENS}, n AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n FROM t) SELECT uid, pos - 1 AS pos, CASE WHEN pos < 3 OR pos = n THEN 0 ELSE 1 END::INT AS mask FROM n")
def prompt_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(datasets.prompt_masked(F.size("mask"), F.lit(3))).alias("pos", "mask"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), "mask")


@register(f"{TOKENS}, k AS (SELECT uid, list(reward ORDER BY pos) AS a FROM t GROUP BY uid) SELECT uid, i::BIGINT AS pos, coalesce(a[i + 1], -1.0)::DOUBLE AS reward FROM k, range(5) r(i)")
def fixed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(datasets.fixed_length(F.col("rewards"), 5, F.lit(-1.0))).alias("pos", "reward"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), "reward")


@register(f"{TOKENS}, s AS (SELECT uid, sum(reward) AS a, sum(value) AS b FROM t WHERE mask <> 0 GROUP BY uid) SELECT uid, {R('a / sqrt(a * a + b * b)')} AS a, {R('b / sqrt(a * a + b * b)')} AS b FROM s WHERE a * a + b * b > 0")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir)
    kept = F.aggregate(F.arrays_zip("rewards", "values", "mask"), F.lit(0.0), lambda s, z: s + (z["rewards"] + z["values"]) * z["mask"])
    pairs = F.transform(F.arrays_zip("rewards", "values"), lambda z: F.array(z["rewards"], z["values"]))
    pooled = rows.where(kept > 0).select("uid", datasets.masked_mean_vector(pairs, F.col("mask")).alias("v"))
    return pooled.select("uid", six(F.get("v", F.lit(0))).alias("a"), six(F.get("v", F.lit(1))).alias("b"))


@register("SELECT l_orderkey, l_linenumber, sha256(l_orderkey || chr(9) || l_linenumber || chr(9) || l_returnflag) AS digest FROM lineitem")
def key_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", datasets.key_digest(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("digest"))


@register("SELECT 'bench' AS data_source, 'math' AS ability, item_id AS idx, 'user' AS role, text AS content, 'rule' AS style, item_id::VARCHAR AS truth FROM benchmark")
def canonical_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = datasets.prompt_row("bench", "math", F.col("text"), F.col("item_id").cast("string"), F.col("item_id"), "train")
    out = table(spark, sf_dir, "benchmark").select(*row)
    return out.select("data_source", "ability", F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "reward_model.style", F.col("reward_model.ground_truth").alias("truth"))


@register("SELECT doc_id, 'system' AS first, 2 AS messages, lang, n_chars::VARCHAR AS n_chars FROM documents")
def collapsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt"), "lang", "n_chars")
    out = datasets.collapsed(rows, ["doc_id", "prompt"], "Answer well.")
    return out.select("doc_id", F.col("prompt")[0]["role"].alias("first"), F.size("prompt").alias("messages"), F.col("extra_info")["lang"].alias("lang"), F.col("extra_info")["n_chars"].alias("n_chars"))


@register("""WITH c AS (SELECT o_orderkey, list_sort([struct_pack(d := md5(o_orderkey || ':' || i), i := i) FOR i IN range(4)]) AS o FROM orders)
SELECT o_orderkey, array_to_string([['w', 'x', 'y', 'z'][p.i + 1] FOR p IN o], '') AS choices, substr('ABCD', list_position([p.i FOR p IN o], 0)::INT, 1) AS letter FROM c""")
def shuffled_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = datasets.shuffled_choices(F.col("o_orderkey"), F.array(*[F.lit(c) for c in "wxyz"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", F.array_join("s.choices", "").alias("choices"), F.col("s.letter").alias("letter"))


@register(f"{ROLLS} SELECT uid, (sample - 1)::INT AS response, length::DOUBLE AS length, graded AS acc FROM r")
def evaluation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollouts(spark, sf_dir).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("sample", "length", "graded"))).alias("g"))
    rows = rows.select("uid", F.transform("g", lambda x: x["length"]).alias("lengths"), F.transform("g", lambda x: x["graded"]).alias("accs"))
    return datasets.response_rows(rows, "uid", "lengths", "accs")


@register(f"{ROLLS} SELECT uid, array_to_string(list(graded::INT ORDER BY sample), ',') AS graded, {R('avg(graded)')} AS pass_at_1 FROM r GROUP BY uid")
def graded_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.graded_rows(rollouts(spark, sf_dir), "uid", "sample", "graded")
    return out.select("uid", F.array_join(F.transform("graded", lambda x: x.cast("int").cast("string")), ",").alias("graded"), six(F.col("pass_at_1")).alias("pass_at_1"))


@register(f"""WITH m AS (SELECT l_returnflag AS model, l_suppkey AS task, avg(l_quantity) AS s FROM lineitem GROUP BY ALL),
w AS (SELECT a.model, avg((a.s > b.s)::INT) AS win_share FROM m a JOIN m b ON a.task = b.task AND a.model <> b.model GROUP BY a.model)
SELECT model, count(*) AS tasks, {R('avg(s)')} AS mean, {R('any_value(win_share)')} AS win_share FROM m JOIN w USING (model) GROUP BY model""")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("task"), "l_quantity")
    return rounded(datasets.profile_summary(rows, "model", "task", "l_quantity"))


@register(f"{ROLLS}, p AS (SELECT uid, avg(score) AS v FROM r GROUP BY uid) SELECT {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS std, {R('(30 - avg(v)) / stddev_samp(v)')} AS z, {R('avg((v <= 30)::INT)')} AS percentile FROM p")
def selected_against_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = rollouts(spark, sf_dir).groupBy("uid").agg(F.avg("score").alias("v"))
    return rounded(datasets.against_null(30.0, null, "v"))


@register(f"{TOKENS} SELECT {R('sum((log_ratio < 0)::INT * mask) / (sum(mask) + 1e-8)')} AS share FROM t")
def flagged_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).withColumn("f", F.transform("log_ratio", lambda x: (x < 0).cast("double")))
    return rounded(metrics.masked_share(rows, "f"))


@register(f"{TOKENS} SELECT uid, sum(mask) AS n FROM t GROUP BY uid")
def mask_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tokens(spark, sf_dir).select("uid", correction.tokens(F.col("mask")).alias("n"))
