"""Registered queries of batch algebra, probes, sources and sinks that the other modules leave out, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators import balancing, batch, curation, evaluation, probe
from rillmark.plans.queries import ORDERS, ROLLS, TOKENS, numbered, register
from rillmark.plans.rollout_queries import R, rounded, six
from rillmark.plans.rollouts import order_tokens, rollouts, table
from rillmark.sources import evaluation as sources
from rillmark.sources import files
from rillmark.sources.staging import staged, staging_path


@register(f"{ORDERS} SELECT row_id, o_custkey AS customer FROM o")
def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    popped, _ = batch.pop(numbered(spark, sf_dir), ["o_custkey"])
    return batch.rename(popped, ["o_custkey"], ["customer"]).select("row_id", "customer")


@register(f"{ORDERS} SELECT row_id, o_orderkey, o_totalprice FROM o")
def selected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.select_columns(numbered(spark, sf_dir), ["o_orderkey", "o_totalprice"]).select("row_id", "o_orderkey", "o_totalprice")


@register(f"{ORDERS}, k AS (SELECT * FROM o WHERE o_custkey % 2 = 0) SELECT o_orderkey FROM k")
def masked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.where_mask(numbered(spark, sf_dir), F.col("o_custkey") % 2 == 0).select("o_orderkey")


@register(f"{ORDERS}, n AS (SELECT count(*) AS n FROM o) SELECT o_orderkey FROM o, n WHERE row_id < n")
def unpadded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.unpad(batch.pad_to_divisor(numbered(spark, sf_dir), 1024)).select("o_orderkey")


@register(f"{ORDERS}, n AS (SELECT count(*) AS n FROM o) SELECT row_id, o_orderkey FROM o UNION ALL SELECT n + k, o_orderkey FROM o, n, range(5) t(k) WHERE row_id = n - 1")
def padded_with_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.pad_with(numbered(spark, sf_dir), 5, "last").select("row_id", "o_orderkey")


@register(f"{ORDERS}, n AS (SELECT count(*) AS n FROM o) SELECT row_id, o_orderkey FROM o UNION ALL SELECT n + row_id, o_orderkey FROM o, n")
def concatenated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    return batch.concat([rows, rows]).select("row_id", "o_orderkey")


@register(f"{ORDERS}, n AS (SELECT count(*) AS n FROM o) SELECT o_orderkey, (row_id // (n // 5))::INT AS chunk FROM o, n WHERE row_id < n - n % 5")
def chunked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    n = rows.count()
    return batch.chunk(batch.slice_rows(rows, 0, n - n % 5).select("row_id", "o_orderkey"), 5).select("o_orderkey", F.col("chunk").cast("int").alias("chunk"))


@register(f"{ORDERS} SELECT row_id, o_orderkey FROM o")
def unfolded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = batch.fold(numbered(spark, sf_dir).select("row_id", "o_orderkey"), 7, ["o_orderkey"])
    return batch.unfold(folded, 7, ["o_orderkey"]).select("row_id", "o_orderkey")


# ---- probes

FIVE = "[reward, value, -new * 3, -old * 2, adv / 100]"


def _five():
    return F.transform(F.arrays_zip("rewards", "values", "new", "old", "advantages"), lambda z: F.array(z["rewards"], z["values"], -z["new"] * 3, -z["old"] * 2, z["advantages"] / 100))


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(_five()).alias("pos", "logits"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), "logits")


@register(f"{TOKENS}, l AS (SELECT uid, pos - 1 AS pos, {FIVE} AS l FROM t), z AS (SELECT *, ln(list_sum([exp(x) FOR x IN l])) AS z FROM l) SELECT uid, pos, {R('z - list_sum([exp(x - z) * x FOR x IN l])')} AS entropy, {R('l[2] - z')} AS logp FROM z")
def logit_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir).select("uid", "pos", six(probe.entropy(F.col("logits"))).alias("entropy"), six(F.get(probe.log_softmax(F.col("logits")), F.lit(1))).alias("logp"))


@register(f"{TOKENS}, l AS (SELECT uid, pos - 1 AS pos, {FIVE} AS l FROM t) SELECT uid, pos, (list_sort([struct_pack(v := -l[i + 1], i := i) FOR i IN range(5)])[1].i)::INT AS top, {R('-list_sort([struct_pack(v := -l[i + 1], i := i) FOR i IN range(5)])[2].v')} AS second FROM l")
def top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = probe.top_k(F.col("logits"), 2)
    own = _probe(spark, sf_dir).select("uid", "pos", top.alias("t"))
    return own.select("uid", "pos", F.get("t", F.lit(0))["index"].cast("int").alias("top"), six(F.get("t", F.lit(1))["value"]).alias("second"))


@register(f"{TOKENS}, p AS (SELECT ((pos - 1) // 3) * 3 AS s, reward, value FROM t) SELECT s::BIGINT AS chunk_start, {R('avg(reward)')} AS reward, {R('avg(value)')} AS value FROM p GROUP BY s UNION ALL SELECT -1, {R('avg(reward)')}, {R('avg(value)')} FROM t")
def depth_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select(F.posexplode(F.arrays_zip("rewards", "values")).alias("pos", "z")).select("pos", F.col("z.rewards").alias("reward"), F.col("z.values").alias("value"))
    out = probe.by_chunk(rows, 3, ["reward", "value"])
    return out.select(F.col("chunk_start").cast("long").alias("chunk_start"), six(F.col("reward")).alias("reward"), six(F.col("value")).alias("value"))


# ---- statistics


@register(f"{ROLLS}, p AS (SELECT uid, avg(score) AS v FROM r GROUP BY uid) SELECT {R('avg((v <= 27.5)::INT)')} AS percentile FROM p")
def null_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = rollouts(spark, sf_dir).groupBy("uid").agg(F.avg("score").alias("score"))
    out = evaluation.inclusive_percentile(null, 27.5)
    return rounded(out.toDF("percentile"))


@register("SELECT o_orderkey, 24576 * o_custkey + o_custkey * o_custkey AS work FROM orders")
def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", balancing.workload(F.col("o_custkey")).alias("work"))


@register("""WITH s AS (SELECT lang AS stratum, count(*)::DOUBLE AS w FROM documents GROUP BY lang), i AS (SELECT *, 97 * w / sum(w) OVER () AS ideal FROM s), f AS (SELECT *, floor(ideal) AS f, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, stratum) AS k FROM i)
SELECT stratum, (f + (k <= 97 - (SELECT sum(f) FROM f))::INT)::BIGINT AS allocated FROM f""")
def apportioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("weight"))
    return curation.apportion(strata, 97)


@register("WITH b AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL) SELECT p_type, max(n) AS top, arg_max(p_size, (n, -p_size)) AS size FROM b GROUP BY p_type")
def latest_probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n"))
    last = sources.last_rows(one.withColumn("step", F.struct("n", -F.col("p_size"))), "p_type", "step")
    return last.select("p_type", F.col("n").alias("top"), F.col("p_size").alias("size"))


# ---- sources and sinks: written to the shared folder and read back


@register("SELECT doc_id, text, lang FROM documents")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark)
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return files.read_jsonl(spark, [path], "doc_id long, text string, lang string")


@register("SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR END AS o_custkey FROM orders")
def ragged_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, orders = staging_path(spark), table(spark, sf_dir, "orders")
    files.write_csv([orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey"), orders.where("o_orderkey % 2 <> 0").select("o_orderkey")], path, ["o_orderkey"])
    return spark.read.option("header", True).csv(path).select("o_orderkey", "o_custkey")


@register("SELECT o_orderkey, o_totalprice FROM orders")
def probe_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark)
    files.write_csv([table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")], path)
    return sources.probe_rows(spark, [path], ["o_totalprice"]).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice")


@register("SELECT conv_id, turn, text, turn % 3 AS step FROM conversations")
def generation_dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark)
    files.dump_generations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 3).alias("step")), path)
    kind = table(spark, sf_dir, "conversations").schema
    return spark.read.schema(f"conv_id {kind['conv_id'].dataType.simpleString()}, turn {kind['turn'].dataType.simpleString()}, text string, step {kind['turn'].dataType.simpleString()}").json(path)


@register("SELECT o_orderkey, o_custkey FROM orders")
def cached_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = staging_path(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    files.read_or_write(rows, path)
    return files.read_or_write(rows.where("false"), path)  # what was written first is what is read


@register(f"{ORDERS} SELECT row_id, o_custkey AS budget FROM o")
def budget_records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark)
    sources.write_budgets(numbered(spark, sf_dir).withColumn("budget", F.col("o_custkey")), path)
    return sources.read_budgets(spark, path)


@register(f"{ROLLS}, w AS (SELECT uid, count(*) AS n, min(graded) AS worst FROM r GROUP BY uid) SELECT uid, n, worst < 1 AS mistaken FROM w")
def evaluation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark)
    sources.write_results(rollouts(spark, sf_dir).select("uid", "sample", F.col("graded").alias("acc"), "length"), path)
    schema = "uid long, samples array<struct<sample:long,acc:double,length:long>>"
    wrong = spark.read.schema(schema).json(f"{path}/mistakes").select("uid", F.lit(True).alias("mistaken"))
    every = spark.read.schema(schema).json(f"{path}/results").select("uid", F.size("samples").cast("long").alias("n"))
    return every.join(wrong, "uid", "left").withColumn("mistaken", F.coalesce("mistaken", F.lit(False)))


@register("SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type")
def staged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(table(spark, sf_dir, "events").select("event_type", "value")).groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@register("SELECT 'step:' || o_orderkey AS line, o_orderkey AS step, o_totalprice AS loss FROM orders")
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("step:"), F.col("o_orderkey").cast("string"), F.lit(" - loss:"), F.col("o_totalprice").cast("string")).alias("value"))
    out = files.metric_lines(lines)
    return out.select(F.concat(F.lit("step:"), F.col("step").cast("string")).alias("line"), "step", F.col("metrics")["loss"].alias("loss"))
