"""The subpackage's queries: each takes (spark, sf_dir) and runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillmark.llm import content_store, expiry, jpeg, language, mixture, packing, quality, quantised, runs, secrets, simhash, storage, surrogates, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "store")
    content_store.write_store(_table(spark, sf_dir, "documents"), path)
    return content_store.document_digests(spark, path)


def op2_impact_ordered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed_documents(_table(spark, sf_dir, "documents"))


def op5_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_documents(_table(spark, sf_dir, "documents"))


def op6_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised_documents(_table(spark, sf_dir, "documents"), surrogates.session_key(spark))


def op10_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op11_quantised_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_expiring_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.windows(_table(spark, sf_dir, "clicks"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_content_store,
    op2_impact_ordered_top_k,
    op3_best_fit_packing,
    op4_raked_mixture,
    op5_jpeg_media,
    op6_fused_language,
    op7_simhash_components,
    op8_subword_quality,
    op9_keyed_surrogates,
    op10_token_efficiency_secrets,
    op11_quantised_near_duplicates,
    op12_expiring_clicks,
    op13_periodic_runs,
)

#: DuckDB: the scores of op2 need no index to state.
TOP_K_SQL = """
WITH n AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
), v AS (
  SELECT row, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM n
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.row AS row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_impact_ordered_top_k": TOP_K_SQL}
