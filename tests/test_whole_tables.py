"""Queries over whole tables against brute force on small ones."""

import numpy as np

from rillmark.plans.queries import QUERIES


def test_facility_coverage_searches_every_other_row(spark, tmp_path):
    v = np.random.default_rng(2).normal(size=(45, 8))
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = v.astype("f4").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    best = (u @ u.T - 9 * np.eye(45)).max(axis=1)
    got = QUERIES["facility_coverage_all"](spark, str(tmp_path)).first()["coverage"]
    assert abs(got - best.mean()) < 2e-6


def test_key_coverage_checks_every_document(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (0, 1, 2, 2, 9)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i,) for i in range(5)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["key_coverage_all"](spark, str(tmp_path)).collect())
    assert got == [(2, "repeated"), (3, "missing"), (4, "missing"), (9, "unexpected")]


def test_normalised_words_takes_every_language(spark, tmp_path):
    spark.createDataFrame([(1, "fr", "L'océan  a ÉTÉ, the BLEU"), (2, "en", "The An a: end")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["normalised_words_all"](spark, str(tmp_path)).collect())
    assert got == [(1, "locéan été bleu"), (2, "end")]
