import math

import numpy as np

from rillmark.operators import projection
from rillmark.plans.decision_queries import projected_embeddings

M = (1 << 64) - 1


def mix(x):
    x = (x + 1) * 0x9E3779B97F4A7C15 & M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def sign(seed, i, j, outputs):
    return 1 - 2 * (mix((i * -(-outputs // 64) + j // 64) ^ mix(seed)) >> j % 64 & 1)


def test_query_against_a_loop(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    got = projected_embeddings(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    s = [[sign(11, i, j, 32) for j in range(32)] for i in range(64)]
    for r in got[::10]:
        v = rows[r["vec_id"]]
        want = [sum(v[i] * s[i][j] for i in range(64)) / math.sqrt(32) for j in range(32)]
        assert np.allclose(r["projected"], want, rtol=0, atol=1e-12)


def test_same_at_any_partitioning_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=int(rng.integers(1, 9000))).tolist()) for i in range(30)] + [(30, None), (31, []), (None, [1.0]), (33, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    once = {r["id"]: r["projected"] for r in projection.project(df.coalesce(1), "id", "v", 70).collect()}
    assert {r["id"]: r["projected"] for r in projection.project(df.repartition(7), "id", "v", 70).collect()} == once
    assert once[30] is None and once[33] is None and once[31] == [0.0] * 70
    assert once[None] == [sign(0, 0, j, 70) / math.sqrt(70) for j in range(70)]
    assert projection.project(df.limit(0), "id", "v", 3).collect() == []


def test_distances_are_kept(spark):
    """At 512 outputs the squared distances of 60 vectors keep their size within a quarter, and on average within 2 %."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    y = np.array([r["projected"] for r in sorted(projection.project(df, "id", "v", 512, seed=3).collect())])
    a, b = np.triu_indices(60, 1)
    ratio = ((y[a] - y[b]) ** 2).sum(axis=1) / ((x[a] - x[b]) ** 2).sum(axis=1)
    assert abs(ratio - 1).max() < 0.25 and abs(ratio.mean() - 1) < 0.02
