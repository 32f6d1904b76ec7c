"""Statistics, probes and rewards."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.functions import rewards
from rillmark.operators import probe, statistics


def value(spark, expression, schema, *values):
    return spark.createDataFrame([values], schema).select(expression.alias("x")).first()["x"]


def test_alignment(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 5))
    assert statistics.cka(x, x) == pytest.approx(1) and abs(statistics.cka(x, rng.normal(size=(30, 5)))) < 0.4
    seen, p = statistics.permutation_test(spark, x, x + 0.1 * rng.normal(size=x.shape), 40, 3)
    assert seen > 0.9 and p == pytest.approx(1 / 41)
    with pytest.raises(ValueError):
        statistics.hsic(np.eye(3), np.eye(3))


def test_agreement():
    rng = random.Random(0)
    a = [rng.randrange(4) for _ in range(200)]
    assert statistics.adjusted_mutual_information(a, [x + 9 for x in a]) == pytest.approx(1)
    assert abs(statistics.adjusted_mutual_information(a, [rng.randrange(4) for _ in a])) < 0.05
    assert statistics.chance_adjusted_overlap({1, 2}, {2, 3}, 10) == {"intersection": 1, "jaccard": 1 / 3, "adjusted": pytest.approx((1 - 0.4) / (2 - 0.4))}
    assert statistics.median_of_eight([8, 1, 7, 2, 6, 3, 5, 4]) == 4.5 and statistics.nearest_rank([3, 1, 2], 0.5) == 2
    assert statistics.gate({"a": {1: 0.99, 2: 0.97}}) == "go" and statistics.gate({"a": {1: 0.1, 2: 0.2}, "b": {1: 1.0}}) == "no_go" and statistics.gate({"a": {1: 0.1, 2: 0.9}}) == "borderline"


def test_subsets(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    subsets = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "subset string, vec_id long")
    got = {r["subset"]: r["vendi"] for r in statistics.subset_scores(vectors, subsets).collect()}
    assert got == {"a": pytest.approx(2), "b": pytest.approx(1)}
    draws = statistics.null_schedules(spark, 50, 5, 8, 1).collect()
    again = statistics.null_schedules(spark, 50, 5, 8, 1).collect()
    assert sorted(draws) == sorted(again) and len(draws) == 40 and len({(r["draw"], r["position"]) for r in draws}) == 40


def test_sizes_and_lengths(spark):
    labels = spark.createDataFrame([(x,) for x in [0, 0, 0, 2]], "label long")
    row = statistics.cluster_sizes(labels, 4).first()
    assert (row["least"], row["most"], row["mean"], row["singletons"], row["largest"]) == (0, 3, 1.0, 0.25, 0.75)
    row = statistics.length_summary(spark.range(101), "id").first()
    assert (row["n"], row["p50"], row["p90"], row["p99_9"], row["most"]) == (101, 50, 90, 99.9, 100)


def test_resample(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 3.0)], "k int, w double")
    got = [r["k"] for r in statistics.weighted_resample(df, "w", 800, 4).collect()]
    assert len(got) == 800 and set(got) == {2, 3} and abs(got.count(3) / 800 - 0.75) < 0.06


def test_cover_and_segments(spark):
    rows = [("t", a, i) for a, items in {"a": [1, 2], "b": [2, 3, 4], "c": [1], "d": [5]}.items() for i in items]
    got = statistics.greedy_cover(spark.createDataFrame(rows, "task string, test string, item int"), "task", "test", "item").orderBy("place").collect()
    assert [r["test"] for r in got] == ["b", "a", "d"]
    costs = spark.createDataFrame([("k", v) for v in (100.0, 98.0, 50.0, 49.0, 10.0)], "k string, v double")
    assert [r["segment"] for r in statistics.adaptive_segments(costs, "k", "v", 0.1, 0.1).orderBy(F.desc("v")).collect()] == [0, 0, 1, 1, 2]
    refs = spark.createDataFrame([("t", 0, 9.0), ("t", 1, 5.0), ("t", 2, 1.0), ("u", 0, 1.0)], "task string, place int, cost double")
    got = {r["task"]: r["norm"] for r in statistics.differential_score(spark.createDataFrame([("t", 4.0), ("u", 2.0)], "task string, cost double"), refs).collect()}
    assert got == {"t": pytest.approx(200 / 3), "u": 0.0}


def test_probe(spark):
    logits = [2.0, 5.0, 5.0, 1.0]
    assert [tuple(p) for p in value(spark, probe.top_k(F.col("v"), 3), "v array<double>", logits)] == [(5.0, 1), (5.0, 2), (2.0, 0)]
    p = np.exp(logits) / np.exp(logits).sum()
    assert value(spark, probe.log_softmax(F.col("v")), "v array<double>", logits) == pytest.approx(np.log(p).tolist())
    assert value(spark, probe.entropy(F.col("v")), "v array<double>", logits) == pytest.approx(-(p * np.log(p)).sum())
    assert value(spark, probe.overlap(F.col("a"), F.col("b")), "a array<int>, b array<int>", [1, 2, 3, 4], [2, 4, 6]) == 0.5
    tokens = spark.createDataFrame([(i, float(i)) for i in range(5)], "pos int, m double")
    assert sorted(map(tuple, probe.by_chunk(tokens, 2, ["m"]).collect())) == [(-1, 5, 2.0), (0, 2, 0.5), (2, 2, 2.5), (4, 1, 4.0)]
    steps = spark.createDataFrame([(n, s, v, w) for n in ("a", "b", "c") for s, v, w in ((1, 4.0, 1.0), (2, 2.0, 3.0))], "name string, step int, value double, weight double")
    got = {r["name"]: r["value"] for r in probe.combine_steps(steps, {"a": "last", "b": "weighted_avg"}).collect()}
    assert got == {"a": 2.0, "b": 2.5, "c": 3.0}
    row = probe.agreement(spark.createDataFrame([(0.1, 0.2), (0.5, 0.5), (0.9, 0.7)], "a double, b double"), "a", "b").first()
    assert row["most"] == pytest.approx(0.2) and row["corr"] > 0.9


def test_rewards(spark):
    rows = [("openai/gsm8k", "#### 5", "5", 1.0), ("lighteval/MATH", r"\boxed{\frac12}", "1/2", 1.0), ("math", "Answer: 3", "4", -1.0), ("searchR1_nq", "<answer>The cat</answer>", "cat", 1.0), ("Idavidrein/gpqa", "answer: c", "C", 0.0), ("Idavidrein/gpqa", "Answer: C", "C", 1.0)]
    df = spark.createDataFrame(rows, "s string, r string, t string, want double")
    assert [r["got"] for r in df.withColumn("got", rewards.score(F.col("s"), F.col("r"), F.col("t"))).collect()] == [r[3] for r in rows]
    with pytest.raises(Exception, match="no score for"):
        df.withColumn("got", rewards.score(F.lit("other"), F.col("r"), F.col("t"))).collect()
    assert value(spark, rewards.tool_use(F.col("s"), F.col("n")), "s double, n int", -1.0, 6) == pytest.approx(-0.8)
    assert [value(spark, rewards.step_error(F.col("p"), F.col("t"), F.col("n")), "p int, t int, n int", *x) for x in ((2, 4, 8), (-1, -1, 8), (3, -1, 8), (9, 1, 8), (None, 1, 8))] == [0.75, 1.0, -1.0, -1.0, -1.0]
    box = F.array(*[F.lit(float(v)) for v in (0, 0, 2, 2)])
    assert value(spark, rewards.point_in_box(F.col("p"), box), "p array<array<double>>", [[5.0, 5.0], [1.0, 1.0]]) == pytest.approx(1 / math.sqrt(4))
    assert value(spark, rewards.point_in_box(F.col("p"), box), "p array<array<double>>", [[5.0, 5.0]]) == -1.0
    assert value(spark, rewards.collinear(F.col("p")), "p array<array<double>>", [[0.0, 0.0], [1.0, 1.0], [5.0, 0.0], [3.0, 3.0]]) is True
    assert value(spark, rewards.collinear(F.col("p")), "p array<array<double>>", [[0.0, 0.0], [1.0, 1.0], [5.0, 0.0]]) is False
    assert value(spark, rewards.think_answer(F.col("r")), "r string", "<think>a</think> b ").asDict() == {"think": "a", "answer": "b"}
    assert value(spark, rewards.think_answer(F.col("r")), "r string", "<think>a</think> ") is None
    assert value(spark, rewards.token_amount(F.col("c"), 1), "c array<string>", ["p q", "a b", " c "]) == 3
    assert value(spark, rewards.place_at_end(F.lit(2.0), F.col("m")), "m array<int>", [1, 1, 0]) == [0.0, 2.0, 0.0]
    assert value(spark, rewards.formatted(F.col("r"), F.lit(""), F.lit(1.0)), "r string", "<think>x</think>\\boxed{1}") == pytest.approx(1.0)
