import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.operators import agreement, statistics
from rillmark.operators.quantiles import quantiles
from rillmark.streaming.queue import version_spread


def test_quantiles_of_skewed_groups_against_numpy(spark):
    rng = random.Random(3)
    rows = [("hot", rng.random()) for _ in range(3000)] + [("ties", 2.0)] * 500 + [(None, float(rng.randrange(5))) for _ in range(77)] + [("one", 4.5), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", shares).collect()}
    least = {r["g"]: r["q"] for r in quantiles(df, ["g"], "v", shares, interpolate=False).collect()}
    assert set(got) == {"hot", "ties", None, "one"}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert r["n"] == len(values)
        assert np.allclose(r["q"], np.quantile(values, shares), rtol=1e-12, atol=0)
        assert least[g] == [sorted(values)[max(0, math.ceil(s * len(values) - 1e-9) - 1)] for s in shares]
    whole = [v for _, v in rows if v is not None]
    assert np.allclose(quantiles(df, [], "v", shares).first()["q"], np.quantile(whole, shares), rtol=1e-12, atol=0)


def test_quantiles_of_odd_values(spark):
    assert quantiles(spark.createDataFrame([], "g int, v double"), ["g"], "v", [0.5]).collect() == []
    assert quantiles(spark.createDataFrame([], "v double"), [], "v", [0.5]).collect() == []
    row = quantiles(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (float("inf"),)], "v double"), [], "v", [0.0, 1.0], interpolate=False).first()
    assert row["q"][0] == 1.0 and math.isnan(row["q"][1])
    clashing = spark.createDataFrame([(1, 2, 3, 4.0), (1, 2, 3, 6.0)], "g int, c int, p int, v double")
    assert [tuple(r) for r in quantiles(clashing, ["g", "c", "p"], "v", [0.5]).collect()] == [(1, 2, 3, 2, [5.0])]
    with pytest.raises(ValueError):
        quantiles(clashing, ["g"], "v", [1.5])
    empty = statistics.length_summary(spark.createDataFrame([], "x int"), "x").first()
    assert empty["n"] == 0 and empty["p50"] is None


def test_version_spread_has_exact_quantiles(spark):
    rows = [(b, i % 3, i % 2, float(i * i % 17)) for b in (1, 2, None) for i in range(40)]
    got = version_spread(spark.createDataFrame(rows, "batch int, version_end int, version_start int, seconds double")).collect()
    assert len(got) == 3
    for r in got:
        assert np.allclose(r["seconds"], np.quantile([x[3] for x in rows if x[0] == r["batch"]], [0.5, 0.95, 0.99]))


def labelled(spark, runs):
    rows = [(r, i, v) for r, labels in runs.items() for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "run string, row long, label int").repartition(3)


def test_agreements_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.randrange(6) for _ in range(240)]
    runs = {"a": base, "b": [x if rng.random() < 0.8 else rng.randrange(6) for x in base], "c": [0] * 200 + list(range(1, 41)), "d": [x // 2 for x in base], "e": [9 - x for x in base]}
    got = {(r["left"], r["right"]): r for r in agreement.agreements(labelled(spark, runs)).collect()}
    assert len(got) == 10
    for (x, y), r in got.items():
        assert r["n"] == 240
        assert r["ami"] == pytest.approx(statistics.adjusted_mutual_information(runs[x], runs[y]), abs=1e-9)
        same = [[p == q for j, q in enumerate(runs[z]) for p in runs[z][:j]] for z in (x, y)]
        t, a, b, n = sum(map(min, *same)), sum(same[0]), sum(same[1]), len(same[0])
        assert r["ari"] == pytest.approx((t - a * b / n) / ((a + b) / 2 - a * b / n), abs=1e-12)
    assert (got["a", "e"]["ari"], got["a", "e"]["ami"]) == pytest.approx((1.0, 1.0))


def test_agreements_where_nothing_varies_or_is_missing(spark):
    runs = {"one": [1] * 9, "same": [4] * 9, "each": list(range(9)), "other": list(range(9, 18))}
    got = {(r["left"], r["right"]): (r["ari"], r["ami"]) for r in agreement.agreements(labelled(spark, runs)).collect()}
    assert got["one", "same"] == got["each", "other"] == (1.0, 1.0)
    assert got["each", "one"] == pytest.approx((0.0, 0.0), abs=1e-12)
    odd = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, None), ("b", 1, 5), ("b", 3, 5), (None, 1, 1), ("c", 9, 1)], "run string, row long, label int")
    assert [(r["left"], r["right"], r["n"]) for r in agreement.agreements(odd).collect()] == [("a", "b", 1)]
    assert agreement.agreements(odd.limit(0)).collect() == []


def test_chance_information_keeps_its_precision_in_large_tables():
    for p, q, n in ((1, 1, 10), (7, 5, 11), (400, 900, 1000), (50, 3, 100000), (30000, 20000, 60000)):
        log = math.lgamma
        want = 0.0
        for k in range(max(1, p + q - n), min(p, q) + 1):
            ways = log(p + 1) + log(q + 1) + log(n - p + 1) + log(n - q + 1) - log(n + 1) - log(k + 1) - log(p - k + 1) - log(q - k + 1) - log(n - p - q + k + 1)
            want += k / n * math.log(n * k / (p * q)) * math.exp(ways)
        assert agreement.chance_information(p, q, n) == pytest.approx(want, rel=1e-6, abs=1e-12)
    assert math.isfinite(agreement.chance_information(3 * 10**9, 10**9, 10**10))


def test_overlaps_against_sets(spark):
    rng = random.Random(2)
    sets = {r: set(rng.sample(range(100), n)) for r, n in (("a", 30), ("b", 60), ("c", 100))} | {"d": {100, 101}}
    df = spark.createDataFrame([(r, i) for r, s in sets.items() for i in s for _ in range(1 + i % 2)] + [(None, 1), ("a", None)], "run string, row long")
    got = {(r["left"], r["right"]): r for r in agreement.overlaps(df, 110).collect()}
    assert len(got) == 6
    for (x, y), r in got.items():
        want = statistics.chance_adjusted_overlap(sets[x], sets[y], 110)
        assert (r["n_left"], r["n_right"], r["intersection"]) == (len(sets[x]), len(sets[y]), want["intersection"])
        assert r["jaccard"] == pytest.approx(want["jaccard"]) and r["adjusted"] == pytest.approx(want["adjusted"])
    assert got["a", "d"]["intersection"] == 0
    assert agreement.overlaps(df.limit(0), 5).collect() == []


def test_run_sizes(spark):
    got = {r["run"]: r for r in agreement.run_sizes(labelled(spark, {"a": [1, 1, 1, 2, 3], "b": [0] * 5})).collect()}
    assert (got["a"]["clusters"], got["a"]["rows"], got["a"]["least"], got["a"]["median"], got["a"]["most"]) == (3, 5, 1, 1.0, 3)
    assert got["a"]["singletons"] == pytest.approx(2 / 3) and got["b"]["p99"] == 5.0
