import random

import pytest
from pyspark.sql import functions as F

from rillmark.operators import covers


def sequential(edges):
    """The greedy rule, a test at a time."""
    out = {}
    for task in {t for t, _, _ in edges}:
        shows = {}
        for t, test, item in edges:
            if t == task:
                shows.setdefault(test, set()).add(item)
        left = set().union(*shows.values())
        while left:
            best = min(shows, key=lambda x: (-len(shows[x] & left), x))
            out[task, best] = (len([k for k in out if k[0] == task]), len(shows[best] & left))
            left -= shows[best]
    return out


def got(df):
    return {(r["task"], r["test"]): (r["place"], r["gain"]) for r in covers.greedy_covers(df).collect()}


@pytest.mark.parametrize(("seed", "group"), [(1, 0), (2, 30), (3, 100_000)])
def test_rounds_take_what_the_sequential_rule_takes(spark, monkeypatch, seed, group):
    monkeypatch.setattr(covers, "GROUP", group)
    rng = random.Random(seed)
    edges = [(t, f"t{rng.randrange(14):02}", rng.randrange(20)) for t in range(5) for _ in range(rng.randrange(5, 90))]
    edges += [(99, f"t{i}", i) for i in range(40)] + [(98, "hot", i) for i in range(120)] + [(97, f"t{i:03}", 0) for i in range(120)]
    df = spark.createDataFrame(edges, "task int, test string, item int").repartition(4)
    assert got(df) == sequential(edges)


def test_a_chain_of_waiting_tests(spark, monkeypatch):
    monkeypatch.setattr(covers, "GROUP", 0)
    edges = [("a", i, j) for i in range(6) for j in range(i, i + 3)]
    assert got(spark.createDataFrame(edges, "task string, test int, item int")) == sequential(edges)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", None, 2), (None, "x", 1), ("a", "y", None)]
    df = spark.createDataFrame(rows, "task string, test string, item int").withColumn("gain", F.lit(7)).withColumn("pair", F.lit(7))
    assert got(df) == {("a", "x"): (0, 1)}
    assert got(df.limit(0)) == {}


def test_edges_leave_out_a_source(spark):
    rows = [("a", "x", "model-1", 3), ("a", "x", "other-2", 3), ("a", "y", "model-9", 4), ("a", "y", None, 4)]
    df = spark.createDataFrame(rows, "k string, t string, s string, found int")
    assert covers.cover_edges(df, "k", "t", "s", F.col("found")).count() == 3
    assert [tuple(r) for r in covers.cover_edges(df, "k", "t", "s", F.col("found"), "model").collect()] == [("a", "x", ("other-2", 3))]


def test_merged_covers_and_average(spark):
    cover = lambda rows: spark.createDataFrame(rows, "task string, test string, place int")
    merged = covers.merged_covers([cover([("a", "x", 0), ("a", "y", 1)]), cover([("a", "y", 0), ("a", "z", 1), ("b", "q", 0)]), cover([])])
    assert sorted(map(tuple, merged.collect())) == [("a", "x", 0, 0), ("a", "y", 0, 1), ("a", "z", 1, 1), ("b", "q", 1, 0)]
    base = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "task string, n_base int")
    assert tuple(covers.average_tests(base, merged).first()) == (pytest.approx((2 + 3 + 3 + 1 + 4) / 3), 3)
