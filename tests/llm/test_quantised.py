import numpy as np
import pytest

from rillmark.llm import quantised, queries


def brute(ids, rows, least=0.95):
    """(vec_id, n_links, component_id) by all pairs, for rows of numbers."""
    x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = x @ x.T >= least
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.where(near, label[None], len(ids)).min(axis=1)
        if (new == label).all():
            break
        label = new
    ids = np.array(ids)
    least_id = {k: ids[label == k].min() for k in set(label.tolist())}
    return sorted((int(i), int(n) - 1, int(least_id[k])) for i, n, k in zip(ids, near.sum(axis=1), label.tolist(), strict=True))


def planted(seed, families, n, d, noise):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(families, d))
    return middles[rng.integers(0, families, n) * (rng.random(n) < 0.7)] + noise * rng.normal(size=(n, d)) * rng.random((n, 1))


def frame(spark, ids, rows):
    return spark.createDataFrame([(i, r.tolist(), 3) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>, key int")


@pytest.mark.parametrize("seed,n,d,lists", [(0, 400, 8, None), (1, 900, 32, 40), (2, 700, 64, 60)])
def test_links_against_all_pairs(spark, seed, n, d, lists):
    """A third of the rows in one family; at least 0.9 of the links, none below the similarity, components as by brute force."""
    rows = planted(seed, 60, n, d, 0.5)
    ids = np.random.default_rng(seed).permutation(3 * n)[:n].tolist()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in quantised.near_duplicates(frame(spark, ids, rows), lists=lists).collect())
    want = brute(ids, rows)
    assert sum(r[1] for r in want) > 1000
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) >= 0.97 * n


def test_units_of_any_size_agree(spark, monkeypatch):
    rows = planted(5, 20, 500, 16, 0.3)
    docs = frame(spark, range(500), rows)
    once = sorted(map(tuple, quantised.near_duplicates(docs).collect()))
    deal = quantised.links
    monkeypatch.setattr(quantised, "links", lambda *a: deal(*a, members=17, asking=11))
    assert sorted(map(tuple, quantised.near_duplicates(docs).collect())) == once


def test_codes_decide_few(spark):
    """Of all pairs of scattered vectors, few need their exact cosine, and no linked one is passed over."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(2000, 64))
    rows[1000:] = rows[:1000] + 0.15 * rng.normal(size=(1000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    q = quantised.Quantiser.fit(rows, 1)
    code, error, square = q.encoded(rows, np.zeros(2000, int))
    own = {"node": np.arange(2000), "copies": np.ones(2000, int), "list": np.zeros(2000, int), "code": code, "error": error, "square": square, "unit": rows, "probes": [[0]] * 2000}
    unit = quantised.Unit(q, own, 0, 0.95)
    n, a, b = unit.ask({k: own[k] for k in ("node", "copies", "list", "unit")})
    assert (n + unit.links).sum() == (rows @ rows.T >= 0.95).sum() - 2000
    assert unit.decided < 2000 * 1999 / 2 / 20
    assert len(a) == 1000


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (9, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [2.0, 4.0, 0.0]), (None, [2.0, 1.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (None, None)]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, key int")
    got = sorted((tuple(r) for r in quantised.near_duplicates(docs).collect()), key=str)
    alone = [(i, 0, i, True) for i in range(1, 7)]
    # (1, 2) and (1, 1) have a cosine of 0.949, (2, 1) and (1, 1) as well
    want = [*alone, (9, 2, 8, False), (8, 2, 8, True), (8, 2, 8, True), (None, 0, None, False), (None, 0, None, False), (10, 1, 10, True), (11, 1, 10, False)]
    assert got == sorted(want, key=str)
    assert quantised.near_duplicates(docs.limit(0)).collect() == []
    assert quantised.near_duplicates(docs.where("vec_id < 7")).count() == 6


def test_query_against_brute_force(spark):
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in queries.op11_quantised_near_duplicates(spark, "/root/testdata/sf0.001").collect())
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    assert got == brute([r[0] for r in rows], np.array([r[1] for r in rows], float))
