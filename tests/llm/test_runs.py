import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from rillmark.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(w):
    """Maximal stretches of each period, and of equal stretches the smallest period."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in found.items())


@pytest.mark.parametrize("seed", range(300))
def test_runs_against_all_periods(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < rng.randrange(1, 300):
        part = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))]
        words += part * rng.choice([1, 1, 3, 5, 9])
        words += words[-rng.randrange(1, 40) :] * rng.choice([0, 0, 2, 3])
    w = np.array(words[:700], np.int64)
    assert runs.runs(w) == brute(w.tolist())


def test_z_function():
    rng = np.random.default_rng(0)
    for _ in range(200):
        p, t = rng.integers(0, 2, rng.integers(1, 30)), rng.integers(0, 2, rng.integers(1, 40))

        def common(a, b):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            return k

        assert runs.z_function(p).tolist() == [common(p[i:], p) for i in range(len(p))]
        assert runs.z_function(p, t).tolist() == [common(t[i:], p) for i in range(len(t))]


def expected(doc_id, text):
    words = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    found = {}
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])
        edge = np.flatnonzero(np.diff(same))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
    all_ = sorted((s, size, q) for (s, size), q in found.items())
    best = max(all_, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=None)
    drop = {i for s, size, q in all_ for i in range(s + q, s + size)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(all_), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{z},{q}\n" for s, z, q in all_)), digest(" ".join(x for i, x in enumerate(words) if i not in drop)))


def test_query_against_brute_force(spark):
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert got == {expected(*r) for r in rows}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "a " * 40, 5), (4, "a " * 40, 5), (None, "b c " * 20, 5), (7, "x\u00a0y " * 30, 5), (8, "ü ß " * 23 + "ü", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period int")
    got = sorted(map(tuple, runs.periodic_runs(docs, rewrite=False).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    by = {r[0]: r for r in got}
    assert [by[i][1:] for i in (1, 2, 3)] == [(0, None, None, None, None, empty, empty)] * 3
    assert got.count(by[4]) == 2 and by[4][1:6] == (1, 0, 40, 1, 40000) and by[4][7] == hashlib.sha256(b"a").hexdigest()
    assert by[None][1:6] == (1, 0, 40, 2, 20000) and by[7][1:6] == (1, 0, 30, 1, 30000)
    assert by[8][1:6] == (1, 0, 47, 2, 23500)
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    cut = {r["doc_id"]: r for r in runs.without_runs(docs).collect()}
    assert cut[4]["text"] == "a" and cut[8]["text"] == "ü ß" and cut[1]["text"] is None and cut[3]["text"] == " \t\n" and cut[2]["period"] == 5


def test_very_long_texts():
    """A quarter of a million words: one word, one long period, and ordinary words."""
    n = 250_000
    rng = np.random.default_rng(0)
    texts = (np.zeros(n, np.int64), [(0, n, 1)]), (np.tile(rng.permutation(1000), n // 1000), [(0, n, 1000)]), (rng.permutation(n), [])
    for w, wanted in texts:
        began = time.perf_counter()
        assert runs.runs(w) == wanted
        assert time.perf_counter() - began < 30
