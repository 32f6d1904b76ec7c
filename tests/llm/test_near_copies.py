"""Near copies against all pairs: star families and short texts."""

import random

import numpy as np
import pytest

from rillmark.llm import simhash


def similar(a, b):
    return simhash.similarity(simhash.shingle_hashes(a, simhash.STAGE_WORDS), simhash.shingle_hashes(b, simhash.STAGE_WORDS)) >= simhash.SIMILARITY


def kept_by_all_pairs(texts):
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            a, b = find(i), find(j)
            if a != b and similar(texts[i], texts[j]):
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(0, len(words), 5), n):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


def test_star_family_with_the_original_in_the_middle(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(304)]
    texts = [" ".join(edited(rng, words, 6)) for _ in range(300)]
    texts.insert(150, " ".join(words))
    assert all(similar(t, texts[150]) for t in texts) and not all(similar(texts[0], t) for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in simhash.deduplicated(docs).collect()] == [0]


def test_short_texts(spark):
    rng = random.Random(5)
    texts = []
    for base in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 40))]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(words[1:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicated(docs).collect()} == kept_by_all_pairs(texts)


@pytest.mark.parametrize("n", [1, 5, 6, 8, 20, 45, 300])
def test_prefixes_of_similar_sets_meet(n):
    rng = np.random.default_rng(n)
    frequent = np.sort(rng.integers(1, 2000, 200).astype(np.uint64))
    for _ in range(200):
        a = rng.choice(np.arange(1, 2000), n, replace=False).astype(np.uint64)
        b = np.concatenate([a[rng.integers(0, n // 5 + 1) :], rng.integers(3000, 10**9, rng.integers(0, n // 5 + 1)).astype(np.uint64)])
        if simhash.similarity(a, b) >= simhash.SIMILARITY:
            assert len(np.intersect1d(simhash.prefix(a, frequent), simhash.prefix(b, frequent)))
