import random

import numpy as np
import pytest

from rillmark.operators import ranks
from rillmark.operators.balancing import differencing
from rillmark.plans.diagnostic_queries import even_ranks


def cost(n):
    return 24576 * n + n * n


def both_ends(rows):
    return rows[::2] + rows[1::2][::-1]


def spread(parts):
    sums = [sum(map(cost, p)) for p in parts]
    return max(sums) - min(sums)


def by_rank(spark, lengths, k, **more):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "row_id long, length long").repartition(3)
    found = {}
    for r in ranks.balanced_ranks(df, k, **more).collect():
        found.setdefault(r["rank"], {})[r["position"]] = r["row_id"]
    assert all(sorted(p) == list(range(len(p))) for p in found.values())
    assert sorted(i for p in found.values() for i in p.values()) == list(range(len(lengths)))
    return [[p[i] for i in range(len(p))] for p in found.values()]


def test_sets_merge_like_the_sequential_algorithm():
    rng = random.Random(1)
    for k, many in ((2, 9), (4, 25), (7, 40), (3, 1), (1, 5)):
        for top in (3, 50, 4000):
            lengths = sorted(rng.randrange(top) for _ in range(k * many))
            part, total = ranks.merge_sets(np.array([cost(n) for n in lengths]).reshape(many, k))
            assert all(sorted(p) == list(range(k)) for p in part.tolist())
            sums = np.zeros(k, np.int64)
            for p, n in zip(part.ravel(), lengths, strict=True):
                sums[p] += cost(n)
            assert np.array_equal(sums, total)
            want = [sum(cost(lengths[i]) for i in p) for p in differencing([cost(n) for n in lengths], k, equal=True)]
            assert max(sums) - min(sums) <= max(want) - min(want) + cost(lengths[-1]) - cost(lengths[0])
            assert (sums.max() - sums.min()) <= max(cost(b) - cost(a) for a, b in zip(lengths[::k], lengths[k - 1 :: k], strict=True))


@pytest.mark.parametrize("block", [65536, 12])
def test_ranks_are_equal_and_even(spark, monkeypatch, block):
    monkeypatch.setattr(ranks, "BLOCK", block)
    rng = random.Random(2)
    lengths = [rng.choice([7, 7, 7, rng.randrange(900)]) for _ in range(240)]
    got = by_rank(spark, lengths, 4)
    assert [len(p) for p in got] == [60] * 4
    for p in got:
        assert p == both_ends(sorted(p, key=lambda i: (lengths[i], i)))
    ordered = sorted(lengths)
    bound = max(cost(b) - cost(a) for a, b in zip(ordered[::4], ordered[3::4], strict=True))
    assert spread([[lengths[i] for i in p] for p in got]) <= bound
    sequential = differencing([cost(n) for n in lengths], 4, equal=True)
    assert spread([[lengths[i] for i in p] for p in got]) <= spread([[lengths[i] for i in p] for p in sequential]) + bound


def test_sizes_differ_by_one_where_rows_are_no_multiple(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", 9)
    rng = random.Random(4)
    for n in (1, 2, 25, 50):
        lengths = [rng.randrange(300) for _ in range(n)]
        got = by_rank(spark, lengths, 3, exact=False)
        sizes = [len(p) for p in got] + [0] * (3 - len(got))
        assert max(sizes) - min(sizes) <= 1
        for p in got:
            assert p == both_ends(sorted(p, key=lambda i: (lengths[i], i)))
    with pytest.raises(ValueError):
        by_rank(spark, [1, 2], 3)


def test_empty_nulls_and_one_rank(spark):
    empty = spark.createDataFrame([], "row_id long, length long")
    assert ranks.balanced_ranks(empty, 4).collect() == []
    odd = spark.createDataFrame([(5, None), (6, 3), (7, None), (8, 3)], "row_id long, length long")
    assert sorted((r["rank"], r["row_id"], r["position"]) for r in ranks.balanced_ranks(odd, 1).collect()) == [(0, 5, 0), (0, 6, 1), (0, 7, 3), (0, 8, 2)]
    got = {r["rank"]: (r["rows"], r["tokens"]) for r in ranks.rank_balance(ranks.balanced_ranks(odd, 2), odd).collect()}
    assert got == {0: (2, 3), 1: (2, 3)}
    with pytest.raises(ValueError):
        ranks.balanced_ranks(odd, 0)


def test_query_holds_on_the_small_table(spark):
    assert all(r["whole"] and r["even"] for r in even_ranks(spark, "/root/testdata/sf0.001").collect())
