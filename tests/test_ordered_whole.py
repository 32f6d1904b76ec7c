"""Sequences that a task can hold are walked whole: no round of segments, whatever their number."""

from datetime import date

import pytest

from rillmark.operators import ordered
from test_ordered import brute


@pytest.fixture
def sides(spark):
    f = [(None if g == 3 else date(2020, 1, 1 + g % 28), g // 28, r, str((r * (g + 3)) % 4) if r % 9 else "lacking") for g in range(60) for r in range(g % 12)]
    o = [(None if g == 3 else date(2020, 1, 1 + g % 28), g // 28, 10 * r, str((r * (g + 3)) % 4)) for g in range(60) for r in range(14)]
    want = [(d, n, *t) for d, n in {(x[0], x[1]) for x in f} for t in brute([(x[2], x[3]) for x in f if x[:2] == (d, n)], [(x[2], x[3]) for x in o if x[:2] == (d, n)])]
    return spark.createDataFrame(f, "day date, more int, row long, k string"), spark.createDataFrame(o, "day date, more int, position long, k string"), sorted(want, key=str)


def test_short_sequences_take_no_rounds(spark, sides, monkeypatch):
    """Two names of other types, a null one, batches that cut sequences."""
    monkeypatch.setattr(ordered, "greedy", lambda *a: pytest.fail("a round of segments for short sequences"))
    f, o, want = sides
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ordered.ordered_matches(f, o, ["k"], by=["day", "more"])
        assert got.columns == ["day", "more", "row", "earliest", "latest", "outcome"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("chunk", [13, 14])
def test_long_and_short_give_the_same(sides, chunk):
    """Fourteen originals each: at 13 all sequences go by segments, at 14 none does."""
    f, o, want = sides
    assert sorted(map(tuple, ordered.ordered_matches(f, o, ["k"], by=["day", "more"], chunk=chunk).collect()), key=str) == want
