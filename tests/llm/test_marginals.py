"""What the mixture keeps against its targets."""

import pytest

from rillmark.llm import mixture


def test_kept_tokens_meet_targets_when_cells_are_full(spark):
    sizes = {("a", "en"): 60, ("a", "fr"): 10, ("b", "en"): 20, ("b", "fr"): 10}
    rows = [(i, "w " * 10, lang, source, "t") for (source, lang), n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.65, "fr": 0.35}, "topic": {"t": 1.0}}
    got = mixture.marginals(mixture.mix(docs, targets), targets).collect()
    assert all(r["expected"] == pytest.approx(r["target"], abs=1e-4) for r in got), got


def test_targets_beyond_what_there_is_are_cut(spark):
    rows = [(i, "w " * 10, "en", s, "t") for s, n in (("a", 5), ("b", 45), ("c", 50)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    targets = {"source": {"a": 0.5, "b": 0.2, "c": 0.3}}
    got = {r["category"]: r for r in mixture.marginals(mixture.mix(docs, targets), targets).collect() if r["axis"] == "source"}
    assert [round(got[c]["expected"], 6) for c in "abc"] == [0.1, 0.36, 0.54] == [round(got[c]["reachable"], 6) for c in "abc"]
