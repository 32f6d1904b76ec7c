"""Texts that repeat are read once, not once a row."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillmark.functions import grading
from rillmark.functions.algebra import keyed
from rillmark.operators import equivalence


@pytest.mark.parametrize("most", [equivalence.BROADCAST_TEXTS, 0])
def test_keys_come_by_joins_and_not_by_reading_each_row(spark, most):
    """A text with a third of the rows, nulls, texts that cannot be read or are too long; forms broadcast, and joined by text."""
    texts = [None, "", "x+", "1/2", "0.5", "\\sqrt{x}", "a" * 2000, "\\{1,2\\}"]
    rows = [(i, "2/4" if i % 3 == 0 else texts[i % len(texts)], texts[i // 3 % len(texts)]) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, one string, two string")
    out = equivalence.with_keys(df, "one", "two", most=most)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    want = [repr((*r, *keyed(r[1]), *keyed(r[2]))) for r in rows]
    got = out.select("i", "one", "two", "one_key", "one_near", "two_key", "two_near").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(want)


def test_keys_of_numbers(spark):
    got = equivalence.with_keys(spark.range(3).withColumn("two", F.col("id").cast("double")), "id", "two").collect()
    assert len(got) == 3 and all(r["id_key"] == r["two_key"] and r["id_near"] == r["two"] for r in got)


def test_code_is_parsed_once_a_different_text(monkeypatch):
    calls = []
    texts = pd.Series(["a", None, "b", "a", None] * 100)
    assert grading.each_once(texts, lambda t: calls.append(t) or f"<{t}>").tolist() == ["<a>", "<None>", "<b>", "<a>", "<None>"] * 100 and len(calls) == 3
    one = grading._failing_line
    monkeypatch.setattr(grading, "_failing_line", lambda code: calls.append(code) or one(code))
    calls.clear()
    assert grading.longest_code("no code here\nx = 1\ny = 2\nor here, no\nnor there") == "x = 1\ny = 2" and len(calls) == 4


@pytest.mark.parametrize("text,code", [("(a\n + b) = 3\nx = 1\ny = 2", "x = 1\ny = 2"), ("x = '''\n1\ny = 2\n3", "1\ny = 2\n3"), ("if x:\n    y = 1\nelse\nz", "if x:\n    y = 1"), ("x = 1\ny = (2\n", "x = 1"), ("a = \\\n= 3\nb = 1\nc", "b = 1\nc"), (None, "")])
def test_errors_that_rule_out_runs(text, code):
    assert grading.longest_code(text).strip("\n") == code
