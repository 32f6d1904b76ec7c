"""Minimum covers of many tasks at once by the greedy rule, in rounds over edges (task, test, item).

The greedy rule takes, one at a time, the test that covers most of what is left (ties: the first by
name).  A test that is ahead of every test it shares an item with keeps its count until it is
taken, whatever is taken elsewhere, so all such tests are taken in one round, of all tasks
together; the result is the sequential one's.  A task whose edges fit a group is finished there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.operators.batch import number_rows
from rillmark.sources.staging import joined_by_count, staged

EDGE = ["task", "test", "item"]
#: A task with so many edges left at most is finished in one group.
GROUP = 100_000
PAIR, SPOT = ("task", "test"), ("task", "item")


def cover_edges(df: DataFrame, task: str, test: str, source: str, item: Column, excluded: str | None = None) -> DataFrame:
    """task, test, item of what each test shows, an item being a pair (source, what it shows).

    The same finding at two sources (models, files) is two items.  Sources whose name contains
    ``excluded`` are left out, and so are rows with a null.
    """
    rows = df.select(F.col(task).alias("task"), F.col(test).alias("test"), F.col(source).alias("source"), item.alias("found")).dropna()
    if excluded is not None:
        rows = rows.where(~F.col("source").contains(excluded))
    return rows.select("task", "test", F.struct("source", "found").alias("item")).distinct()


def greedy_covers(edges: DataFrame) -> DataFrame:
    """task, test, place (from 0 within the task), gain (items it covers first) of the tests taken.

    ``edges`` has (task, test, item); repeated edges count once, rows with a null take no part.
    Tasks of more than ``GROUP`` edges go through rounds, each of which ends with a written table of
    the edges left, until few enough are left of them; there are as many rounds at most as the
    longest chain of tests that each wait for the one ahead.
    """
    left = staged(edges.select(*EDGE).dropna().distinct())
    taken: list[DataFrame] = []
    while total := left.count():
        sizes = staged(left.groupBy("task").agg(F.count("*").alias("size")))
        sized = staged(joined_by_count(left, sizes, "task", "size", total, "size"))
        taken.append(_finished(sized.where(F.col("size") <= GROUP).select(*EDGE)))
        left = sized.where(F.col("size") > GROUP).select(*EDGE)
        if total := left.count():
            picked, left = _round(left, total)
            taken.append(picked)
    if not taken:
        return edges.select("task", "test", F.lit(0).alias("place"), F.lit(0).cast("long").alias("gain")).limit(0)
    return ordered(staged(union(taken)))


def _round(left: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(task, test, gain of the tests that are ahead wherever they are, the edges left after them)."""
    marked = left.withColumn("pair", F.struct(*PAIR))
    gains = staged(marked.groupBy("pair").agg(F.count("*").alias("gain")))
    weighed = joined_by_count(marked, gains, "pair", "gain", total, "gain")
    ahead = weighed.groupBy(F.struct(*SPOT).alias("spot")).agg(F.min(F.struct((-F.col("gain")).alias("g"), "pair")).alias("first"), F.count("*").alias("edges"))
    ahead = staged(ahead.select("spot", F.col("first.pair").alias("pair"), "edges"))
    leads = ahead.groupBy("pair").agg(F.count("*").alias("leads"))
    picked = staged(leads.join(gains, "pair").where("leads = gain").select("pair", "gain"))
    covered = joined_by_count(ahead, picked.withColumnRenamed("gain", "won"), "pair", "won", total, "won").where("won IS NOT NULL")
    rest = joined_by_count(left.withColumn("spot", F.struct(*SPOT)), covered, "spot", "edges", total, "won").where("won IS NULL")
    return picked.select("pair.task", "pair.test", "gain"), staged(rest.select(*EDGE))


def _finished(left: DataFrame) -> DataFrame:
    """task, test, gain of the tests taken, each task's edges (a bounded number) in one group."""
    kinds = {c: left.schema[c].dataType.simpleString() for c in PAIR}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        names, test = np.unique(rows["test"].to_numpy(), return_inverse=True)
        item = pd.factorize(rows["code"])[0]
        open_ = np.ones(item.max() + 1, bool)
        picked: list[tuple[int, int]] = []
        while open_.any():
            counts = np.bincount(test[open_[item]], minlength=len(names))
            best = int(counts.argmax())  # the first of equal ones
            picked.append((best, int(counts[best])))
            open_[item[test == best]] = False
        return pd.DataFrame({"task": rows["task"].iloc[0], "test": names[[p for p, _ in picked]], "gain": [g for _, g in picked]})

    coded = left.select("task", "test", F.to_json(F.struct("item")).alias("code"))
    return coded.groupBy("task").applyInPandas(one, f"task {kinds['task']}, test {kinds['test']}, gain long")


def union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def ordered(picked: DataFrame) -> DataFrame:
    """Add ``place``: falling gains, names among equal ones, which is the order of the greedy rule."""
    numbered = number_rows(picked, "task", F.desc("gain"), "test")
    starts = staged(numbered.groupBy("task").agg(F.min("row_id").alias("start"), F.count("*").alias("tests")))
    placed = joined_by_count(numbered, starts, "task", "tests", picked.count(), "start")
    return placed.select("task", "test", (F.col("row_id") - F.col("start")).cast("int").alias("place"), "gain")


def merged_covers(covers: Sequence[DataFrame]) -> DataFrame:
    """task, test, source (place among ``covers`` of the first cover that has it), place (there)."""
    each = [c.select("task", "test", F.lit(i).alias("source"), "place") for i, c in enumerate(covers)]
    first = union(each).groupBy("task", "test").agg(F.min(F.struct("source", "place")).alias("f"))
    return first.select("task", "test", "f.source", "f.place")


def average_tests(base: DataFrame, cover: DataFrame) -> DataFrame:
    """average: tests a task has on average, its base tests (task, n_base) and those of its cover; tasks without a cover count."""
    extra = cover.groupBy("task").agg(F.count("*").alias("extra"))
    n = F.col("n_base") + F.coalesce("extra", F.lit(0))
    return base.join(extra, "task", "left").agg(F.avg(n).alias("average"), F.count("*").alias("tasks"))
