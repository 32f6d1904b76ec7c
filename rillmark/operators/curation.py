"""Data curation: decontamination, provenance, apportionment, strata, coverage and set comparisons."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.arrays import unit_rows, windows
from rillmark.functions.text import decontamination_tokens
from rillmark.sources.staging import spread

GRAM = 10
GROUP_BLOCKS = 8


def grams(df: DataFrame, key: str, text: str, n: int = GRAM) -> DataFrame:
    """(key, gram): SHA-256 of every run of n tokens, joined by the unit separator."""
    runs = windows(decontamination_tokens(F.col(text)), n)
    return spread(df.select(key, text)).select(key, F.explode(F.transform(runs, lambda g: F.sha2(F.array_join(g, "\u001f"), 256))).alias("gram"))


def contaminated(train: DataFrame, bench: DataFrame, n: int = GRAM, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """key, exact, first_item: rows that equal a benchmark text when folded or share an n-gram.

    The benchmark's distinct grams are joined with the corpus's; a gram that many documents hold
    makes a skewed but one-sided equi-join.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    hits = grams(train, key, text, n).join(grams(bench, item, text, n).groupBy("gram").agg(F.min(item).alias("item")), "gram").groupBy(key).agg(F.min("item").alias("gram_item"))
    same = train.select(key, F.sha2(fold(F.col(text)), 256).alias("h")).join(bench.select(F.sha2(fold(F.col(text)), 256).alias("h"), F.col(item).alias("i")).groupBy("h").agg(F.min("i").alias("exact_item")), "h").groupBy(key).agg(F.min("exact_item").alias("exact_item"))
    return hits.join(same, key, "full").select(key, F.col("exact_item").isNotNull().alias("exact"), F.least("gram_item", "exact_item").alias("first_item"))


def clean(train: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    return train.join(found.select(key), key, "left_anti")


def first_of_each(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, by order: deterministic where dropDuplicates is not."""
    rest = [c for c in df.columns if c not in keys]
    least = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return least.select(*keys, "__r.*").select(*df.columns)


def key_coverage(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing, unexpected or repeated, with what is wrong; empty if all is well."""
    a, e = actual.groupBy(*keys).agg(F.count("*").alias("__a")), expected.groupBy(*keys).agg(F.count("*").alias("__e"))
    both = a.join(e, list(keys), "full")
    wrong = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when((F.col("__a") > 1) | (F.col("__e") > 1), "repeated")
    return both.withColumn("problem", wrong).where("problem IS NOT NULL").select(*keys, "problem")


def quartiles(df: DataFrame, total: int, order: Sequence[str]) -> DataFrame:
    """Add quartile: floor(4 x place / total) in the given order."""
    from rillmark.operators.batch import number_rows

    return number_rows(df, *order).withColumn("quartile", F.floor(F.lit(4) * F.col("row_id") / F.lit(total)).cast("int")).drop("row_id")


def apportion(strata: DataFrame, total: int, key: str = "stratum", weight: str = "weight", capacity: str | None = None) -> DataFrame:
    """Largest-remainder shares of ``total``; ties go to the lesser key; capacities hold.

    Strata are few and are worked on the driver; what a full stratum cannot take is shared again.
    """
    rows = strata.select(key, F.col(weight).cast("double").alias("w"), (F.col(capacity) if capacity else F.lit(None)).cast("long").alias("c")).orderBy(key).limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("strata are expected to be few")
    given = {r[key]: 0 for r in rows}
    room = {r[key]: r["c"] if r["c"] is not None else total for r in rows}
    weights = {r[key]: r["w"] for r in rows}
    left = min(total, sum(room.values()))
    while left:
        open_ = [k for k in given if given[k] < room[k] and weights[k] > 0] or [k for k in given if given[k] < room[k]]
        whole = sum(weights[k] for k in open_)
        ideal = {k: left * (weights[k] / whole if whole else 1 / len(open_)) for k in open_}
        share = {k: int(ideal[k]) for k in open_}
        for k in sorted(open_, key=lambda k: (-(ideal[k] - share[k]), k))[: left - sum(share.values())]:
            share[k] += 1
        for k, n in share.items():
            n = min(n, room[k] - given[k])
            given[k] += n
            left -= n
    kind = strata.schema[key].dataType.simpleString()
    return strata.sparkSession.createDataFrame(list(given.items()), f"{key} {kind}, allocated long")


def stratified_draw(df: DataFrame, stratum: str, shares: DataFrame, seed: int, row: str) -> DataFrame:
    """As many rows of each stratum as ``shares`` allocates: those with the least seeded hash."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(row), F.lit(seed)), row)))
    return ranked.join(shares, stratum).where(F.col("__r") <= F.col("allocated")).drop("__r", "allocated")


def round_robin(df: DataFrame, cluster: str, target: int, seed: int, row: str) -> DataFrame:
    """``target`` rows, one of each cluster a round, in seeded orders within and between clusters."""
    turn = F.row_number().over(Window.partitionBy(cluster).orderBy(F.xxhash64(F.col(row), F.lit(seed)), row))
    ordered = df.withColumn("round", turn)
    return ordered.orderBy("round", F.xxhash64(F.col(cluster), F.col("round"), F.lit(seed)), cluster).limit(target)


def coverage(heldout: DataFrame, selected: DataFrame, block: int = 2048, others: bool = False) -> DataFrame:
    """Mean over held-out vectors of the greatest cosine to a selected one; with ``others``, of another vec_id.

    Both sides travel as blocks of bytes of ``block`` rows at most; a held-out block and a selected
    one meet once, by an equi-join on a group of ``GROUP_BLOCKS`` selected blocks.
    """

    def gather(batches):
        ids: list = []
        held: list = []
        for pdf in batches:
            ids += pdf["vec_id"].tolist()
            held += pdf["v"].tolist()
            while len(held) >= block:
                yield pd.DataFrame({"of": [np.array(ids[:block], np.int64).tobytes()], "data": [np.array(held[:block]).tobytes()]})
                ids, held = ids[block:], held[block:]
        if held:
            yield pd.DataFrame({"of": [np.array(ids, np.int64).tobytes()], "data": [np.array(held).tobytes()]})

    def blocks(df: DataFrame) -> DataFrame:
        return df.select("vec_id", unit_rows(F.col("embedding").cast("array<double>")).alias("v")).mapInPandas(gather, "of binary, data binary")

    groups = -(-max(1, -(-selected.count() // block)) // GROUP_BLOCKS)
    against = blocks(selected).withColumn("part", F.pmod(F.xxhash64("of"), F.lit(groups)))
    asked = blocks(heldout).select(F.col("of").alias("ids"), F.col("data").alias("vs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))

    def best(batches):
        for pdf in batches:
            for ids, vs, of, data in zip(pdf["ids"], pdf["vs"], pdf["of"], pdf["data"], strict=True):
                mine, theirs = np.frombuffer(ids, np.int64), np.frombuffer(of, np.int64)
                sims = np.frombuffer(vs).reshape(len(mine), -1) @ np.frombuffer(data).reshape(len(theirs), -1).T
                if others:
                    sims[mine[:, None] == theirs] = -np.inf
                yield pd.DataFrame({"vec_id": mine, "best": sims.max(axis=1)})

    met = asked.join(against.hint("merge"), "part").select("ids", "vs", "of", "data").mapInPandas(best, "vec_id long, best double")
    return met.groupBy("vec_id").agg(F.max("best").alias("best")).where(F.col("best") > F.lit(float("-inf"))).agg(F.avg("best").alias("coverage"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes, intersection and Jaccard index of two sets of keys."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), (F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / F.count("*")).alias("jaccard"))


def rand_index(df: DataFrame, left: str, right: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(left, right).agg(F.count("*").alias("c"))
    a = cells.groupBy(left).agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("a"))
    b = cells.groupBy(right).agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("b"))
    t = cells.agg(pairs(F.col("c")).alias("t"), F.sum("c").alias("n"))
    chance = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2)
    return t.crossJoin(a).crossJoin(b).select(((F.col("t") - chance) / ((F.col("a") + F.col("b")) / 2 - chance)).alias("ari"))


def vendi(df: DataFrame, column: str = "embedding") -> float:
    """exp of the entropy of the normalised eigenvalues of X'X: a d x d matrix summed by partition."""

    def moments(batches):
        total = None
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy())
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    rows = df.select(unit_rows(F.col(column).cast("array<double>")).alias("v")).mapInPandas(moments, "i int, row array<double>")
    d = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # d^2 numbers
    n = max((r["i"] for r in d), default=-1) + 1
    m = np.zeros((n, n))
    for r in d:
        m[r["i"], r["j"]] = r["x"]
    eigen = np.linalg.eigvalsh(m)
    p = eigen[eigen > 0] / eigen[eigen > 0].sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def ordered_match(filtered: Sequence[tuple], original: Sequence[tuple]) -> list[int]:
    """For each filtered (question, answer) the place of its match in ``original``, in order.

    Greedy from the front and from the back must give the same places, else the match is ambiguous.
    """
    forward, at = [], 0
    for row in filtered:
        while at < len(original) and original[at] != row:
            at += 1
        if at == len(original):
            raise ValueError("answer mismatch" if any(o[0] == row[0] for o in original) else "no original question match")
        forward.append(at)
        at += 1
    backward, at = [], len(original) - 1
    for row in reversed(filtered):
        while original[at] != row:
            at -= 1
        backward.append(at)
        at -= 1
    if forward != backward[::-1]:
        raise ValueError("ambiguous ordered original match")
    return forward


def seeded_choice(n: int, size: int, seed: int) -> list[int]:
    return sorted(random.Random(seed).sample(range(n), size))
