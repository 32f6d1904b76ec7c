"""Answers compared and grouped by what they mean.

Sampled answers repeat, so every different text is read once, however many rows have it: the texts are
counted, their normal forms made side by side and joined back to the rows.  Everything after that is
equality of keys, so grouping and joining by meaning are ordinary aggregations and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.algebra import LONGEST, answer_key
from rillmark.sources.staging import joined_by_count, staged

#: Forms of so many texts and characters at most are broadcast; more are joined by text, the frequent ones apart.
BROADCAST_TEXTS, BROADCAST_CHARS = 200_000, 24_000_000


def read_texts(rows: DataFrame, *columns: str) -> DataFrame:
    """text, n (how often the columns have it), form (key, near) of the different texts that can be read; on disk."""
    texts = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("text"))
    counted = texts.where(F.length("text") <= LONGEST).groupBy("text").agg(F.count("*").alias("n"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    formed = staged(counted.repartition(tasks).select("text", "n", answer_key("text").alias("form")))  # a filter before it is written would read the texts twice
    near = F.col("form.near")
    return formed.where("form.key IS NOT NULL").select("text", "n", F.struct(F.col("form.key").alias("key"), F.when(~F.isnan(near), near).alias("near")).alias("form"))


def with_keys(rows: DataFrame, *columns: str, most: int = BROADCAST_TEXTS) -> DataFrame:
    """``rows`` and, for each column c of texts, c_key (null if it cannot be read) and c_near (a constant's number).

    ``rows`` are gone through twice, so they must be the same each time.
    """
    known = read_texts(rows, *columns)
    texts, chars, total = known.agg(F.count("*"), F.sum(F.length("text") + F.length("form.key")), F.sum("n")).first()
    out = rows
    for c in columns:
        form = f"__{c}_form"
        if texts <= most and (chars or 0) <= BROADCAST_CHARS:
            table = known.select(F.col("text").alias(f"__{c}_text"), F.col("form").alias(form))
            out = out.join(F.broadcast(table), F.col(c).cast("string") == F.col(f"__{c}_text"), "left").drop(f"__{c}_text")
        else:
            table = known.select(F.col("text").alias(f"__{c}_text"), F.col("n").alias("__n"), F.col("form").alias(form))
            asked = out.withColumn(f"__{c}_text", F.col(c).cast("string"))
            out = joined_by_count(asked, table, f"__{c}_text", "__n", total, form).drop(f"__{c}_text")
    for c in columns:
        form = f"__{c}_form"
        out = out.withColumns({f"{c}_key": F.col(f"{form}.key"), f"{c}_near": F.col(f"{form}.near")}).drop(form)
    return out


def same_answer(one: str, other: str, tolerance: float = 1e-4) -> Column:
    """Whether two columns of a table ``with_keys`` agree: as text, by key, or as numbers within the tolerance.

    False where either is null.
    """
    a, b, x, y = F.col(one), F.col(other), F.col(f"{one}_near"), F.col(f"{other}_near")
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    close = F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y))
    tests = plain(a) == plain(b), F.col(f"{one}_key") == F.col(f"{other}_key"), close
    return F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False)) | F.coalesce(tests[2], F.lit(False))


def answer_classes(rows: DataFrame, group: str, answer: str) -> DataFrame:
    """group, key, votes and the least writing of every class of equal answers in a group.

    An answer that cannot be read is a class with those of the same text; null answers have no vote.
    """
    keyed = with_keys(rows.select(group, answer).where(F.col(answer).isNotNull()), answer)
    key = F.coalesce(F.col(f"{answer}_key"), F.concat(F.lit("text "), F.trim(F.col(answer))))
    return keyed.groupBy(group, key.alias("key")).agg(F.count("*").alias("votes"), F.min(answer).alias("writing"))


def majority_answer(rows: DataFrame, group: str, answer: str) -> DataFrame:
    """group, writing, votes, classes: the class of most votes, of those the one with the least writing.

    Two grouped aggregations and no window: a group's classes are never gathered.
    """
    best = F.min(F.struct((-F.col("votes")).alias("less"), F.col("writing"))).alias("best")
    out = answer_classes(rows, group, answer).groupBy(group).agg(best, F.count("*").alias("classes"))
    return out.select(group, F.col("best.writing").alias("writing"), (-F.col("best.less")).alias("votes"), "classes")


def reward_by_meaning(responses: DataFrame, truths: DataFrame, key: str, answer: str, truth: str) -> DataFrame:
    """The columns of ``responses`` with reward: 1 where the answer agrees with its problem's truth, else 0 (also without one)."""
    one = with_keys(truths.select(key, truth), truth)
    asked = with_keys(responses, answer).join(one.hint("shuffle_hash"), key, "left")
    return asked.select(*responses.columns, same_answer(answer, truth).cast("double").alias("reward"))
