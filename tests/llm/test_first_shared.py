"""A family of copies with many words of their own: who meets whom, and what is kept, against all pairs."""

import random

from pyspark.sql import functions as F

from rillmark.llm import simhash, storage
from test_near_copies import edited, kept_by_all_pairs


def family(rng, sizes):
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    return [" ".join(edited(rng, words, n)) for n in sizes]


def met(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    reps = simhash.sketched(docs).select(F.col("__row").alias("row"), F.col("__size").alias("size"), F.col("__prefix").alias("prefix"))
    scratch = storage.Scratch(spark)
    shared = scratch.staged(simhash.shared_prefixes(reps), "shared").withColumnRenamed("row", "root").withColumn("row", F.col("root"))
    filed = scratch.staged(shared.withColumn("weight", F.lit(1)), "filed")
    return filed, [tuple(r) for r in simhash.meetings(filed, filed.count(), simhash.SIMILARITY, True, scratch).collect()]


def test_copies_that_differ_too_much_do_not_meet(spark):
    """Five edits each: they share shingles in their prefixes, but too few are left for any pair."""
    texts = family(random.Random(1), [5] * 60)
    filed, pairs = met(spark, texts)
    assert filed.groupBy("key").count().agg(F.max("count")).first()[0] >= 30
    assert pairs == []


def test_a_mixed_family_against_all_pairs(spark):
    """Few and many edits, copies of copies, shorter ones: the same rows stay as by all pairs."""
    rng = random.Random(2)
    texts = family(rng, [rng.randrange(1, 6) for _ in range(80)])
    texts += [" ".join(edited(rng, rng.choice(texts).split(), rng.randrange(3))) for _ in range(40)]
    texts += [" ".join(rng.choice(texts).split()[rng.randrange(30) :]) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicated(docs).collect()} == kept_by_all_pairs(texts)
