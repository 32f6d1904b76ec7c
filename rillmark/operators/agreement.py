"""Agreement of many labellings and overlap of many selections, all pairs of runs in one plan.

A row's labels meet once, in an array as long as there are runs; a pair of runs is then a sparse
contingency table of counts.  Everything after it reads counts, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.operators.quantiles import quantiles

PAIR = ["left", "right"]
#: Distinct cluster sizes of one side are dealt to so many groups of a pair.
SLICES = 16


def _pairs(rows: Column) -> Column:
    """All (x, y) of a sorted array with x before y."""
    return F.flatten(F.transform(rows, lambda x, i: F.transform(F.slice(rows, i + 2, F.size(rows)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def contingency(labels: DataFrame) -> DataFrame:
    """left, right, a, b, c: rows that run ``left`` labels a and run ``right`` labels b, left < right.

    ``labels`` has (run, row, label); a row repeated in a run counts once, with its least label; null
    runs, rows and labels take no part; a row counts for a pair if both its runs label it.
    """
    known = labels.select("run", "row", "label").dropna()
    once = known.groupBy("row", "run").agg(F.min("label").alias("label"))
    met = once.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("r"))  # as long as there are runs
    pair = met.select(F.explode(_pairs(F.col("r"))).alias("p"))
    return pair.groupBy(F.col("p.x.run").alias("left"), F.col("p.y.run").alias("right"), F.col("p.x.label").alias("a"), F.col("p.y.label").alias("b")).agg(F.count("*").alias("c"))


def chance_information(p: int, q: int, n: int) -> float:
    """Expected share of mutual information of one cell whose marginals are p and q of n rows.

    The hypergeometric weights come from their ratios outwards from the mode and are normalised, so
    no large factorials cancel; weights further than 12 deviations and 40 from the mode are below
    the precision of a double.
    """
    low, high = max(0, p + q - n), min(p, q)
    mode = min(max((p + 1) * (q + 1) // (n + 2), low), high)
    reach = int(12 * np.sqrt(p * q / n * (1 - p / n) * (1 - q / n) * n / max(1, n - 1))) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    up = np.log((p - k[:-1]) * (q - k[:-1]) / ((k[:-1] + 1) * (n - p - q + k[:-1] + 1)))
    w = np.concatenate([[0.0], np.cumsum(up)])
    w = np.exp(w - w.max())
    some = k > 0
    return float((w[some] * k[some] / n * np.log(n * k[some] / (float(p) * q))).sum() / w.sum())


def _expected(a: DataFrame, b: DataFrame) -> DataFrame:
    """left, right, emi from how many clusters have which size on both sides.

    n rows have at most sqrt(2n) distinct cluster sizes, so the pairs of sizes are 2n at most.
    """
    sizes = lambda m, size, many: m.groupBy(*PAIR, "n", F.col("m").alias(size)).agg(F.count("*").alias(many))
    mine = sizes(a, "p", "mp").withColumn("slice", F.pmod(F.xxhash64("p"), F.lit(SLICES)).cast("int"))
    theirs = sizes(b, "q", "mq").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).drop("n")
    met = mine.join(theirs, [*PAIR, "slice"]).select(*PAIR, "n", "p", "mp", "q", "mq")
    kinds = {c: met.schema[c].dataType.simpleString() for c in PAIR}

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [mp * mq * chance_information(int(p), int(q), int(n)) for n, p, mp, q, mq in zip(pdf["n"], pdf["p"], pdf["mp"], pdf["q"], pdf["mq"], strict=True)]
            yield pdf[PAIR].assign(e=each).groupby(PAIR, as_index=False)["e"].sum()

    return met.mapInPandas(terms, f"left {kinds['left']}, right {kinds['right']}, e double").groupBy(*PAIR).agg(F.sum("e").alias("emi"))


def agreements(labels: DataFrame) -> DataFrame:
    """left, right, n, ari, ami of every two runs that label rows in common, left < right.

    ``ari`` is the adjusted Rand index, ``ami`` the mutual information above chance over the mean of
    the entropies above it; both are 1 where no other value is defined (one cluster on both sides,
    or singletons alone).  ``labels``: as for ``contingency``.
    """
    cells = contingency(labels)
    two = lambda c: F.sum(c * (c - 1.0) / 2)
    log = lambda c: F.sum(c * F.log(c))
    whole = cells.groupBy(*PAIR).agg(F.sum("c").alias("n"), two(F.col("c")).alias("t"), log(F.col("c")).alias("lt"))
    marginal = {}
    for side in "ab":
        marginal[side] = cells.groupBy(*PAIR, side).agg(F.sum("c").alias("m")).join(whole.select(*PAIR, "n"), PAIR)
        sums = marginal[side].groupBy(*PAIR).agg(F.count("*").alias(f"k{side}"), two(F.col("m")).alias(f"s{side}"), log(F.col("m")).alias(f"l{side}"))
        whole = whole.join(sums, PAIR)
    all_of = whole.join(_expected(marginal["a"], marginal["b"]), PAIR)
    c = F.col
    chance = c("sa") * c("sb") / F.greatest(c("n") * (c("n") - 1.0) / 2, F.lit(1.0))
    room = (c("sa") + c("sb")) / 2 - chance
    ari = F.when(F.abs(room) < 1e-12, 1.0).otherwise((c("t") - chance) / room)
    entropy = lambda total: F.log("n") - total / c("n")
    mutual = entropy(c("la")) + entropy(c("lb")) - entropy(c("lt"))
    above = (entropy(c("la")) + entropy(c("lb"))) / 2 - c("emi")
    trivial = (c("ka") == c("kb")) & c("ka").isin(1) | (c("ka") == c("n")) & (c("kb") == c("n"))
    ami = F.when(trivial | (F.abs(above) < 1e-15), 1.0).otherwise((mutual - c("emi")) / above)
    return all_of.select(*PAIR, "n", ari.alias("ari"), ami.alias("ami"))


def overlaps(selected: DataFrame, candidates: int) -> DataFrame:
    """left, right, n_left, n_right, intersection, jaccard, adjusted of every two runs of ``selected`` (run, row).

    ``adjusted`` is the overlap above that of random selections of the same sizes among
    ``candidates``, over the most there can be above it (0 where there is no room).  Repeated rows count once; nulls take no part;
    pairs without a row in common are there too.
    """
    once = selected.select("run", "row").dropna().distinct()
    sizes = once.groupBy("run").agg(F.count("*").alias("n"))  # one row a run
    pairs = sizes.agg(F.array_sort(F.collect_list(F.struct("run", "n"))).alias("r")).select(F.explode(_pairs(F.col("r"))).alias("p"))
    pairs = pairs.select(F.col("p.x.run").alias("left"), F.col("p.y.run").alias("right"), F.col("p.x.n").alias("n_left"), F.col("p.y.n").alias("n_right"))
    met = once.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("run"))).alias("r")).select(F.explode(_pairs(F.col("r"))).alias("p"))
    both = met.groupBy(F.col("p.x.run").alias("left"), F.col("p.y.run").alias("right")).agg(F.count("*").alias("intersection"))
    out = pairs.join(both, PAIR, "left").withColumn("intersection", F.coalesce("intersection", F.lit(0)).cast("long"))
    c = F.col
    chance = c("n_left") * c("n_right") / F.lit(float(candidates))
    room = F.least("n_left", "n_right") - chance
    return out.withColumn("jaccard", c("intersection") / (c("n_left") + c("n_right") - c("intersection"))).withColumn("adjusted", F.when(F.abs(room) < 1e-12, 0.0).otherwise((c("intersection") - chance) / room))


def run_sizes(labels: DataFrame) -> DataFrame:
    """run, clusters, rows, least, median, p90, p99, most, singletons (share) of the clusters each run fills."""
    sizes = labels.select("run", "row", "label").dropna().groupBy("run", "label").agg(F.count("*").alias("n"))
    plain = sizes.groupBy("run").agg(F.count("*").alias("clusters"), F.sum("n").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg((F.col("n") == 1).cast("double")).alias("singletons"))
    q = quantiles(sizes, ["run"], "n", [0.5, 0.9, 0.99]).select("run", *[F.col("q")[i].alias(name) for i, name in enumerate(("median", "p90", "p99"))])
    return plain.join(q, "run")
