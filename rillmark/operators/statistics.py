"""Kernel statistics, permutation tests, partition agreement and gates over small selections.

Inputs of the numpy functions are selected subsets (hundreds of rows), not corpora.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators.quantiles import quantiles


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if not np.isfinite(x).all() or (norm == 0).any():
        raise ValueError("vectors must be finite and not zero")
    return x / norm


def hsic(k: np.ndarray, m: np.ndarray) -> float:
    """Unbiased Hilbert-Schmidt independence criterion of two kernels of n >= 4 rows."""
    n = len(k)
    if n < 4:
        raise ValueError("four rows are needed")
    k, m = k - np.diag(np.diag(k)), m - np.diag(np.diag(m))
    whole = k.sum() * m.sum() / ((n - 1) * (n - 2)) - 2 * (k.sum(axis=0) @ m.sum(axis=0)) / (n - 2)
    return float(((k * m).sum() + whole) / (n * (n - 3)))


def cka(x: np.ndarray, y: np.ndarray) -> float:
    """Debiased linear centred kernel alignment."""
    k, m = x @ x.T, y @ y.T
    below = hsic(k, k) * hsic(m, m)
    if below <= 0:
        raise ValueError("a kernel does not vary")
    return hsic(k, m) / math.sqrt(below)


def permutation_test(spark: SparkSession, x: np.ndarray, y: np.ndarray, draws: int, seed: int) -> tuple[float, float]:
    """Observed alignment and p = (1 + draws at or above it) / (draws + 1); draws run in parallel."""
    seen = cka(x, y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [cka(x, y[np.random.default_rng([seed, int(i)]).permutation(len(y))]) for i in pdf["id"]]
            yield pd.DataFrame({"above": [sum(g >= seen for g in got)]})

    above = spark.range(draws).mapInPandas(run, "above long").agg(F.sum("above")).first()[0] or 0
    return seen, (1 + above) / (draws + 1)


def adjusted_mutual_information(left: Sequence, right: Sequence) -> float:
    """Mutual information above chance (hypergeometric), over the arithmetic mean of entropies."""
    n = len(left)
    a, b, c = Counter(left), Counter(right), Counter(zip(left, right, strict=True))
    if len(a) == len(b) == 1 or len(a) == len(b) == n:
        return 1.0
    entropy = lambda t: -sum(v / n * math.log(v / n) for v in t.values())
    mutual = sum(v / n * math.log(n * v / (a[x] * b[y])) for (x, y), v in c.items())
    log = math.lgamma
    chance = 0.0
    for p in a.values():
        for q in b.values():
            for k in range(max(1, p + q - n), min(p, q) + 1):
                ways = log(p + 1) + log(q + 1) + log(n - p + 1) + log(n - q + 1) - log(n + 1) - log(k + 1) - log(p - k + 1) - log(q - k + 1) - log(n - p - q + k + 1)
                chance += k / n * math.log(n * k / (p * q)) * math.exp(ways)
    top = (entropy(a) + entropy(b)) / 2
    return (mutual - chance) / (top - chance) if abs(top - chance) > 1e-15 else 1.0


def chance_adjusted_overlap(left: set, right: set, candidates: int) -> dict[str, float]:
    """Intersection, Jaccard, and overlap above that of random sets of the same size."""
    both, size = len(left & right), len(left)
    chance = size * len(right) / candidates
    most = min(size, len(right))
    return {"intersection": both, "jaccard": both / len(left | right) if left | right else 1.0, "adjusted": (both - chance) / (most - chance) if most != chance else 0.0}


def median_of_eight(values: Sequence[float]) -> float:
    if len(values) != 8 or not all(map(math.isfinite, values)):
        raise ValueError("eight finite values are needed")
    ordered = sorted(values)
    return (ordered[3] + ordered[4]) / 2


def subset_scores(vectors: DataFrame, subsets: DataFrame) -> DataFrame:
    """subset, vendi, n: diversity of each subset; vectors (vec_id, embedding), subsets (subset, vec_id)."""
    kind = subsets.schema["subset"].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(rows["embedding"].to_numpy()))
        eigen = np.linalg.eigvalsh(x.T @ x if x.shape[1] < len(x) else x @ x.T)
        p = eigen[eigen > 1e-12] / eigen[eigen > 1e-12].sum()
        return pd.DataFrame({"subset": rows["subset"].iloc[:1], "vendi": [float(np.exp(-(p * np.log(p)).sum()))], "n": [len(rows)]})

    return subsets.join(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id").select("subset", "embedding").groupBy("subset").applyInPandas(one, f"subset {kind}, vendi double, n long")


def null_schedules(spark: SparkSession, candidates: int, size: int, draws: int, seed: int) -> DataFrame:
    """(draw, position): ``draws`` uniform subsets, each from its own spawned stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed, spawn_key=(int(i),))))
                yield pd.DataFrame({"draw": int(i), "position": np.sort(rng.choice(candidates, size, replace=False))})

    return spark.range(draws).mapInPandas(run, "draw long, position long")


def gate(percentiles: dict[str, dict[int, float]], go: float = 0.95, stop: float = 0.5) -> str:
    """go where every metric of every seed reaches ``go``, no_go where a metric's all stay below ``stop``."""
    if all(v >= go for by in percentiles.values() for v in by.values()):
        return "go"
    return "no_go" if any(all(v < stop for v in by.values()) for by in percentiles.values()) else "borderline"


def cluster_sizes(labels: DataFrame, clusters: int) -> DataFrame:
    """Statistics of cluster sizes, empty clusters counted as zero."""
    counts = labels.sparkSession.range(clusters).withColumnRenamed("id", "label").join(labels.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    plain = counts.agg(F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.avg((F.col("n") == 1).cast("double")).alias("singletons"), (F.max("n") / F.sum("n")).alias("largest"))
    met = _with_quantiles(plain, counts, "n", [0.5, 0.9, 0.99])
    return met.select("least", F.col("q")[0].alias("median"), "mean", F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"), "most", "singletons", "largest")


def _with_quantiles(row: DataFrame, df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """The one row of an aggregate and ``q``, the exact quantiles of a column, null if there are none."""
    q = quantiles(df, [], column, shares).select("q", F.lit(0).alias("__one"))
    return row.withColumn("__one", F.lit(0)).join(q, "__one", "left").drop("__one")


def nearest_rank(values: Sequence[float], q: float) -> float:
    ordered = sorted(values)
    return ordered[max(0, math.ceil(q * len(ordered)) - 1)]


def length_summary(df: DataFrame, column: str) -> DataFrame:
    points = [0.5, 0.9, 0.95, 0.99, 0.999]
    plain = df.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.avg(column).alias("mean"), F.max(column).alias("most"))
    out = _with_quantiles(plain, df, column, points)
    return out.select("n", "least", "mean", *[F.col("q")[i].alias(f"p{100 * p:g}".replace(".", "_")) for i, p in enumerate(points)], "most")


def weighted_resample(df: DataFrame, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement in proportion to ``weight``: each draw falls in a row's stretch
    of the running total, found by a join on equal slices of that total."""
    from rillmark.operators.batch import number_rows
    from rillmark.operators.routing import running_total

    rows = running_total(number_rows(df, *df.columns).where(F.col(weight) > 0), "row_id", weight, "__from")
    total = df.agg(F.sum(F.when(F.col(weight) > 0, F.col(weight)))).first()[0] or 0.0
    if not total:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    width = total / n
    slot = lambda x: F.floor(x / F.lit(width)).cast("long")
    stretch = rows.withColumn("__to", F.col("__from") + F.col(weight)).withColumn("__slot", F.explode(F.sequence(slot(F.col("__from")), slot(F.col("__to")))))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(1 << 53)) * F.lit(total)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), u.alias("__u")).withColumn("__slot", slot(F.col("__u")))
    met = draws.join(stretch, "__slot").where((F.col("__u") >= F.col("__from")) & (F.col("__u") < F.col("__to")))
    return met.select(*df.columns, "draw")


def greedy_cover(df: DataFrame, task: str, test: str, item: str) -> DataFrame:
    """Per task, tests in the order picked: the one that covers most of what is left (ties: first)."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (task, test)}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        covers = {t: set(g[item]) for t, g in rows.groupby(test)}
        left, picked = set(rows[item]), []
        while left:
            best = max(sorted(covers), key=lambda t: len(covers[t] & left))
            picked.append(best)
            left -= covers.pop(best)
        return pd.DataFrame({task: rows[task].iloc[0], test: picked, "place": range(len(picked))})

    return df.select(task, test, item).groupBy(task).applyInPandas(one, f"{task} {kinds[task]}, {test} {kinds[test]}, place int")


def adaptive_segments(df: DataFrame, key: str, value: str, base: float, weight: float) -> DataFrame:
    """Add ``segment``: per key, in falling order, cut where the relative gap exceeds base + sqrt(weight / x)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(value))
    before = F.lag(value).over(w)
    cut = ((before - F.col(value)) / before > F.lit(base) + F.sqrt(F.lit(weight) / before)).cast("int")
    return df.withColumn("__cut", F.coalesce(cut, F.lit(0))).withColumn("segment", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")


def differential_score(samples: DataFrame, references: DataFrame) -> DataFrame:
    """task, score, norm: 100 x share of references, fast to slow, that a sample is at least as fast as.

    samples (task, cost), references (task, place, cost); place 0 is the slowest.
    """
    n = references.groupBy("task").agg(F.count("*").alias("__n"))
    met = samples.join(references.select("task", "place", F.col("cost").alias("__r")), "task").where(F.col("cost") <= F.col("__r"))
    best = met.groupBy("task").agg((F.max("place") + 1).alias("__j"))
    return samples.select("task").distinct().join(n, "task").join(best, "task", "left").select("task", (F.lit(100.0) * F.coalesce("__j", F.lit(0)) / F.col("__n")).alias("norm"))
