"""Cosine k-means: seeded centres, assignment in blocks, sums by centre."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.arrays import unit_rows


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T, axis=1)  # ties go to the first centre


def cosine_means(df: DataFrame, k: int, rounds: int = 20, seed: int = 0, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(key, cluster) of every row and the k unit centres.

    The first centres are the rows of the least seeded hash.  A round sums vectors by centre in
    each partition, so k sums a partition move; a centre that gets no row stays.  It ends when the
    assignment's sums stay the same or after ``rounds``.
    """
    rows = df.select(F.col(key).alias("key"), unit_rows(F.col(vector).cast("array<double>")).alias("v"))
    first = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(k).collect()  # k rows
    centres = np.array([r["v"] for r in first])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy())
            at = _nearest(x, centres)
            np.add.at(total, at, x)
            n += np.bincount(at, minlength=len(centres))
        yield pd.DataFrame({"cluster": np.arange(len(centres)), "n": n, "s": list(total)})

    before = None
    for _ in range(rounds if len(centres) else 0):
        parts = rows.mapInPandas(sums, "cluster int, n long, s array<double>").toPandas()  # k rows a partition
        n = parts.groupby("cluster")["n"].sum().to_numpy()
        total = np.stack([np.sum(np.stack(g.to_numpy()), axis=0) for _, g in parts.groupby("cluster")["s"]])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where((n[:, None] > 0) & (norm > 0), total / np.where(norm > 0, norm, 1), centres)
        if before is not None and np.array_equal(n, before[0]) and np.allclose(total, before[1], atol=1e-12):
            break
        before = n, total

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "cluster": _nearest(np.stack(pdf["v"].to_numpy()), centres).astype("i4")})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(label, f"key {kind}, cluster int").withColumnRenamed("key", key), centres
