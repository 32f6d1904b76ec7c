"""Balanced partitions and micro-batches of sequences by length."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def workload(length: Column) -> Column:
    """Cost of a sequence: a linear and a quadratic share."""
    return F.lit(24576) * length + length * length


def greedy(lengths: Sequence[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each sequence, in input order, to the part with the least sum."""
    sums, parts = [0] * k, [[] for _ in range(k)]
    most = -(-len(lengths) // k)
    for i, n in enumerate(lengths):
        free = [p for p in range(k) if not equal or len(parts[p]) < most]
        p = min(free, key=lambda p: sums[p])
        sums[p] += n
        parts[p].append(i)
    return parts


def differencing(lengths: Sequence[int], k: int, equal: bool = False) -> list[list[int]]:
    """Largest differencing: merge the two states with the widest spread, large with small.

    ``equal``: all parts get as many sequences; their number must be a multiple of k.
    """
    if equal and len(lengths) % k:
        raise ValueError("the number of sequences is no multiple of k")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    firsts = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    heap = []
    for tie, group in enumerate(firsts):
        parts = sorted(([(lengths[i], [i]) for i in group] + [(0, [])] * (k - len(group))), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], tie, parts))
    tie = len(firsts)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], tie, parts))
        tie += 1
    return sorted(sorted(p) for _, p in heap[0][2])


def micro_batches(lengths: Sequence[int], most_tokens: int, least: int = 1) -> list[list[int]]:
    """As few balanced batches as the tokens need, larger work first."""
    k = max(least, -(-sum(lengths) // most_tokens))
    cost = [24576 * n + n * n for n in lengths]
    parts = differencing(cost, min(k, len(lengths)))
    return sorted(parts, key=lambda p: -sum(cost[i] for i in p))


def inverse(order: Sequence[int]) -> list[int]:
    out = [0] * len(order)
    for place, i in enumerate(order):
        out[i] = place
    return out


def imbalance(df: DataFrame, size: int, length: str = "length") -> DataFrame:
    """min, max and spread of the token sums of blocks of ``size`` neighbouring rows."""
    sums = df.groupBy(F.floor(F.col("row_id") / size).alias("block")).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("spread"))


def partition_groups(df: DataFrame, key: str, k: int, length: str = "length") -> DataFrame:
    """Add ``part``: each key's rows (a bounded batch) balanced over k parts by differencing."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, row_id long, part int"

    def one(rows):
        import pandas as pd

        rows = rows.sort_values("row_id").reset_index(drop=True)
        parts = differencing(rows[length].tolist(), k)
        of = {i: p for p, members in enumerate(parts) for i in members}
        return pd.DataFrame({key: rows[key], "row_id": rows["row_id"], "part": [of[i] for i in range(len(rows))]})

    return df.select(key, "row_id", length).groupBy(key).applyInPandas(one, schema)
