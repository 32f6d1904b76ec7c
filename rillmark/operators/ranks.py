"""Equal numbers of sequences on every rank, with sums of lengths as even as differencing makes them.

In order of length, every k neighbours are a set that gives one sequence to each of k ranks.
Differencing then merges the two sets with the widest spread, large sums with small ones.  Blocks of
sets are merged where they lie, their k sums are the sets of the next round, and so on until one is
left: no task holds more than ``BLOCK`` sums, whatever the number of sequences.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.operators.balancing import workload
from rillmark.operators.batch import number_rows
from rillmark.sources.staging import staged

#: Sums that one task merges at a time.
BLOCK = 65536


def merge_sets(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part of each set's each sum, sums of the parts) of a table with one set of k sums a row.

    Parts are numbered by rising sum.  Sets without spread do not bear on which is merged with which.
    """
    many, k = sums.shape
    part = np.tile(np.arange(k), (many, 1))
    total = np.zeros(k, sums.dtype)
    nodes: list[tuple] = []
    heap: list[tuple] = []

    def push(values: np.ndarray, made: tuple) -> None:
        order = np.argsort(values, kind="stable")
        nodes.append((made, order))
        heapq.heappush(heap, (int(values[order[0]]) - int(values[order[-1]]), len(nodes) - 1, values[order]))

    for i in range(many):
        if sums[i].max() == sums[i].min():
            total += sums[i]
        else:
            push(sums[i], (i,))
    while len(heap) > 1:
        _, a, large = heapq.heappop(heap)
        _, b, small = heapq.heappop(heap)
        push(large + small[::-1], (a, b))
    if heap:
        _, root, values = heap[0]
        total = total + values
        at = {root: np.arange(k)}  # node -> part of each of its sums in rising order
        for node in range(root, -1, -1):
            if node in at:
                made, order = nodes[node]
                label = np.empty(k, np.int64)
                label[order] = at.pop(node)  # part of each sum as it was before it was ordered
                if len(made) == 1:
                    part[made[0]] = label
                else:
                    at[made[0]], at[made[1]] = label, label[::-1]
    return part, total


def _merged(df: DataFrame, k: int, sets: int) -> DataFrame:
    """set, slot, block, part, cost: the sets of each block merged; df has (set, slot, cost)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["set", "slot"])
        part, _ = merge_sets(rows["cost"].to_numpy(np.int64).reshape(-1, k))
        return rows.assign(part=part.ravel())

    return df.withColumn("block", F.floor(F.col("set") / sets).cast("long")).groupBy("block").applyInPandas(one, "set long, slot int, cost long, block long, part int")


def balanced_ranks(df: DataFrame, k: int, row: str = "row_id", length: str = "length", exact: bool = True) -> DataFrame:
    """row, rank (0 to k - 1), position (in the rank, from 0): all ranks get as many rows and even work.

    The cost of a row is ``workload`` of its length (null: 0).  In a rank short sequences stand at
    both ends: in order of (length, row) the even ones come first, then the odd ones backwards.
    ``exact``: a number of rows that is no multiple of k is an error; else sizes differ by one at most.
    Rows are told apart by ``row``, which must not repeat.  No rows give no rows.
    """
    if k < 1:
        raise ValueError("one rank is needed at least")
    rows = df.select(F.col(row).alias("r"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"))
    placed = number_rows(rows, "n", "r").withColumnRenamed("row_id", "place")
    count = placed.count()
    lacking = -count % k
    if exact and lacking:
        raise ValueError("the number of rows is no multiple of the ranks")
    cost = workload(F.col("n"))
    at = F.col("place") + lacking  # the first set lacks its first slots
    level = placed.select(F.col("r"), F.floor(at / k).cast("long").alias("set"), (at % k).cast("int").alias("slot"), cost.alias("cost"))
    gaps = df.sparkSession.range(lacking).select(F.lit(0).cast("long").alias("set"), F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("cost"))
    sets = max(2, BLOCK // k)
    left = -(-count // k)
    tables = []
    current = level.select("set", "slot", "cost").unionByName(gaps)
    while left:
        tables.append(staged(_merged(current, k, sets)))
        left = -(-left // sets)
        if left == 1:
            break
        current = tables[-1].groupBy(F.col("block").alias("set"), F.col("part").alias("slot")).agg(F.sum("cost").alias("cost"))
    if not tables:
        return level.select(F.col("r").alias(row), F.col("slot").alias("rank"), F.col("set").alias("position"))
    rank = tables[-1].select("set", "slot", F.col("part").alias("rank"))
    for table in reversed(tables[:-1]):
        upper = rank.select(F.col("set").alias("block"), F.col("slot").alias("part"), "rank")
        rank = table.join(upper, ["block", "part"]).select("set", "slot", "rank")
    ranked = level.join(rank, ["set", "slot"])
    late = gaps.join(rank, ["set", "slot"]).select("rank", F.lit(1).cast("long").alias("lacks"))  # fewer than k rows
    ranked = ranked.join(F.broadcast(late), "rank", "left").withColumn("lacks", F.coalesce("lacks", F.lit(0).cast("long")))
    size, turn = F.lit(-(-count // k)) - F.col("lacks"), F.col("set") - F.col("lacks")
    return ranked.select(F.col("r").alias(row), "rank", _both_ends(turn, size).cast("long").alias("position"))


def _both_ends(turn: Column, size: Column) -> Column:
    return F.when(turn % 2 == 0, F.floor(turn / 2)).otherwise(size - 1 - F.floor(turn / 2))


def rank_balance(ranked: DataFrame, df: DataFrame, row: str = "row_id", length: str = "length") -> DataFrame:
    """rank, rows, tokens, work of each rank."""
    met = ranked.join(df.select(row, F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n")), row)
    return met.groupBy("rank").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.sum(workload(F.col("n"))).alias("work"))
