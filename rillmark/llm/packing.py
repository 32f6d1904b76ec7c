"""Best-fit-decreasing packing of token sequences.

Pieces are placed longest first, each into the tightest open bin that takes it.  Lengths are
integers up to the capacity, so the decisions depend on the number of pieces of each length
alone: the plan is made from that histogram (``capacity`` rows, whatever the corpus), with a
segment tree over remaining capacities that holds the open bins of each.  Equal pieces are placed
in runs, which gives the very bins of one-by-one placement.  The plan is a bounded table
(runs, at most capacity squared over two); every piece then finds its bin from its rank among
pieces of its length, which a two-level count gives without any task seeing a whole length.

Defined cases: a null or empty text is its end id; repeated rows are pieces of their own; a null
doc_id ranks first; no documents, no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm import storage
from rillmark.llm.tokens import BYTE_BPE, encoder

CAPACITY = 1024
BUCKETS = 1024

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, first long, count long, per_bin long, bin long, at long"


class CapacityTree:
    """Segment tree over remaining capacities 0..n; a leaf is open while it holds bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]

    def _mark(self, capacity: int) -> None:
        i = capacity + self.size
        self.open[i] = int(bool(self.bins[capacity]))
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        """``count`` bins, numbered from ``first``, now have ``capacity`` left."""
        if count and capacity:
            self.bins[capacity].append((first, count))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        group = self.bins[capacity].pop()
        self._mark(capacity)
        return group

    def tightest(self, length: int) -> int | None:
        """The least capacity of ``length`` or more with an open bin."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, count, pieces per bin, first bin, offset) and the number of bins."""
    tree, runs, bins = CapacityTree(capacity), [], 0
    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = room // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                first, count = tree.take(room)
                each = room // length
            used = min(count, -(-left // each))
            placed = min(left, used * each)
            runs.append((length, rank, placed, each, first, capacity - room))
            full = placed // each
            tree.add(room, first + used, count - used)
            if full < used:  # the last bin got fewer
                tree.add(room - (placed - full * each) * length, first + full, 1)
            tree.add(room - each * length, first, full)
            rank, left = rank + placed, left - placed
    return runs, bins


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: full ones, and what is left over comes first."""
    rest = n % capacity
    return [rest] * bool(rest) + [capacity] * (n // capacity)


def cut_pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize whole texts and cut only what is longer than ``capacity``."""
    storage.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start = memoryview(table.id_bytes(text) + end), 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    out.append((doc_id, row, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start += length
                row += 1
            if not out:
                continue
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Add sequence_id and offset to pieces that are on disk and have ``row``, ``piece``, ``length``."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int"))
    cells = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, _ = best_fit_decreasing(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as buckets
    cells = cells.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1
    ranked = pieces.withColumn("within", within).join(cells, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    plan = spark.createDataFrame(runs, RUNS).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "count", "per_bin", "bin", "at"))).alias("runs"))
    found = ranked.join(F.broadcast(plan), "length")
    # the last run that begins at or before the rank; there are at most capacity runs of a length
    run = F.expr("element_at(filter(runs, r -> r.first <= rank), -1)")
    found = found.withColumn("r", run)
    nth = F.col("rank") - F.col("r.first")
    return found.select(
        *[c for c in pieces.columns if c not in ("bucket", "sequence_id", "offset")],
        (F.col("r.bin") + F.floor(nth / F.col("r.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("r.at") + (nth % F.col("r.per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = storage.staged(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
