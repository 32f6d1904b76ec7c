"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are scaled to integers.  A shard of the index holds, for each dimension, its least value
and the base-4 digits of what its rows have above it.  A posting segment is the set of rows with
the same digit at one place of one dimension, and its quantised impact is the digit times the
place's value; all segments of one place are stored together, two bits a row, highest place first.

Segments are processed by descending quantised impact for a block of queries at once: after each
place the accumulators and what the unprocessed places can still add (the dimension's greatest
remainder times a positive weight) bound every score.  A query stops only when that proves that
few rows can reach the k-th best score that it has found so far, here or in the shards before;
those rows are rescored exactly.  A shard that no row of which can reach it is left at once.

Shards and blocks of queries are bounded rows of bytes that meet in an equi-join on a group of
shards; a task goes through a group's shards in turn and carries the best scores along.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
rows without a vec_id; an empty vector scores 0 with all; rows that repeat a vec_id are candidates and queries of their own;
shorter vectors are as if filled up with zeros; ties go to the smaller vec_id; an empty table
gives no rows; other columns are not read.  Scores are exact below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm import storage

SCALE, TOP, EVERY = 64, 20, 20
SHARD_ROWS, QUERY_ROWS = 4096, 1024
#: Shards that a task goes through in turn for a block of queries.
GROUP_SHARDS = 8
#: A query stops where this part of a shard's rows, or 4 k rows, are left.
FEW = 32
_HEAD = 4
FOUND = "row long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, v (array<long>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    fine &= ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class Shard:
    """Segments of some rows: ``least`` (a dimension's), ``planes`` (digits, highest place first)."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, least: np.ndarray, planes: np.ndarray):
        self.own, self.ids, self.least, self.planes = own, ids, least, planes

    @classmethod
    def of(cls, own: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Shard:
        least = rows.min(axis=0)
        above = rows - least
        places = max(1, -(-int(above.max()).bit_length() // 2))
        return cls(own, ids, least, np.stack([(above >> 2 * j & 3).astype(np.uint8) for j in reversed(range(places))]))

    def packed(self) -> bytes:
        places, n, d = self.planes.shape
        digits = np.zeros((places, -(-n * d // 4) * 4), np.uint8)
        digits[:, : n * d] = self.planes.reshape(places, -1)
        four = digits[:, 0::4] | digits[:, 1::4] << 2 | digits[:, 2::4] << 4 | digits[:, 3::4] << 6
        return b"".join([np.array([places, n, d, 0], "<i8").tobytes(), *(x.astype("<i8").tobytes() for x in (self.own, self.ids, self.least)), four.tobytes()])

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        places, n, d, _ = np.frombuffer(data, "<i8", _HEAD)
        own, ids, least = np.split(np.frombuffer(data, "<i8", 2 * n + d, 8 * _HEAD), [n, 2 * n])
        four = np.frombuffer(data, np.uint8, offset=8 * (_HEAD + 2 * n + d)).reshape(places, -1)
        digits = np.stack([four >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(places, -1)
        return cls(own, ids, least, digits[:, : n * d].reshape(places, n, d))

    def widened(self, d: int) -> Shard:
        more = d - len(self.least)
        return self if more <= 0 else Shard(self.own, self.ids, np.pad(self.least, (0, more)), np.pad(self.planes, ((0, 0), (0, 0), (0, more))))

    def rows(self) -> np.ndarray:
        above = np.zeros(self.planes.shape[1:], np.int64)
        for plane in self.planes:
            above = 4 * above + plane
        return above + self.least


class Search:
    """The best rows of a block of queries, over shards that are added one after the other."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.ids, self.queries, self.k = own, ids, queries, k
        self.best = [np.zeros(0, np.int64) for _ in range(3)]  # query, score, vec_id
        self.reach = np.full(len(queries), -np.inf)  # the k-th best score, once there are k
        self.processed = np.zeros(len(queries), np.int64)  # impact levels
        self.rescored = np.zeros(len(queries), np.int64)

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate([a, b]) for a, b in zip(self.best, (q, score, ids), strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        begins = np.searchsorted(q, np.arange(len(self.queries)))
        rank = np.arange(len(q)) - begins[q]
        self.best = [x[rank < self.k] for x in (q, score, ids)]
        last = rank == self.k - 1
        self.reach[q[last]] = np.maximum(self.reach[q[last]], score[last])

    def add(self, shard: Shard) -> None:
        d = max(shard.planes.shape[2], self.queries.shape[1])
        shard, queries = shard.widened(d), np.pad(self.queries, ((0, 0), (0, d - self.queries.shape[1])))
        rows, n, places = shard.rows(), len(shard.ids), len(shard.planes)
        kind = np.float32 if int(np.abs(queries).sum(axis=1).max()) * int(max(1, (rows - shard.least).max())) < 1 << 24 else np.float64
        rest, above = [], rows - shard.least
        for place in range(places):  # the greatest remainder of each dimension after this place
            rest.append((above & (1 << 2 * (places - 1 - place)) - 1).max(axis=0))
        ahead = np.maximum(queries, 0) @ np.stack([above.max(axis=0), *rest]).T  # (queries, 1 + places)
        base = queries @ shard.least
        live = np.flatnonzero(base + ahead[:, 0] >= self.reach)
        total = np.zeros((n, len(live)), kind)
        for place in range(places):
            if not len(live):
                return
            total += shard.planes[place].astype(kind) @ (queries[live].astype(kind) * kind(4 ** (places - 1 - place))).T
            self.processed[live] += 1
            fresh = ~np.isfinite(self.reach[live])
            if fresh.any() and place < places - 1 and n > 2 * self.k:  # probe the likeliest rows for a first reach
                probe = np.argpartition(-total[:, fresh], 2 * self.k, axis=0)[: 2 * self.k].T
                q = live[fresh]
                exact = np.einsum("qpd,qd->qp", rows[probe], queries[q])
                exact = np.where(shard.own[probe] == self.own[q][:, None], np.iinfo(np.int64).min, exact)
                kth = -np.sort(-exact, axis=1)[:, self.k - 1]
                self.reach[q] = np.where(kth > np.iinfo(np.int64).min, kth, -np.inf)
            needed = self.reach[live] - base[live] - ahead[live, 1 + place]
            possible = total >= needed.astype(np.float64)[None, :]
            ends = possible.sum(axis=0) <= max(4 * self.k, n // FEW) if place < places - 1 else np.ones(len(live), bool)
            if ends.any():
                done, own = live[ends], possible[:, ends]
                r, q = np.nonzero(own)
                q = done[q]
                other = shard.own[r] != self.own[q]
                r, q = r[other], q[other]
                score = np.concatenate([np.einsum("pd,pd->p", rows[r[i : i + 65536]], queries[q[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0, np.int64)])
                self.rescored += np.bincount(q, minlength=len(queries))
                kept = score >= self.reach[q]
                self._keep(q[kept], score[kept], shard.ids[r[kept]])
                live, total = live[~ends], total[:, ~ends]


def _filled(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), max(1, *map(len, rows))), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _blocks(vectors: DataFrame, count: int, size: int, seed: int) -> DataFrame:
    """Rows in ``ceil(count / size)`` shards of bytes, of much the same size: rows are dealt by hash."""
    blocks = max(1, -(-count // size))

    def gather(table: pa.Table) -> pa.Table:
        shard = Shard.of(table.column("row").to_numpy(), table.column("vec_id").to_numpy(), _filled(table.column("v").to_pylist()))
        return pa.table({"block": table.column("block")[:1], "data": pa.array([shard.packed()], pa.binary())})

    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)).cast("int"))
    return keyed.groupBy("block").applyInArrow(gather, "block int, data binary")


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = storage.staged(scaled(vectors, scale), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, q = rows.count(), asked.count()
    groups = -(-max(1, -(-n // SHARD_ROWS)) // GROUP_SHARDS)
    index = storage.staged(_blocks(rows, n, SHARD_ROWS, 1), "index").withColumn("part", F.floor(F.col("block") / GROUP_SHARDS).cast("int"))
    blocks = _blocks(asked, q, QUERY_ROWS, 2).select(F.col("block").alias("asked"), F.col("data").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def results(search: Search) -> pa.RecordBatch:
        at, score, ids = search.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (search.own[at], search.ids[at], ids, score)], [c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, search = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("asked")[i].as_py(), batch.column("part")[i].as_py()
                if key != last:
                    if search:
                        yield results(search)
                    block = Shard.unpacked(batch.column("queries")[i].as_py())
                    last, search = key, Search(block.own, block.ids, block.rows(), k)
                search.add(Shard.unpacked(batch.column("data")[i].as_py()))
        if search:
            yield results(search)

    units = max(1, -(-q // QUERY_ROWS)) * groups
    pairs = blocks.join(index.hint("merge"), "part").select("asked", "part", "block", "queries", "data")
    pairs = pairs.repartition(units, "asked", "part").sortWithinPartitions("asked", "part", "block")
    with storage.batches_of(spark, 16):
        found = storage.staged(pairs.mapInArrow(run, FOUND), "found")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
