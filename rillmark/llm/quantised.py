"""Near duplicates of embeddings by product quantisation.

Unit vectors are filed under the nearest of some coarse centres; what they differ from it is cut
into subspaces, each replaced by the nearest of 256 codewords.  A vector is asked of every list that
its neighbours may be in: those whose bisector with its own centre it lies within a margin of.  In a
list, distances come from a table of inner products with all codewords (asymmetric: the asking
vector is not quantised).  As the error of each code is stored, a member is only passed over if no
vector so far from its code can reach the similarity; all others are decided by their exact cosine.

Centres, codewords and the margin are fitted on ``SAMPLE`` vectors at most, drawn by hash.  At the
margin ``REACHED`` of vectors at exactly the least similarity, in random directions from the
sample's, are asked of the right list, and so are ``REACHED`` of the links of ``PAIRED`` of them from
either side (tests compare all links with brute force).

Equal vectors are one from the start, with their number.  A list is dealt to units of ``MEMBERS``
members and ``ASKING`` asking vectors; a unit keeps counts and which members are connected, so what it
emits grows with its rows, never with its pairs.  A link that both sides find counts once: in the
list of the smaller number.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing and are components of their own; shorter vectors are as if filled up with zeros; rows
that repeat a vec_id are vectors of their own; a null vec_id comes after all others; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import simhash, storage

LEAST = 0.95
SAMPLE, LISTS_MOST, REACHED = 16_384, 1024, 0.98
SUBSPACES, WORDS, ROUNDS = 16, 256, 10
#: Vectors of the sample whose links in it are looked at.
PAIRED = 2048
MEMBERS, ASKING, BLOCK = 4096, 16_384, 256
INDEXED = "node long, copies long, list int, code binary, error double, square double, unit binary, probes array<int>"


def means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centres of ``rows`` by Lloyd's rounds; a centre without rows becomes the row farthest from its own."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        far = (centres * centres).sum(axis=1)[None] - 2 * rows @ centres.T
        at = far.argmin(axis=1)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            order = np.argsort(-far[np.arange(len(rows)), at] - (rows * rows).sum(axis=1), kind="stable")
            centres[~full] = rows[order[: (~full).sum()]]
    return centres


@dataclass
class Quantiser:
    """Coarse centres, codewords (subspace, word, components) and the margin of the probes."""

    centres: np.ndarray
    words: np.ndarray
    margin: float

    @classmethod
    def fit(cls, rows: np.ndarray, lists: int, least: float = LEAST, reached: float = REACHED, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        out = cls(means(rows, lists, rng), np.zeros((0, 0, 0)), 0.0)
        rest = out.cut(rows - out.centres[out.nearest(rows)])
        out.words = np.stack([means(rest[:, j], WORDS, rng) for j in range(rest.shape[1])])
        aside = rng.normal(size=rows.shape)
        aside -= (aside * rows).sum(axis=1, keepdims=True) * rows
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-12)
        near = least * rows + sqrt(1 - least * least) * aside
        own, beyond = out.nearest(rows), out.beyond(rows)
        drawn = np.quantile(out.beyond(near)[np.arange(len(rows)), own], reached)
        real = [np.zeros(1)]  # of real pairs, the side that needs less
        for i in range(0, min(PAIRED, len(rows)), BLOCK):
            a, b = np.nonzero(rows[i : min(i + BLOCK, PAIRED)] @ rows.T >= least)
            a, b = (a + i)[a + i != b], b[a + i != b]
            real.append(np.minimum(beyond[a, own[b]], beyond[b, own[a]]))
        out.margin = float(max(drawn, np.quantile(np.concatenate(real), reached))) + 1e-9
        return out

    def cut(self, rows: np.ndarray) -> np.ndarray:
        """(row, subspace, component), filled up with zeros."""
        parts = min(SUBSPACES, rows.shape[1])
        wide = ceil(rows.shape[1] / parts)
        return np.pad(rows, ((0, 0), (0, parts * wide - rows.shape[1]))).reshape(len(rows), parts, wide)

    def _far(self, rows: np.ndarray) -> np.ndarray:
        return (self.centres * self.centres).sum(axis=1)[None] - 2 * rows @ self.centres.T

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        return self._far(rows).argmin(axis=1)

    def beyond(self, rows: np.ndarray) -> np.ndarray:
        """How far each row is from the bisector between its own centre and each other one."""
        far = self._far(rows)
        own = far.argmin(axis=1)
        c = self.centres
        square = (c * c).sum(axis=1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * c @ c.T, 1e-18))
        return (far - far[np.arange(len(rows)), own][:, None]) / (2 * apart[own])

    def encoded(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, their errors, and the squared lengths of what they stand for."""
        rest = self.cut(rows - self.centres[own])
        code = np.empty(rest.shape[:2], np.uint8)
        for j, words in enumerate(self.words):
            code[:, j] = ((words * words).sum(axis=1)[None] - 2 * rest[:, j] @ words.T).argmin(axis=1)
        told = np.stack([self.words[j][code[:, j]] for j in range(len(self.words))], axis=1)
        error = np.sqrt(((rest - told) ** 2).sum(axis=(1, 2)))
        back = self.centres[own] + told.reshape(len(rows), -1)[:, : rows.shape[1]]
        return code, error, (back * back).sum(axis=1)

    def tables(self, rows: np.ndarray) -> np.ndarray:
        """(row, subspace, word): inner products with all codewords."""
        return np.einsum("rsc,swc->rsw", self.cut(rows), self.words, optimize=True).astype(np.float32)


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each node's least known one) after nodes ``a`` and ``b`` have been connected."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return label
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


class Unit:
    """Members of a list, and what asking vectors find among them."""

    def __init__(self, quantiser: Quantiser, rows: dict[str, np.ndarray], number: int, least: float):
        self.q, self.rows, self.number, self.least = quantiser, rows, number, least
        self.links = np.zeros(len(rows["node"]), np.int64)
        self.label = np.arange(len(rows["node"]))
        self.reach = (sqrt(2 - 2 * least) + rows["error"]) ** 2 + 1e-4
        self.code = rows["code"].T.astype(np.intp)
        probed = np.zeros((len(rows["node"]), len(quantiser.centres)), bool)
        for i, lists in enumerate(rows["probes"]):
            probed[i, lists] = True
        self.probed = probed
        self.decided = 0

    def ask(self, asking: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of links of the asking vectors; and pairs of nodes (a, b) that connect what is not yet connected."""
        own, y = self.rows, asking["unit"]
        table = self.q.tables(y)
        told = np.zeros((len(y), len(own["node"])), np.float32)
        for j, code in enumerate(self.code):
            told += np.take(table[:, j], code, axis=1)
        far = (1 - 2 * (y @ self.q.centres[self.number]))[:, None] + own["square"][None] - 2 * told
        i, k = np.nonzero(far <= self.reach[None])
        same = asking["list"][i] == self.number  # both are members: the smaller one asks
        mine = np.where(same, asking["node"][i] < own["node"][k], (asking["list"][i] > self.number) | ~self.probed[k, asking["list"][i]])
        i, k = i[mine], k[mine]
        self.decided += len(i)
        step = 65_536
        cosine = np.concatenate([np.einsum("pd,pd->p", y[i[s : s + step]], own["unit"][k[s : s + step]]) for s in range(0, len(i), step)] or [np.zeros(0)])
        i, k = i[cosine >= self.least], k[cosine >= self.least]
        links = np.bincount(i, own["copies"][k], len(y)).astype(np.int64)
        self.links += np.bincount(k, asking["copies"][i], len(self.links)).astype(np.int64)
        m = len(self.label)
        before = np.concatenate([self.label, m + np.arange(len(y))])
        after = joined_labels(before, m + i, self.label[k])
        node = np.concatenate([own["node"], asking["node"]])
        moved = np.flatnonzero((after != before) & ((before == np.arange(m + len(y)))))
        self.label = after[:m]
        return links, node[moved], node[after[moved]]


def _unpacked(batch: pa.RecordBatch, d: int) -> dict[str, np.ndarray]:
    """Columns of ``INDEXED`` rows as arrays."""
    raw = lambda c: b"".join(batch.column(c).to_pylist())
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "list", "error", "square")}
    return out | {"code": np.frombuffer(raw("code"), np.uint8).reshape(batch.num_rows, -1), "unit": np.frombuffer(raw("unit"), "<f8").reshape(batch.num_rows, d), "probes": np.array(batch.column("probes").to_pylist() + [None], object)[:-1]}


def _units(rows: pa.ListArray, d: int) -> np.ndarray:
    """Unit vectors of rows of at most ``d`` components."""
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), d))
    at = np.repeat(np.arange(len(rows)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = rows.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def distinct_vectors(vectors: DataFrame, scratch: storage.Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows (row, vec_id, key), key null where the vector takes no part; and (key, node, copies, least, v) of each distinct vector."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.exists(x, lambda c: c != 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda c: c + F.lit(0.0)))  # no negative zero
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    key = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64(F.lit(1), "v").alias("a"), F.xxhash64(F.lit(2), "v").alias("b")))
    rows = scratch.staged(rows.withColumn("key", key), "vectors")
    known = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    return rows.drop("v"), scratch.staged(known, "distinct")


def index(known: DataFrame, quantiser: Quantiser, d: int) -> DataFrame:
    """``INDEXED`` rows of all distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(batch.column(2), d)
            beyond = quantiser.beyond(unit)
            own = quantiser.nearest(unit)
            beyond[np.arange(len(own)), own] = 0
            code, error, square = quantiser.encoded(unit, own)
            probes = [np.flatnonzero(x).astype("i4") for x in beyond <= quantiser.margin]
            columns = (batch.column(0), batch.column(1), pa.array(own.astype("i4")), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(square), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(probes, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in INDEXED.split(", ")])

    return known.select("node", "copies", "v").mapInArrow(run, INDEXED)


def links(indexed: DataFrame, quantiser: Quantiser, d: int, least: float = LEAST, members: int = MEMBERS, asking: int = ASKING) -> DataFrame:
    """Rows (a, null, n): a has n more links; and rows (a, b, 0): a and b are connected.

    ``indexed`` is on disk.
    """
    spark = indexed.sparkSession
    asks = indexed.withColumn("number", F.explode("probes"))
    # two numbers a list, LISTS_MOST rows at most
    sizes = indexed.groupBy(F.col("list").alias("number")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
    sizes = sizes.unionByName(asks.groupBy("number").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m"))).groupBy("number").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    dealt = F.broadcast(sizes.where("n > 0").select("number", F.ceil(F.col("n") / members).alias("shards"), F.ceil(F.col("m") / asking).alias("blocks")))
    names = [c.split()[0] for c in INDEXED.split(", ")]
    pick = lambda salt, of: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    held = indexed.withColumn("number", F.col("list")).join(dealt, "number").select("number", pick(1, "shards").alias("shard"), every("blocks").alias("block"), F.lit(False).alias("asks"), *names)
    none = {"code": F.lit(b""), "probes": F.array().cast("array<int>"), "error": F.lit(0.0), "square": F.lit(0.0)}
    came = asks.join(dealt, "number").select("number", every("shards").alias("shard"), pick(2, "blocks").alias("block"), F.lit(True).alias("asks"), *[none.get(c, F.col(c)).alias(c) for c in names])
    unit = ("number", "shard", "block")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = held.unionByName(came).repartition(parts, *unit).sortWithinPartitions(*unit, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, at = None, [], None

        def told(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(n)], ["a", "b", "n"])

        def ends() -> Iterator[pa.RecordBatch]:
            if at is not None and at.links.any():
                some = at.links > 0
                yield told(at.rows["node"][some], None, at.links[some])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*unit, "asks")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                key = tuple(keys[:3, begin].tolist())
                if key != now:
                    yield from ends()
                    now, gathered, at = key, [], None
                part = batch.slice(begin, end - begin)
                if not keys[3, begin]:
                    gathered.append(part)
                    continue
                if not gathered:  # no member in this shard
                    continue
                if at is None:
                    at = Unit(quantiser, _unpacked(pa.Table.from_batches(gathered).combine_chunks().to_batches()[0], d), key[0], least)
                for s in range(0, part.num_rows, BLOCK):
                    rows_ = part.slice(s, BLOCK)
                    asked = {c: rows_.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "list")} | {"unit": np.frombuffer(b"".join(rows_.column("unit").to_pylist()), "<f8").reshape(-1, d)}
                    n, a, b = at.ask(asked)
                    if n.any():
                        yield told(asked["node"][n > 0], None, n[n > 0])
                    if len(a):
                        yield told(a, b, np.zeros(len(a), np.int64))
        yield from ends()

    return rows.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE, lists: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; ``lists`` coarse centres, by default the root of the number of vectors."""
    scratch, kept = storage.Scratch(vectors.sparkSession), storage.Scratch(vectors.sparkSession)
    rows, known = distinct_vectors(vectors, kept)
    count, d = known.agg(F.count("*"), F.max(F.size("v"))).first()
    result = rows.select("row", "vec_id", "key")
    if count:
        drawn = known.orderBy(F.xxhash64("node"), "node").limit(sample).select("v").toArrow()  # SAMPLE rows at most
        quantiser = Quantiser.fit(_units(drawn.column("v").combine_chunks(), d), lists or max(1, min(LISTS_MOST, round(sqrt(count)))), least)
        indexed = scratch.staged(index(known, quantiser, d), "index")
        found = scratch.staged(links(indexed, quantiser, d, least), "found")
        roots = simhash.components(found.where("b IS NOT NULL").select("a", "b"), scratch)
        more = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
        told = known.drop("v").join(more.hint("merge"), F.col("node") == F.col("a"), "left").join(roots.withColumnRenamed("node", "at").hint("merge"), F.col("node") == F.col("at"), "left")
        told = scratch.staged(told.select("key", "copies", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "told")
        names = told.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("vectors"))
        told = storage.staged(storage.joined(told, scratch.staged(names, "names"), "root", "vectors", count).select("key", "copies", "n_links", "component_id"), "told")
        scratch.drop()
        result = storage.joined(result, told, "key", "copies", rows.count(), "left")
    else:
        result = result.withColumn("n_links", F.lit(None).cast("long")).withColumn("component_id", F.lit(None).cast("long"))
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
