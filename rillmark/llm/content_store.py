"""Content-addressed store of token-id streams.

A rolling hash over a window of ids cuts each document's stream into content-defined chunks.
``chunks`` holds every distinct chunk once, under its SHA-256; ``recipes`` holds, in ascending
doc_id order, the chunk digests of each document with the Merkle root over them; ``manifest``
holds, for each recipe part, the ids it spans and the root over its documents, in blocks of FAN.  Reading back recomputes each chunk's
digest and each root, so a result exists only where reconstruction is verified.

Defined cases: a null or empty text is its end id alone; a null doc_id sorts first; rows that
repeat a doc_id are documents of their own, in an order fixed when the store is written; an empty
table gives empty tables; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.llm import storage
from rillmark.llm.tokens import WORD_BPE, encoder

WINDOW = 16
TARGET_IDS = 512
LEAST_IDS, MOST_IDS = 128, 4096
FAN = 512
#: Texts that are encoded and hashed as one array.
TOGETHER = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POLYNOMIAL = 0xEDB88320

ENCODED = "doc_id long, row long, n_tokens long, digests array<binary>, sizes array<int>, payloads array<binary>"
RECIPES = "doc_id long, row long, n_tokens long, digests array<binary>, sizes array<int>, root binary, part int, local_start long, block long"


def rolling_hash(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Polynomial hash of the ``window`` ids that end at each position (fewer at the start).

    The hash of 2w ids is that of the last w plus a power of the multiplier times that of the w
    before them, so log2(window) vector steps give it everywhere.
    """
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        h ^= h >> np.uint64(29)
        step, power = 1, _MULTIPLIER
        while step < window:
            longer = h.copy()
            longer[step:] += power * h[:-step] if step < len(h) else 0
            h, step, power = longer, 2 * step, power * power
        return h ^ (h >> np.uint64(32))


def cut_points(ids: np.ndarray, target: int = TARGET_IDS, least: int = LEAST_IDS, most: int = MOST_IDS) -> list[int]:
    """Ends of the chunks: where the rolling hash falls in one of ``target`` classes, or ``most``."""
    marks = np.flatnonzero(rolling_hash(ids) % np.uint64(target) == 0) + 1 if len(ids) > least else ()
    return _ends(marks, len(ids), least, most)


def _ends(marks, n: int, least: int, most: int) -> list[int]:
    ends, last = [], 0
    for end in [*(int(m) for m in marks), n]:
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least or end == n and end > last:
            ends.append(end)
            last = end
    return ends


def cut_together(streams: list[np.ndarray], target: int = TARGET_IDS, least: int = LEAST_IDS, most: int = MOST_IDS) -> list[list[int]]:
    """``cut_points`` of each stream, hashed as one array.

    Windows that reach back into the stream before end among the first ``WINDOW`` - 1 ids, where
    no chunk can end, as chunks have ``least`` ids.
    """
    if least < WINDOW:
        return [cut_points(ids, target, least, most) for ids in streams]
    ends = np.cumsum([len(x) for x in streams])
    marks = np.flatnonzero(rolling_hash(np.concatenate(streams)) % np.uint64(target) == 0) + 1 if len(streams) else np.zeros(0, np.int64)
    edges = np.searchsorted(marks, ends, side="right")
    out, first, at = [], 0, 0
    for ids, edge, end in zip(streams, edges.tolist(), ends.tolist(), strict=True):
        out.append(_ends(marks[at:edge] - first if len(ids) > least else (), len(ids), least, most))
        first, at = end, edge
    return out


def packed(ids: np.ndarray) -> bytes:
    """A width byte and the ids: two bytes each where they fit, else four."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\x04" if wide else b"\x02") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u4" if payload[0] == 4 else "<u2", offset=1).astype("<u4")


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary SHA-256 tree; an odd node moves up as it is; no leaves: the digest of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def encode_documents(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 1) -> DataFrame:
    """One row per document: its chunks in order, digested and packed."""
    storage.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[tuple] = []
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), TOGETHER):
                streams = [np.frombuffer(table.id_bytes(t) + end, "<u4") for t in texts[at : at + TOGETHER].to_pylist()]
                for ids, ends in zip(streams, cut_together(streams), strict=True):
                    chunks = [packed(ids[a:b]) for a, b in pairwise([0, *ends])]
                    out.append((doc_ids[len(out)], row, len(ids), [hashlib.sha256(c).digest() for c in chunks], [b - a for a, b in pairwise([0, *ends])], chunks))
                    row += 1
            yield _batch(out, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())], ENCODED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def write_store(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 1, parts: int | None = None) -> None:
    """Write chunks, recipes and manifest below ``path``."""
    spark = docs.sparkSession
    at = storage.new_path(spark, "encoded")
    encoded = storage.write_table(encode_documents(docs, tokenizer, end_id), at, "snappy")
    one = F.explode(F.arrays_zip("digests", "sizes", "payloads")).alias("c")
    encoded.select(one).select(F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n_ids"), F.col("c.payloads").alias("payload")).dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            lengths = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            starts = start + np.cumsum(lengths) - lengths
            start += int(lengths.sum())
            roots = [merkle_root(d) for d in batch.column("digests").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(roots, pa.binary()), pa.array(np.full(len(roots), part, "i4")), pa.array(starts.astype("i8")), pa.array((row + np.arange(len(roots))) // FAN)],
                [*batch.schema.names, "root", "part", "local_start", "block"],
            )
            row += len(roots)

    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.drop("payloads").repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    ordered.mapInArrow(recipes, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    storage.drop_table(spark, at)
    _manifest(spark, path).write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per recipe part: documents, ids and the root of a tree of blocks over documents' roots."""

    def root(order: str, of: str) -> Column:
        return F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, of))), lambda x: x[of])), 256)

    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").withColumn("leaf", F.hex("root"))
    blocks = recipes.groupBy("part", "block").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"), root("local_start", "leaf").alias("block_root"))
    return blocks.groupBy("part").agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), root("block", "block_root").alias("part_root"))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their global start; raises where a root or a part's manifest does not match."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    kept = spark.read.parquet(f"{path}/manifest")
    found = _manifest(spark, path).select("part", F.col("part_root").alias("found"))
    same = F.col("part_root").eqNullSafe(F.col("found"))
    # a row a part: their number is a parameter and does not follow the documents
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = kept.join(found, "part", "full").select("part", F.when(same, F.coalesce(before, F.lit(0))).otherwise(F.raise_error(F.lit("a recipe part differs from its manifest")).cast("long")).alias("part_start"))
    return recipes.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("local_start"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n_ids, payload of every stored chunk."""
    return spark.read.parquet(f"{path}/chunks")


def chunk_digests(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, crc) of every chunk as read back; raises where a payload is not its digest's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ns, crcs = batch.column("digest").to_pylist(), [], []
            for digest, payload in zip(digests, batch.column("payload").to_pylist(), strict=True):
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = unpacked(payload)
                ns.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return read_chunks(spark, path).select("digest", "payload").mapInArrow(run, "digest binary, n long, crc long")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials over GF(2), modulo the CRC-32 polynomial."""
    total = np.zeros_like(a)
    for i in range(31, -1, -1):
        total ^= np.where((a >> np.uint64(i)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(_POLYNOMIAL), b >> np.uint64(1))
    return total


def crc_shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds, by exclusive or, to that of a stream with ``after`` more bytes."""
    crc, after = crc.astype(np.uint64), after.astype(np.uint64)
    power = np.full(1, 1 << 23, np.uint64)  # x^8
    while after.any():
        crc = np.where(after & np.uint64(1), _times(crc, np.broadcast_to(power, crc.shape)), crc)
        power, after = _times(power, power), after >> np.uint64(1)
    return crc.astype(np.int64)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, root of every document, from the files.

    Chunks are read, verified and summed once each; a document's CRC is the exclusive or of its
    chunks' CRCs, each shifted by the ids behind it, so no payload is shuffled.
    """

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = batch.column("sizes").to_pylist(), batch.column("digests").to_pylist()
            for root, d in zip(batch.column("root").to_pylist(), digests, strict=True):
                if merkle_root(d) != root:
                    raise ValueError("a recipe differs from its Merkle root")
            take = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
            after = [x for s in sizes for x in (4 * (sum(s) - np.cumsum(s))).tolist()]
            same = [batch.column(c).take(pa.array(take)) for c in ("doc_id", "row", "part", "start", "n_tokens", "root")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([x for d in digests for x in d], pa.binary()), pa.array(after, pa.int64())], ["doc_id", "row", "part", "start", "n_tokens", "root", "digest", "after"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in storage.wider(batches):
            if batch.column("crc").null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            crc = crc_shifted(batch.column("crc").to_numpy(), batch.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(crc), batch.column("n")], ["doc_id", "row", "start", "n_tokens", "root", "crc", "n"])

    asked = read_recipes(spark, path).select("doc_id", "row", "part", "start", "n_tokens", "root", "digests", "sizes")
    asked = asked.mapInArrow(refs, "doc_id long, row long, part int, start long, n_tokens long, root binary, digest binary, after long")
    # chunks that many documents share are few, and go to where the recipes are
    named = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select(F.explode("digests").alias("digest"))
    total = spark.read.schema(RECIPES).parquet(f"{path}/recipes").agg(F.sum(F.size("digests"))).first()[0] or 0
    shared = named.groupBy("digest").agg(F.count("*").alias("refs")).where(F.col("refs") > max(1, total // storage.HEAVY_MOST))
    sums = chunk_digests(spark, path).join(F.broadcast(shared), "digest", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    joined = storage.joined(asked, storage.staged(sums, "sums"), "digest", "refs", total, "left").select("doc_id", "row", "start", "n_tokens", "root", "crc", "after", "n")
    shifted = joined.mapInArrow(shift, "doc_id long, row long, start long, n_tokens long, root binary, crc long, n long")
    whole = shifted.groupBy("row", "doc_id", "start", "n_tokens", "root").agg(F.expr("bit_xor(crc)").alias("ids_crc32"), F.count("*").alias("n_chunks"), F.sum("n").alias("n"))
    n = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("chunks do not add up to their document")).cast("long"))
    return whole.select("doc_id", "start", n.alias("n_tokens"), "ids_crc32", "n_chunks", F.lower(F.hex("root")).alias("merkle_root"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the whole id stream (array<long>) of every document; an error where a chunk is missing or is not its digest's."""

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, parts in zip(batch.column("n_tokens").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                for p in parts:
                    if p["payload"] is None or hashlib.sha256(p["payload"]).digest() != p["digest"]:
                        raise ValueError(f"chunk {p['digest'].hex()} is missing or damaged")
                ids = np.concatenate([unpacked(p["payload"]) for p in parts]).astype("i8")
                if len(ids) != n or [p["pos"] for p in parts] != list(range(len(parts))):
                    raise ValueError("chunks do not add up to their document")
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    asked = read_recipes(spark, path).select("doc_id", "row", "start", "n_tokens", F.posexplode("digests").alias("pos", "digest"))
    parts = asked.join(read_chunks(spark, path).select("digest", "payload"), "digest", "left").groupBy("row", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "payload"))).alias("parts"))
    return parts.select("doc_id", "start", "n_tokens", "parts").mapInArrow(join_up, "doc_id long, start long, ids array<long>")
