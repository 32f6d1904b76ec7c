"""SimHash fingerprints, and groups of documents whose fingerprints nearly agree.

A fingerprint is mapped to the bit counts of its sixteen 4-bit segments.  The Manhattan distance
of two such points never exceeds the Hamming distance of the fingerprints, so a range join on the
grid of points misses no pair: two points at distance two or less have a grid point within one
step of both, and every fingerprint is filed under the points within one step of its own.  Pairs
that share a point are verified exactly; a point's group yields a spanning forest of its links,
never all its pairs.  Groups over ``GROUP_MOST`` fingerprints are not gathered: their members are
filed under every value one bit away, where at most 65 can meet, and two fingerprints that differ
in two bits or fewer do meet.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows
and equal texts share a fingerprint; a null doc_id belongs to its component but never names it;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from rillmark.llm import storage

SHINGLE_WORDS = 3
SEED = 42
GROUP_MOST = 4096
CONTRACTED = 1 << 18
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle in order, repeats included; nothing for a text without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, "<u8")
    line = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip([0, *ends[: n - 1]], ends[min(words, len(found)) - 1 :], strict=True)], "<u8")


def fingerprint_of(h: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint: the bits that over half the hashes have set."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        bits += np.unpackbits(h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""
    storage.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts (0 to 4) of the sixteen segments, a nibble each."""
    bits = F.lit(0x1111111111111111)
    return fp.bitwiseAND(bits) + F.shiftrightunsigned(fp, 1).bitwiseAND(bits) + F.shiftrightunsigned(fp, 2).bitwiseAND(bits) + F.shiftrightunsigned(fp, 3).bitwiseAND(bits)


def grid_points(point: Column) -> Column:
    """The point and its neighbours one step away, inside the grid."""
    nibble = lambda i: F.shiftrightunsigned(point, 4 * i).bitwiseAND(F.lit(15))
    one = lambda i: F.lit(1 << 4 * i).cast("long")
    near = [x for i in range(16) for x in (F.when(nibble(i) < 4, point + one(i)), F.when(nibble(i) > 0, point - one(i)))]
    return F.array_compact(F.array(point, *near))


def near_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (two differing bits or fewer) among distinct fingerprints."""
    x = np.asarray(fps, np.int64).view(np.uint64)
    if len(x) <= 128:
        i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1))
    else:  # two meet at a value one bit or less from both
        near = (x[:, None] ^ np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)).ravel()
        order = np.argsort(near, kind="stable")
        same = near[order][1:] == near[order][:-1]
        i, j = order[:-1][same] // 65, order[1:][same] // 65
    root = list(range(len(x)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    kept = []
    for a, b in set(zip(i.tolist(), j.tolist(), strict=True)):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            kept.append((int(fps[a]), int(fps[b])))
    return kept


def links(fps: DataFrame, scratch: storage.Scratch, group_most: int = GROUP_MOST) -> DataFrame:
    """Verified links (a, b), enough to connect all that two bits or fewer connect.

    ``fps`` has distinct values in column fp and is on disk.
    """
    spark = fps.sparkSession
    storage.small_batches(spark)
    spread = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # each row becomes up to 33
    filed = spread.withColumn("z", F.explode(grid_points(segment_counts(F.col("fp")))))
    groups = scratch.staged(filed.groupBy("z").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "grid")
    pairs = groups.where("n = 2 and bit_count(a ^ b) <= 2").select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [link for members in batch.column(0).to_pylist() for link in near_links(np.array(members, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    some = groups.where(f"n > 2 and n <= {group_most}").select("z")
    forest = filed.join(some.hint("merge"), "z").groupBy("z").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(verify, "a long, b long")
    out = pairs.unionByName(forest)
    crowded = groups.where(f"n > {group_most}").select("z")
    if not crowded.isEmpty():
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        met = filed.join(crowded.hint("merge"), "z").select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("w"))
        star = met.groupBy("w").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        out = out.unionByName(star.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))
    return out.distinct()


def local_stars(u: np.ndarray, v: np.ndarray, root: dict[int, int]) -> None:
    """Union-find: ``root`` leads every node of the edges to the least node that they connect it with."""

    def find(k: int) -> int:
        top = k
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[k] != top:
            root[k], k = top, root[k]
        return top

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)


def components(edges: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """node, root of every node that has an edge (a, b); root is the least node of its component.

    Tasks of ``CONTRACTED`` edges each contract theirs to stars first; where there were several,
    large-star and small-star steps alternate until nothing changes, each round written out, so
    lineage stays short.  A hub's edges are never gathered: its least neighbour is a grouped
    minimum, and goes back to them by ``storage.joined``.
    """
    spark = edges.sparkSession
    edges = scratch.staged(edges.select("a", "b").where("a <> b"), "links")
    tasks = -(-max(1, edges.count()) // CONTRACTED)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for batch in batches:
            local_stars(batch.column(0).to_numpy(), batch.column(1).to_numpy(), root)
        nodes = np.fromiter(root, np.int64, len(root))
        tops = np.empty(len(nodes), np.int64)
        for i, k in enumerate(nodes.tolist()):
            while root[k] != k:
                k = root[k]
            tops[i] = k
        some = nodes != tops
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(tops[some])], ["u", "v"])

    def stars(pairs: DataFrame, larger: bool, total: int) -> DataFrame:
        about = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs
        least = about.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        met = storage.joined(about, least, "u", "n", total)
        if larger:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(path: str) -> tuple:
        df = spark.read.schema("u long, v long").parquet(path)
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    at = storage.new_path(spark, "edges")
    contracted = edges.repartition(tasks).mapInArrow(contract, "u long, v long")
    now = storage.write_table(contracted.distinct() if tasks > 1 else contracted, at)
    seen = state(at) if tasks > 1 else (0,)
    while seen[0]:
        to = storage.new_path(spark, "edges")
        new = storage.write_table(stars(stars(now, True, 2 * seen[0]), False, seen[0]), to)
        was, seen = seen, state(to)
        storage.drop_table(spark, at)
        now, at = new, to
        if was == seen:
            break
    scratch.paths.append(at)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(prints: DataFrame) -> DataFrame:
    """Add component_id to rows (doc_id, fp, ...) that are on disk: the least doc_id reachable."""
    scratch = storage.Scratch(prints.sparkSession)
    known = scratch.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    size = known.agg(F.count("*"), F.sum("n")).first()
    roots = components(links(known.select("fp"), scratch), scratch)
    rooted = known.join(roots.hint("merge"), known["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.staged(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    named = storage.staged(storage.joined(rooted, names, "root", "prints", size[0]).select("fp", "n", "component_id"), "named")
    scratch.drop()
    return storage.joined(prints, named, "fp", "n", size[1] or 0)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    prints = storage.staged(fingerprints(docs, words), "fingerprints")
    return groups(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies by similarity
#
# Two texts that share four fifths of their five-word shingles often differ in more than two bits:
# at one edit in forty words, most do.  So the links of the fingerprints are the first source of
# candidates, and prefixes are the second: in any one order of all shingles, two texts at the
# similarity share one among the first n - ceil(similarity x n) + 1 of each.  How many they share
# there bounds how many they share at all, so most pairs that have only a passage in common are
# ruled out without their texts.  No pair is missed at any length, and every candidate, of either
# source, is decided on the shingles.

ADDED = ("__row", "__same", "__fp", "__size", "__prefix", "__text")
STAGE_WORDS, SIMILARITY = 5, 0.8
#: Shingles that come last in the order of prefixes: the most frequent in a sample.  They change
#: the number of candidates and never what is found.
SAMPLED, FREQUENT, FREQUENT_MOST = 4000, 5, 100_000


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct shingles of either that both have; two texts without any are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def frequent_shingles(docs: DataFrame, words: int = STAGE_WORDS) -> np.ndarray:
    """Sorted hashes of the shingles that most rows of a sample have."""
    storage.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, words)).view(np.int64))], ["h"])

    rows = docs.count()
    some = docs.select(F.col("text").cast("string")).where(F.lit(rows <= SAMPLED) | (F.pmod(F.xxhash64("text"), F.lit(max(1, rows))) < SAMPLED))
    found = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(FREQUENT_MOST)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def prefix(h: np.ndarray, frequent: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a text of which any at the similarity has one among its own first."""
    h = np.unique(h)
    n = len(h)
    with np.errstate(over="ignore"):
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
    common = np.zeros(n, bool)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    return h[np.lexsort((mixed, common))][: max(0, n - ceil(least * n - 1e-9) + 1)].view(np.int64)


def sketched(docs: DataFrame, words: int = STAGE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with __row, __same (a digest of the words), __fp, __size (distinct shingles) and __prefix."""
    storage.small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ADDED]
    frequent = frequent_shingles(docs, words)
    added = [StructField("__row", LongType()), StructField("__same", BinaryType()), StructField("__fp", LongType()), StructField("__size", LongType()), StructField("__prefix", ArrayType(LongType()))]
    schema = StructType([*docs.select(*names).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            hashes = [shingle_hashes(t, words) for t in texts]
            same = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            made = [pa.array(row + np.arange(len(texts))), pa.array(same, pa.binary()), pa.array(np.array([fingerprint_of(h) for h in hashes], np.uint64).astype(np.int64)), pa.array([len(np.unique(h)) for h in hashes], pa.int64()), pa.array([prefix(h, frequent, least) for h in hashes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], [*names, *[f.name for f in added]])
            row += len(texts)

    return docs.select(*names, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def near_prints(reps: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """Pairs (a, b) of rows whose fingerprints are alike or linked: a fingerprint's rows with its first, and firsts.

    ``reps`` (row, fp) is on disk.
    """
    first = scratch.staged(reps.groupBy("fp").agg(F.min("row").alias("first"), F.count("*").alias("n")), "prints")
    total = first.agg(F.sum("n")).first()[0] or 0
    alike = storage.joined(reps.select("fp", "row"), first.where("n > 1"), "fp", "n", total).select(F.col("first").alias("a"), F.col("row").alias("b"))
    near = links(first.select("fp"), scratch).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")).hint("merge"), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")).hint("merge"), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return alike.unionByName(near).where("a <> b").distinct()


def similar(pairs: DataFrame, texts: DataFrame, words: int = STAGE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b), both on disk, whose texts (row, text) share ``least`` of their shingles.

    A row ``a`` of many pairs sends its text once to each of the tasks that decide them, not once a
    pair: the pairs of a heavy row are dealt over as many salts as it has shares of the whole.
    """
    spark = pairs.sparkSession
    storage.small_batches(spark)
    total = pairs.count()
    share = max(1, total // storage.HEAVY_MOST)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(share)).alias("salts"))
    heavy = F.broadcast(hubs.where("salts > 1"))  # HEAVY_MOST rows at most
    asks = pairs.join(heavy, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"), "b")
    asks = asks.join(texts.hint("merge"), asks["b"] == texts["row"]).select("a", "salt", "b", "text")
    first = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    first = first.join(texts.hint("merge"), first["a"] == texts["row"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = first.unionByName(asks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hub = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                if b is None:
                    hub, known = a, np.unique(shingle_hashes(text, words))
                elif hub == a and similarity(known, shingle_hashes(text, words)) >= least:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(decide, "a long, b long")


def shared_prefixes(reps: DataFrame) -> DataFrame:
    """key, row, size, rest, n of the prefix shingles that n > 1 rows have; one shuffle of all prefixes.

    ``rest`` counts the text's shingles from this one on, in the order of prefixes.
    """
    filed = reps.select(F.posexplode("prefix").alias("at", "key"), "row", F.col("size").cast("int").alias("size"))
    filed = filed.select("key", "row", "size", (F.col("size") - F.col("at")).alias("rest"))
    return filed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def first_shared(m: Column, n: Column, rest: Column, other: Column, least: float) -> Column:
    """Whether a shingle that texts of m and n shingles share can be the first that they share, if they reach the similarity.

    From the first one on, each text must have as many shingles as similar texts share.  So a text
    with many shingles of its own, which come first in the order, meets no other at the later ones.
    """
    sizes = F.least(m, n) >= F.lit(least) * F.greatest(m, n) - F.lit(1e-9)
    return sizes & (F.least(rest, other) >= F.lit(least / (1 + least)) * (m + n) - F.lit(1e-6))


def possible(m: Column, n: Column, shared: Column, least: float) -> Column:
    """Whether texts of m and n shingles that share so many in their prefixes can reach the similarity.

    The prefix that ends first holds all that is shared up to its end; beyond it that text has
    ceil(least x its size) - 1 shingles, which may all be shared.
    """
    beyond = F.ceil(F.lit(least) * F.greatest(m, n) - F.lit(1e-9)) - 1
    sizes = F.least(m, n) >= F.lit(least) * F.greatest(m, n) - F.lit(1e-9)
    return sizes & (shared + beyond >= F.lit(least / (1 + least)) * (m + n) - F.lit(1e-6))


def meetings(filed: DataFrame, total: int, least: float, every: bool, scratch: storage.Scratch) -> DataFrame:
    """a, b, m, size of rows of two components, once for each shingle that can be the first that they share.

    ``filed`` (key, row, size, rest, root, weight; at most ``total`` rows) is on disk.
    """
    hubs = filed.groupBy("key").agg(F.max(F.struct("weight", "row", "size", "root", "rest")).alias("h"), F.count("*").alias("many"))
    hubs = scratch.staged(hubs.select("key", "many", F.col("h.row").alias("x"), F.col("h.size").alias("m"), F.col("h.root").alias("s"), F.col("h.weight").alias("w"), F.col("h.rest").alias("left")), "hubs")
    met = storage.joined(filed, hubs, "key", "many", total).where("root <> s")
    if every:  # the hub's own component needs no pairs within, so the others ask
        met = met.select("key", F.col("row").alias("x"), F.col("size").alias("m"), F.col("root").alias("s"), F.col("weight").alias("w"), F.col("rest").alias("left"), F.col("s").alias("h")).join(filed.hint("merge"), "key").where("root <> s")
    heavier = (F.col("w") > F.col("weight")) | ((F.col("w") == F.col("weight")) & (F.col("x") >= F.col("row")))
    ends = F.when(heavier, F.struct(F.col("x").alias("a"), F.col("row").alias("b"))).otherwise(F.struct(F.col("row").alias("a"), F.col("x").alias("b")))
    if every:  # where both ask, the heavier one does
        met = met.where(heavier | (F.col("root") == F.col("h")))
    met = met.where(first_shared(F.col("m"), F.col("size"), F.col("left"), F.col("rest"), least))
    return met.select(ends.alias("p"), F.least("m", "size").alias("m"), F.greatest("m", "size").alias("size")).select("p.a", "p.b", "m", "size")


def sharing(shared: DataFrame, total: int, roots: DataFrame, least: float, every: bool, scratch: storage.Scratch) -> DataFrame:
    """Pairs (a, b) of rows of two components that share prefix shingles and could be similar by sizes and number shared.

    ``shared`` (``total`` rows) is on disk.  With ``every``, all of them; otherwise of each shingle
    only those with one row, the one whose shingles the most rows share, which in a family of
    copies is the original: a cheap pass that joins most, so that few are left to meet each other.
    ``a`` is the row of the greater weight.
    """
    rooted = shared.join(roots.hint("merge"), shared["row"] == roots["node"], "left").select("key", "row", "size", "rest", "n", F.coalesce("root", "row").alias("root"))
    rooted = scratch.staged(rooted, "rooted")
    live = rooted.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("r"), F.max("root").alias("z")).where("r < z").select("key", F.col("rows").alias("many"), "rows")
    filed = scratch.staged(storage.joined(rooted.drop("n"), scratch.staged(live, "keys"), "key", "many", total), "live")
    held = scratch.staged(filed.groupBy("row").agg(F.sum("rows").alias("weight"), F.collect_list("key").alias("keys")), "held")
    filed = scratch.staged(filed.drop("rows").join(held.drop("keys").hint("merge"), "row"), "weighed")
    pairs = scratch.staged(meetings(filed, total, least, every, scratch).distinct(), "met")
    many = pairs.count()
    for end in ("a", "b"):  # all live shingles of their prefixes, not only those at which they met
        asked = pairs.groupBy(end).agg(F.count("*").alias("many")).join(held.hint("merge"), F.col(end) == F.col("row")).select(end, "many", F.col("keys").alias(f"keys_{end}"))
        pairs = storage.joined(pairs, asked, end, "many", many)
    return pairs.where(possible(F.col("m"), F.col("size"), F.size(F.array_intersect("keys_a", "keys_b")), least)).select("a", "b")


def deduplicated(docs: DataFrame, words: int = STAGE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` of which each group of near copies keeps one: the least (doc_id, row).

    Near copies share ``least`` of their distinct word shingles, or are linked by others that do.
    Texts with the same words in the same order are one from the start; so are all null, empty and
    blank texts.  A null doc_id comes after all others, equal ones are told apart by their place.
    An empty table stays empty; other columns are kept, but for those named in ``ADDED``.
    """
    names = [c for c in docs.columns if c not in ADDED]
    spark = docs.sparkSession
    full = storage.staged(sketched(docs.select(*names), words, least), "sketched")
    kept, scratch = storage.Scratch(spark), storage.Scratch(spark)
    order = (F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__row").alias("row"))
    first = full.groupBy("__same").agg(F.min(F.struct(*order)).alias("r")).select(F.col("r.row").alias("__row"))
    reps = full.join(first.hint("merge"), "__row", "left_semi").select(*order, F.col("__fp").alias("fp"), F.col("__size").alias("size"), F.col("__prefix").alias("prefix"))
    reps = kept.staged(reps, "representatives")
    roots = spark.createDataFrame([], "node long, root long")
    shared = kept.staged(shared_prefixes(reps), "shared")
    total = shared.count()
    for source in (lambda: near_prints(reps, scratch), lambda: sharing(shared, total, roots, least, False, scratch), lambda: sharing(shared, total, roots, least, True, scratch)):
        pairs = scratch.staged(source(), "pairs")
        if not pairs.isEmpty():
            asked = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
            texts = full.select(F.col("__row").alias("row"), F.col("text").cast("string").alias("text")).join(asked.hint("merge"), "row", "left_semi")
            found = scratch.staged(similar(pairs, scratch.staged(texts, "texts"), words, least), "found")
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
            roots = kept.staged(components(known, scratch), "roots")
        scratch.drop()
    grouped = reps.select("no_id", "doc_id", "row").join(roots.hint("merge"), F.col("row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row"))
    stays = storage.staged(grouped.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("r")).select(F.col("r.row").alias("__row")), "stays")
    kept.drop()
    # what stays grows with the corpus, so it is never broadcast: the plan is the same at every size
    return full.join(stays.hint("merge"), "__row", "left_semi").select(*names)
