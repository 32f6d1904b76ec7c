"""Supervised quality classifier over learned subword embeddings.

A word is its hashed id and the hashed character n-grams of ``<word>``; a document is the mean of
its features' learned vectors; a softmax layer gives the class.  Vectors and layer are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows: the ``TRAIN_DOCS`` rows
of ``labels`` with the least hash of doc_id, with their whole texts.  Texts become bags of features
where they are, and one task trains on the sample's bags, so neither passes through the driver,
which gets the fitted numbers alone.  Scoring takes whole texts: the mean commutes with the layer,
so each distinct word adds one number and its count of features.

Defined cases: a null or empty text scores the prior (the layer's bias); labels that are null or
not 0 or 1, and rows of fold 2, are not learned from; without any learnable label, or with one
class only, the smoothed share of the class is every score; a null doc_id is in fold 0; repeated
rows are scored each; columns other than doc_id and text are no input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rillmark.llm import storage

TRAIN_DOCS = 5000
BUCKETS, DIMENSIONS = 1 << 16, 12
EPOCHS, RATE, LOSS_SMOOTHING = 4, 0.5, 0.02
NGRAMS = (3, 4)
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
WORDS_KEPT = 300_000


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % FOLDS


def features(word: str, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed ids of a word and of its character n-grams."""
    own = f"<{word}>"
    grams = [own] + [own[i : i + n] for n in NGRAMS for i in range(len(own) - n + 1)]
    return np.array([zlib.crc32(g.encode("utf-8", "replace")) % buckets for g in grams])


def words(text: str | None) -> list[str]:
    return (text or "").split()


class Model:
    """What scoring needs: each bucket's share in the log odds, and the bias."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share, bias

    def score(self, total: complex) -> float:
        """``total``: sum of shares, and as imaginary part the number of features."""
        odds = self.bias + (total.real / total.imag if total.imag else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


class WordShares(dict):
    """word -> its features' summed share and, as imaginary part, their number."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> complex:
        f = features(word, len(self.model.share))
        out = complex(float(self.model.share[f].sum()), len(f))
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = out
        return out


def bag(text: str | None, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a whole text and how often each occurs."""
    ids = []
    for word in words(text):
        own = known.get(word)
        if own is None:
            if len(known) >= WORDS_KEPT // 4:
                known.clear()
            own = known[word] = features(word).astype("<i4")
        ids.append(own)
    found, counts = np.unique(np.concatenate(ids) if ids else np.zeros(0, "<i4"), return_counts=True)
    return found.astype("<i4"), counts.astype("<i4")


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent over documents' bags, in a fixed random order."""
    y = np.asarray(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((2, DIMENSIONS)), np.array([-prior / 2, prior / 2])
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, counts = bags[i]
            if not len(ids):
                continue
            weights = counts / counts.sum()
            mean = weights @ vectors[ids]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            wanted = np.full(2, LOSS_SMOOTHING / 2)
            wanted[y[i]] += 1 - LOSS_SMOOTHING
            error = p - wanted
            back = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= 0.05 * rate * error
            # a feature's share of the mean is tiny, so its step is scaled up to the mean's
            vectors[ids] -= rate * min(50.0, len(ids)) * np.outer(weights, back)
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS, seed: int = 7) -> Model:
    """Train on the bounded sample of labelled rows outside the held-out fold."""
    storage.small_batches(docs.sparkSession)
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).distinct()
    known = known.orderBy(order, "doc_id", "y").limit(sample)  # so many rows at most: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").select(order.alias("at"), "doc_id", "y", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids, counts = bag(text, seen)
                own = [batch.column(n)[i : i + 1] for n in ("at", "doc_id", "y")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([ids.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["at", "doc_id", "y", "ids", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r["at"], r["doc_id"], r["y"], r["ids"], r["counts"]) for batch in batches for r in batch.to_pylist())[:sample]
        model = train([(np.frombuffer(i, "<i4"), np.frombuffer(c, "<i4")) for *_, i, c in held], [r[2] for r in held], seed)
        yield pa.RecordBatch.from_arrays([pa.array([model.share.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], ["share", "bias"])

    # the sample is bounded by its parameter, so one task holds it
    bagged = rows.mapInArrow(bags, "at long, doc_id long, y int, ids binary, counts binary")
    sampled = bagged.orderBy("at", "doc_id", "y", "ids", "counts").limit(sample)  # also where a doc_id has many rows
    got = sampled.mapInArrow(learn, "share binary, bias double").first()
    if got is None:  # nothing to learn from
        return train([], [], seed)
    return Model(np.frombuffer(got["share"], "<f4"), got["bias"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` whose names are free, with held_out, score and predicted."""
    storage.small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = WordShares(model)
        for batch in batches:
            got = [model.score(sum(map(shares.__getitem__, words(t)), 0j)) for t in batch.column("__text").to_pylist()]
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(got, pa.float64())], [n for n, _ in kept] + ["score"])

    kept = docs.select(*names, fold(F.col("doc_id")).eqNullSafe(HELD_OUT).alias("held_out"))
    out = kept.withColumn("__text", F.col("text").cast("string")) if "text" in names else kept
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    return out.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(narrow, model).select("doc_id", "held_out", "score", "predicted")
