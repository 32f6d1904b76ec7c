"""Periodic runs of words in whole texts, by divide and conquer.

A run is a stretch of consecutive words with smallest period q that is at least ``LEAST`` words and
``TIMES`` periods long and that no neighbouring word extends keeping the period.  Words become small
numbers; a text is halved again and again, and at each midpoint Z-functions of the right half, of
the left half reversed and of each followed by the other tell for every q how far words q apart agree
around it (Main and Lorentz).  A run crosses some first midpoint on the way down and lies whole
within that block, so what reaches a block's edge and goes on beyond it belongs to a run found
before and is left out.  Equal intervals are one run, of the smallest period found.

A Z-function is nonzero only where the first word occurs again, so only those places are visited,
and a block is entered only if ``GRAM`` words in it occur again in it: every run has at least that
many words that agree with those q further.

Defined cases: a null, empty or blank text has no words, no run, four nulls and two digests of the
empty string; a null doc_id is never rewritten; repeated rows are judged each; an empty table gives no
rows; other columns are not read.  Words are separated by the ASCII blanks alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import storage

LEAST, TIMES, GRAM = 24, 3, 16

Run = tuple[int, int, int]
"""start, length, period"""


def interned(words: list[bytes]) -> np.ndarray:
    """Small numbers, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def z_function(p: np.ndarray, t: np.ndarray | None = None) -> np.ndarray:
    """For each place of ``t`` how many words from there on are those that ``p`` begins with; ``p`` in itself without ``t``."""
    out = np.zeros(len(p) if t is None else len(t), np.int64)
    if not len(p) or not len(out):
        return out
    own = t is None
    z = out if own else z_function(p)
    where = np.flatnonzero((p if own else t) == p[0])
    if own:
        out[0] = len(p)
        where = where[1:]
    if not len(where):
        return out
    a, b, known = p.tolist(), (p if own else t).tolist(), [0] * len(p)
    if not own:
        known = z.tolist()
    n, m, left, right = len(b), len(a), 0, 0
    for i in where.tolist():
        k = min(right - i, known[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and k < m and b[i + k] == a[k]:
                k += 1
            left, right = i, i + k
        out[i] = k
        if own:
            known[i] = k
    return out


def crossing(w: np.ndarray, s: int, m: int, e: int) -> np.ndarray:
    """(start, length, period) of the repetitions of block [s, e) around its midpoint, those of a run's size."""
    u, v = w[s:m][::-1], w[m:e]
    right, left = z_function(v), z_function(u)
    most = (e - s) // TIMES
    q = np.arange(1, most + 1)
    at = lambda z: np.where(q < len(z), z[np.minimum(q, len(z) - 1)], 0)
    zr, zl = at(right), at(left)
    q, zr, zl = (x[(zr > 0) | (zl > 0)] for x in (q, zr, zl))
    if not len(q):
        return np.zeros((0, 3), np.int64)
    # how far the words before the midpoint agree with those before place m + q, and those from m - q on with those from m on
    before, after = z_function(u, v[::-1]), z_function(v, w[s:m])
    back = np.where(q <= len(v), before[np.clip(len(v) - q, 0, len(v) - 1)], 0)
    ahead = np.where(q <= len(u), after[np.clip(len(u) - q, 0, len(u) - 1)], 0)
    back = np.where(back >= q, q + zl, back)
    ahead = np.where(ahead >= q, q + zr, ahead)
    begin = np.concatenate([m - back, m - q - zl])
    stop = np.concatenate([m + zr, m - q + ahead])  # of the first word's place, so the run ends a period later
    q = np.concatenate([q, q])
    begin, size = begin, stop + q - begin
    fits = size >= np.maximum(LEAST, TIMES * q)
    begin, size, q = begin[fits], size[fits], q[fits]
    end, n = begin + size, len(w)
    more = (begin > 0) & (w[np.maximum(begin - 1, 0)] == w[begin - 1 + q])
    more |= (end < n) & (w[np.minimum(end, n - 1)] == w[end - q])
    return np.stack([begin, size, q], axis=1)[~more]


def again(w: np.ndarray) -> np.ndarray:
    """How many of the first i places begin ``GRAM`` words that occur again (equal hashes at least)."""
    n = len(w) - GRAM + 1
    h = w.astype(np.uint64) + np.uint64(1)
    step = 1
    with np.errstate(over="ignore"):
        while step < GRAM:
            h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step)) ^ (h[step:] + (h[step:] << np.uint64(31)))
            step *= 2
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    mark = np.zeros(n, np.int64)
    mark[order[:-1][same]] = 1
    return np.concatenate([[0], np.cumsum(mark)])


def runs(w: np.ndarray) -> list[Run]:
    """All runs, by start and period."""
    if len(w) < LEAST:
        return []
    repeated = again(w)
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(w))]
    while todo:
        s, e = todo.pop()
        if e - s < LEAST or repeated[e - GRAM + 1] == repeated[s]:
            continue
        m = (s + e) // 2
        for start, size, q in crossing(w, s, m, e).tolist():
            found[start, size] = min(q, found.get((start, size), q))
        todo += [(s, m), (m, e)]
    return sorted((start, size, q) for (start, size), q in found.items())


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in some documents repeating from a place on: those whose crc32 is divisible by ten."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Which words stay: those in no run beyond its first period."""
    inside = np.zeros(n + 1, np.int64)
    for start, size, q in found:
        inside[start + q] += 1
        inside[start + size] -= 1
    return np.cumsum(inside[:n]) == 0


def strongest(found: list[Run]) -> Run | None:
    """The run of the most periods, exactly; then the first, then the one of the smaller period."""
    best = None
    for run in found:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def described(text: bytes | None, doc_id: int | None, rewrite: bool) -> tuple:
    """The columns of ``SCHEMA`` after doc_id."""
    words = (text or b"").split()
    if rewrite:
        words = rewritten(words, doc_id)
    found = runs(interned(words))
    top = strongest(found)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    rest = words if not found else [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()]
    numbers = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(found), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(rest)).hexdigest()


def periodic_runs(docs: DataFrame, rewrite: bool = True) -> DataFrame:
    """doc_id, n_runs, the strongest run and the digests of all runs and of the collapsed text, for every row."""
    storage.small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [described(t, i, rewrite) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, SCHEMA)


def without_runs(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts keep of every run the first period; texts without runs are unchanged."""
    storage.small_batches(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                found = runs(interned(words))
                out.append(text if not found else b" ".join(words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
