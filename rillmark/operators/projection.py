"""Seeded random projection of vectors, without a stored matrix.

The entry for component i and output j is a sign that a counter-based generator gives for (seed, i, j), so any task
makes the entries it needs, in blocks of components, and the same seed gives the same output
however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers of a counter (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signs(seed: int, begin: int, end: int, outputs: int) -> np.ndarray:
    """(component, output) of +1 and -1 for components ``begin`` to ``end``; each word of the generator makes 64."""
    words = -(-outputs // 64)
    with np.errstate(over="ignore"):
        counter = np.arange(begin, end, dtype=np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)[None]
        made = mixed(counter ^ mixed(np.array([seed], np.uint64)))
    bits = made[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
    return 1.0 - 2.0 * bits.reshape(end - begin, -1)[:, :outputs]


def project(rows: DataFrame, key: str, vector: str, outputs: int, seed: int = 0) -> DataFrame:
    """key and projected (array<double>): signed sums of the components over the root of ``outputs``.

    Lengths of vectors may differ, as missing components count as zeros.  A null vector, or one with
    a null component, stays null; an empty one becomes zeros; NaN and infinities spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            out = np.zeros((len(batch), outputs))
            for begin in range(0, int(sizes.max(initial=0)), COMPONENTS):
                if begin not in known:
                    if len(known) > 8:
                        known.clear()
                    known[begin] = signs(seed, begin, begin + COMPONENTS, outputs)
                for i in np.flatnonzero(sizes > begin).tolist():  # row by row: the sums' order is the same in any batch
                    part = values[starts[i] + begin : min(starts[i + 1], starts[i] + begin + COMPONENTS)]
                    out[i] += np.add.reduce(part[:, None] * known[begin][: len(part)], axis=0)
            flat = pa.array((out / sqrt(outputs)).ravel())
            offsets = pa.array(np.arange(len(batch) + 1, dtype="i4") * outputs)
            made = pa.ListArray.from_arrays(offsets, flat, mask=pa.array(batch.column(2).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], [key, "projected"])

    x = F.col(vector).cast("array<double>")
    absent = x.isNull() | F.exists(F.coalesce(x, F.array().cast("array<double>")), lambda c: c.isNull())
    narrow = rows.select(key, F.when(absent, F.array().cast("array<double>")).otherwise(x).alias("v"), absent.alias("absent"))
    kind = rows.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, projected array<double>")
