"""Columnar batch algebra over DataFrames whose order is an explicit ``row_id`` (0, 1, 2, ...).

Positional operators are joins, filters and generators on row_id, so none needs a global sort of
the rows it returns; only :func:`number_rows` orders, and it does so by range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.sources.staging import staged

ROW = "row_id"


def number_rows(df: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
    """Add consecutive row_id in the given order without gathering the rows in one task.

    Rows are range-partitioned and sorted; only one count per partition meets in a single task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    parted = staged(parted)
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))  # as many rows as partitions
    return parted.join(F.broadcast(starts), "__part").withColumn(ROW, F.col("__start") + local).drop("__part", "__at", "__start")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(ROW, *columns)


def pop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest), both keyed by row_id; a missing column is an error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no column {missing}")
    return df.select(ROW, *columns), df.drop(*columns)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def take(df: DataFrame, indices: DataFrame | Sequence[int]) -> DataFrame:
    """Rows at ``indices``, in that order and with repeats; the new row_id is the place in the list.

    A list comes from the driver and is small; a DataFrame (row_id, index) may be of any size.
    """
    if not isinstance(indices, DataFrame):
        indices = df.sparkSession.createDataFrame(list(enumerate(indices)), f"{ROW} long, index long")
    return df.withColumnRenamed(ROW, "index").join(indices, "index").drop("index")


def where_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, rows: int | None = None) -> DataFrame:
    """Rows start, start + step, ... before stop; negative bounds count from the end."""
    if step < 1:
        raise ValueError("step must be positive")
    if any(x is not None and x < 0 for x in (start, stop)):
        rows = df.count() if rows is None else rows
    low = max(0, start + rows if start is not None and start < 0 else start or 0)
    out = df.where((F.col(ROW) >= low) & ((F.col(ROW) - low) % step == 0))
    if stop is not None:
        out = out.where(F.col(ROW) < (stop + rows if stop < 0 else stop))
    return out


def repeat(df: DataFrame, times: int, interleave: bool = True, rows: int | None = None) -> DataFrame:
    """Each row ``times`` times: aabb if interleaved, else abab."""
    made = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("__k", F.lit(0))
    if interleave:
        new = F.col(ROW) * times + F.col("__k")
    else:
        new = F.col("__k") * F.lit(df.count() if rows is None else rows) + F.col(ROW)
    return made.withColumn(ROW, new.cast("long")).drop("__k")


def repeat_each(df: DataFrame, count: Column) -> DataFrame:
    """Each row as often as its ``count`` says (0 drops it); ``copy`` numbers the copies."""
    return df.withColumn("copy", F.explode(F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def unfold_chunks(df: DataFrame, splits: int, columns: Sequence[str]) -> DataFrame:
    """Each row in ``splits`` rows: array ``columns`` are cut into equal runs, others repeated."""
    made = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    for c in columns:
        size = (F.size(c) / F.lit(splits)).cast("int")
        made = made.withColumn(c, F.when(size > 0, F.slice(c, F.col("chunk") * size + 1, F.greatest(size, F.lit(1)))).otherwise(F.slice(c, 1, 0)))
    return made.withColumn(ROW, F.col(ROW) * splits + F.col("chunk"))


def fold(df: DataFrame, size: int, columns: Sequence[str]) -> DataFrame:
    """Groups of ``size`` neighbouring rows; each column becomes an array in row order."""
    rows = F.array_sort(F.collect_list(F.struct(ROW, *columns)))  # size rows a group
    folded = df.groupBy(F.floor(F.col(ROW) / size).cast("long").alias("group_id")).agg(rows.alias("__rows"))
    return folded.select("group_id", *[F.col(f"__rows.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, size: int, columns: Sequence[str]) -> DataFrame:
    return df.select("group_id", F.posexplode(F.arrays_zip(*columns)).alias("__k", "__r")).select((F.col("group_id") * size + F.col("__k")).alias(ROW), *[F.col(f"__r.{c}").alias(c) for c in columns])


def chunk(df: DataFrame, chunks: int, rows: int | None = None) -> DataFrame:
    """Add ``chunk``: equal runs of neighbouring rows; the number of rows must be a multiple."""
    rows = df.count() if rows is None else rows
    if rows % chunks:
        raise ValueError(f"{rows} rows do not make {chunks} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(ROW) / max(1, rows // chunks)).cast("long"))


def split(df: DataFrame, size: int) -> DataFrame:
    """Add ``block``: runs of ``size`` rows, the last of which may be shorter."""
    return df.withColumn("block", F.floor(F.col(ROW) / size).cast("long"))


def shard_bounds(total: int, shards: int, index: int) -> tuple[int, int]:
    """Rows [start, stop) of a shard when each holds floor(total / shards) + 1, the last what is left."""
    size = total // shards + 1
    return min(total, index * size), min(total, (index + 1) * size)


def pad_to_divisor(df: DataFrame, divisor: int, rows: int | None = None) -> DataFrame:
    """Append rows from the head, again and again, up to a multiple of ``divisor``; they are ``is_pad``."""
    rows = df.count() if rows is None else rows
    need = -rows % divisor if rows else 0
    own = df.withColumn("is_pad", F.lit(False))
    if not need:
        return own
    # a head row comes back every ``rows`` places
    times = F.floor((F.lit(need - 1) - F.col(ROW)) / rows).cast("int")
    head = df.where(F.col(ROW) < need).withColumn("__k", F.explode(F.sequence(F.lit(0), times)))
    more = head.withColumn(ROW, F.lit(rows) + F.col("__k") * rows + F.col(ROW)).drop("__k")
    return own.unionByName(more.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def pad_with(df: DataFrame, count: int, candidate: str = "first", rows: int | None = None) -> DataFrame:
    """Append ``count`` copies of the first or last row."""
    rows = df.count() if rows is None else rows
    row = df.where(F.col(ROW) == (0 if candidate == "first" else rows - 1))
    more = repeat_each(row, F.lit(count)).withColumn(ROW, F.lit(rows) + F.col("copy")).drop("copy")
    return df.unionByName(more)


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both by position; a column of both must agree (NaN equals NaN), else an error."""
    shared = [c for c in left.columns if c in right.columns and c != ROW]
    other = right.select(F.col(ROW).alias("__r"), *[F.col(c).alias(f"__{c}" if c in shared else c) for c in right.columns if c != ROW])
    joined = left.join(other, left[ROW] == other["__r"], "full")
    fine = F.col(ROW).isNotNull() & F.col("__r").isNotNull()
    for c in shared:
        fine &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    checked = F.when(fine, F.col(ROW)).otherwise(F.raise_error(F.lit("rows or shared columns differ")).cast("long"))
    return joined.withColumn(ROW, checked).drop("__r", *[f"__{c}" for c in shared])


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, one after the other; row_id goes on."""
    out, at = None, 0
    for part in parts:
        moved = part.withColumn(ROW, F.col(ROW) + F.lit(at))
        out = moved if out is None else out.unionByName(moved)
        at += part.count()
    return out


def balanced_order(df: DataFrame, seed: int) -> DataFrame:
    """A seeded order of the rows: by hash, then row_id."""
    return df.withColumn("__h", F.xxhash64(F.col(ROW), F.lit(seed))).orderBy("__h", ROW).drop("__h")
