"""Staging tables in the folder that all executors share.

Every table that is read more than once is written as Parquet below
``spark.checkpoint.dir`` and read again, so a lost executor costs a task and not a lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, a folder of this machine if it is the only one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='rillmark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/rillmark/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to ``path`` and return a frame over the written files."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, new_path(df.sparkSession, label))


#: A key is heavy where it has more than this share of the rows, so there are ``HEAVY_MOST`` at most.
HEAVY_MOST = 500


def joined(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key, with the key's number of rows in ``count``).

    A key that many rows have would send them all to one task, so the few heavy keys (no more than
    ``HEAVY_MOST``, whatever the size) are broadcast, and only the others are dealt by key.  Null
    keys take no part in ``table``; ``how`` is inner or left.
    """
    least = max(1, total // HEAVY_MOST)
    extra = [c for c in table.columns if c not in (key, count)]
    heavy = F.broadcast(table.where(F.col(count) > least).select(F.col(key).alias("__key"), F.struct(*extra).alias("__heavy")))
    marked = rows.join(heavy, F.col(key) == F.col("__key"), "left").drop("__key")
    light = table.where(F.col(count) <= least).select(F.col(key).alias("__key"), F.struct(*extra).alias("__light"))
    names = rows.columns
    done = marked.where("__heavy IS NOT NULL").select(*names, *[F.col(f"__heavy.{c}").alias(c) for c in extra])
    rest = marked.where("__heavy IS NULL").drop("__heavy").join(light.hint("merge"), F.col(key) == F.col("__key"), how)
    return done.unionByName(rest.select(*names, *[F.col(f"__light.{c}").alias(c) for c in extra]))


class Scratch:
    """The staging tables of one operator, dropped when it is done with them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(new_path(self.spark, label))
        return write_table(df, self.paths[-1])

    def keep(self) -> None:
        """What has been staged so far stays: the result reads it."""
        self.paths = []

    def drop(self) -> None:
        for path in self.paths:
            drop_table(self.spark, path)
        self.paths = []
        self.spark._jvm.System.gc()  # the shuffle files of finished jobs go when the driver forgets them


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a staging table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that carry whole texts: very long texts come in small numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` at most for what runs within; the session's own bound afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def wider(batches: Iterator[pa.RecordBatch], rows: int = 16_384) -> Iterator[pa.RecordBatch]:
    """The same narrow rows in fewer batches, for work whose cost is by the batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
