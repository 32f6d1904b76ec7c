"""Tables written once and read several times, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again.

    What depends on how rows were dealt to partitions must be read, not computed twice: the bounds
    of a range partitioning are sampled anew each time.
    """
    spark = df.sparkSession
    path = staging_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staging_path(spark: SparkSession) -> str:
    """A new path below the shared folder; a folder of this machine only where it is the only one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='rillmark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rillmark/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many partitions as there are cores, if it has fewer.

    A file of one row group is one task, however much work its rows make; large inputs have
    partitions enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: A key is heavy where it has more than this share of the rows, so there are so many at most.
HEAVY_MOST = 500


def joined_by_count(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, added: str) -> DataFrame:
    """``rows`` with column ``added`` of ``table`` (one row a key, with its number of rows in ``count``), null where the key is not in it.

    The few heavy keys are broadcast, and only the others are dealt by key, so no task gets a third
    of the rows because they share a value.
    """
    least = max(1, total // HEAVY_MOST)
    side = lambda test, name: table.where(test).select(F.col(key).alias(f"__key_{name}"), F.struct(added).alias(f"__{name}"))
    marked = rows.join(F.broadcast(side(F.col(count) > least, "heavy")), F.col(key) == F.col("__key_heavy"), "left").drop("__key_heavy")
    done = marked.where("__heavy IS NOT NULL").select(*rows.columns, F.col(f"__heavy.{added}").alias(added))
    rest = marked.where("__heavy IS NULL").drop("__heavy").join(side(F.col(count) <= least, "light").hint("merge"), F.col(key) == F.col("__key_light"), "left")
    return done.unionByName(rest.select(*rows.columns, F.col(f"__light.{added}").alias(added)))
