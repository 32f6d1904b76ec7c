"""Scans and sinks: JSON lines, Parquet with contracts, metric logs, manifests, dumps."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_parquet(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def nested(df: DataFrame, column: str, path: Sequence[str]) -> Column:
    """A field below ``column``."""
    out = F.col(column)
    for name in path:
        out = out.getField(name)
    return out


def read_jsonl(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """Lines as rows; a line that does not fit the schema ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths))


def read_jsonl_strict(spark: SparkSession, path: str) -> DataFrame:
    """``value``: canonical text of every non-blank line; repeated keys, NaN and non-objects are errors."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(canonical_json("value").alias("value"))


def _strict(text: str | None) -> str | None:
    if text is None:
        return None

    def unique(pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key is repeated")
        return out

    def refuse(name: str) -> float:
        raise ValueError(f"{name} is no JSON number")

    value = json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
    if not isinstance(value, dict):
        raise ValueError("a line is no object")
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no blanks."""
    return text.map(_strict)


def write_jsonl(df: DataFrame, path: str, append: bool = False, drop_private: bool = False) -> None:
    kept = [c for c in df.columns if not (drop_private and c.startswith("_"))]
    df.select(*kept).write.mode("append" if append else "overwrite").json(path)


def write_csv(parts: Sequence[DataFrame], path: str, first: Sequence[str] = ()) -> None:
    """The union of rows with different columns: ``first`` come first, missing values are empty."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    columns = [c for c in first if c in out.columns] + [c for c in out.columns if c not in first]
    out.select(*columns).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def metric_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(wandb_step, step, metrics): lines ``step:N - key:value - ...``; a logged global step wins."""
    text = F.col(column)
    found = lines.where(text.rlike(r"^step:") & text.contains(" - "))
    pairs = F.regexp_extract_all(text, F.lit(r"([A-Za-z][\w/@.\-]*):(-?[0-9.eE+\-]+)"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(.*):[^:]*$", 1).alias("key"), F.regexp_extract(p, r":([^:]*)$", 1).try_cast("double").alias("value")))
    # a key that comes again keeps its last value
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    parsed = found.select(F.map_from_entries(last).alias("metrics"))
    own = F.try_element_at("metrics", F.lit("step")).cast("long")
    return parsed.select(own.alias("wandb_step"), F.coalesce(F.try_element_at("metrics", F.lit("training/global_step")).cast("long"), own).alias("step"), "metrics")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path below ``root``, size and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", f"^.*{root.rstrip('/').rsplit('/', 1)[-1]}/", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def check_chunks(df: DataFrame) -> DataFrame:
    """Gaps and overlaps of chunks (start, stop): rows whose start is not the stop before it."""
    from pyspark.sql import Window

    before = F.lag("stop").over(Window.orderBy("start"))  # a row a file
    return df.withColumn("expected", F.coalesce(before, F.lit(0))).where("start <> expected")


def dump_generations(df: DataFrame, path: str) -> None:
    """One folder a step; rows keep any further column."""
    df.write.mode("append").partitionBy("step").json(path)


def read_or_write(df: DataFrame, path: str) -> DataFrame:
    """What was written at ``path`` before, or ``df``, written there now."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_in_order(df: DataFrame, rank: str, path: str) -> None:
    """Files whose names follow ``rank``: range partitions, each sorted."""
    df.repartitionByRange(F.col(rank)).sortWithinPartitions(rank).write.mode("errorifexists").parquet(path)


def sha256_lines(ids: Column) -> Column:
    """Digest of the ids in their order, each followed by a newline."""
    return F.sha2(F.concat_ws("", F.transform(ids, lambda x: F.concat(x.cast("string"), F.lit("\n")))), 256)
