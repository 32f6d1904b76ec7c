"""Named extension points: reward managers, tool parsers, datasets, generators and ways to deal batches."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import grading, rewards
from rillmark.functions import text as t
from rillmark.operators import batch


class Registry(dict):
    """name -> thing; a second thing of the same name is an error, an unknown name names the known ones."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, *names: str) -> Callable:
        def add(thing: Any) -> Any:
            for name in names:
                if self.setdefault(name, thing) is not thing:
                    raise ValueError(f"there is a {self.kind} {name} already")
            return thing

        return add

    def find(self, name: str) -> Any:
        if name not in self:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self))}")
        return self[name]


TOOL_PARSERS, MANAGERS, DATASETS, GENERATORS, DISPATCH = (Registry(k) for k in ("tool parser", "reward manager", "dataset", "generator", "way to deal"))
TOOL_PARSERS.register("hermes")(t.tool_calls)
TOOL_PARSERS.register("gpt-oss")(grading.channel_calls)


@MANAGERS.register("naive", "batch")
def scored(df: DataFrame, score: Callable[..., Column] | None = None, response: str = "response", truth: str = "truth", source: str = "data_source", mask: str = "mask") -> DataFrame:
    """Add ``acc`` (the source's score, or the given function's) and ``rewards`` (it at the last token that counts)."""
    value = score(F.col(source), F.col(response), F.col(truth)) if score else rewards.score(F.col(source), F.col(response), F.col(truth))
    out = df.withColumn("acc", value)
    return out.withColumn("rewards", rewards.place_at_end(F.col("acc"), F.col(mask)))


@MANAGERS.register("dapo")
def scored_with_length(df: DataFrame, longest: int, buffer: int, factor: float = 1.0, end: str = "", score: Callable[..., Column] | None = None, response: str = "response", mask: str = "mask", **columns: str) -> DataFrame:
    """As ``naive``, on the response without its end mark, and less what an overlong response costs."""
    from rillmark.operators.routing import overlong_penalty

    text = F.col(response)
    plain = F.when(text.endswith(F.lit(end)), F.left(text, F.length(text) - len(end))).otherwise(text) if end else text
    out = scored(df.withColumn(response, plain), score, response, mask=mask, **columns)
    n = F.aggregate(mask, F.lit(0), lambda a, m: a + (m != 0).cast("int"))
    out = out.withColumn("overlong", overlong_penalty(n, longest, buffer, factor))
    return out.withColumn("rewards", rewards.place_at_end(F.col("acc") + F.col("overlong"), F.col(mask)))


def custom(path: str, name: str, **options: Any) -> Callable:
    """A function of a Python file, with options bound; a missing file or name is an error."""
    spec = importlib.util.spec_from_file_location("custom_reward", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return partial(getattr(module, name), **options)


def manager(name: str, **options: Any) -> Callable[[DataFrame], DataFrame]:
    """The named manager with its options."""
    return partial(MANAGERS.find(name), **options)


@DATASETS.register("parquet")
def parquet_rows(spark: SparkSession, paths: list[str], most: int = -1, **_: Any) -> DataFrame:
    """All rows of the files, or so many of them."""
    rows = spark.read.parquet(*paths)
    return rows if most < 0 else rows.limit(most)


def dataset(spark: SparkSession, kind: str, paths: list[str], **options: Any) -> DataFrame:
    """Rows by the named kind; with option ``generator``, the generator's rows after them."""
    maker = options.pop("generator", None)
    rows = DATASETS.find(kind)(spark, paths, **options)
    return rows.unionByName(GENERATORS.find(maker)(rows), allowMissingColumns=True) if maker else rows


@DISPATCH.register("chunks")
def chunks(df: DataFrame, parts: int) -> Iterator[DataFrame]:
    """Equal runs of neighbouring rows, one after the other."""
    cut = batch.chunk(df, parts)
    for i in range(parts):
        yield cut.where(F.col("chunk") == i).drop("chunk")


@DISPATCH.register("all")
def everywhere(df: DataFrame, parts: int) -> Iterator[DataFrame]:
    """The whole batch for each part."""
    for _ in range(parts):
        yield df
