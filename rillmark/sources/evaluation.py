"""Scans and sinks of evaluation: releases, problem rows, arrays, probe tables and results."""

from __future__ import annotations

import ast
import io
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: how many files the newest release has.
RELEASES = 6


def release_files(name: str, newest: int = RELEASES) -> list[str]:
    """The files of ``release_vN`` (all up to N), ``vN`` (that one) or ``vA_vB`` (from A to B)."""
    if m := re.fullmatch(r"release_(?:v(\d+)|latest)", name):
        numbers = range(1, int(m[1] or newest) + 1)
    elif m := re.fullmatch(r"v(\d+)(?:_v(\d+))?", name):
        numbers = range(int(m[1]), int(m[2] or m[1]) + 1)
    else:
        raise ValueError(f"no release {name}")
    if not numbers or numbers[-1] > newest or numbers[0] < 1:
        raise ValueError(f"no release {name}")
    return ["test.jsonl" if i == 1 else f"test{i}.jsonl" for i in numbers]


TESTS = "array<struct<input:string,output:string,testtype:string>>"


def problems(lines: DataFrame) -> DataFrame:
    """Typed problems: date, tests as arrays, function name.

    Private tests are read where they are plain JSON.  The packed form holds pickled data, which is
    never loaded: such rows have null tests and ``packed`` true.
    """
    private = F.from_json("private_test_cases", TESTS, {"mode": "PERMISSIVE"})
    plain = F.trim("private_test_cases").startswith("[")
    return lines.select(
        "question_id", "platform", "difficulty",
        F.to_timestamp("contest_date").alias("contest_date"),
        F.from_json("public_test_cases", TESTS).alias("public_tests"),
        F.when(plain, private).alias("private_tests"),
        (F.col("private_test_cases").isNotNull() & ~plain).alias("packed"),
        F.get_json_object("metadata", "$.func_name").alias("fn_name"),
    )


def evaluation_sample(public: Column, private: Column, name: Column) -> Column:
    """JSON {inputs, outputs, fn_name} of public and then private tests."""
    tests = F.concat(F.coalesce(public, F.array().cast(TESTS)), F.coalesce(private, F.array().cast(TESTS)))
    return F.to_json(F.struct(F.transform(tests, lambda t: t["input"]).alias("inputs"), F.transform(tests, lambda t: t["output"]).alias("outputs"), name.alias("fn_name")), {"ignoreNullFields": "false"})


def literal(text: str | None, kind: str = "list") -> str | None:
    """A JSON value as the Python literal of its kind: nested lists become tuples, sets or complex numbers."""
    if text is None:
        return None
    value = json.loads(text)
    make = {"list": lambda x: x, "tuple": lambda x: tuple(map(tuple_of, x)), "set": lambda x: [set(y) if isinstance(y, list) else y for y in x], "complex": lambda x: [complex(y) if isinstance(y, str) else y for y in x]}[kind]
    return repr(make(value))


def tuple_of(x):
    return tuple(map(tuple_of, x)) if isinstance(x, list) else x


def restored_inputs(text: Column, kind: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: literal(x, kind)), StringType())(text)


def literal_back(text: str, kind: str):
    """The value that ``literal`` wrote; complex numbers need arithmetic, which only their own form gets."""
    return ast.literal_eval(text) if kind != "complex" else [complex(x) for x in re.findall(r"\(?-?[\d.]+(?:[+-][\d.]+)?j\)?", text)]


def array_rows(spark: SparkSession, paths: Sequence[str], dtype: str, width: int) -> DataFrame:
    """path, row, v of little-endian two-dimensional .npy files; another type, order, shape or a pickled array is an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.dtype != np.dtype(dtype) or x.dtype.byteorder == ">" or x.ndim != 2 or x.shape[1] != width or np.isfortran(x):
                    raise ValueError(f"{path} holds {x.dtype} {x.shape}, not {dtype} rows of {width}")
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096].astype(float)
                    yield pd.DataFrame({"path": path, "row": np.arange(at, at + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(read, "path string, row long, v array<double>")


def vector_set(rows: DataFrame, ids: DataFrame, expected: DataFrame) -> DataFrame:
    """id, v: arrays joined with the ids of their places (path, row, id); ids that repeat, lack or are not expected are errors."""
    out = rows.join(ids, ["path", "row"], "full")
    counted = out.groupBy("id").agg(F.count("*").alias("n"), F.count("v").alias("vectors"))
    wrong = counted.join(expected.select(F.col("id").alias("__id")), F.col("id").eqNullSafe(F.col("__id")), "full").where("n <> 1 OR vectors <> 1 OR id IS NULL OR __id IS NULL")
    if not wrong.isEmpty():
        raise ValueError("the vectors are not those of the expected ids")
    return out.select("id", "v")


def probe_rows(spark: SparkSession, paths: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Rows of CSV files with a header; the named columns are numbers, null where they cannot be read."""
    raw = spark.read.option("header", True).csv(list(paths))
    return raw.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in raw.columns])


def last_rows(df: DataFrame, by: str, step: str) -> DataFrame:
    """Of each group the row of the greatest step."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), step).alias("r")).select(by, "r.*")


def write_results(df: DataFrame, path: str, key: str = "uid", order: str = "sample", right: str = "acc") -> None:
    """Problems with their samples as arrays below ``path``/results, and those with a wrong one below ``path``/mistakes."""
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("samples"))
    one.write.mode("overwrite").json(f"{path}/results")
    one.where(F.exists("samples", lambda s: s[right] != 1)).write.mode("overwrite").json(f"{path}/mistakes")


def write_budgets(df: DataFrame, path: str) -> None:
    df.select("row_id", "budget").write.mode("overwrite").json(path)


def read_budgets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id long, budget long").option("mode", "FAILFAST").json(path)
