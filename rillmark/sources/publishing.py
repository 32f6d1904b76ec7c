"""Several tables published together under one manifest, each manifest chained to the one before it.

Tables are written first, to new folders; one appended manifest row then makes them visible, so a
writer that is lost on the way leaves nothing a reader sees.  A table's digest does not depend on
the order of its rows or on their partitions: each row's SHA-256 goes to one of 256 leaves by its
first byte, a leaf is the sums of its rows' digests by word, and the root is the digest of the leaves.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "number long, previous string, tables array<struct<name: string, path: string, rows: long, root: string, leaves: map<string, string>>>, digest string"
WORDS = 8


def leaf_digests(df: DataFrame) -> DataFrame:
    """leaf (two hex digits), rows, digest of the leaves that have rows; equal rows count as often as they come."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}) if df.columns else F.lit("{}")
    hashed = df.select(F.sha2(text, 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(WORDS)]
    return hashed.groupBy(F.substring("h", 1, 2).alias("leaf")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", F.count("*").cast("string"), *words), 256).alias("digest"))


def table_digest(df: DataFrame) -> tuple[int, str, dict[str, str]]:
    """(rows, root, leaves) of a table: 256 leaves at most come to the driver."""
    found = leaf_digests(df).collect()
    leaves = {r["leaf"]: r["digest"] for r in sorted(found, key=lambda r: r["leaf"])}
    columns = sorted(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return sum(r["rows"] for r in found), hashlib.sha256(json.dumps([columns, leaves], sort_keys=True).encode()).hexdigest(), leaves


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """All manifests below ``root`` in order; none where nothing was published."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(f"{root}/manifests").collect()  # one a publication
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return []
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda m: (m["number"], m["digest"]))


def manifest_digest(manifest: Mapping) -> str:
    return hashlib.sha256(json.dumps({k: manifest[k] for k in ("number", "previous", "tables")}, sort_keys=True).encode()).hexdigest()


def publish(tables: Mapping[str, DataFrame], root: str) -> dict:
    """Write the tables and commit them under one manifest, which is returned.

    Tables equal to those of the last manifest are not published again: that manifest is returned.
    """
    spark = next(iter(tables.values())).sparkSession
    done = manifests(spark, root)
    entries = []
    for name, df in sorted(tables.items()):
        path = f"data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{path}")
        rows, digest, leaves = table_digest(spark.read.schema(df.schema).parquet(f"{root}/{path}"))
        entries.append({"name": name, "path": path, "rows": rows, "root": digest, "leaves": leaves})
    if done and [(t["name"], t["root"]) for t in done[-1]["tables"]] == [(t["name"], t["root"]) for t in entries]:
        return done[-1]
    manifest = {"number": len(done), "previous": done[-1]["digest"] if done else "", "tables": entries}
    manifest["digest"] = manifest_digest(manifest)
    spark.createDataFrame([manifest], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/manifests")
    return manifest


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as of the last manifest; KeyError where none has it."""
    done = manifests(spark, root)
    for t in done[-1]["tables"] if done else []:
        if t["name"] == name:
            return spark.read.parquet(f"{root}/{t['path']}")
    raise KeyError(name)


def broken_links(spark: SparkSession, root: str) -> list[str]:
    """What does not hold below ``root``, each fault by its place; empty where everything does.

    Checked are each manifest's own digest, its place in the chain, and for each table the leaves.
    """
    faults, before = [], ""
    for place, m in enumerate(manifests(spark, root)):
        where = f"manifest {m['number']}"
        if m["digest"] != manifest_digest(m):
            faults.append(f"{where}: changed after it was written")
        if m["number"] != place or m["previous"] != before:
            faults.append(f"{where}: does not follow the one before it")
        before = m["digest"]
        for t in m["tables"]:
            try:
                _, digest, leaves = table_digest(spark.read.parquet(f"{root}/{t['path']}"))
            except AnalysisException as e:
                faults.append(f"{where}, {t['name']}: {e.getCondition()}")
                continue
            if digest != t["root"]:
                wrong = sorted(k for k in leaves.keys() | t["leaves"].keys() if leaves.get(k) != t["leaves"].get(k))
                faults.append(f"{where}, {t['name']}: " + (f"leaves {', '.join(wrong)} differ" if wrong else "columns differ"))
    return faults
