import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rillmark.sources import publishing


def two(spark, n=300):
    return {"rows": spark.range(n).withColumn("v", F.col("id") % 7), "marks": spark.range(20).withColumn("m", F.when(F.col("id") > 3, "x"))}


def test_digests_do_not_depend_on_order_but_on_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "")], "k int, t string")
    once = publishing.table_digest(df)
    assert once[0] == 4 and publishing.table_digest(df.repartition(3).select("t", "k").orderBy("t")) == once
    changed = [df.distinct(), df.fillna("x"), df.withColumn("k", F.col("k").cast("long")), df.withColumnRenamed("t", "u"), df.unionByName(df)]
    assert len({once[1], *[publishing.table_digest(d)[1] for d in changed]}) == 6
    assert publishing.table_digest(df.limit(0))[0] == 0


def test_tables_are_published_together_and_once(spark, tmp_path):
    root = str(tmp_path)
    assert publishing.manifests(spark, root) == [] and publishing.broken_links(spark, root) == []
    first = publishing.publish(two(spark), root)
    assert publishing.publish({k: v.repartition(5) for k, v in two(spark).items()}, root) == first
    second = publishing.publish(two(spark, 301), root)
    assert (second["number"], second["previous"]) == (1, first["digest"])
    assert publishing.published(spark, root, "rows").count() == 301 and publishing.published(spark, root, "marks").count() == 20
    assert publishing.broken_links(spark, root) == []
    with pytest.raises(KeyError):
        publishing.published(spark, root, "none")


def test_a_lost_writer_leaves_nothing_visible(spark, tmp_path):
    root = str(tmp_path)
    first = publishing.publish(two(spark), root)
    failing = two(spark, 5) | {"rows": spark.range(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="lost"):
        publishing.publish(failing, root)
    assert publishing.manifests(spark, root) == [first] and publishing.published(spark, root, "marks").count() == 20
    assert publishing.publish(two(spark, 6), root)["number"] == 1 and publishing.broken_links(spark, root) == []


def test_damage_is_named(spark, tmp_path):
    root = str(tmp_path)
    first = publishing.publish(two(spark), root)
    second = publishing.publish(two(spark, 301), root)
    path = {t["name"]: Path(root, t["path"]) for t in second["tables"]}
    one = two(spark, 301)["rows"].withColumn("v", F.when(F.col("id") == 17, 99).otherwise(F.col("v")))
    one.write.mode("overwrite").parquet(str(path["rows"]))
    shutil.rmtree(path["marks"])
    marks, rows = publishing.broken_links(spark, root)
    assert marks == "manifest 1, marks: PATH_NOT_FOUND"
    assert rows.startswith("manifest 1, rows: leaves ") and rows.count(",") <= 3
    shutil.rmtree(Path(root, "manifests"))
    forged = second | {"previous": "0", "tables": []}
    spark.createDataFrame([first, forged], publishing.SCHEMA).write.parquet(f"{root}/manifests")
    assert publishing.broken_links(spark, root) == ["manifest 1: changed after it was written", "manifest 1: does not follow the one before it"]
