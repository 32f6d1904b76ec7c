"""Grading, registries, evaluation sources, assembly and clustering on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.functions import grading
from rillmark.operators import clustering, correction, datasets, losses, policy, registry
from rillmark.sources import evaluation as sources
from rillmark.streaming import assembly


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("5", "5.0", True), ("0.5", "1/2", True), ("\\frac{1}{2}", "0.5", True), ("50", "0.5", True), ("50\\%", "0.5", True), ("1,000", "1000", True), ("(1, 2)", "(1,2.0)", True), ("[1, 2]", "(1, 2)", False),
        ("x = 5", "5", True), ("1, 2", "2, 1", False), ("\\text{yes}", "Yes", True), ("7", "8", False), (None, "8", False), ("", "8", False), ("[0, \\frac{1}{2}]", "[0, 0.5]", True), ("abc = 5", "5", False),
    ],
)
def test_equal_answers(a, b, same):
    assert grading.equal_answers(a, b) is same


@pytest.mark.parametrize(("a", "b", "same"), [("1 2\n3", "1 2\n3\n", True), ("1.0 2", "1 2.00", True), ("1 2", "1 2 3", False), ("a", "b", False), ("50000000000000000", "50000000000000001", False), (None, "1", False), ("x\n", "x\n\ny", False)])
def test_same_output(a, b, same):
    assert grading.same_output(a, b) is same


def test_assertions_and_literals():
    assert grading.asserted("assert f(1) == [1, 2]") == "[1, 2]" and grading.asserted("assert f(") == "Invalid syntax" and grading.asserted("") == "Empty statement"
    assert grading.asserted("x = 1") == "Not an assert statement" and grading.asserted("assert f(1)") == "Not an equality assertion"
    assert grading.same_literal("# c\nassert f(2) == [1, 'a']", '[1, "a"]') and not grading.same_literal("assert f(2) == __import__('os')", "1") and not grading.same_literal("1", "")


def test_code_is_sanitised():
    text = "Sure!\n\nimport math\n\ndef helper(x):\n    return math.sqrt(x)\n\ndef unused(x):\n    return x\n\ndef solve(x):\n    return helper(x) + K\n\nK = 3\nprint(solve(4))\nHope it helps!"
    out = grading.sanitised(text, "solve")
    assert "unused" not in out and "print" not in out and out.startswith("import math") and out.endswith("K = 3")
    assert grading.sanitised("no code at (all") == "" and grading.sanitised(None) == ""
    brute = max((sum(bool(x.strip()) for x in text.split("\n")[i:j]) for i in range(17) for j in range(i + 1, 18) if grading.parses("\n".join(text.split("\n")[i:j]))), default=0)
    assert sum(bool(x.strip()) for x in grading.longest_code(text).split("\n")) == brute


def test_expressions():
    rng = random.Random(3)
    for _ in range(300):
        text = grading.drawn_expression(rng, rng.randint(1, 7))
        assert grading.evaluated(text) == eval(text)  # digits, signs and brackets of our own making
    assert grading.evaluated("7 - 2 - 1") == 4 and grading.evaluated("2 * (3 + 4) / 7") == 2 and grading.evaluated("-3 + 5") == 2
    assert grading.counted_letters("banana", "a").endswith("\\boxed{3}")


def test_questions_fold():
    assert grading.folded_question("ＡＢＣ  Straße\n" + grading.SUFFIX + " \n") == "abc strasse" and grading.folded_question(None) is None


def test_registries(spark):
    own = registry.Registry("thing")
    own.register("a")(1)
    with pytest.raises(ValueError, match="already"):
        own.register("a")(2)
    with pytest.raises(KeyError, match="no thing b"):
        own.find("b")
    df = spark.createDataFrame([(1, "openai/gsm8k", "so #### 4<end>", "4", [1, 1, 1, 1]), (2, "openai/gsm8k", "so #### 5<end>", "4", [1, 0, 0, 0])], "uid long, data_source string, response string, truth string, mask array<int>")
    got = {r["uid"]: r for r in registry.manager("dapo", longest=4, buffer=2, end="<end>")(df).collect()}
    assert got[1]["rewards"] == [0.0, 0.0, 0.0, 0.0] and got[1]["overlong"] == -1.0 and got[2]["rewards"] == [0.0, 0.0, 0.0, 0.0] and got[2]["overlong"] == 0.0
    parts = list(registry.DISPATCH.find("chunks")(df.withColumn("row_id", F.col("uid") - 1), 2))
    assert [p.count() for p in parts] == [1, 1]


def test_custom_function(tmp_path):
    (tmp_path / "r.py").write_text("def score(x, scale=1):\n    return x * scale\n")
    assert registry.custom(f"{tmp_path}/r.py", "score", scale=3)(2) == 6
    with pytest.raises(AttributeError):
        registry.custom(f"{tmp_path}/r.py", "none")


def test_releases_and_samples(spark):
    assert sources.release_files("release_v2") == ["test.jsonl", "test2.jsonl"] and sources.release_files("v3") == ["test3.jsonl"] and sources.release_files("v2_v3") == ["test2.jsonl", "test3.jsonl"]
    assert len(sources.release_files("release_latest")) == sources.RELEASES
    for bad in ("v9", "release", "v3_v2"):
        with pytest.raises(ValueError):
            sources.release_files(bad)
    one = '[{"input": "1", "output": "2", "testtype": "stdin"}]'
    lines = spark.createDataFrame([("q", "x", "easy", "2024-01-02T03:04:05", one, one, '{"func_name": "f"}'), ("p", "x", "hard", "2024-01-02", one, "eJxrYJ==", "{}")], "question_id string, platform string, difficulty string, contest_date string, public_test_cases string, private_test_cases string, metadata string")
    rows = {r["question_id"]: r for r in sources.problems(lines).withColumn("sample", sources.evaluation_sample(F.col("public_tests"), F.col("private_tests"), F.col("fn_name"))).collect()}
    assert rows["q"]["sample"] == '{"inputs":["1","1"],"outputs":["2","2"],"fn_name":"f"}' and not rows["q"]["packed"]
    assert rows["p"]["packed"] and rows["p"]["private_tests"] is None


def test_array_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    rows = sources.array_rows(spark, [f"file://{tmp_path}/a.npy"], "<f4", 3)
    assert [r["v"] for r in rows.orderBy("row").collect()] == x.tolist()
    ids = rows.select("path", "row", (F.col("row") + 7).alias("id"))
    assert sources.vector_set(rows, ids, ids.select("id")).count() == 4
    with pytest.raises(ValueError, match="expected"):
        sources.vector_set(rows, ids, ids.select("id").where("id > 7"))
    with pytest.raises(Exception, match="not <f8"):
        sources.array_rows(spark, [f"file://{tmp_path}/a.npy"], "<f8", 3).collect()


def test_inputs_are_restored():
    assert sources.literal('[[1, [2, 3]], "a"]', "tuple") == "((1, (2, 3)), 'a')" and sources.literal("[[1, 1, 2]]", "set") == "[{1, 2}]"
    assert sources.literal_back(sources.literal('["1+2j", "3j"]', "complex"), "complex") == [1 + 2j, 3j] and sources.literal(None) is None


def test_clusters_match_plain_loops(spark):
    rng = np.random.default_rng(4)
    middles = np.eye(6)[:4] * 5
    x = middles[rng.integers(0, 4, 300)] + rng.normal(0, 0.3, (300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got, centres = clustering.cosine_means(df, 4, rounds=10, seed=1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = {r["vec_id"]: r["cluster"] for r in got.collect()}
    assert len(labels) == 300 and all(labels[i] == int(np.argmax(u[i] @ centres.T)) for i in range(300))
    for k in set(labels.values()):
        mean = u[[i for i in labels if labels[i] == k]].sum(axis=0)
        assert np.allclose(centres[k], mean / np.linalg.norm(mean), atol=1e-6)


def test_assembly(spark):
    df = spark.createDataFrame([(i, i, [i % 3, 2]) for i in range(10)], "sample_id long, seq long, versions array<int>")
    logs = spark.createDataFrame([(i, [0.5]) for i in range(10)], "sample_id long, log_probs array<double>")
    rows = assembly.assembled(assembly.merged(df, logs), 4).collect()
    assert sorted(r["batch"] for r in rows) == [0] * 4 + [1] * 4 + [2] * 2 and all(r["version_start"] == r["sample_id"] % 3 and r["version_end"] == 2 for r in rows)
    v = assembly.Version(every=2)
    assert not v.bump(1, 3, 4, 1.0, 10.0) and v.stale == 7 and v.idle == [0.1] and v.bump(2, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        v.bump(1, 0, 0, 0.0, 1.0)


def test_groups_are_gathered_over_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(0, 10 * i + j, j % 2 == 0) for j in range(4)], "run int, uid long, varied boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run int, uid long, varied boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = assembly.kept_groups(stream.withColumn("run", F.col("run").cast("string")), 2).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("kept").collect()
    assert sorted(r["uid"] for r in rows) == [0, 2, 10, 12, 20, 22] and {r["step"] for r in rows} == {0, 1, 2}
    seen = []
    assembly.after_each_batch(stream, lambda df, i: seen.append((i, df.count())), f"{tmp_path}/c2").awaitTermination(120)
    assert [n for _, n in seen] == [4, 4, 4]


def test_moments_and_guards(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 9.0], [1, 1, 0]), (2, [4.0], [1])], "uid long, values array<double>, mask array<int>")
    got = correction.masked_moments(df).first()
    assert got["mean"] == pytest.approx(7 / 3) and got["var"] == pytest.approx(np.var([1, 2, 4], ddof=1))
    with pytest.raises(Exception, match="too few"):
        correction.masked_moments(df.where("uid = 2")).collect()
    none = spark.createDataFrame([(1, [0.1, 0.2], [0.0, 0.0])], "uid long, log_ratio array<double>, mask array<double>")
    assert losses.correction_weights(none, "sequence", normalise=True).first()["weights"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        correction.vetoed(df, 0.0)


def test_top_rows(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1.0, 1.0, rng.random()]) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    for k in (0, 1, 7, 100, 10_000):
        got = {r["id"] for r in policy.top_rows(df, "v", k, "id").where("chosen").collect()}
        want = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: (-values[i], i))[:k]
        assert got == set(want)


def test_dataset_guards(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "row_id long, prompt string")
    with pytest.raises(Exception, match="repeated index"):
        datasets.guarded_unique(rows, "row_id").collect()
    with pytest.raises(ValueError, match="both sides"):
        datasets.staged_rows(rows.withColumn("x", F.lit(1)), rows.withColumn("x", F.lit(1)), "row_id", "prompt")
    one = rows.limit(1)
    with pytest.raises(ValueError, match="expected"):
        datasets.checked_exclusions(one.select("row_id"), one.select("row_id").where("false"), "row_id", 5)
    assert datasets.checked_exclusions(one.select("row_id"), one.select("row_id"), "row_id", 5).count() == 1
