"""Operators that no SQL states, and the small fixtures with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from rillmark.functions import arrays, text
from rillmark.operators import advantages, balancing, batch, curation, evaluation, losses, routing
from rillmark.sources import files
from rillmark.streaming import queue


def column(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [_kind(v) for v in values.values()], strict=True)))
    return row.select(expression.alias("x")).first()["x"]


def _kind(v):
    if isinstance(v, list):
        return f"array<{_kind(v[0])}>" if v else "array<string>"
    return {str: "string", int: "long", float: "double", bool: "boolean"}[type(v)]


def test_midrank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 1.0, float("nan"), 5.0, None])], "i int, v double")
    got = {r["i"]: r["unit_rank"] for r in routing.midrank(df, "v").collect()}
    assert [got[i] for i in range(6)] == pytest.approx([2 / 3, 1 / 6, 1 / 6, 0.5, 1, 0.5])
    assert routing.midrank(df.where("v > 4 AND NOT isnan(v)"), "v").first()["unit_rank"] == 0.5


def test_group_routing(spark):
    rows = [(f"g{k}", s, float(s < k)) for k in range(5) for s in range(4)]
    df = spark.createDataFrame(rows, "uid string, sample int, score double")
    routed = routing.group_success(df, 4)
    got = {r["uid"]: (r["bucket"], r["style"], r["beta"]) for r in routed.collect()}
    assert got["g4"] == ("easy", "concise", 0.2) and got["g0"][0] == "unresolved" and all(got[f"g{k}"] == ("learnable", "normal", 0.5) for k in (1, 2, 3))
    assert sorted(map(tuple, routing.success_histogram(routed).collect())) == [(k, 1) for k in range(5)]
    with pytest.raises(Exception, match="another size"):
        routing.group_success(df, 3).collect()


def test_candidate_fixture(spark):
    rows = [("a", 0, 1.0, 6, -0.2), ("a", 1, 1.0, 3, -0.5), ("b", 2, 0.0, 2, -3.0), ("b", 3, 0.0, 4, -0.3)]
    df = spark.createDataFrame(rows, "uid string, sample int, score double, length int, logp double")
    assert sorted(r["sample"] for r in routing.select_candidates(df).collect()) == [1, 3]


def test_budget_fixture(spark):
    budget, supervised = routing.length_budget(F.col("n"), 0.8, 1.0)
    assert column(spark, F.struct(budget, supervised), n=20000) == (16000, 16000)


def test_grpo_and_group_fixture(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "uid string, score double")
    got = sorted((r["uid"], r["advantage"]) for r in advantages.grpo(df).collect())
    assert [v for _, v in got] == pytest.approx([-0.7071063, 0.7071063, 1.999998], abs=1e-6)
    stats = {r["uid"]: (r["mean"], r["std"], r["n"]) for r in advantages.group_stats(df).collect()}
    assert stats["a"] == pytest.approx((2, math.sqrt(2), 2)) and stats["b"] == (0, 1, 1)
    with pytest.raises(Exception, match="group of one"):
        advantages.grpo_passk(df.withColumn("sample", F.lit(0))).collect()
    with pytest.raises(ValueError):
        advantages.register("grpo")(lambda df: df)


def test_gae_ignores_masked_values(spark):
    mask = [0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0]
    reward = [0.0, 0.0, 0.1, 0.1, 0.1, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0]
    rng, outs = random.Random(0), []
    base = [rng.random() for _ in mask]
    for _ in range(2):
        value = [b if m else rng.random() for b, m in zip(base, mask, strict=True)]
        outs.append(column(spark, arrays.gae(F.col("r"), F.col("v"), F.col("m"), 0.99, 0.9), r=reward, v=value, m=mask))
    on = [i for i, m in enumerate(mask) if m]
    assert [outs[0][i] for i in on] == pytest.approx([outs[1][i] for i in on])
    nxt = last = 0.0
    for t in reversed(on):
        last = reward[t] + 0.99 * nxt - base[t] + 0.99 * 0.9 * last
        nxt = base[t]
        assert outs[0][t] == pytest.approx(last)


@pytest.mark.parametrize(("n", "c", "k", "want"), [(4, 1, 1, 0.25), (4, 2, 2, 5 / 6), (4, 3, 2, 1.0), (4, 0, 2, 0.0)])
def test_pass_at_k(spark, n, c, k, want):
    assert column(spark, arrays.pass_at_k(F.col("n"), F.col("c"), k), n=n, c=c) == pytest.approx(want)


def test_array_functions(spark):
    ids = [5, 6, 7, 8, 9]
    assert column(spark, arrays.mask_to_first_end(F.col("a"), F.array(F.lit(7), F.lit(9))), a=ids) == [1, 1, 1, 0, 0]
    assert column(spark, arrays.mask_to_first_end(F.col("a"), F.array(F.lit(1))), a=ids) == [1] * 5
    for mode, want in (("right", [5, 6, 7]), ("left", [7, 8, 9]), ("middle", [5, 8, 9])):
        assert column(spark, arrays.truncate(F.col("a"), 3, mode), a=ids) == want
    assert column(spark, arrays.pad(F.col("a"), 7, F.lit(0), left=True), a=ids) == [0, 0, *ids]
    assert column(spark, arrays.windows(F.col("a"), 4), a=ids) == [[5, 6, 7, 8], [6, 7, 8, 9]] and column(spark, arrays.windows(F.col("a"), 6), a=ids) == []
    assert column(spark, arrays.unit_rows(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="no direction"):
        column(spark, arrays.unit_rows(F.col("a")), a=[0.0])


def test_batch_errors_and_pads(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(5)], "row_id long, v long")
    assert sorted((r["row_id"], r["v"]) for r in batch.pad_to_divisor(df, 13).collect()) == [(i, i % 5 * 10) for i in range(13)]
    assert batch.unpad(batch.pad_to_divisor(df, 13)).count() == 5
    assert sorted((r["row_id"], r["v"]) for r in batch.pad_with(df, 2, "last").collect())[-2:] == [(5, 40), (6, 40)]
    assert [r["v"] for r in batch.take(df, [3, 0, 3]).orderBy("row_id").collect()] == [30, 0, 30]
    assert [r["row_id"] for r in batch.slice_rows(df, -2).orderBy("row_id").collect()] == [3, 4]
    assert batch.chunk(df.where("row_id < 4"), 2).where("chunk = 1").count() == 2
    for bad in (lambda: batch.chunk(df, 2), lambda: batch.rename(df, ["v"], []), lambda: batch.pop(df, ["x"])):
        with pytest.raises((ValueError, KeyError)):
            bad()
    with pytest.raises(Exception, match="differ"):
        batch.union_columns(df, df.withColumn("v", F.col("v") + 1)).collect()
    wide = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])], "row_id long, a array<int>")
    assert [tuple(r) for r in batch.unfold_chunks(wide, 2, ["a"]).select("row_id", "a").orderBy("row_id").collect()] == [(0, [1, 2]), (1, [3, 4]), (2, [5, 6]), (3, [7, 8])]
    assert [tuple(r) for r in batch.unfold(batch.fold(df, 2, ["v"]), 2, ["v"]).orderBy("row_id").collect()] == [(i, i * 10) for i in range(5)]
    assert [tuple(r) for r in batch.concat([df, df]).orderBy("row_id").collect()] == [(i, i % 5 * 10) for i in range(10)]


def test_votes_and_suites(spark):
    votes = spark.createDataFrame([("p", i, v, s) for i, (v, s) in enumerate([("A", 0.9), ("B", 0.8), ("B", 0.7), ("A", 0.6)])], "uid string, sample int, vote string, score double")
    assert evaluation.majority(votes).first()["value"] == 0.9
    exact = evaluation.expected_best(votes, 2).first()
    drawn = evaluation.bootstrap(votes, 2, draws=4000).first()
    assert drawn["best"] == pytest.approx(exact["best"], abs=0.01) and drawn["worst"] == pytest.approx(exact["worst"], abs=0.01)
    suite = spark.createDataFrame([("d", [True, False, False, False], [1, 3, 5, 7]), ("d", [True, True, False, False], [2, 4, 6, 8])], "dataset string, correct array<boolean>, lengths array<long>")
    row = evaluation.summarise(suite, 4).first()
    assert (row["pass_at_1"], row["pass_at_4"], row["mean_length"], row["median_length"]) == (3 / 8, 1.0, 4.5, 4.5)
    with pytest.raises(Exception, match="expected 5 samples"):
        evaluation.summarise(suite, 5).collect()
    delta = evaluation.compare(evaluation.summarise(suite, 4), evaluation.summarise(suite, 4), ["pass_at_1"]).first()
    assert delta["delta_pass_at_1"] == 0
    assert evaluation.sizes(6) == [2, 4, 6] and evaluation.sizes(1) == []


def test_partitions():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 1000) for _ in range(64)]
    for equal in (False, True):
        parts = balancing.differencing(lengths, 8, equal)
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(64)) and max(sums) - min(sums) < 200
        assert not equal or {len(p) for p in parts} == {8}
    assert balancing.greedy([5, 1, 1, 9], 2) == [[0], [1, 2, 3]]
    batches = balancing.micro_batches(lengths, 9000)
    assert len(batches) == -(-sum(lengths) // 9000) and sorted(i for b in batches for i in b) == list(range(64))
    assert balancing.inverse([2, 0, 1]) == [1, 2, 0]


def test_ordered_match():
    a, d, z = ("Left anchor", "1"), ("Duplicate", "2"), ("Right anchor", "3")
    assert curation.ordered_match([a, d, z], [a, ("x", "0"), d, z, d]) == [0, 2, 3]
    with pytest.raises(ValueError, match="ambiguous"):
        curation.ordered_match([a, d, z], [a, d, d, z])
    with pytest.raises(ValueError, match="no original"):
        curation.ordered_match([("q", "1")], [a])
    with pytest.raises(ValueError, match="answer mismatch"):
        curation.ordered_match([("Duplicate", "9")], [d])


def test_decontamination_fixture(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(7, f"Find x when {words}."), (9, words)], "item_id long, text string")
    train = spark.createDataFrame([(0, f"find  X when {words.upper()}."), (1, f"prefix {words} suffix"), (2, "unrelated words"), (3, None)], "doc_id long, text string")
    found = curation.contaminated(train, bench)
    assert sorted(map(tuple, found.collect())) == [(0, True, 7), (1, False, 7)]
    assert sorted(r["doc_id"] for r in curation.clean(train, found).collect()) == [2, 3]
    assert curation.grams(spark.createDataFrame([(1, " ".join("abcdefghijk"))], "k long, text string"), "k", "text").count() == 2


def test_apportionment(spark):
    strata = spark.createDataFrame([("a", 1.0, 10), ("b", 1.0, 1), ("c", 1.0, 10)], "stratum string, weight double, capacity long")
    assert {r["stratum"]: r["allocated"] for r in curation.apportion(strata, 10).collect()} == {"a": 4, "b": 3, "c": 3}
    assert {r["stratum"]: r["allocated"] for r in curation.apportion(strata, 10, capacity="capacity").collect()} == {"a": 5, "b": 1, "c": 4}


def test_vendi_and_rounds(spark):
    same = spark.createDataFrame([([1.0, 0.0],)] * 4, "embedding array<double>")
    both = spark.createDataFrame([([1.0, 0.0],), ([0.0, 2.0],)], "embedding array<double>")
    assert curation.vendi(same) == pytest.approx(1) and curation.vendi(both) == pytest.approx(2)
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, cluster int")
    drawn = curation.round_robin(rows, "cluster", 7, 5, "id").collect()
    assert len(drawn) == 7 and {sum(r["cluster"] == c for r in drawn) for c in range(3)} == {2, 3}
    shares = spark.createDataFrame([(0, 2), (1, 1)], "cluster int, allocated long")
    assert sorted(r["cluster"] for r in curation.stratified_draw(rows, "cluster", shares, 1, "id").collect()) == [0, 0, 1]


def test_preference_and_is(spark):
    loss = losses.preference(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0), 0.1)
    assert column(spark, loss, a=-1.0, b=-3.0) == pytest.approx(math.log1p(math.exp(-0.2)))
    assert column(spark, losses.preference(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0), 0.1, kind="ipo"), a=-1.0, b=-3.0) == pytest.approx((2 - 5) ** 2)
    df = spark.createDataFrame([([0.5, -0.5], [1.0, 1.0]), ([2.0, 9.0], [1.0, 0.0])], "log_ratio array<double>, mask array<double>")
    got = [r["weights"] for r in losses.correction_weights(df, "token", 2.0, normalise=True).collect()]
    mean = (math.exp(0.5) + math.exp(-0.5) + 2) / 3
    assert got[0] == pytest.approx([math.exp(0.5) / mean, math.exp(-0.5) / mean]) and got[1] == pytest.approx([2 / mean, 0])
    kept = [r["kept_mask"] for r in losses.rejection_mask(df, "sequence", 2.0).collect()]
    assert kept == [[1.0, 1.0], [0.0, 0.0]]


@pytest.mark.parametrize(
    ("raw", "want"),
    [(r"so \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{1} then \fbox{a{b}c}", "a{b}c"), (r"\boxed{open", None), ("none", None), (None, None), (r"\boxed 7$", "7")],
)
def test_boxed(raw, want):
    assert text.boxed(raw) == want


@pytest.mark.parametrize(("a", "b", "same"), [(r"\dfrac12", r"\frac{1}{2}", True), ("0.5", r"\frac{1}{2}", True), ("x=5", "5", True), (r"50\%", "50", True), ("3/4", r"\frac{3}{4}", True), (r"\sqrt2", r"\sqrt{2}", True), ("5", "6", False), (None, None, True), (None, "1", False)])
def test_same_answer(a, b, same):
    assert text.same_answer(a, b) is same


def test_text_scores(spark):
    t = F.col("t")
    assert column(spark, text.gsm8k_answer(t), t="9 #### 3 so #### 1,234") == "1234"
    assert column(spark, text.gsm8k_answer(t, strict=False), t="it is 7 . or 8.") == "8."
    assert column(spark, text.gsm8k_score(t, F.lit("3")), t="no") == 0.0
    assert column(spark, text.signed_score(t, F.lit("1,000")), t="thus\nAnswer: x = $1000$ dollars").asDict() == {"score": 1.0, "acc": True, "pred": "1000"}
    assert column(spark, text.minerva_answer(t), t="nothing") == "[INVALID]"
    assert column(spark, text.answer_score(t, F.array(F.lit("Paris"))), t="<answer>x</answer> <answer> The paris!</answer>") == 1.0
    assert column(spark, text.parse_budget(t), t="say [[ 42 ]]") == 42 and column(spark, text.parse_budget(t), t="x\nBudget: 7") == 7 and column(spark, text.parse_budget(t), t="x 7") is None
    assert column(spark, text.normalise_budget(F.col("n"), 10, 100, 4, 50), n=18) == 16
    assert column(spark, text.code_block(t), t="a\n```py\nx\n```\nb\n```\ny\nz\n```") == "y\nz"
    assert column(spark, F.size(text.tool_calls(t)), t='<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call><tool_call>bad</tool_call>') == 1
    assert [s["type"] for s in column(spark, text.media_segments(t), t="see <image>and<video>")] == ["text", "image", "text", "video"]
    assert column(spark, text.provenance_answer(t), t="$1, 000$") == "1000"
    assert column(spark, text.boxed_score(t, F.lit("1/2")), t=r"\boxed{\frac12}") == 1.0
    assert 0.8 < column(spark, text.compression_repetition(t), t="ab" * 500) <= 1 and column(spark, text.compression_repetition(t), t="") == 0


def test_files(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"
    with open(path, "w") as f:
        f.write('{"b": 1, "a": [2]}\n\n{"a": "é"}\n')
    assert sorted(r["value"] for r in files.read_jsonl_strict(spark, path).collect()) == ['{"a":"é"}', '{"a":[2],"b":1}']
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[1]"):
        with open(path, "w") as f:
            f.write(bad)
        with pytest.raises(Exception):
            files.read_jsonl_strict(spark, path).collect()
    log = spark.createDataFrame([("step:7 - actor/entropy:0.25 - training/global_step:19 - x:1e-3",), ("other",), ("step:3 - loss:-2",)], "value string")
    got = sorted((r["wandb_step"], r["step"], r["metrics"].get("actor/entropy")) for r in files.metric_lines(log).collect())
    assert got == [(3, 3, None), (7, 19, 0.25)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, _y string")
    files.write_jsonl(df, f"{tmp_path}/out", drop_private=True)
    assert sorted(json.loads(r["value"])["x"] for r in spark.read.text(f"{tmp_path}/out").collect()) == [1, 2]
    assert files.manifest(spark, f"{tmp_path}/out").where("size > 0").count() >= 1
    again = [files.read_or_write(df.withColumn("x", F.lit(v)), f"{tmp_path}/cache").select("x").distinct().collect() for v in (5, 6)]
    assert again[0] == again[1]
    chunks = spark.createDataFrame([(0, 10), (10, 20), (25, 30)], "start long, stop long")
    assert [r["expected"] for r in files.check_chunks(chunks).collect()] == [20]
    files.write_csv([df, df.withColumn("z", F.lit(1))], f"{tmp_path}/csv", ["z"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["z", "x", "_y"]


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/src"
    for i in range(3):
        spark.createDataFrame([("q", 10 * i + j, i) for j in range(4)], "queue string, seq long, version long").coalesce(1).write.mode("append").parquet(src)
    out = queue.bounded_queue(queue.samples(spark, src, "queue string, seq long, version long", 1), 5)
    run = out.writeStream.format("memory").queryName("held").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    run.awaitTermination(90)
    last = spark.sql("SELECT * FROM held ORDER BY produced DESC LIMIT 1").first()
    assert (last["produced"], last["held"], last["dropped"], last["oldest"]) == (12, 5, 7, 13)
    steps = [("r", 0, 2.0, 100), ("r", 1, 0.5, 100)]
    spark.createDataFrame(steps, "run string, step long, kl double, n long").coalesce(1).write.parquet(f"{tmp_path}/kl")
    stream = spark.readStream.schema("run string, step long, kl double, n long").parquet(f"{tmp_path}/kl")
    run = queue.adaptive_coefficient(stream, 0.1, 1.0, 1000).writeStream.format("memory").queryName("kl").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    run.awaitTermination(90)
    assert [r["coefficient"] for r in spark.sql("SELECT * FROM kl ORDER BY step").collect()] == pytest.approx([0.1 * 1.02, 0.1 * 1.02 * 0.98])
    limit = queue.Staleness(required=4, threshold=0.5, every=2, most_queued=10)
    assert limit.most == 12 and limit.pauses(10, 0) and limit.pauses(0, 12) and not limit.pauses(9, 11)
