"""Registered queries of text extraction, scoring and prompts, each with its DuckDB SQL.

Responses are built from orders, one of eight forms each, so that every extraction meets responses
with and without what it looks for; the truth is off by one for a third of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import arrays, grading, rewards
from rillmark.functions import text as t
from rillmark.plans.queries import TOKENS, register
from rillmark.plans.rollout_queries import R, six
from rillmark.plans.rollouts import order_tokens, table
from rillmark.sources.staging import spread

_PARTS = {
    0: ("We add. #### ", ""),
    1: ("Thus\nAnswer: $", "$ units\nso"),
    2: ("<think>hm</think> so \\boxed{", "}"),
    3: ("<answer> The ", "! </answer>"),
    4: ("no idea, but ", ",000 it is"),
    5: ("text\n```python\nprint(", ")\n```\nend"),
    6: ("# note\nassert f(1) == ", "\nBudget: 7"),
    7: ('<tool_call>{"name": "add", "arguments": {"x": ', "}}</tool_call> [[19]]"),
}


def _quoted(x: str) -> str:
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n"))


RESPONSES = (
    "WITH p AS (SELECT o_orderkey AS uid, (o_custkey % 40)::VARCHAR AS k, (o_custkey % 40 + (o_orderkey % 3 = 0)::INT)::VARCHAR AS truth, (o_orderkey // 3) % 8 AS form FROM orders), "
    "x AS (SELECT uid, truth, form, k, CASE form " + " ".join(f"WHEN {i} THEN {_quoted(a)} || k || {_quoted(b)}" for i, (a, b) in _PARTS.items()) + " END AS s FROM p)"
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_custkey") % 40).cast("string")
    form = F.floor(F.col("o_orderkey") / 3) % 8
    text = None
    for i, (a, b) in _PARTS.items():
        own = F.concat(F.lit(a), k, F.lit(b))
        text = F.when(form == i, own) if text is None else text.when(form == i, own)
    truth = (F.col("o_custkey") % 40 + (F.col("o_orderkey") % 3 == 0).cast("int")).cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), truth.alias("truth"), form.alias("form"), k.alias("k"), text.alias("s"))


def _query(name: str, sql: str, columns: Callable[[Column, Column], dict[str, Column]]) -> None:
    """Register columns made of the response and the truth."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return responses(spark, sf_dir).select("uid", *[c.alias(n) for n, c in columns(F.col("s"), F.col("truth")).items()])

    query.__name__ = name
    register(f"{RESPONSES} SELECT uid, {sql} FROM x")(query)


_LAST = "list_extract(regexp_extract_all(right(s, 300), '{}', 1), -1)"
_STRICT = "regexp_replace(" + _LAST.format("#### (\\-?[0-9\\.\\,]+)") + ", '[,$]', '', 'g')"
_FLEX = "list_extract([z FOR z IN regexp_extract_all(right(s, 300), '(\\-?[0-9\\.\\,]+)', 1) IF z NOT IN ('', '.')], -1)"
_query("gsm8k_answers", f"{_STRICT} AS strict, {_FLEX} AS flexible", lambda s, g: dict(strict=t.gsm8k_answer(s), flexible=t.gsm8k_answer(s, False)))
_query("gsm8k_scores", f"CASE WHEN {_STRICT} IS NULL THEN 0.0::DOUBLE WHEN {_STRICT} = truth THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score", lambda s, g: dict(score=t.gsm8k_score(s, g, formatted=0.1)))
_BOX = "CASE WHEN form = 2 THEN k END"
_query("boxed_answers", f"{_BOX} AS answer, CASE WHEN form = 2 AND k = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score", lambda s, g: dict(answer=t.boxed_answer(s), score=t.boxed_score(s, g)))
_query("strict_boxes", f"CASE WHEN form = 2 AND k = truth THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score, {_BOX} AS pred", lambda s, g: dict(score=grading.strict_box(s, g)["score"], pred=grading.strict_box(s, g)["pred"]))
_query("verified_boxes", "CASE WHEN form = 2 AND k = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score", lambda s, g: dict(score=grading.verified_box(s, g)))
_query("turn_scores", "CASE WHEN form = 2 AND k = truth THEN 1.0::DOUBLE ELSE least(-0.6, -1 + (form - 2) / 2.0 * 0.1)::DOUBLE END AS score", lambda s, g: dict(score=grading.negative_by_turns(grading.strict_box(s, g)["score"], F.col("form"))))
_query("labelled_answers", "CASE WHEN form = 1 THEN k ELSE '[INVALID]' END AS answer", lambda s, g: dict(answer=t.minerva_answer(s)))
_query("signed_scores", "CASE WHEN form = 1 AND k = truth THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score", lambda s, g: dict(score=t.signed_score(s, g)["score"]))
_query("tagged_answers", "trim(list_extract(regexp_extract_all(s, '(?s)<answer>(.*?)</answer>', 1), -1)) AS answer", lambda s, g: dict(answer=t.tagged_answer(s)))
_query("tagged_scores", "CASE WHEN form <> 3 THEN 0.0::DOUBLE WHEN k = truth THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS score", lambda s, g: dict(score=t.answer_score(s, F.array(g), formatted=0.25)))
_query("contained_answers", "contains(trim(regexp_replace(regexp_replace(lower(s), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g')), truth) AS found", lambda s, g: dict(found=t.exact_match(s, F.array(g), True)))
_query("code_blocks", "CASE WHEN form = 5 THEN 'print(' || k || ')' ELSE '' END AS code", lambda s, g: dict(code=t.code_block(s)))
_query("test_lines", "CASE WHEN form = 6 THEN 'assert f(1) == ' || k WHEN form = 5 THEN 'print(' || k || ')' ELSE '' END AS line", lambda s, g: dict(line=grading.test_line(s)))
_query("assertion_values", "CASE WHEN form = 6 THEN k ELSE 'Empty statement' END AS expected", lambda s, g: dict(expected=grading.assertion_value(F.when(F.col("form") == 6, grading.test_line(s)).otherwise(""))))
_query("literal_matches", "form = 6 AND k = truth AS same", lambda s, g: dict(same=F.when(F.col("form") == 6, grading.literal_matches(s, g)).otherwise(False)))
_query("execution_answers", "CASE WHEN form = 6 THEN k ELSE trim(string_split(s, chr(10))[1]) END AS answer", lambda s, g: dict(answer=grading.execution_answer(s)))
_query("answer_code", "CASE WHEN form = 3 THEN 'The ' || k || '!' WHEN form = 5 THEN 'print(' || k || ')' || chr(10) ELSE trim(s) END AS code", lambda s, g: dict(code=grading.answer_code(s)))
def _code() -> Column:
    return F.concat(F.lit("Here it is:\nx = "), F.col("k"), F.lit("\ndef g(a):\n    return a\ndef f(a):\n    return a + x\nThat is all, folks."))


_query("sanitised_code", "'x = ' || k || chr(10) || 'def f(a):' || chr(10) || '    return a + x' AS code", lambda s, g: dict(code=grading.sanitise(_code(), "f")))
_query("tool_calls", "CASE WHEN form = 7 THEN 'add' END AS name, CASE WHEN form = 7 THEN '{\"x\":' || k || '}' END AS arguments", lambda s, g: dict(name=F.get(t.tool_calls(s), F.lit(0))["name"], arguments=F.get(t.tool_calls(s), F.lit(0))["arguments"]))
_query("json_spans", "CASE WHEN form = 7 THEN '{\"name\": \"add\", \"arguments\": {\"x\": ' || k || '}}' END AS span", lambda s, g: dict(span=grading.json_span(s)))
_query("parsed_budgets", "CASE WHEN form = 7 THEN 19 WHEN form = 6 THEN 7 END::BIGINT AS budget", lambda s, g: dict(budget=t.parse_budget(s)))
_query("normalised_budgets", "greatest(8, least(32, round_even(greatest(8, least(32, coalesce(CASE WHEN form = 7 THEN 19 WHEN form = 6 THEN 7 END, k::BIGINT))) / 4.0, 0) * 4))::BIGINT AS budget", lambda s, g: dict(budget=t.normalise_budget(F.coalesce(t.parse_budget(s), F.col("k").cast("long")), 8, 32, 4, 16)))
_query("think_answers", "CASE WHEN form = 2 THEN 'hm' END AS think, CASE WHEN form = 2 THEN 'so \\boxed{' || k || '}' END AS answer", lambda s, g: dict(think=rewards.think_answer(s)["think"], answer=rewards.think_answer(s)["answer"]))
_query("format_rewards", "0.9::DOUBLE * (k = truth)::INT + 0.1::DOUBLE * (form = 2)::INT AS reward", lambda s, g: dict(reward=rewards.formatted(s, g, (F.col("k") == g).cast("double"))))
_query("choice_scores", "(substr('ABCD', (k::INT % 4) + 1, 1) = substr('ABCD', (truth::INT % 4) + 1, 1))::INT::DOUBLE AS score", lambda s, g: dict(score=rewards.choice(F.concat(F.lit("Answer: "), F.substring(F.lit("ABCD"), F.col("k").cast("int") % 4 + 1, F.lit(1))), F.substring(F.lit("ABCD"), g.cast("int") % 4 + 1, F.lit(1)))))
_query("step_error_rewards", "CASE WHEN k::INT >= 30 THEN -1.0::DOUBLE WHEN truth::INT < 0 THEN 0 ELSE 1 - abs(k::INT - truth::INT) / 30.0 END::DOUBLE AS reward", lambda s, g: dict(reward=rewards.step_error(F.col("k").cast("int"), g.cast("int"), F.lit(30))))
_query("routed_scores", "CASE WHEN form % 2 = 0 THEN (form = 0 AND k = truth)::INT ELSE CASE WHEN form = 3 AND k = truth THEN 1 ELSE 0 END END::DOUBLE AS score", lambda s, g: dict(score=rewards.score(F.when(F.col("form") % 2 == 0, "openai/gsm8k").otherwise("searchR1_nq"), s, g)))
_query("value_matches", "k::DOUBLE = truth::DOUBLE OR abs(k::DOUBLE - truth::DOUBLE * 100) <= 1e-4 * greatest(k::DOUBLE, truth::DOUBLE * 100) OR abs(k::DOUBLE - truth::DOUBLE / 100) <= 1e-4 * greatest(k::DOUBLE, truth::DOUBLE / 100) AS same", lambda s, g: dict(same=grading.same_value(F.concat(F.lit("\\frac{"), F.col("k"), F.lit("}{1}")), F.concat(g, F.lit(".0")))))
_query("output_matches", "k = truth AS same", lambda s, g: dict(same=grading.output_matches(F.concat(F.lit("ok\n"), F.col("k"), F.lit(".00 1e1\n")), F.concat(F.lit("ok \n"), g, F.lit(" 10")))))
_query("channel_calls", "'add' AS name, '{\"x\": ' || k || '}' AS arguments", lambda s, g: dict(name=F.get(grading.channel_calls(F.concat(F.lit("<|channel|>analysis<|message|>a<|end|><|start|>assistant<|channel|>commentary to=functions.add <|constrain|>json<|message|>{\"x\": "), F.col("k"), F.lit("}<|call|>"))), F.lit(0))["name"], arguments=F.get(grading.channel_calls(F.concat(F.lit("<|start|>assistant<|channel|>commentary to=functions.add <|constrain|>json<|message|>{\"x\": "), F.col("k"), F.lit("}<|call|>"))), F.lit(0))["arguments"]))
_query("message_roles", "CASE WHEN k::INT % 2 = 0 THEN 'assistant/code/tool' ELSE 'assistant/code/assistant' END AS roles", lambda s, g: dict(roles=F.array_join(F.transform(grading.tagged_messages(F.concat(s, F.lit("<code>x=1</code>"), F.when(F.col("k").cast("int") % 2 == 0, "<interpreter>1</interpreter>").otherwise(" done"))), lambda m: m["role"]), "/")))
_query("stripped_prompts", "s AS exact, s AS loose", lambda s, g: dict(exact=grading.without_suffix(F.concat(s, F.lit(grading.SUFFIX))), loose=grading.without_instruction(F.concat(s, F.lit(grading.SUFFIX.upper().replace("BOXED", "boxed"))))))
_query("folded_questions", "trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) AS question", lambda s, g: dict(question=grading.normalise_question(F.concat(s, F.lit(grading.SUFFIX + " \n")))))
_query("budgeted_prompts", "s || chr(10) || 'Let''s think step by step and use less than ' || k || ' tokens. Put your final answer within \\boxed{}.' AS prompt, s || chr(10) || 'Solve concisely. Avoid unnecessary explanation. Put your final answer within \\boxed{}.' AS concise", lambda s, g: dict(prompt=grading.budgeted_prompt(s, F.col("k"))[0]["content"], concise=grading.concise_prompt(s)[0]["content"]))
_query("few_shot_prompts", "4 AS messages, 'system' AS first, s AS last", lambda s, g: dict(messages=F.size(grading.few_shot_prompt(s, [("1 + 1", "2")], "Be brief.")), first=grading.few_shot_prompt(s, [("1 + 1", "2")], "Be brief.")[0]["role"], last=grading.few_shot_prompt(s, [("1 + 1", "2")], "Be brief.")[3]["content"]))


@register(f"{TOKENS}, n AS (SELECT *, sum(mask) OVER (PARTITION BY uid)::INT AS n FROM t) SELECT uid, pos - 1 AS pos, CASE WHEN pos = n THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM n")
def placed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(rewards.place_at_end(F.lit(2.5), F.col("mask"))).alias("pos", "reward"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), "reward")


@register("SELECT doc_id, regexp_replace(replace(replace(text, '$', ''), ' ', ''), '\\s', '', 'g') AS answer FROM documents WHERE false UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey // 10) || '' || (o_custkey % 10) ELSE 'x,' || o_custkey END FROM orders")
def provenance_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$ "), F.floor(F.col("o_custkey") / 10).cast("string"), F.lit(","), (F.col("o_custkey") % 10).cast("string"), F.lit("$"))).otherwise(F.concat(F.lit("x, "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), t.provenance_answer(raw).alias("answer"))


@register("SELECT conv_id, turn, len([w FOR w IN string_split_regex(text, '\\s+') IF w <> ''])::INT AS words FROM conversations")
def token_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rewards.token_amount(F.array(F.lit("prompt"), F.col("text")), 1).alias("words"))


@register("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 30) || right(text, 30) ELSE text END AS cut FROM documents")
def middle_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").select("doc_id", "text", F.filter(F.split("text", ""), lambda c: c != "").alias("chars"))
    return chars.select("doc_id", F.array_join(arrays.truncate(F.col("chars"), 60, "middle"), "").alias("cut"))


@register(f"{TOKENS}, k AS (SELECT uid, pos, 1 + pos % 3 AS id FROM t), f AS (SELECT uid, min(pos) AS f FROM k WHERE id = 1 GROUP BY uid) SELECT k.uid, pos - 1 AS pos, (f IS NULL OR pos <= f)::INT AS mask FROM k LEFT JOIN f USING (uid)")
def first_end_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform("mask", lambda _, i: 1 + (i + 1) % 3)
    rows = order_tokens(spark, sf_dir).select("uid", F.posexplode(arrays.mask_to_first_end(ids, F.array(F.lit(1)))).alias("pos", "mask"))
    return rows.select("uid", F.col("pos").cast("long").alias("pos"), "mask")


@register(f"SELECT vec_id, {R('list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])')} AS squared FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = arrays.unit_rows(F.transform("embedding", lambda x: x.cast("double")))
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.sqrt(arrays.dot(F.col("embedding"), F.col("embedding"))).alias("n"), v.alias("u"), "embedding")
    return own.select("vec_id", six(F.col("n") * arrays.dot(F.col("u"), F.col("embedding"))).alias("squared"))


@register("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def spread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("lang")).groupBy("lang").agg(F.count("*").alias("n"))


@register("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
