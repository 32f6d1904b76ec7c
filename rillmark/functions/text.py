"""Answer extraction, normalisation and scoring of response texts.

What regular expressions express is a Catalyst expression; brace matching and TeX repair are plain
Python functions behind Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from rillmark.functions.arrays import bound, windows

# Rewrites and removals that normalise a final answer.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def gsm8k_answer(text: Column, strict: bool = True) -> Column:
    """The number after the last ``####``, or with ``strict`` off the last number, of 300 characters."""
    tail = F.right(text, F.lit(300))
    if strict:
        return F.regexp_replace(last_match(tail, r"#### (\-?[0-9\.\,]+)"), "[,$]", "")
    found = F.filter(F.regexp_extract_all(tail, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.try_element_at(found, F.lit(-1))


def gsm8k_score(text: Column, truth: Column, strict: bool = True, formatted: float = 0.0, right: float = 1.0) -> Column:
    answer = gsm8k_answer(text, strict)
    return F.when(answer.isNull(), F.lit(0.0)).when(answer == truth, F.lit(right)).otherwise(F.lit(formatted))


def normalise_final(answer: Column) -> Column:
    """What follows the last ``=``, without units, markup and thousands separators."""
    x = F.element_at(F.split(answer, "="), -1)
    x = reduce(lambda a, s: F.replace(a, F.lit(s[0]), F.lit(s[1])), SUBSTITUTIONS, x)
    x = reduce(lambda a, s: F.replace(a, F.lit(s), F.lit("")), REMOVED, x)
    # fixed values: the rewrites of markup
    for pattern, to in [(r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", r"frac{$2}{$3}"), (r"(sqrt)([^{])", r"sqrt{$2}")]:
        x = F.regexp_replace(x, pattern, to)
    x = F.replace(x, F.lit("$"), F.lit(""))
    bare = F.replace(x, F.lit(","), F.lit(""))
    return F.trim(F.when(bare.rlike(r"^[0-9]+$"), bare).otherwise(x))


def minerva_answer(text: Column) -> Column:
    """The normalised line after the last ``Answer:``; [INVALID] where there is none."""
    return normalise_final(F.coalesce(last_match(text, r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]")))


def signed_score(text: Column, truth: Column) -> Column:
    """struct(score +-1, acc, pred) from the last 300 characters."""
    pred = minerva_answer(F.right(text, F.lit(300)))
    acc = pred == normalise_final(truth)
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def normalise_words(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column, contained: bool = False) -> Column:
    own = normalise_words(prediction)
    return F.exists(golds, (lambda g: own.contains(normalise_words(g))) if contained else (lambda g: own == normalise_words(g)))


def tagged_answer(text: Column) -> Column:
    """What the last <answer> pair holds."""
    return F.trim(last_match(text, r"(?s)<answer>(.*?)</answer>"))


def answer_score(text: Column, golds: Column, right: float = 1.0, formatted: float = 0.0, tags_most: int = 10) -> Column:
    """Exact match of the tagged answer; a quarter where there are more than ``tags_most`` tags."""
    found = tagged_answer(text)
    tags = F.greatest(F.regexp_count(text, F.lit("<answer>")), F.regexp_count(text, F.lit("</answer>")))
    good = F.when(tags > tags_most, F.lit(right / 4)).otherwise(F.lit(right))
    return F.when(found.isNull(), F.lit(0.0)).when(exact_match(found, golds), good).otherwise(F.lit(formatted))


def decontamination_tokens(text: Column) -> Column:
    """TeX commands and alphanumeric runs of a folded text."""
    folded = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.regexp_extract_all(folded, F.lit(r"(\\[A-Za-z]+|[A-Za-z0-9]+)"), F.lit(1))


def provenance_answer(answer: Column) -> Column:
    """Without $ and blanks; commas go only where digits are left."""
    x = F.regexp_replace(answer, r"[$\s]", "")
    bare = F.replace(x, F.lit(","), F.lit(""))
    return F.when(bare.rlike("^[0-9]+$"), bare).otherwise(x)


def ngram_repetition(words: Column, n: int = 4) -> Column:
    """Share of n-grams that repeat an earlier one."""
    # as strings: distinct arrays are found by comparing all pairs, distinct strings by hash
    grams = F.transform(windows(words, n), lambda g: F.array_join(g, "\u001f"))
    return bound(grams, lambda g: F.when(F.size(g) > 0, F.lit(1.0) - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(0.0)))


def parse_budget(text: Column) -> Column:
    """``[[n]]``, else a ``Budget: n`` line, else a bare number; null if none."""
    found = [F.regexp_extract(text, p, 1) for p in (r"\[\[\s*(\d+)\s*\]\]", r"(?im)^\s*budget\s*:\s*(\d+)\s*$", r"^\s*(\d+)\s*$")]
    return F.coalesce(*[F.when(x != "", x.cast("long")) for x in found])


def normalise_budget(raw: Column, least: int, most: int, step: int, fallback: int) -> Column:
    """Clamped, rounded to a whole step (halves to even), clamped again."""
    clamp = lambda x: F.greatest(F.lit(least), F.least(F.lit(most), x))
    return clamp((F.bround(clamp(F.coalesce(raw, F.lit(fallback))) / F.lit(float(step))) * step).cast("long"))


def code_block(text: Column) -> Column:
    """What lies between the last two fences; empty where there are fewer."""
    lines = F.split(text, "\n")
    fences = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("```"), i)), lambda i: i.isNotNull())
    a, b = F.try_element_at(fences, F.lit(-2)), F.try_element_at(fences, F.lit(-1))
    return F.when(F.size(fences) < 2, F.lit("")).otherwise(F.array_join(F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))), "\n"))


def tool_calls(text: Column) -> Column:
    """(name, arguments) of each <tool_call> block that parses."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(raw, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull())


def media_segments(text: Column) -> Column:
    """Typed segments around <image> and <video> marks; empty ones go."""
    parts = F.split(text, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)")
    kind = lambda x: F.when(x == "<image>", "image").when(x == "<video>", "video").otherwise("text")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(kind(x).alias("type"), x.alias("text")))


# ---- functions that need matching braces or bytes


def boxed(text: str | None) -> str | None:
    r"""The content of the last ``\boxed{...}`` or ``\fbox{...}``, braces matched; None if it never closes."""
    at = max((text or "").rfind("\\boxed"), (text or "").rfind("\\fbox"))
    if at < 0:
        return None
    bare = re.match(r"\\boxed ([^$]*)", text[at:])
    if bare:
        return bare[1]
    depth = 0
    for i in range(text.find("{", at), len(text)) if "{" in text[at:] else ():
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[text.find("{", at) + 1 : i]
    return None


def plain_tex(text: str | None) -> str | None:
    """An answer's TeX in one form: fractions and roots braced, units, signs and blanks gone."""
    if text is None:
        return None
    x = text.replace("\n", "").replace("\\!", "").replace("\\\\", "\\")
    x = re.sub(r"\\[td]frac", r"\\frac", x)
    x = re.sub(r"\\left|\\right|\^\{\\circ\}|\^\\circ|\\\$|\\%", "", x)
    x = x.split("\\text{ ")[0]
    x = re.sub(r"(^|[ {])\.", r"\g<1>0.", x)
    left, _, right = x.partition("=")
    x = right if right and len(left) <= 2 and "=" not in right else x
    x = re.sub(r"\\sqrt\s*([^{\s\\])", r"\\sqrt{\1}", x).replace(" ", "")
    x = re.sub(r"\\frac([^{\\])([^{\\])", r"\\frac{\1}{\2}", x)
    x = re.sub(r"\\frac([^{\\])\{", r"\\frac{\1}{", x)
    if x == "0.5":
        return "\\frac{1}{2}"
    return re.sub(r"^(-?\d+)/(-?\d+)$", r"\\frac{\1}{\2}", x)


def same_answer(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is b
    return a == b or plain_tex(a) == plain_tex(b)


@F.pandas_udf(StringType())
def boxed_answer(text: pd.Series) -> pd.Series:
    return text.map(boxed)


@F.pandas_udf(DoubleType())
def boxed_score(text: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([float((found := boxed(t)) is not None and same_answer(found, g)) for t, g in zip(text, truth, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def compression_repetition(text: pd.Series) -> pd.Series:
    """1 - compressed / plain bytes, within [0, 1]; 0 for an empty text."""

    def one(t: str | None) -> float:
        raw = (t or "").encode("utf-8", "replace")
        return min(1.0, max(0.0, 1 - len(zlib.compress(raw, 9)) / len(raw))) if raw else 0.0

    return text.map(one).astype("float64")
