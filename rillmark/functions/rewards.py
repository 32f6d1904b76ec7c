"""Rule-based rewards of several response formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillmark.functions import text as t

#: The names of data sources, in the routes below.
ROUTES: dict[str, Callable[[Column, Column], Column]] = {}


def route(*sources: str) -> Callable:
    """Name the data sources that a score is for."""

    def add(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        for s in sources:
            if ROUTES.setdefault(s, f) is not f:
                raise ValueError(f"{s} has a score already")
        return f

    return add


@route("openai/gsm8k")
def gsm8k(response: Column, truth: Column) -> Column:
    return t.gsm8k_score(response, truth)


@route("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500")
def boxed(response: Column, truth: Column) -> Column:
    return t.boxed_score(response, truth)


@route("math_dapo", "math", "math_dapo_reasoning")
def signed(response: Column, truth: Column) -> Column:
    return t.signed_score(response, truth)["score"]


@route("searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa")
def searched(response: Column, truth: Column) -> Column:
    return t.answer_score(response, F.array(truth))


@route("Idavidrein/gpqa")
def choice(response: Column, truth: Column) -> Column:
    """The first ``Answer: X`` with X of A to D."""
    return (F.regexp_extract(response, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1) == truth).cast("double")


def score(source: Column, response: Column, truth: Column) -> Column:
    """The score of each row's data source; an unknown one is an error."""
    out = None
    for name, f in ROUTES.items():
        value = f(response, truth)
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("no score for "), source)).cast("double"))


def formatted(response: Column, truth: Column, accuracy: Column, share: float = 0.1) -> Column:
    """(1 - share) x accuracy + share x (a think block with a boxed answer after it)."""
    shape = response.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")
    return F.lit(1 - share) * accuracy + F.lit(share) * shape


def tool_use(signed_score: Column, turns: Column) -> Column:
    """A wrong answer loses less the more turns it took, but 0.6 at least."""
    return F.when(signed_score < 0, F.least(F.lit(-0.6), signed_score + (turns - 2) / F.lit(2) * F.lit(0.1))).otherwise(signed_score)


def step_error(predicted: Column, truth: Column, steps: Column) -> Column:
    """Where an error was found and is there: 1 - distance / steps; else right or wrong, +-1; unreadable -1."""
    found = predicted.isNotNull() & (predicted >= -1) & (predicted < steps)
    near = F.lit(1.0) - F.abs(predicted - truth) / steps
    return F.when(~found, F.lit(-1.0)).when((truth >= 0) & (predicted >= 0), near).when(predicted == truth, F.lit(1.0)).otherwise(F.lit(-1.0))


def point_in_box(points: Column, box: Column) -> Column:
    """1 / sqrt(n k) where point k of n is the first inside [x1, y1, x2, y2], -1 / n if none, -1 without points."""
    n = F.size(points)
    inside = F.transform(points, lambda p: (p[0] >= box[0]) & (p[0] <= box[2]) & (p[1] >= box[1]) & (p[1] <= box[3]))
    first = F.array_position(inside, F.lit(True))
    return F.when(points.isNull() | (n == 0), F.lit(-1.0)).when(first > 0, F.lit(1.0) / F.sqrt(n * first)).otherwise(F.lit(-1.0) / n)


def collinear(points: Column, tolerance: float = 1e-9) -> Column:
    """Whether any three of the points lie on a line."""
    n = F.size(points)
    i = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    triple = F.exists(i, lambda x: F.exists(i, lambda y: F.exists(i, lambda z: (x < y) & (y < z) & (F.abs(cross(F.get(points, x), F.get(points, y), F.get(points, z))) <= tolerance))))
    return F.when(n < 3, F.lit(False)).otherwise(triple)


def think_answer(response: Column) -> Column:
    """struct(think, answer): the block and what follows; null where either is missing."""
    think, rest = (F.regexp_extract(response, r"(?s)^\s*<think>(.*?)</think>\s*(\S.*)$", i) for i in (1, 2))
    return F.when(rest != "", F.struct(think.alias("think"), F.trim(rest).alias("answer")))


def token_amount(contents: Column, prefix: int) -> Column:
    """Blank-separated words of the messages after the prompt."""
    words = F.transform(F.slice(contents, prefix + 1, F.greatest(F.size(contents) - prefix, F.lit(0))), lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    return F.aggregate(words, F.lit(0), lambda a, x: a + x)


def place_at_end(score_: Column, mask: Column) -> Column:
    """Zeros, but the score at the last token that counts."""
    last = F.aggregate(mask, F.lit(0), lambda a, m: a + (m != 0).cast("int"))
    return F.transform(mask, lambda _, i: F.when(i == last - 1, score_).otherwise(F.lit(0.0)))
