"""Registered queries of answers compared by meaning, each with its DuckDB SQL.

The expressions are built from several columns of ``lineitem``; SQL does the algebra on the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators import equivalence
from rillmark.plans.queries import register
from rillmark.plans.rollouts import table
from rillmark.sources.staging import spread

#: a, b, c, d of a line: small numbers of four columns; off tells whether its second expression is changed.
NUMBERS_SQL = "SELECT l_orderkey AS uid, l_linenumber AS line, CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b, l_suppkey % 9 + 1 AS c, l_partkey % 11 + 2 AS d, (l_orderkey + l_linenumber) % 3 = 0 AS off FROM lineitem"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").cast("long").alias("a"), F.col("l_quantity").cast("long").alias("b"),
        (F.col("l_suppkey") % 9 + 1).alias("c"), (F.col("l_partkey") % 11 + 2).alias("d"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0).alias("off"),
    )


def _compared(rows: DataFrame, one: Column, two: Column) -> DataFrame:
    keyed = equivalence.with_keys(rows.select("uid", "line", one.alias("one"), two.alias("two")), "one", "two")
    return keyed.select("uid", "line", "one", "two", equivalence.same_answer("one", "two").alias("same"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@register(f"""WITH n AS ({NUMBERS_SQL}) SELECT uid, line, '(' || a || 'x+' || b || ')(' || c || 'x-' || d || 'y)' AS one,
  (a * c) || 'x^2-' || (a * d) || ' x y + ' || (b * c + CASE WHEN off THEN 1 ELSE 0 END) || 'x - ' || (b * d) || 'y' AS two, NOT off AS same FROM n""")
def expanded_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = map(F.col, "abcd")
    one = _text("(", a, "x+", b, ")(", c, "x-", d, "y)")
    two = _text(a * c, "x^2-", a * d, " x y + ", b * c + F.col("off").cast("int"), "x - ", b * d, "y")
    return _compared(numbers(spark, sf_dir), one, two)


@register(f"""WITH n AS ({NUMBERS_SQL}) SELECT uid, line, '\\frac{{' || a || '}}{{x+' || b || '}} - \\dfrac{{' || c || '}}{{x-' || d || '}}' AS one,
  '((' || (a - c) || ')x-' || (a * d + b * c) || ')/((x+' || b || ')*(x-' || (d + CASE WHEN off THEN 1 ELSE 0 END) || '))' AS two, NOT off AS same FROM n""")
def rational_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = map(F.col, "abcd")
    one = _text("\\frac{", a, "}{x+", b, "} - \\dfrac{", c, "}{x-", d, "}")
    two = _text("((", a - c, ")x-", a * d + b * c, ")/((x+", b, ")*(x-", d + F.col("off").cast("int"), "))")
    return _compared(numbers(spark, sf_dir), one, two)


@register(f"""WITH n AS ({NUMBERS_SQL}) SELECT uid, line, '\\frac{{1}}{{' || b || '+\\sqrt{{' || d || '}}}}' AS one,
  '(' || b || '-\\sqrt{{' || d || '}})/' || '(' || (b * b - d + CASE WHEN off THEN b ELSE 0 END) || ')' AS two, NOT off AS same FROM n WHERE b * b <> d AND b * b - d + b <> 0""")
def rationalised_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = F.col("b"), F.col("d")
    one = _text("\\frac{1}{", b, "+\\sqrt{", d, "}}")
    two = _text("(", b, "-\\sqrt{", d, "})/(", b * b - d + F.when(F.col("off"), b).otherwise(0), ")")
    return _compared(numbers(spark, sf_dir).where((b * b != d) & (b * b - d + b != 0)), one, two)


@register(f"""WITH n AS ({NUMBERS_SQL}) SELECT uid, line, '\\{{' || a || ', ' || b || ', \\frac{{' || c || '}}{{' || d || '}}\\}}' AS one,
  '\\left\\{{ ' || (2 * c) || '/' || (2 * d) || ',' || b || ',' || (a + CASE WHEN off THEN 1 ELSE 0 END) || ',' || b || ' \\right\\}}' AS two,
  list_sort(list_distinct([a * d, b * d, c])) = list_sort(list_distinct([c, b * d, (a + CASE WHEN off THEN 1 ELSE 0 END) * d])) AS same FROM n""")
def compared_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = map(F.col, "abcd")
    one = _text("\\{", a, ", ", b, ", \\frac{", c, "}{", d, "}\\}")
    two = _text("\\left\\{ ", 2 * c, "/", 2 * d, ",", b, ",", a + F.col("off").cast("int"), ",", b, " \\right\\}")
    return _compared(numbers(spark, sf_dir), one, two)


@register(f"""WITH n AS ({NUMBERS_SQL}) SELECT uid, line, '(' || a || ',' || b || CASE WHEN c % 2 = 0 THEN ']' ELSE ')' END || '\\cup[' || (b + c) || ',' || (b + c + d) || ')' AS one,
  '\\left[' || (b + c) || ', \\frac{{' || (3 * (b + c + d)) || '}}{{3}}\\right) \\cup (\\sqrt{{' || (a * a) || '}}, ' || b || CASE WHEN off THEN ')' ELSE ']' END AS two, off = (c % 2 <> 0) AS same FROM n""")
def compared_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = map(F.col, "abcd")
    one = _text("(", a, ",", b, F.when(c % 2 == 0, "]").otherwise(")"), "\\cup[", b + c, ",", b + c + d, ")")
    two = _text("\\left[", b + c, ", \\frac{", 3 * (b + c + d), "}{3}\\right) \\cup (\\sqrt{", a * a, "}, ", b, F.when(F.col("off"), ")").otherwise("]"))
    return _compared(numbers(spark, sf_dir), one, two)


def _written(v: Column) -> Column:
    """A number in one of four writings, by the line."""
    form = F.col("line") % 4
    return F.when(form == 0, _text(v)).when(form == 1, _text("\\frac{", 6 * v, "}{6}")).when(form == 2, _text("\\sqrt{", v * v, "}")).otherwise(_text(v, ".0"))


_WRITTEN_SQL = "CASE line % 4 WHEN 0 THEN v || '' WHEN 1 THEN '\\frac{' || (6 * v) || '}{6}' WHEN 2 THEN '\\sqrt{' || (v * v) || '}' ELSE v || '.0' END"


@register(f"""WITH n AS (SELECT uid, line, b % 3 AS v FROM ({NUMBERS_SQL}) z), g AS (SELECT uid, v, count(*) AS votes, min({_WRITTEN_SQL}) AS writing FROM n GROUP BY uid, v),
  r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY votes DESC, writing) AS k, count(*) OVER (PARTITION BY uid) AS classes FROM g) SELECT uid, writing, votes, classes FROM r WHERE k = 1""")
def majority_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equivalence.majority_answer(numbers(spark, sf_dir).withColumn("answer", _written(F.col("b") % 3)), "uid", "answer")


@register(f"""WITH n AS (SELECT uid, line, b % 3 AS v FROM ({NUMBERS_SQL}) z) SELECT n.uid, n.line, {_WRITTEN_SQL} AS answer, CASE WHEN v = o_custkey % 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
  FROM n JOIN orders ON uid = o_orderkey""")
def rewards_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbers(spark, sf_dir).select("uid", "line", _written(F.col("b") % 3).alias("answer"))
    truths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), _text(F.col("o_custkey") % 3 * 2, "/2").alias("truth"))
    return equivalence.reward_by_meaning(rows, truths, "uid", "answer", "truth")
