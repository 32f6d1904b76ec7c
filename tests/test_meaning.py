import random
import time
from fractions import Fraction

import pytest

from rillmark.functions.algebra import keyed
from rillmark.functions.grading import equal_answers
from rillmark.operators import equivalence

EQUAL = [
    ("(x+1)^2", "x^2+2x+1"), ("\\frac{1}{2}", "0.5"), ("\\frac12", "1/2"), ("\\sqrt{8}", "2\\sqrt2"), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}"), ("\\frac{x^2-1}{x-1}", "x+1"),
    ("2\\pi", "\\pi\\cdot 2"), ("1,234", "1234"), ("x=5", "5"), ("\\left(1,\\frac{2}{4}\\right)", "(1, 0.5)"), ("\\{1,2,3\\}", "\\{3, 2, 1, 1\\}"), ("(1,2]\\cup[3,4)", "[3,4) \\cup (1,2]"),
    ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix} 1 & \\frac{4}{2} \\\\ 3 & 4 \\end{pmatrix}"), ("\\frac{1}{1+\\sqrt{2}+\\sqrt3}", "\\frac{1}{\\sqrt3+\\sqrt2+1}"), ("(\\sqrt2+\\sqrt3)^2", "5+2\\sqrt6"),
    ("x^{-1}", "1/x"), ("\\sqrt{x+1}", "\\sqrt{1+x}"), ("\\sin^2 x", "\\sin x\\cdot\\sin x"), ("50\\%", "1/2"), ("4!", "24"), ("-x^2", "-(x^2)"), ("x_1+x_2", "x_2+x_1"), ("x^{\\frac12}", "\\sqrt{x}"), ("x**3", "x*x*x"),
    ("-3/4", "\\frac{-3}{4}"), ("$\\frac{3}{4}$.", "0.75"), ("\\sqrt[3]{y}", "y^{1/3}"),
]
UNEQUAL = [("(x+1)^2", "x^2+2x"), ("(1,2)", "(2,1)"), ("(1,2]", "(1,2)"), ("\\sqrt2", "1.5"), ("x", "y"), ("\\frac{1}{3}", "0.333"), ("x^2", "-x^2"), ("\\{1,2\\}", "(1,2)"), ("\\sqrt{x}", "x"), ("\\sin x", "\\cos x")]


@pytest.mark.parametrize("a,b", EQUAL)
def test_equal_answers_share_a_key(a, b):
    assert keyed(a)[0] is not None and keyed(a)[0] == keyed(b)[0]


@pytest.mark.parametrize("a,b", UNEQUAL)
def test_unequal_answers_do_not(a, b):
    assert None not in (keyed(a)[0], keyed(b)[0]) and keyed(a)[0] != keyed(b)[0]


def test_grading_sees_algebra_and_decimals():
    assert equal_answers("(x+1)^2", "x^2+2x+1") and not equal_answers("(x+1)^2", "x^2+x+1")
    assert equal_answers("1.41421", "\\sqrt{2}") and not equal_answers("1.42", "\\sqrt{2}") and equal_answers("3.1416", "\\pi")


@pytest.mark.parametrize("text", [None, "", "x+", "\\frac{1}", "1/0", "1/(x-x)", "((((", "(" * 480 + "1" + ")" * 480, "a" * 2000, "\\begin{pmatrix}1", "9^{99999999}", "&", "2^", "\\cup"])
def test_what_cannot_be_read_has_no_key(text):
    began = time.perf_counter()
    key, near = keyed(text)
    assert time.perf_counter() - began < 2 and (key is None or "(((" in text)


@pytest.mark.parametrize("seed", range(60))
def test_random_expressions_against_exact_values(seed):
    """Two random expressions in x have one key only if they agree at all of many rational points."""
    rng = random.Random(seed)

    def grow(depth):
        if not depth:
            n = rng.randrange(1, 4)
            return rng.choice([("x", lambda x: x), (str(n), lambda x: Fraction(n))])
        (a, f), (b, g) = grow(depth - 1), grow(depth - 1)
        return rng.choice([(f"({a}+{b})", lambda x: f(x) + g(x)), (f"({a}-{b})", lambda x: f(x) - g(x)), (f"{a}\\cdot {b}" if depth == 1 else f"({a})({b})", lambda x: f(x) * g(x)), (f"({a})^2", lambda x: f(x) ** 2)])

    made = [grow(rng.randrange(1, 4)) for _ in range(40)]
    points = [Fraction(n, 7) for n in range(3, 60)]
    values = [tuple(f(x) for x in points) for _, f in made]
    keys = [keyed(text)[0] for text, _ in made]
    assert None not in keys
    for i in range(40):
        for j in range(i):
            assert (keys[i] == keys[j]) == (values[i] == values[j]), (made[i][0], made[j][0])


def test_odd_rows(spark):
    rows = [(1, "1/2", "x"), (1, "0.5", "x"), (1, None, "x"), (1, "no answer here!", "x"), (2, None, "x"), (None, "2", "x"), (None, "\\sqrt4", "x")]
    df = spark.createDataFrame(rows, "uid long, answer string, votes string")
    got = {tuple(r) for r in equivalence.majority_answer(df, "uid", "answer").collect()}
    assert got == {(1, "0.5", 2, 2), (None, "2", 2, 1)}
    truths = spark.createDataFrame([(1, "\\frac{2}{4}"), (2, "7")], "uid long, truth string")
    got = [tuple(r) for r in equivalence.reward_by_meaning(df, truths, "uid", "answer", "truth").collect()]
    assert sorted(got, key=str) == sorted([(1, "1/2", "x", 1.0), (1, "0.5", "x", 1.0), (1, None, "x", 0.0), (1, "no answer here!", "x", 0.0), (2, None, "x", 0.0), (None, "2", "x", 0.0), (None, "\\sqrt4", "x", 0.0)], key=str)
    assert equivalence.majority_answer(df.limit(0), "uid", "answer").collect() == []
