"""Exact comparison of mathematical answers by a normal form.

An expression in TeX or plain notation becomes a value: its rational functions are taken at two fixed
points of a prime field, one for each square root of integers that it holds, so equal expressions have
equal values however they are written, and unequal ones differ but for a chance of about 1e-30.
Denominators are made free of roots; roots and functions of what is no number, and powers with such
exponents, are symbols named after their arguments' values.  Constants keep a float beside it, for
answers given as decimals.

Sets compare without order and repeats, unions without order, tuples, intervals and matrices place
by place; an equation ``x = ...`` counts as its right side.  What cannot be read has no value.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


PRIME = (1 << 61) - 1
LONGEST, POWER_MOST, ROOT_MOST = 1000, 1000, 10**12

_TOKEN = re.compile(r"\s+|\\(?:left|right|!|,|;|:|quad|displaystyle|limits)(?![A-Za-z])|(\d+(?:\{?,\}?\d{3})+(?!\d)(?:\.\d+)?|\d*\.\d+|\d+\.?)|(\\[A-Za-z]+|\\[{}%])|([A-Za-z])|(.)", re.DOTALL)
#: Commands by what they stand for.
_SIGNS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "\\lbrack": "[", "\\rbrack": "]", "\\%": "%", "\\ast": "*"}
_FUNCTIONS = set("\\sin \\cos \\tan \\cot \\sec \\csc \\log \\ln \\exp \\arcsin \\arccos \\arctan".split())
_FRACTIONS = {"\\frac", "\\dfrac", "\\tfrac", "\\cfrac"}

Parts = dict[int, tuple[int, int]]


class Unread(ValueError):
    """An expression that has no value."""


def _field(x: Fraction) -> tuple[int, int]:
    if not x.denominator % PRIME:
        raise Unread
    return (x.numerator * pow(x.denominator, -1, PRIME) % PRIME,) * 2


def _symbol(name: str) -> tuple[int, int]:
    h = hashlib.blake2b(name.encode(), digest_size=16).digest()
    return int.from_bytes(h[:8], "big") % PRIME, int.from_bytes(h[8:], "big") % PRIME


class Value:
    """``parts``: by squarefree n, the factor of its root at both points; ``exact`` for rational numbers, ``near`` for all constants."""

    def __init__(self, parts: Parts, exact: Fraction | None = None, near: float | None = None):
        self.parts = {n: p for n, p in parts.items() if any(p)}
        self.exact, self.near = exact, near

    @classmethod
    def number(cls, x: Fraction) -> Value:
        return cls({1: _field(x)}, x, float(x) if abs(x) < 10**300 else None)

    @classmethod
    def named(cls, name: str, near: float | None = None) -> Value:
        return cls({1: _symbol(name)}, None, near)

    def _near(self, other: Value, f: Callable[[float, float], float]) -> float | None:
        try:
            out = None if self.near is None or other.near is None else f(self.near, other.near)
        except (OverflowError, ZeroDivisionError, ValueError):
            return None
        return out if isinstance(out, float) and math.isfinite(out) else None

    def __add__(self, other: Value) -> Value:
        parts = dict(self.parts)
        for n, p in other.parts.items():
            q = parts.get(n, (0, 0))
            parts[n] = (q[0] + p[0]) % PRIME, (q[1] + p[1]) % PRIME
        exact = None if self.exact is None or other.exact is None else self.exact + other.exact
        return Value(parts, exact, self._near(other, lambda a, b: a + b))

    def __mul__(self, other: Value) -> Value:
        parts: Parts = {}
        for a, p in self.parts.items():
            for b, q in other.parts.items():
                g = math.gcd(a, b)
                n, old = a // g * (b // g), parts.get(a // g * (b // g), (0, 0))
                parts[n] = tuple((o + x * y * g) % PRIME for o, x, y in zip(old, p, q, strict=True))
        exact = None if self.exact is None or other.exact is None else self.exact * other.exact
        return Value(parts, exact, self._near(other, lambda a, b: a * b))

    def inverse(self) -> Value:
        """Multiplied by conjugates until no root is left below."""
        top, low = Value.number(Fraction(1)), Value(self.parts)
        while any(n > 1 for n in low.parts):
            n = max(low.parts)
            p = next(d for d in range(2, n + 1) if n % d == 0)  # a prime, as the least divisor
            mate = Value({k: v if k % p else tuple(-x % PRIME for x in v) for k, v in low.parts.items()})
            top, low = top * mate, low * mate
        if 1 not in low.parts or not all(low.parts[1]):
            raise Unread
        out = top * Value({1: tuple(pow(x, -1, PRIME) for x in low.parts[1])})
        return Value(out.parts, None if self.exact is None else 1 / self.exact, None if not self.near else 1 / self.near)

    def power(self, n: int) -> Value:
        if abs(n) > POWER_MOST:
            raise Unread
        base, out = (self if n >= 0 else self.inverse()), Value.number(Fraction(1))
        for bit in bin(abs(n))[2:]:
            out = out * out
            if bit == "1":
                out = out * base
        return out

    def root(self) -> Value:
        x = self.exact
        if x is None or x < 0 or x.numerator * x.denominator > ROOT_MOST:
            near = math.sqrt(self.near) if self.near is not None and self.near >= 0 else None
            return Value.named(f"root {self.key()}", near)
        rest, out, free, d = x.numerator * x.denominator, 1, 1, 2
        while d * d <= rest:
            while rest % (d * d) == 0:
                rest, out = rest // (d * d), out * d
            if rest % d == 0:
                rest, free = rest // d, free * d
            d += 1
        free, factor = free * rest if x else 1, Fraction(out, x.denominator)
        if not x:
            return Value.number(Fraction(0))
        return Value({free: _field(factor)}, factor if free == 1 else None, math.sqrt(x))

    def raised(self, other: Value) -> Value:
        if other.exact is not None and other.exact.denominator == 1:
            return self.power(int(other.exact))
        if other.exact is not None and other.exact.denominator == 2 and abs(other.exact) < POWER_MOST:
            return self.root().power(other.exact.numerator)
        return Value.named(f"{self.key()} ^ {other.key()}", self._near(other, lambda a, b: a**b))

    def key(self) -> str:
        return ";".join(f"{n}:{a:x},{b:x}" for n, (a, b) in sorted(self.parts.items()))


class Reader:
    """Precedence climbing over the tokens of one expression."""

    def __init__(self, text: str):
        self.tokens = [_SIGNS.get(t, t) for m in _TOKEN.finditer(text.replace("**", "^")) if (t := m[1] or m[2] or m[3] or m[4])]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or wanted and token != wanted:
            raise Unread
        self.at += 1
        return token

    def total(self) -> Value:
        out, sign = None, 1
        while True:
            while self.peek() in ("+", "-") and self.peek():
                sign *= -1 if self.take() == "-" else 1
            term = self.product() * Value.number(Fraction(sign))
            out, sign = term if out is None else out + term, 1
            if self.peek() not in ("+", "-") or not self.peek():
                return out

    def product(self) -> Value:
        out = self.factor()
        while True:
            token = self.peek()
            if token == "*":
                self.take()
                out = out * self.factor()
            elif token == "/":
                self.take()
                out = out * self.factor().inverse()
            elif token and (token[0].isalnum() or token in ("(", "{", "[") or token in _FRACTIONS or token in _FUNCTIONS or token == "\\sqrt" or token[0] == "\\" and token[1:].isalpha() and token != "\\cup"):
                out = out * self.factor()
            else:
                return out

    def factor(self) -> Value:
        if self.peek() == "-":
            self.take()
            return self.factor() * Value.number(Fraction(-1))
        out = self.atom()
        while self.peek() in ("^", "%", "!") and self.peek():
            token = self.take()
            if token == "^":
                out = out.raised(self.factor() if self.peek() == "-" else self.atom())
            elif token == "%":
                out = out * Value.number(Fraction(1, 100))
            elif out.exact is None or out.exact.denominator != 1 or not 0 <= out.exact <= 100:
                raise Unread
            else:
                out = Value.number(Fraction(math.factorial(int(out.exact))))
        return out

    def atom(self) -> Value:
        token = self.take()
        if token[0].isdigit() or token[0] == ".":
            return Value.number(Fraction(token.replace(",", "").replace("{", "").replace("}", "").rstrip(".") or "0"))
        if token in ("(", "{", "["):
            out = self.total()
            self.take({"(": ")", "{": "}", "[": "]"}[token])
            return out
        if token in _FRACTIONS:
            top = self.digit_or_atom()
            return top * self.digit_or_atom().inverse()
        if token == "\\sqrt":
            degree = self.atom() if self.peek() == "[" else Value.number(Fraction(2))
            inside = self.digit_or_atom()
            return inside.root() if degree.exact == 2 else inside.raised(degree.inverse())
        if token in _FUNCTIONS:
            power = self.atom() if self.peek() == "^" and self.take() else None
            out = Value.named(f"{token} {self.factor().key()}")
            return out if power is None else out.raised(power)
        if token == "\\pi":
            return Value.named(token, math.pi)
        if token not in ("\\begin", "\\end") and (token.isalpha() or token[0] == "\\" and token[1:].isalpha()):
            if self.peek() == "_":
                self.take()
                token += f"_{self.take()}" if self.peek() != "{" else "_" + self.grouped()
            return Value.named(token)
        raise Unread

    def digit_or_atom(self) -> Value:
        """``\\frac12`` takes one digit each."""
        token = self.peek()
        if len(token) > 1 and token.isdigit():
            self.tokens[self.at : self.at + 1] = [token[0], token[1:]]
        return self.atom()

    def grouped(self) -> str:
        out = [self.take("{")]
        while out[-1] != "}":
            out.append(self.take())
        return "".join(out[1:-1])


def read(text: str) -> Value:
    reader = Reader(text)
    out = reader.total()
    if reader.peek():
        raise Unread
    return out


def split(text: str, mark: str) -> list[str]:
    """What ``mark`` separates outside brackets; the bracket of an interval may be closed by another kind."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(text):
        if not depth and text.startswith(mark, i):
            out.append(text[at:i])
            i = at = i + len(mark)
            continue
        depth += (text[i] in "([{") - (text[i] in ")]}")
        i += 1
    return [*out, text[at:]]


def normal_form(text: str) -> tuple[str, float | None]:
    """The key that equal answers share, and the number that a constant is."""
    text = text.strip().removesuffix(".").strip().strip("$").strip().removesuffix(".").strip()
    text = re.sub(r"\\(?:left|right|!|,|;|:)(?![A-Za-z])", "", text)
    text = re.sub(r"\\(?:text|mathrm|mbox)\{[^{}]*\}", "", text).replace("\\$", "").strip()
    if m := re.fullmatch(r"\\begin\{([pbv]?matrix)\}(.*)\\end\{\1\}", text, re.DOTALL):
        rows = [[normal_form(c)[0] for c in split(r, "&")] for r in split(m[2].removesuffix("\\\\"), "\\\\")]
        return f"matrix{rows}", None
    if len(joined := split(text, "\\cup")) > 1:
        return f"union{sorted({normal_form(p)[0] for p in joined})}", None
    if m := re.fullmatch(r"\\\{(.*)\\\}", text, re.DOTALL):
        return f"set{sorted({normal_form(p)[0] for p in split(m[1], ',')} if m[1].strip() else [])}", None
    sides = split(text, "=")
    if len(sides) == 2 and re.fullmatch(r"\s*[A-Za-z]\s*(\([A-Za-z]\))?\s*", sides[0]):
        return normal_form(sides[1])
    if len(text) > 1 and text[0] in "([" and text[-1] in ")]" and len(items := split(text[1:-1], ",")) > 1:
        return f"{text[0]}{[normal_form(p)[0] for p in items]}{text[-1]}", None
    try:
        value = read(text)
    except Unread:
        if len(items := split(text, ",")) > 1:
            return f"list{[normal_form(p)[0] for p in items]}", None
        raise
    return value.key(), value.near




@lru_cache(maxsize=65_536)
def keyed(text: str | None) -> tuple[str | None, float | None]:
    """``normal_form`` with nulls for what is null, longer than ``LONGEST`` or cannot be read."""
    if text is None or not text.strip() or len(text) > LONGEST:
        return None, None
    try:
        return normal_form(text)
    except (Unread, RecursionError, ZeroDivisionError, OverflowError):
        return None, None


@F.pandas_udf(StructType([StructField("key", StringType()), StructField("near", DoubleType())]))
def answer_key(text: pd.Series) -> pd.DataFrame:
    found = [keyed(t) for t in text]
    return pd.DataFrame({"key": [k for k, _ in found], "near": pd.array([math.nan if x is None else x for _, x in found], dtype="float64")})
