"""Masked and ordered functions of token arrays, as Catalyst higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum where mask is not 0; what the mask hides may be NaN."""
    return total(F.zip_with(values, mask, lambda v, m: F.when(m != 0, v * m).otherwise(F.lit(0.0))))


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (total(F.transform(mask, lambda m: m.cast("double"))) + F.lit(EPSILON))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reverse_scan(values: Column, carry: float | Column) -> Column:
    """out[t] = values[t] + carry x out[t + 1], in log2(n) passes over the whole array.

    After a pass each place holds the sum over twice as many places as before.
    """
    carry = carry if isinstance(carry, Column) else F.lit(float(carry))

    def double(acc: Column, k: Column) -> Column:
        step = F.pow(F.lit(2.0), k).cast("int")
        return bound(F.struct(step.alias("s"), F.pow(carry, step).alias("c")), lambda z: F.transform(acc, lambda x, i: x + z["c"] * F.coalesce(F.get(acc, i + z["s"]), F.lit(0.0))))

    def scan(v: Column) -> Column:
        passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1)
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(F.when(F.size(v) < 2, F.array().cast("array<int>")).otherwise(passes), v, double))

    return bound(F.transform(values, lambda x: x.cast("double")), scan)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Advantages by a reverse scan; tokens outside the mask hand on the state they were given.

    The kept tokens are scanned by themselves, and each token outside takes what the next kept one
    has, or 0 where there is none.
    """
    tokens = F.transform(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")), lambda z: F.struct(z["r"].cast("double").alias("r"), z["v"].cast("double").alias("v"), z["m"].cast("double").alias("m")))

    def kept_advantages(kept: Column) -> Column:
        return reverse_scan(F.transform(kept, lambda z, i: z["r"] + F.lit(gamma) * F.coalesce(F.get(kept, i + 1)["v"], F.lit(0.0)) - z["v"]), gamma * lam)

    def spread_out(z: Column) -> Column:
        total = F.size(z["kept"])
        return F.transform(z["ahead"], lambda n: F.coalesce(F.get(z["kept"], (total - n).cast("int")), F.lit(0.0)))

    def both(t: Column) -> Column:
        on = F.transform(t, lambda z: (z["m"] != 0).cast("double"))
        kept = bound(F.filter(t, lambda z: z["m"] != 0), kept_advantages)
        return bound(F.struct(kept.alias("kept"), reverse_scan(on, 1.0).alias("ahead")), spread_out)

    return bound(tokens, both)


def mask_to_first_end(ids: Column, ends: Column) -> Column:
    """1 up to and with the first id that is in ``ends``, then 0."""
    first = F.array_position(F.transform(ids, lambda x: F.array_contains(ends, x)), F.lit(True))
    return F.transform(ids, lambda _, i: ((first == 0) | (i < first)).cast("int"))


def pad(values: Column, length: int, fill: Column, left: bool = False) -> Column:
    more = F.array_repeat(fill, F.greatest(F.lit(0), F.lit(length) - F.size(values)))
    return F.concat(more, values) if left else F.concat(values, more)


def truncate(values: Column, length: int, mode: str = "right") -> Column:
    """At most ``length`` elements: left and right name the side that is cut; middle keeps both ends."""
    over = F.size(values) > length
    half = length // 2
    kept = {
        "right": F.slice(values, 1, length),
        "left": F.slice(values, F.greatest(F.size(values) - length + 1, F.lit(1)), length),
        "middle": F.concat(F.slice(values, 1, half), F.slice(values, F.greatest(F.size(values) - (length - half) + 1, F.lit(1)), length - half)),
        "error": F.when(over, F.raise_error(F.lit("a sequence is too long")).cast("array<bigint>")).otherwise(values) if mode == "error" else values,
    }[mode]
    return F.when(over, kept).otherwise(values)


def windows(values: Column, n: int) -> Column:
    """All runs of ``n`` neighbours."""
    runs = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - n + 1, F.lit(1))), lambda i: F.slice(v, i, n))
    return bound(values, lambda v: F.when(F.size(v) >= n, runs(v)).otherwise(F.slice(F.array(v), 1, 0)))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased chance that one of k of n samples, of which c are right, is right."""
    terms = F.when(c > 0, F.sequence((n - c + 1).cast("int"), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    missed = F.aggregate(terms, F.lit(1.0), lambda a, i: a * (F.lit(1.0) - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - missed)


def unit_rows(values: Column) -> Column:
    """The vector over its Euclidean length; an error where that is 0 or not finite."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    safe = F.when((norm > 0) & (norm < float("inf")), norm).otherwise(F.raise_error(F.lit("a vector has no direction")).cast("double"))
    return F.transform(values, lambda x: x / safe)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
