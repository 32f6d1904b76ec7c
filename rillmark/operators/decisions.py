"""Decision tables: rules as rows, checked, and compiled to one expression; and the gates that feed them.

A rule names an outcome and, for some columns, the range that a value must lie in.  ``faults`` looks
at every cell that the rules' bounds cut the space into, so overlaps and gaps are found for certain,
not by sampling; rules are configuration and few, rows are data and never leave the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product
from math import inf, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_MOST = 1_000_000


@dataclass(frozen=True)
class Range:
    """Values from ``low`` to ``high``; each end belongs to it unless it is open."""

    low: float = -inf
    high: float = inf
    open_low: bool = False
    open_high: bool = False

    def has(self, x: float) -> bool:
        return (x > self.low if self.open_low else x >= self.low) and (x < self.high if self.open_high else x <= self.high)

    def test(self, c: Column) -> Column:
        out = F.lit(True)
        if self.low > -inf:
            out = out & (c > self.low if self.open_low else c >= self.low)
        if self.high < inf:
            out = out & (c < self.high if self.open_high else c <= self.high)
        return out


@dataclass(frozen=True)
class Rule:
    outcome: str
    when: dict[str, Range] = field(default_factory=dict)

    def has(self, point: dict[str, float]) -> bool:
        return all(r.has(point[c]) for c, r in self.when.items())


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from rows (rule, outcome, column, low, high, open_low, open_high), a row a condition; null bounds are open ended.

    A rule of one row whose column is null has no condition.
    """
    rows = table.orderBy("rule", "column").collect()  # configuration: as many rows as conditions
    when: dict[tuple, dict[str, Range]] = {}
    for r in rows:
        own = when.setdefault((r["rule"], r["outcome"]), {})
        if r["column"] is not None:
            if r["column"] in own:
                raise ValueError(f"rule {r['rule']} states {r['column']} twice")
            own[r["column"]] = Range(-inf if r["low"] is None else r["low"], inf if r["high"] is None else r["high"], bool(r["open_low"]), bool(r["open_high"]))
    return [Rule(outcome, own) for (_, outcome), own in when.items()]


def _points(bounds: set[float], low: float, high: float) -> list[float]:
    """One value of every cell: each bound, and one between each two."""
    inner = sorted(b for b in bounds | {low, high} if low <= b <= high and abs(b) < inf)
    if not inner:
        return [0.0]
    out = [inner[0] - 1] if low == -inf else []
    for a, b in zip(inner, [*inner[1:], None], strict=True):
        out += [a] if b is None else [a, (a + b) / 2]
    return [*out, inner[-1] + 1] if high == inf else out


def faults(rules: Sequence[Rule], domain: dict[str, tuple[float, float]] | None = None) -> list[tuple[str, dict[str, float], list[str]]]:
    """("gap" or "overlap", a point of the cell, the outcomes that hold there) of every faulty cell; overlaps within one outcome are none."""
    domain = domain or {}
    columns = sorted({c for r in rules for c in r.when})
    values = [_points({b for r in rules if c in r.when for b in (r.when[c].low, r.when[c].high)}, *domain.get(c, (-inf, inf))) for c in columns]
    if prod(map(len, values)) > CELLS_MOST:
        raise ValueError("the rules cut too many cells to check")
    out = []
    for point in product(*values):
        at = dict(zip(columns, point, strict=True))
        held = sorted({r.outcome for r in rules if r.has(at)})
        if len(held) != 1:
            out.append(("overlap" if held else "gap", at, held))
    return out


def decision(rules: Sequence[Rule], domain: dict[str, tuple[float, float]] | None = None, first: bool = False, otherwise: str | None = None) -> Column:
    """The outcome of a row as one expression.

    Rules with gaps or overlaps raise; with ``first`` the first rule that holds decides, and with
    ``otherwise`` gaps are its.  A null in a column that a rule asks for never satisfies it.
    """
    wrong = [f for f in faults(rules, domain) if not (f[0] == "overlap" and first or f[0] == "gap" and otherwise is not None)]
    if wrong:
        raise ValueError(f"{len(wrong)} cells without one outcome, such as {wrong[0]}")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        test = F.lit(True)
        for c, own in r.when.items():
            test = test & own.test(F.col(c))
        out = out.when(test, F.lit(r.outcome))
    return out.otherwise(F.lit(otherwise))


def worst_corners(rows: DataFrame, by: Sequence[str], metrics: Sequence[str], corner: str, corners: int = 4) -> DataFrame:
    """by and the least of each metric over a group's corners; another number of corners, or one twice, is an error."""
    whole = (F.count("*") == corners) & (F.count_distinct(corner) == corners)
    agg = rows.groupBy(*by).agg(*[F.min(m).alias(m) for m in metrics], whole.alias("__whole"))
    checked = F.when(~F.col("__whole"), F.raise_error(F.lit(f"primary corners must be {corners} distinct ones"))).otherwise(F.col(metrics[0]))
    return agg.withColumn(metrics[0], checked).drop("__whole")


@dataclass(frozen=True)
class Gate:
    """A metric passes if its median reaches ``median`` and ``count`` of the values reach ``least``."""

    metric: str
    median: float = -inf
    least: float = -inf
    count: int = 0


def component_gates(rows: DataFrame, by: Sequence[str], gates: Sequence[Gate], values: int = 8) -> DataFrame:
    """by, per metric its median, count and pass, and all_pass, of groups of exactly ``values`` rows.

    The median of a group is taken from its few sorted values; larger groups are an error before they are gathered.
    """
    agg = []
    for g in gates:
        agg += [F.count_if(F.col(g.metric) >= g.least).cast("long").alias(f"{g.metric}_count"), F.sort_array(F.collect_list(g.metric)).alias(f"__{g.metric}")]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__size")).where(F.col("__size") != values).limit(1)
    wrong = sizes.first()
    if wrong:
        raise ValueError(f"{values} values are needed, found {wrong['__size']}")
    out = rows.groupBy(*by).agg(*agg)
    shown, passes = [], []
    for g in gates:
        v = F.col(f"__{g.metric}")
        median = (F.get(v, F.lit((values - 1) // 2)) + F.get(v, F.lit(values // 2))) / 2
        passed = F.coalesce((median >= g.median) & (F.col(f"{g.metric}_count") >= g.count), F.lit(False))
        shown += [median.alias(f"{g.metric}_median"), F.col(f"{g.metric}_count"), passed.alias(f"{g.metric}_pass")]
        passes.append(passed)
    every = passes[0]
    for p in passes[1:]:
        every = every & p
    return out.select(*by, *shown, every.alias("all_pass"))
