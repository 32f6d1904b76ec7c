"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed in cells of source, language and topic; raking scales the cells until
their marginals meet the targets.  No document is kept more than once, so a category can give no
more than it has: targets beyond that are cut to it and the rest shared among the others, and the
cells are raked again with probabilities of 1 at most, until what is kept meets those targets.  The
expected tokens are the stated share of the corpus; ``marginals`` tells wished, reachable and met.
The draw is a keyed hash of doc_id and text, so it is the same in every run.

The cell table is small beside the corpus, but nothing bounds it: up to ``CELLS_MOST`` cells it is
raked on the driver and broadcast, beyond that by grouped aggregation, staged every round.

Defined cases: repeated rows (the same doc_id and text) are kept or dropped together, as the draw is theirs; null source, language or topic is a category of its own; a null or empty text has no
tokens and its cell's probability; targets of categories that do not occur are shared among those
that do; a category without target gets none and its documents are not drawn; an empty table gives
no rows; columns of the input are kept unless they clash with those added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm import storage

AXES = ("source", "lang", "topic")
ROUNDS = 50
TOLERANCE = 1e-9
CELLS_MOST = 100_000
WEIGHT_MOST = 1e12
SHARE = 0.5
TEMPERATURE = 0.5
ADDED = ("__source", "__lang", "__topic", "__draw", "n_tokens", "topic", "weight", "probability", "kept")


def n_tokens(text: Column) -> Column:
    """Words between blanks."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic(text: Column) -> Column:
    """What a text is about, as far as its form tells: the first rule that holds."""
    return (
        F.when(text.isNull(), F.lit("none"))
        .when(text.rlike(r"(?i)licen[sc]e|copyright"), F.lit("legal"))
        .when(text.contains(" | "), F.lit("table"))
        .when(text.rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]{1,3} ?\("), F.lit("contact"))
        .when(text.rlike(r"[#$%&*]{3}|!!"), F.lit("noise"))
        .when(F.length(text) < 1000, F.lit("note"))
        .otherwise(F.lit("prose"))
    )


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with its cell (null as a name of its own) and tokens."""
    text = F.col("text").cast("string")
    axis = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    docs = docs.drop(*[c for c in ADDED if c != "topic"])
    about = F.col("topic") if "topic" in docs.columns else topic(text)
    return docs.withColumns({"__source": axis(F.col("source")), "__lang": axis(F.col("lang")), "__topic": axis(about), "n_tokens": n_tokens(text)})


def tempered(shares: dict[str, float], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Targets that even out the shares: each to the power of ``temperature``."""
    total = sum(v**temperature for v in shares.values() if v > 0)
    return {k: v**temperature / total if v > 0 else 0.0 for k, v in shares.items()}


def rake(cells: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Factors that bring the cells' marginals (shares) to the targets; ``codes`` (axes, cells)."""
    mass = cells / max(cells.sum(), 1e-300)
    factor = np.ones(len(cells))
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, mass * factor, len(target))
            step = np.divide(target, now, out=np.zeros(len(target)), where=now > 0)
            factor *= step[code]
            worst = max(worst, float(np.abs(now - target).max()))
        if worst < TOLERANCE:
            break
    return factor


def rate(factor: np.ndarray, tokens: np.ndarray, wanted: float) -> float:
    """The rate at which min(1, rate x factor) keeps ``wanted`` tokens; infinite where none does."""
    reach = tokens[factor > 0].sum()
    if wanted >= reach:
        return float("inf")
    order = np.argsort(-factor)
    f, t = factor[order], tokens[order].astype(float)
    full = np.cumsum(t) - t  # kept whole: those with a greater factor
    part = np.cumsum((f * t)[::-1])[::-1]
    for i in range(len(f)):
        r = (wanted - full[i]) / part[i] if part[i] > 0 else float("inf")
        if r * f[i] <= 1 + 1e-12:
            return float(max(r, 0.0))
    return float("inf")


def reachable(target: np.ndarray, has: np.ndarray, share: float) -> np.ndarray:
    """Parts of the corpus that categories with masses ``has`` can give, in proportion to ``target`` up to all they have."""
    want = np.divide(target, has, out=np.zeros(len(has)), where=has > 0)
    r = rate(want, has, share)
    return np.where(want > 0, has * np.minimum(1.0, r * np.maximum(want, 1e-300)), 0.0)


def rake_capped(cells: np.ndarray, codes: np.ndarray, goals: list[np.ndarray], weight: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of which min(1, weight) brings the cells' marginals (parts of the corpus) to the goals."""
    mass = cells / max(cells.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, mass * np.minimum(1.0, weight), len(goal))
            step = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            weight = np.minimum(weight * step[code], WEIGHT_MOST)
            worst = max(worst, float(np.abs(now - goal).max()))
        if worst < TOLERANCE:
            break
    return weight


def _targets(names: list[str], own: dict[str, float] | None, shares: dict[str, float], temperature: float) -> np.ndarray:
    wanted = {("null" if k is None else f"={k}"): v for k, v in own.items()} if own else tempered(shares, temperature)
    out = np.array([max(0.0, wanted.get(n, 0.0)) for n in names])
    return out / out.sum() if out.sum() > 0 else out


def cell_table(described_docs: DataFrame) -> DataFrame:
    keys = [f"__{a}" for a in AXES]
    return described_docs.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))


def _raked_here(cells: DataFrame, targets: dict, share: float, temperature: float, rounds: int = ROUNDS) -> DataFrame:
    rows = cells.orderBy(*[f"__{a}" for a in AXES]).collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    codes, wanted = [], []
    for axis in AXES:
        names = sorted({r[f"__{axis}"] for r in rows})
        at = {n: i for i, n in enumerate(names)}
        code = np.array([at[r[f"__{axis}"]] for r in rows], int)
        sums = np.bincount(code, tokens, len(names))
        codes.append(code)
        wanted.append(_targets(names, targets.get(axis), dict(zip(names, sums.tolist(), strict=True)), temperature))
    factor = rake(tokens, np.array(codes), wanted, rounds) if rows else np.zeros(0)
    p = np.zeros(len(rows))
    if rows and tokens.sum() > 0:
        has = tokens / tokens.sum()
        goals = [reachable(t, np.bincount(c, has, len(t)), share) for c, t in zip(codes, wanted, strict=True)]
        first = min(rate(factor, tokens, share * tokens.sum()), WEIGHT_MOST)
        w = rake_capped(tokens, np.array(codes), goals, np.minimum(first * factor, WEIGHT_MOST), rounds)
        r = min(rate(w, tokens, share * tokens.sum()), 1e300)
        p = np.where(w > 0, np.minimum(1.0, r * np.maximum(w, 1e-300)), 0.0)
    elif rows:
        p = np.where(factor > 0, 1.0, 0.0)
    out = [(*[x[f"__{a}"] for a in AXES], float(f), float(q)) for x, f, q in zip(rows, factor, p, strict=True)]
    return cells.sparkSession.createDataFrame(out, "__source string, __lang string, __topic string, weight double, probability double")


def _raked_apart(cells: DataFrame, targets: dict, share: float, temperature: float, rounds: int = ROUNDS) -> DataFrame:
    """The same by joins; each axis's marginal and targets are tables."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = storage.staged(cells.withColumn("weight", F.lit(1.0)), "cells")
    wanted = {}
    for axis in AXES:
        sums = cells.groupBy(f"__{axis}").agg(F.sum("tokens").cast("double").alias("s"))
        own = targets.get(axis)
        if own:
            named = cells.sparkSession.createDataFrame([("null" if k is None else f"={k}", max(0.0, float(v))) for k, v in own.items()], f"__{axis} string, t double")
            raw = sums.join(named, f"__{axis}").select(f"__{axis}", "t")
        else:
            raw = sums.select(f"__{axis}", F.when(F.col("s") > 0, F.pow("s", F.lit(temperature))).otherwise(0.0).alias("t"))
        whole = raw.agg(F.sum("t")).first()[0] or 0.0
        wanted[axis] = storage.staged(raw.select(f"__{axis}", (F.col("t") / F.lit(whole or 1.0)).alias("target")), "targets")
    for _ in range(rounds):
        worst = 0.0
        for axis in AXES:
            sums = now.groupBy(f"__{axis}").agg((F.sum(F.col("tokens") * F.col("weight")) / F.lit(float(total or 1))).alias("now"))
            steps = storage.staged(sums.join(wanted[axis], f"__{axis}", "left").select(f"__{axis}", "now", F.coalesce("target", F.lit(0.0)).alias("target")), "steps")
            worst = max(worst, steps.agg(F.max(F.abs(F.col("now") - F.col("target")))).first()[0] or 0.0)
            step = steps.select(f"__{axis}", F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0).alias("step"))
            now = storage.staged(now.join(step, f"__{axis}").withColumn("weight", F.col("weight") * F.col("step")).drop("step"), "cells")
        if worst < TOLERANCE:
            break
    first = min(_rate_apart(now, "tokens", "weight", share * total), WEIGHT_MOST)
    now = now.withColumn("w", F.least(F.lit(first) * F.col("weight"), F.lit(WEIGHT_MOST)))
    goals = {}
    for axis in AXES if total else ():
        has = cells.groupBy(f"__{axis}").agg((F.sum("tokens") / F.lit(float(total))).alias("has")).join(wanted[axis], f"__{axis}", "left")
        has = storage.staged(has.withColumn("weight", F.when(F.col("has") > 0, F.coalesce("target", F.lit(0.0)) / F.col("has")).otherwise(0.0)), "goals")
        r = min(_rate_apart(has, "has", "weight", share), 1e300)
        goals[axis] = has.select(f"__{axis}", F.when(F.col("weight") > 0, F.col("has") * F.least(F.lit(1.0), F.lit(r) * F.col("weight"))).otherwise(0.0).alias("goal"))
    for _ in range(rounds if total else 0):
        worst = 0.0
        for axis in AXES:
            sums = now.groupBy(f"__{axis}").agg((F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("w"))) / F.lit(float(total))).alias("now"))
            steps = storage.staged(sums.join(goals[axis], f"__{axis}"), "steps")
            worst = max(worst, steps.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
            step = steps.select(f"__{axis}", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("step"))
            now = storage.staged(now.join(step, f"__{axis}").withColumn("w", F.least(F.col("w") * F.col("step"), F.lit(WEIGHT_MOST))).drop("step"), "cells")
        if worst < TOLERANCE:
            break
    last = min(_rate_apart(now, "tokens", "w", share * total), 1e300)
    p = F.when(F.col("w") > 0, F.least(F.lit(1.0), F.lit(last) * F.col("w"))).otherwise(0.0)
    return now.select(*[f"__{a}" for a in AXES], "weight", p.alias("probability"))


def _rate_apart(df: DataFrame, mass: str, weight: str, wish: float) -> float:
    """``rate`` over a table on disk: Newton's steps from below, exact on a concave broken line."""
    r = 0.0
    for _ in range(100):
        over = F.lit(r) * F.col(weight) >= 1
        row = df.where(F.col(weight) > 0).agg(F.sum(F.when(over, F.col(mass)).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col(mass) * F.col(weight)))).first()
        full, part = row[0] or 0.0, row[1] or 0.0
        if part <= 0:
            return float("inf") if full <= wish else r
        to = (wish - full) / part
        if to <= r * (1 + 1e-14):
            return max(r, 0.0)
        r = to
    return r


def marginals(mixed: DataFrame, targets: dict[str, dict] | None = None, temperature: float = TEMPERATURE, share: float = SHARE) -> DataFrame:
    """axis, category, target, reachable, expected: shares of the kept tokens wished, possible by axis, and met by ``mix``."""
    out = []
    for axis in AXES:
        rows = mixed.groupBy(axis).agg(F.sum("n_tokens").cast("double").alias("t"), F.sum(F.col("n_tokens") * F.col("probability")).alias("k")).collect()
        names = ["null" if r[axis] is None else f"={r[axis]}" for r in rows]
        has, kept = (np.array([r[c] for r in rows]) for c in ("t", "k"))
        wish = _targets(names, (targets or {}).get(axis), dict(zip(names, has.tolist(), strict=True)), temperature)
        goal = reachable(wish, has / max(has.sum(), 1e-300), share) if rows else wish
        out += [(axis, r[axis], float(w), float(g / (goal.sum() or 1)), float(k / (kept.sum() or 1))) for r, w, g, k in zip(rows, wish, goal, kept, strict=True)]
    return mixed.sparkSession.createDataFrame(out, "axis string, category string, target double, reachable double, expected double")


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, share: float = SHARE, temperature: float = TEMPERATURE, seed: int = 11, cells_most: int = CELLS_MOST, rounds: int = ROUNDS, drop_text: bool = False) -> DataFrame:
    """``docs`` with n_tokens, topic, weight, probability and kept.

    ``targets``: for an axis, the wished share of each category; other axes get their own shares
    evened out by ``temperature``.  With ``drop_text`` the texts are not returned, and only read once.
    """
    # uniform in [0, 1): 53 bits of a keyed hash
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))), 11) / F.lit(float(1 << 53))
    full = described(docs).withColumn("__draw", drawn)
    if drop_text:  # what is left is narrow, so texts are read and described once
        full = storage.staged(full.drop("text"), "described")
    cells = storage.staged(cell_table(full), "cells")
    small = cells.count() <= cells_most
    raked = (_raked_here if small else _raked_apart)(cells, targets or {}, share, temperature, rounds)
    keys = [f"__{a}" for a in AXES]
    joined = full.join(F.broadcast(raked) if small else raked, keys)
    out = joined.withColumn("kept", F.col("__draw") < F.col("probability")).withColumn("topic", F.when(F.col("__topic") != "null", F.substring("__topic", 2, 1 << 30)))
    rest = [c for c in docs.columns if c not in ADDED and not (drop_text and c == "text")]
    return out.select(*rest, "topic", "n_tokens", "weight", "probability", "kept")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept for every row."""
    return mix(docs.select("doc_id", "text", "lang", "source"), drop_text=True).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")
