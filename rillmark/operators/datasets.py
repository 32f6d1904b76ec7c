"""Dataset-side operators: filters, eligibility, joins by position or key, splits, schema maps and evaluation rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.arrays import pad, truncate
from rillmark.operators.policy import drawn_number, top_rows


def fail(text: str, kind: str = "boolean") -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def word_count(text: Column) -> Column:
    """Blank-separated words; null for a null text."""
    return F.when(text.isNotNull(), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def within_length(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows of ``most`` tokens at most; a row whose tokens could not be counted (null) counts as too long."""
    return df.where(F.coalesce(tokens <= most, F.lit(False)))


def eligibility(df: DataFrame, tokens: Column, most: int, key: str) -> DataFrame:
    """key, tokens, reason of the rows that do not fit the context."""
    n = F.coalesce(tokens, F.lit(-1))
    reason = F.when(tokens.isNull(), "unreadable").otherwise("too long")
    return df.select(key, n.alias("tokens"), reason.alias("reason")).where((F.col("tokens") < 0) | (F.col("tokens") > most))


def checked_exclusions(report: DataFrame, expected: DataFrame, key: str, most: int) -> DataFrame:
    """``report``, an error where it excludes more than ``most`` rows or others than ``expected`` names."""
    wrong = report.select(key).exceptAll(expected.select(key)).unionByName(expected.select(key).exceptAll(report.select(key)))
    if not wrong.isEmpty():
        raise ValueError("the excluded rows are not the expected ones")
    if report.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are excluded")
    return report


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not excluded."""
    return df.join(excluded.select(key), key, "left_anti")


def dated(df: DataFrame, at: Column, first: str | None, last: str | None, platform: Column | None = None, name: str | None = None) -> DataFrame:
    """Rows between two days, both included as midnights, so what happens later on the last day is out; and of one platform."""
    out = df if first is None else df.where(at >= F.lit(first).cast("timestamp_ntz"))
    out = out if last is None else out.where(at <= F.lit(last).cast("timestamp_ntz"))
    return out if platform is None or name is None else out.where(platform == name)


def by_teacher(kind: Column, **columns: Column) -> Column:
    """The column of the row's teacher; ``other`` where its kind is none of the named."""
    out = None
    for name, value in columns.items():
        if name != "other":
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise(columns["other"])


def profiled_tasks(df: DataFrame, task: str, cost: str, profiles: int, least_cost: float, variation_most: float) -> DataFrame:
    """task, n, mean, cv of tasks with enough profiles, none of them null, dear enough, and steady: the coefficient of variation in percent."""
    c = F.col(cost)
    one = df.groupBy(task).agg(F.count("*").alias("n"), F.count(c).alias("known"), F.avg(c).alias("mean"), (F.lit(100.0) * F.stddev_pop(c) / F.avg(c)).alias("cv"))
    return one.where((F.col("n") >= profiles) & (F.col("known") == F.col("n")) & (F.col("mean") >= least_cost) & (F.col("cv") <= variation_most)).drop("known")


def viewed(df: DataFrame, score: Column, text: Column, needle: str | None = None, offset: int = 0, count: int = 20, descending: bool = True, key: str = "sample") -> DataFrame:
    """A page of rows by score (0 where there is none), those whose text holds the needle."""
    own = F.coalesce(score, F.lit(0.0))
    out = df if not needle else df.where(F.contains(text, F.lit(needle)))
    return out.orderBy(own.desc() if descending else own.asc(), key).offset(offset).limit(count)


def masked_text(text: Column, needle: str, by: str = "**") -> Column:
    """Every match of the needle, whatever its case, between marks."""
    return F.regexp_replace(text, f"(?i)({re.escape(needle)})", f"{re.escape(by)}$1{re.escape(by)}")


def split(df: DataFrame, key: str, share: float) -> DataFrame:
    """Add ``part``: train or validation; the share's rows, to the row, are drawn by a hash of the key."""
    n = df.count()
    drawn = top_rows(df.withColumn("__draw", drawn_number(key)), "__draw", n - int(n * share), key)
    return drawn.withColumn("part", F.when(F.col("chosen"), "train").otherwise("validation")).drop("chosen", "__draw")


def guarded_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; reading a row whose key another row has is an error."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit("repeated index "), F.col(key).cast("string"))).cast(df.schema[key].dataType)).otherwise(F.col(key)))


def with_budgets(df: DataFrame, budgets: DataFrame, row: str, parsed: Column, fallback: int) -> DataFrame:
    """``df`` with ``budget``: its row's record, else what its text says, else the fallback; ``budget_source`` says which."""
    known = guarded_unique(budgets.select(row, F.col("budget").alias("__budget")), row)
    out = df.join(known, row, "left")
    source = F.when(F.col("__budget").isNotNull(), "record").when(parsed.isNotNull(), "text").otherwise("fallback")
    return out.withColumns({"budget": F.coalesce("__budget", parsed, F.lit(fallback)), "budget_source": source}).drop("__budget")


def staged_rows(eligible: DataFrame, source: DataFrame, row: str, prompt: str) -> DataFrame:
    """Eligible rows with their source's columns; an error where the two prompts of a row differ or a column clashes."""
    clash = (set(eligible.columns) & set(source.columns)) - {row, prompt}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    out = eligible.join(source.withColumnRenamed(prompt, "__prompt"), row)
    same = F.col(prompt).eqNullSafe(F.col("__prompt"))
    return out.withColumn(prompt, F.when(same, F.col(prompt)).otherwise(fail("the prompts of a row differ", "string"))).drop("__prompt")


def stage_of(place: Column, ends: dict[str, int]) -> Column:
    """The stage whose range of places a place falls in; null beyond the last. ``ends`` are in ascending order."""
    out = None
    for name, end in ends.items():
        out = F.when(place < end, name) if out is None else out.when(place < end, name)
    return out


def clean_scan(df: DataFrame, order: str, clean: Column, wanted: int) -> DataFrame:
    """The first ``wanted`` clean rows in a drawn order, and ``rejected``: how many others come before the last of them."""
    kept = top_rows(df.where(clean).withColumn("__draw", F.lit(0.0) - drawn_number(order)), "__draw", wanted, order).where("chosen").drop("chosen")
    last = kept.agg(F.min("__draw").alias("__last"))
    before = df.where(~clean).withColumn("__draw", F.lit(0.0) - drawn_number(order)).crossJoin(F.broadcast(last)).where("__draw >= __last").agg(F.count("*").alias("rejected"))  # one row
    return kept.drop("__draw").crossJoin(F.broadcast(before))


def complete_keys(df: DataFrame, group: str, slot: str, slots: int) -> DataFrame:
    """group, problem of groups whose slots are not each of 0 to slots - 1 once."""
    one = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(slot).alias("d"), F.min(slot).alias("a"), F.max(slot).alias("b"))
    out_of_range = (F.col("a") < 0) | (F.col("b") >= slots)
    problem = F.when(out_of_range, "out of range").when(F.col("d") < F.col("n"), "repeated").when(F.col("d") < slots, "missing")
    return one.select(group, problem.alias("problem")).where("problem IS NOT NULL")


def vectors_of(selection: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The selection with its vectors; an error where one has none."""
    v = F.col("__vector")
    out = selection.join(vectors.select(key, F.col("vector").alias("__vector")), key, "left")
    return out.withColumn("vector", F.when(v.isNull(), F.raise_error(F.lit("a selected row has no vector")).cast(vectors.schema["vector"].dataType)).otherwise(v)).drop("__vector")


def large_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups of ``least`` rows or more."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return df.join(sizes.select(group), group, "left_semi")


def response_part(mask: Column, n: Column) -> Column:
    """The last n places."""
    return F.slice(mask, F.greatest(F.size(mask) - n + 1, F.lit(1)), n)


def unpadded(ids: Column, mask: Column) -> Column:
    """The ids that the mask keeps."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("x"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["x"])


def prompt_masked(length: Column, prompt: Column) -> Column:
    """A loss mask of ``length`` places: 0 for the first prompt - 1 and the last one, else 1."""
    return F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: F.when((i < prompt) | (i == length), 0).otherwise(1))


def fixed_length(values: Column, n: int, fill: Column) -> Column:
    """Cut at the right or filled up to ``n``."""
    return pad(truncate(values, n), n, fill)


def masked_mean_vector(vectors: Column, mask: Column) -> Column:
    """The mean of the kept token vectors, over its Euclidean length; an error where none is kept or it has no direction."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])
    summed = F.aggregate(F.slice(kept, 2, 1 << 30), F.element_at(kept, 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    norm = F.sqrt(F.aggregate(summed, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((F.size(kept) == 0) | ~(norm > 0), F.raise_error(F.lit("nothing to pool")).cast("array<double>")).otherwise(F.transform(summed, lambda x: x / norm))


def vector_problems(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """key, problem of rows whose key repeats or whose vector is null, of another length, not finite, or zero."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(F.count("*").over(Window.partitionBy(key)) > 1, "repeated").when(v.isNull(), "missing").when(F.size(v) != dimensions, "length").when(odd, "not finite").when(~F.exists(v, lambda x: x != 0), "zero")
    return df.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def key_digest(*fields: Column) -> Column:
    """SHA-256 of tab-joined fields."""
    return F.sha2(F.concat_ws("\t", *[f.cast("string") for f in fields]), 256)


def prompt_row(source: str, ability: str, prompt: Column, truth: Column, index: Column, split_: str) -> list[Column]:
    """The canonical row: data_source, prompt messages, ability, reward_model, extra_info."""
    return [
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split_).alias("split"), index.alias("index")).alias("extra_info"),
    ]


def collapsed(df: DataFrame, kept: list[str], system: str) -> DataFrame:
    """Named columns, everything else in the map ``extra_info``, and a system message before the prompt."""
    rest = [c for c in df.columns if c not in kept]
    extra = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))])
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return df.select(*[F.concat(first, F.col(c)).alias(c) if c == "prompt" else F.col(c) for c in kept], extra.alias("extra_info"))


def shuffled_choices(key: Column, choices: Column, right: int = 0) -> Column:
    """struct(choices, letter): the choices in an order drawn by the key, and the letter of the one that was at ``right``."""
    tagged = F.transform(choices, lambda c, i: F.struct(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))).alias("d"), i.alias("i"), c.alias("c")))
    order = F.array_sort(tagged)
    place = F.array_position(F.transform(order, lambda x: x["i"]), F.lit(right))
    return F.struct(F.transform(order, lambda x: x["c"]).alias("choices"), F.substring(F.lit("ABCDEFGHIJ"), place.cast("int"), 1).alias("letter"))


def response_rows(df: DataFrame, key: str, lengths: str, accuracies: str) -> DataFrame:
    """A row a response: key, response, length (NaN where missing), acc (0 where missing)."""
    n = F.greatest(F.size(lengths), F.size(accuracies))
    rows = df.select(key, lengths, accuracies, F.explode(F.sequence(F.lit(0), n - 1)).alias("response")).where(n > 0)
    return rows.select(key, "response", F.coalesce(F.get(lengths, F.col("response")).cast("double"), F.lit(float("nan"))).alias("length"), F.coalesce(F.get(accuracies, F.col("response")).cast("double"), F.lit(0.0)).alias("acc"))


def graded_rows(df: DataFrame, key: str, order: str, passed: str) -> DataFrame:
    """key, graded (flags in order), pass_at_1 of each problem."""
    one = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, passed))).alias("g"), F.avg(F.col(passed).cast("double")).alias("pass_at_1"))
    return one.select(key, F.transform("g", lambda x: x[passed]).alias("graded"), "pass_at_1")


def profile_summary(df: DataFrame, model: str, task: str, score: str) -> DataFrame:
    """model, tasks, mean and the win share against every other model on the tasks that both have."""
    mine = df.groupBy(model, task).agg(F.avg(score).alias("s"))
    pairs = mine.alias("a").join(mine.alias("b"), task).where(F.col(f"a.{model}") != F.col(f"b.{model}"))
    wins = pairs.groupBy(F.col(f"a.{model}").alias(model)).agg(F.avg((F.col("a.s") > F.col("b.s")).cast("double")).alias("win_share"))
    return mine.groupBy(model).agg(F.count("*").alias("tasks"), F.avg("s").alias("mean")).join(wins, model, "left")


def against_null(selected: float, null: DataFrame, value: str) -> DataFrame:
    """mean, std, z and the inclusive percentile of a selected value among drawn ones."""
    v = F.col(value)
    return null.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), ((F.lit(selected) - F.avg(v)) / F.stddev_samp(v)).alias("z"), F.avg((v <= F.lit(selected)).cast("double")).alias("percentile"))
