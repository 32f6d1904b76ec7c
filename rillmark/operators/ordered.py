"""Order-preserving matching of two sequences of keyed rows, as DataFrames.

Every filtered row is to be matched with an original row of its key so that positions rise with rows.
The earliest positions come from a greedy pass forwards, the latest from one backwards; where both
agree there is just one match.  A sequence of at most ``CHUNK`` rows on either side is walked whole, and
a task walks many, one after the other.  In longer ones, keys that stand once on both sides are anchors:
their pairs are given, and they cut both sequences into segments that are matched side by side.  A
segment is taken ``CHUNK`` rows of either side at a time, with its two places as state between the
rounds, so no task ever holds more of one, however long it is or how often a key repeats.

Defined cases: null keys equal each other, and so do null groups; a row whose key the originals lack
takes no part in the matching and says so; a sequence of which any other row finds no place has
no ordered match, and none of its rows has a position; an empty side gives no rows or no matches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rillmark.functions.text import provenance_answer
from rillmark.sources.staging import staged

CHUNK = 50_000
MATCHED, AMBIGUOUS, NO_PLACE, NO_KEY = "matched", "ambiguous ordered original match", "no ordered original match", "no original match"
STEP = "seq string, seg long, row long, position long, f long, o long"


def running_count(rows: DataFrame, flag: Column, order: Sequence[str], name: str) -> DataFrame:
    """Add how many flagged rows come before each in the given order, by range partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = staged(rows.withColumn("__flag", flag.cast("long")).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = parted.groupBy("__part").agg(F.sum("__flag").alias("__n"))
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row a partition
    inside = F.coalesce(F.sum("__flag").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__inside")).drop("__flag", "__part", "__at", "__start", "__inside")


def anchors(filtered: DataFrame, original: DataFrame) -> DataFrame:
    """(seq, row, position) of the keys that stand once on both sides, of the sequences in which they rise together."""
    once = lambda df, place: df.groupBy("seq", "key").agg(F.min(place).alias(place), F.count("*").alias("n")).where("n = 1").drop("n")
    both = staged(once(filtered, "row").join(once(original, "position").hint("merge"), ["seq", "key"]).drop("key"))
    ranked = running_count(running_count(both, F.lit(True), ["seq", "row"], "a"), F.lit(True), ["seq", "position"], "b")
    ranked = staged(ranked)
    crossed = ranked.where("a <> b").select("seq").distinct()
    return ranked.join(crossed.hint("merge"), "seq", "left_anti").select("seq", "row", "position")


def segmented(rows: DataFrame, fixed: DataFrame, place: str) -> DataFrame:
    """``rows`` but the anchors, with the number ``seg`` of anchors before them and their number ``at`` in their segment."""
    marked = rows.join(fixed.select("seq", place, F.lit(True).alias("fixed")).hint("merge"), ["seq", place], "left")
    counted = staged(running_count(marked, F.coalesce("fixed", F.lit(False)), ["seq", place], "seg").where("fixed IS NULL").drop("fixed"))
    numbered = staged(running_count(counted, F.lit(True), ["seq", "seg", place], "number"))
    first = numbered.groupBy("seq", "seg").agg(F.min("number").alias("first"), F.count("*").alias("size"))
    return staged(numbered.join(first.hint("merge"), ["seq", "seg"]).withColumn("at", F.col("number") - F.col("first")).drop("number", "first"))


def _step(filtered: pa.Table, original: pa.Table) -> pa.Table:
    """Match a chunk of a segment: rows of matches, and one without a row that tells how far both sides got."""
    f, o = filtered.sort_by("at"), original.sort_by("at")
    rows, wanted = f.column("row").to_pylist(), f.column("key").to_pylist()
    places, held = o.column("position").to_pylist(), o.column("key").to_pylist()
    i, at, found = 0, 0, []
    while i < len(rows) and at < len(places):
        if held[at] == wanted[i]:
            found.append((rows[i], places[at]))
            i += 1
        at += 1
    some = f if f.num_rows else o
    if not some.num_rows:
        return pa.table({c.split()[0]: pa.array([], pa.string() if "string" in c else pa.int64()) for c in STEP.split(", ")})
    n = len(found) + 1
    seq, seg = some.column("seq")[0].as_py(), some.column("seg")[0].as_py()
    return pa.table({"seq": [seq] * n, "seg": [seg] * n, "row": pa.array([r for r, _ in found] + [None], pa.int64()), "position": pa.array([p for _, p in found] + [None], pa.int64()), "f": pa.array([None] * len(found) + [i], pa.int64()), "o": pa.array([None] * len(found) + [at], pa.int64())})


def greedy(filtered: DataFrame, original: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(seq, row, position) by the greedy pass in order of ``at``; rows that find no place are left out."""
    sizes = filtered.groupBy("seq", "seg").agg(F.max("size").alias("nf")).join(original.groupBy("seq", "seg").agg(F.max("size").alias("no")).hint("merge"), ["seq", "seg"])
    state = staged(sizes.withColumn("pf", F.lit(0).cast("long")).withColumn("po", F.lit(0).cast("long")))
    done = None
    while not state.isEmpty():
        part = lambda df, p: df.join(state.hint("merge"), ["seq", "seg"]).where((F.col("at") >= F.col(p)) & (F.col("at") < F.col(p) + chunk)).select(*df.columns).groupBy("seq", "seg")  # noqa: E731, B023
        step = staged(part(filtered, "pf").cogroup(part(original, "po")).applyInArrow(_step, STEP))
        found = step.where("row IS NOT NULL").select("seq", "row", "position")
        done = found if done is None else done.unionByName(found)
        moved = state.join(step.where("row IS NULL").select("seq", "seg", "f", "o").hint("merge"), ["seq", "seg"])
        state = staged(moved.select("seq", "seg", "nf", "no", (F.col("pf") + F.col("f")).alias("pf"), (F.col("po") + F.col("o")).alias("po")).where("pf < nf AND po < no"))
    return done if done is not None else filtered.select("seq", "row", F.lit(None).cast("long").alias("position")).limit(0)


def _walk(held: list[int], wanted: list[int]) -> list[int] | None:
    """The earliest place in ``held`` of each of ``wanted``, in rising order; None where one finds no place."""
    found, at = [], 0
    for key in wanted:
        try:
            at = held.index(key, at) + 1
        except ValueError:
            return None
        found.append(at - 1)
    return found


def _outcomes(rows: pa.Table) -> pa.Table:
    """All filtered rows of ``rows`` with their matches; sequences are whole and sorted by seq, side, place."""
    seq = rows.column("seq").combine_chunks()
    starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(seq[1:], seq[:-1]).to_numpy(zero_copy_only=False)) + 1, [len(seq)]]).tolist()
    side, place = rows.column("side").to_numpy(), rows.column("place").to_numpy()
    keys = rows.column("key").combine_chunks().dictionary_encode().indices.to_pylist()
    originals = np.concatenate([[0], np.cumsum(side == 0)]).tolist()
    ends, outcome = np.full((2, len(seq)), -1), np.zeros(len(seq), np.int8)
    for start, end in zip(starts[:-1], starts[1:], strict=True):
        middle = start + originals[end] - originals[start]
        held = keys[start:middle]
        known = set(held)
        mine = [i for i in range(middle, end) if keys[i] in known]
        wanted = [keys[i] for i in mine]
        first = _walk(held, wanted)
        if first is None:
            outcome[mine] = 1
        elif mine:
            last = [len(held) - 1 - k for k in _walk(held[::-1], wanted[::-1])][::-1]
            ends[:, mine] = np.array([first, last]) + start
            outcome[mine] = np.where(np.equal(first, last), 3, 2)
    mine = np.flatnonzero(side == 1)
    at = lambda of: pa.array(place[of[mine]], mask=of[mine] < 0)
    told = pa.array([NO_KEY, NO_PLACE, AMBIGUOUS, MATCHED]).take(pa.array(outcome[mine]))
    taken = rows.take(pa.array(mine))
    by = [c for c in rows.column_names if c.startswith("by")]
    return pa.table({**{c: taken.column(c) for c in by}, "row": taken.column("place"), "earliest": at(ends[0]), "latest": at(ends[1]), "outcome": told})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_outcomes`` of rows in order, whose sequences may go on from batch to batch; the last one waits."""
    waits = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([waits, rows]) if waits is not None else rows
        seq = rows.column("seq")
        ready = pc.index(seq, seq[-1]).as_py()
        if ready:
            yield from _outcomes(rows.slice(0, ready)).combine_chunks().to_batches()
        waits = rows.slice(ready)
    if waits is not None:
        yield from _outcomes(waits).combine_chunks().to_batches()


def walked(filtered: DataFrame, original: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, row, earliest, latest, outcome of sequences that a task can hold: each is walked whole, many in a task."""
    kinds = [filtered.schema[c].dataType for c in by]
    named = [f"by{i}" for i in range(len(by))]
    f = filtered.select("seq", F.lit(1).alias("side"), F.col("row").alias("place"), "key", *[F.col(c).alias(n) for c, n in zip(by, named, strict=True)])
    o = original.select("seq", F.lit(0).alias("side"), F.col("position").alias("place"), "key", *[F.lit(None).cast(k).alias(n) for k, n in zip(kinds, named, strict=True)])
    schema = StructType([*[StructField(n, k) for n, k in zip(named, kinds, strict=True)], *[StructField(c, LongType()) for c in ("row", "earliest", "latest")], StructField("outcome", StringType())])
    done = f.unionByName(o).repartition("seq").sortWithinPartitions("seq", "side", "place").mapInArrow(_whole, schema)
    return done.select(*[F.col(n).alias(c) for c, n in zip(by, named, strict=True)], "row", "earliest", "latest", "outcome")


def ordered_matches(filtered: DataFrame, original: DataFrame, keys: Sequence[str], by: Sequence[str] = (), row: str = "row", position: str = "position", chunk: int = CHUNK) -> DataFrame:
    """by, row, earliest, latest, outcome of every filtered row; rows and positions are unique whole numbers within a sequence.

    ``by`` names the columns of a sequence, ``keys`` those that a row and its original share.
    """
    text = lambda columns: F.to_json(F.array(*[F.col(c).cast("string") for c in columns])) if columns else F.lit("")
    side = lambda df, place, name: df.select(*by, text(by).alias("seq"), text(keys).alias("key"), F.col(place).cast("long").alias(name))
    all_f, o = staged(side(filtered, row, "row")), staged(side(original, position, "position").drop(*by))
    sizes = all_f.select("seq", F.lit(1).alias("f")).unionByName(o.select("seq", F.lit(0).alias("f"))).groupBy("seq").agg(F.sum("f").alias("f"), F.sum(1 - F.col("f")).alias("o"))
    long = staged(sizes.where(F.greatest("f", "o") > chunk).select("seq"))
    if long.isEmpty():
        out = walked(all_f, o, by)
    else:  # one in ``chunk`` rows at most
        those = lambda df, how: df.join(F.broadcast(long), "seq", how).select(*df.columns)
        out = walked(those(all_f, "left_anti"), those(o, "left_anti"), by).unionByName(in_segments(those(all_f, "left_semi"), those(o, "left_semi"), by, chunk))
    return out.select(*by, F.col("row").alias(row), "earliest", "latest", "outcome")


def in_segments(all_f: DataFrame, o: DataFrame, by: Sequence[str], chunk: int) -> DataFrame:
    """by, row, earliest, latest, outcome of sequences of any length, cut at their anchors and taken in chunks."""
    known = o.select("seq", "key").distinct()
    f = staged(all_f.drop(*by).join(known.hint("merge"), ["seq", "key"], "left_semi"))
    fixed = staged(anchors(f, o))
    parts = segmented(f, fixed, "row"), segmented(o, fixed, "position")
    mirror = lambda df: df.withColumn("at", F.col("size") - 1 - F.col("at"))
    ends = [fixed.unionByName(greedy(*pair, chunk)) for pair in (parts, (mirror(parts[0]), mirror(parts[1])))]
    found = f.select("seq", "row").join(ends[0].withColumnRenamed("position", "earliest").hint("merge"), ["seq", "row"], "left").join(ends[1].withColumnRenamed("position", "latest").hint("merge"), ["seq", "row"], "left")
    found = staged(found)
    stuck = found.where("earliest IS NULL OR latest IS NULL").select("seq").distinct().withColumn("stuck", F.lit(True))
    out = all_f.join(found.withColumn("has_key", F.lit(True)).hint("merge"), ["seq", "row"], "left").join(stuck.hint("merge"), "seq", "left")
    outcome = F.when(F.col("has_key").isNull(), NO_KEY).when(F.col("stuck"), NO_PLACE).when(F.col("earliest") == F.col("latest"), MATCHED).otherwise(AMBIGUOUS)
    at = lambda c: F.when(F.col("stuck").isNull(), F.col(c)).alias(c)
    return out.select(*by, "row", at("earliest"), at("latest"), outcome.alias("outcome"))


def provenance(filtered: DataFrame, original: DataFrame) -> DataFrame:
    """Training rows joined to the rows they were filtered from, in order: id, prompt, completion, source_row_index, original_dataset_index, topic, difficulty.

    ``filtered``: row_id, question, answer; ``original``: row_id, question, final_answer, r1_solution_1,
    topic, difficulty.  Answers compare normalised.  Any row without its one original raises, and says why.
    """
    key = lambda df, answer: df.withColumn("answer_key", provenance_answer(F.col(answer)))
    f = key(filtered.withColumnRenamed("row_id", "row"), "answer")
    o = key(original.withColumnRenamed("row_id", "position"), "final_answer")
    complete = o.where(F.trim("final_answer") != "")
    matches = staged(ordered_matches(f, complete, ["question", "answer_key"]))
    wrong = matches.where(F.col("outcome") != MATCHED).orderBy("row").limit(1).join(f.select("row", "question", "answer"), "row").first()
    if wrong:
        reason = wrong["outcome"]
        if reason == NO_KEY:
            same = o.where(F.col("question").eqNullSafe(F.lit(wrong["question"])))
            reason = "no original question match" if same.isEmpty() else "answer mismatch" if not same.where(F.trim("final_answer") != "").isEmpty() else "missing or empty final_answer"
        raise ValueError(f"{reason} for filtered row {wrong['row']}")
    out = f.select("row", "question").join(matches.select("row", F.col("earliest").alias("position")).hint("merge"), "row").join(o.drop("question", "answer_key", "final_answer").hint("merge"), "position")
    empty = F.raise_error(F.concat(F.lit("empty r1_solution_1 for filtered row "), F.col("row").cast("string")))
    completion = F.when(F.trim("r1_solution_1") != "", F.col("r1_solution_1")).otherwise(empty)
    return out.select(F.format_string("deepmath-level6-%06d", "row").alias("id"), F.col("question").alias("prompt"), completion.alias("completion"), F.col("row").alias("source_row_index"), F.col("position").alias("original_dataset_index"), "topic", "difficulty")
