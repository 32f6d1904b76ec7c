"""Version-time pipeline of rollout samples, and event-time windows, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillmark.operators.quantiles import quantiles


def samples(spark: SparkSession, path: str, schema: str, per_trigger: int = 8) -> DataFrame:
    """A stream of sample files; ``per_trigger`` is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def bounded_queue(stream: DataFrame, capacity: int) -> DataFrame:
    """Per queue: what a queue of ``capacity`` that drops its oldest keeps, and its counts.

    Rows (queue, seq, version).  State: the newest ``capacity`` seqs, so it is bounded.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, produced = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for part in parts:
            seqs = sorted(part["seq"].tolist())
            produced += len(seqs)
            kept = sorted(kept + seqs)[-capacity:]
        state.update((kept, produced))
        yield pd.DataFrame({"queue": [key[0]], "produced": [produced], "held": [len(kept)], "dropped": [produced - len(kept)], "oldest": [kept[0]]})

    return stream.groupBy("queue").applyInPandasWithState(step, "queue string, produced long, held long, dropped long, oldest long", "kept array<bigint>, produced long", "update", GroupStateTimeout.NoTimeout)


def adaptive_coefficient(stream: DataFrame, start: float, target: float, horizon: int) -> DataFrame:
    """A running penalty per run: times 1 + clip(kl / target - 1, +-0.2) x n / horizon for each step.

    Rows (run, step, kl, n); steps of a batch are taken in order.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else start
        rows = pd.concat(list(parts)).sort_values("step")
        out = []
        for row in rows.itertuples():
            value *= 1 + min(max(row.kl / target - 1, -0.2), 0.2) * row.n / horizon
            out.append((key[0], row.step, value))
        state.update((value,))
        yield pd.DataFrame(out, columns=["run", "step", "coefficient"])

    return stream.groupBy("run").applyInPandasWithState(step, "run string, step long, coefficient double", "value double", "append", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """Events per type and window; windows close ``late`` after their end."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions per user: events no further apart than ``gap``."""
    windowed = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return windowed.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


@dataclass
class Staleness:
    """How many samples a producer may run ahead of the version that consumes them."""

    required: int
    threshold: float
    every: int
    most_queued: int

    @property
    def most(self) -> int:
        return int(self.required * (self.threshold + 1) * self.every)

    def pauses(self, queued: int, stale: int) -> bool:
        return queued >= self.most_queued or stale >= self.most


def version_spread(df: DataFrame) -> DataFrame:
    """Per batch: samples, distinct versions, share that span versions, processing-time quantiles."""
    q = quantiles(df, ["batch"], "seconds", [0.5, 0.95, 0.99]).select("batch", F.col("q").alias("seconds"))
    plain = df.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("version_end").alias("versions"), F.avg((F.col("version_start") != F.col("version_end")).cast("double")).alias("partial"))
    return plain.alias("a").join(q.alias("b"), F.col("a.batch").eqNullSafe(F.col("b.batch")), "left").select("a.*", "b.seconds")
