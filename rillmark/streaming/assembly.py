"""Assembly of training batches from finished samples: merge, version spread, quotas of groups, growth between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merged(samples: DataFrame, log_probs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with their log probabilities, an uid of their own, and the versions that they began and ended in."""
    both = samples.join(log_probs, key)
    return both.withColumns({"uid": F.concat(F.lit("uid_"), F.col(key).cast("string")), "version_start": F.array_min("versions"), "version_end": F.array_max("versions")})


def assembled(samples: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """Add ``batch``: samples in order of arrival, ``size`` a batch; the last may be short."""
    from rillmark.operators.batch import number_rows

    return number_rows(samples, order).withColumn("batch", F.floor(F.col("row_id") / size)).drop("row_id")


@dataclass
class Version:
    """The consumer's version: a bump counts what is still under way as stale anew and says whether to validate."""

    number: int = 0
    stale: int = 0
    every: int = 0
    idle: list[float] = field(default_factory=list)

    def bump(self, number: int, queued: int, active: int, idle_seconds: float, step_seconds: float) -> bool:
        if number < self.number:
            raise ValueError("versions only rise")
        self.number, self.stale = number, queued + active
        self.idle.append(idle_seconds / step_seconds if step_seconds > 0 else 0.0)
        return self.every > 0 and number % self.every == 0


def kept_groups(stream: DataFrame, quota: int) -> DataFrame:
    """Per run: steps of ``quota`` groups with varied scores, gathered over batches; a step ends when it has enough.

    Rows (run, uid, varied).  State: the groups of the step so far, fewer than ``quota``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for part in parts:
            for uid in sorted(part.loc[part["varied"], "uid"].tolist()):
                held.append(uid)
                if len(held) == quota:
                    out += [(key[0], done, u) for u in held]
                    held, done = [], done + 1
        state.update((held, done))
        yield pd.DataFrame(out, columns=["run", "step", "uid"])

    return stream.groupBy("run").applyInPandasWithState(step, "run string, step long, uid long", "held array<bigint>, done long", "append", GroupStateTimeout.NoTimeout)


def after_each_batch(stream: DataFrame, hook: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``hook`` (a generator that appends files, a curriculum that reweights) on every micro-batch, until the input is done."""
    return stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
