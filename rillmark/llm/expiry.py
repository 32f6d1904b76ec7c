"""Deduplication of clicks by windows that expire, as a stateful stream.

A click's first copy opens a window; copies whose hour is at most ``SPAN`` hours after its start
are repeats, a later one closes it and opens the next.  Copies that come more than ``LATE`` hours
after the greatest hour seen in earlier batches are dropped (the watermark), and windows that no copy
in time can reach any more are closed by event-time timers.  The stream is started anew for every
batch on one checkpoint, with its state in RocksDB, and a sentinel row of a far later hour, which
opens nothing, lets the watermark pass every window in the last batch.

A run visits each state store once: it takes its copies under the watermark that earlier batches
left, and first closes what that watermark ends, as windows of the batch that raised it.  (A second
pass without rows, to close them at once, would load and commit every store again.)  Only the last
run has such a pass, after its sentinel.  No run finds the stores of the one before, so a store is
closed when its task ends; what is open at once is one store a running task, however many there are.

State is kept per click_id, for a group of some thousand ids at once: one ``ValueState`` a group
holds for each open window its opener (start, hash), the counters and the crc sum, packed in one
row of bytes.  (One state a click_id was measured first: each call for a key costs 3 ms of CPU,
whatever it holds.)  The number of groups follows the number of rows, so a group stays small.  Each group has one timer at most, for the window that ends first.

Equal copies (batch, click, hour, hash) become one row with a count before they are shuffled to
their group, so a click that is sent over and over costs no more than its different copies.

Defined cases: rows without click_id or arrived_at have no copies; negative ids have as many
copies as their non-negative remainder says; null fields are empty in the hash; a value that is
no number counts as 0 there, and infinite ones as the greatest or least long; repeated rows are
copies each; an empty table gives no rows; columns not named here are not read, and none of the
table's is touched; timestamps without a zone are taken as UTC.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

from rillmark.llm import storage

BATCHES, SPAN, LATE = 10, 48, 24
#: Rows of the table in a group of click ids, about.
GROUP_ROWS = 16_384
#: Groups in a task of the stream, about: a store of its own costs every task of every batch some tenths of a second.
GROUPS_A_TASK = 16
HOUR_MS = 3_600_000
#: Event time begins here, so that the first hour lies well after the watermark's own beginning.
FIRST_HOUR = 1_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WINDOW = np.dtype([("click", "<i8"), ("start", "<i8"), ("repeats", "<i8"), ("conflicts", "<i8"), ("crc", "<i8"), ("hash", "<u8", (4,))])
CLOSED = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
FED = "part int, click_id long, hour long, hash binary, crc long, n long"


# ---- copies in batches


def epoch_micros(moment: str, kind) -> Column:
    """Microseconds since 1970; a timestamp without a zone is one of UTC, whatever the session's zone."""
    if not isinstance(kind, TimestampNTZType):
        return F.unix_micros(F.col(moment))
    since = f"(`{moment}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    units = (("DAY", 86_400_000_000), ("HOUR", 3_600_000_000), ("MINUTE", 60_000_000), ("SECOND", 1_000_000))
    return F.expr(" + ".join(f"CAST(extract({unit} FROM {since}) * {size}L AS BIGINT)" for unit, size in units))


def copies(clicks: DataFrame) -> DataFrame:
    """click_id, hour, later (the hour that orders batches), hash and all that it takes, a row a copy."""
    types = {f.name: f.dataType for f in clicks.schema.fields}
    micros = {c: epoch_micros(c, types[c]) for c in ("ts", "arrived_at")}
    rows = clicks.where("click_id IS NOT NULL AND arrived_at IS NOT NULL").select(
        F.col("click_id").cast("long").alias("click_id"),
        F.floor(micros["arrived_at"] / F.lit(HOUR_MS * 1000)).alias("arrived"),
        F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (F.col("client_id"), F.col("kind"), F.floor(F.lit(100) * F.col("value").cast("double") + F.lit(0.5)), micros["ts"], F.col("props"))]).alias("told"),
    )
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))).alias("j"))
    each = each.withColumn("c", F.crc32(F.concat(F.col("click_id").cast("string"), F.lit(":"), F.col("j").cast("string"))))
    each = each.withColumn("hour", F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10))
    return each.withColumn("later", F.col("hour") + F.floor(F.col("c") / 10) % 200)


def write_batches(clicks: DataFrame, root: str, batches: int = BATCHES, group_rows: int = GROUP_ROWS) -> tuple[int, int, int, list[int]] | None:
    """Write the copies below ``root`` as batch=0, batch=1, ... and the sentinel as the one after.

    Returns the first and the last hour, the number of groups and the batches that have copies, or
    None if there are no copies.
    """
    spark = clicks.sparkSession
    all_copies = copies(clicks)
    low, high, first, last, rows = all_copies.agg(F.min("later"), F.max("later"), F.min("hour"), F.max("hour"), F.sum((F.col("j") == 0).cast("long"))).first()
    if low is None:
        return None
    batch = F.floor((F.col("later") - F.lit(low)) * F.lit(batches) / F.lit(high - low + 1)).cast("int")
    groups = -(-rows // group_rows)
    part = F.pmod(F.xxhash64("click_id"), F.lit(groups)).cast("int")
    told = F.unhex(F.sha2(F.concat_ws("|", "told", F.col("c") % 3), 256))
    once = all_copies.select(batch.alias("batch"), part.alias("part"), "click_id", "hour", told.alias("hash")).groupBy("batch", "part", "click_id", "hour", "hash").agg(F.count("*").alias("n"))
    once = once.select("batch", "part", "click_id", "hour", "hash", F.crc32(F.lower(F.hex("hash"))).alias("crc"), "n")
    once.write.partitionBy("batch").parquet(root)
    full = sorted({int(re.search(r"/batch=(\d+)/", f)[1]) for f in spark.read.schema(f"{FED}, batch int").parquet(root).inputFiles()})
    end = spark.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("click_id"), F.lit(last + SPAN + LATE + 2).cast("long").alias("hour"), F.lit(b"").alias("hash"), F.lit(0).cast("long").alias("crc"), F.lit(0).cast("long").alias("n"))
    end.write.parquet(f"{root}/batch={batches}")
    return first, last, groups, full


# ---- the fold


def fold(held: np.ndarray, click: np.ndarray, hour: np.ndarray, digest: np.ndarray, crc: np.ndarray, n: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(open, closed) windows after the copies of one batch, for many clicks at once.

    ``held`` are the windows that are open, one a click; copies come in any order, each with the
    number ``n`` of its equals.  Every round takes the next window of all clicks that have copies left.
    """
    order = np.lexsort((*digest.T[::-1], hour, click))
    click, hour, digest, crc, n = click[order], hour[order], digest[order], crc[order], n[order]
    ids, at, sizes = np.unique(click, return_index=True, return_counts=True)
    end = at + sizes
    windows = np.zeros(len(ids), WINDOW)
    windows["click"] = ids
    has = np.zeros(len(ids), bool)
    held = held[np.argsort(held["click"], kind="stable")]
    place = np.searchsorted(held["click"], ids)
    found = place < len(held)
    found[found] = held["click"][place[found]] == ids[found]
    windows[found], has[found] = held[place[found]], True
    untouched = np.ones(len(held), bool)
    untouched[place[found]] = False
    # hours in order over all clicks: one search finds where a window's copies end
    wide = int(hour.max(initial=0) - hour.min(initial=0)) + span + 2
    base = int(hour.min(initial=0))
    rank = np.repeat(np.arange(len(ids)), sizes)
    line = rank * wide + (hour - base)
    total = np.concatenate([[0], np.cumsum(n)])
    closed = []
    live = np.arange(len(ids))
    while len(live):
        new = live[~has[live]]
        first = at[new]
        windows["start"][new], windows["hash"][new] = hour[first], digest[first]
        windows["repeats"][new], windows["conflicts"][new], windows["crc"][new] = -1, 0, 0  # the opener is no repeat
        has[new] = True
        reach = np.clip(windows["start"][live] + span - base, -1, wide - 2)
        stop = np.maximum(np.searchsorted(line, live * wide + reach, side="right"), at[live])
        windows["repeats"][live] += total[stop] - total[at[live]]
        size = stop - at[live]
        own = np.repeat(at[live] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        whose = np.repeat(live, size)
        other = (digest[own] != windows["hash"][whose]).any(axis=1)
        np.add.at(windows["conflicts"], whose[other], n[own[other]])
        np.add.at(windows["crc"], whose[other], n[own[other]] * crc[own[other]])
        at[live] = stop
        live = live[stop < end[live]]
        closed.append(windows[live].copy())
        has[live] = False
    return np.concatenate([held[untouched], windows]), np.concatenate([np.zeros(0, WINDOW), *closed])


class Expiry(StatefulProcessor):
    """Open windows of a group of clicks in batch number ``batch``; at hour ``base`` event time is ``FIRST_HOUR``.

    What the watermark ends when the run begins was closed after ``before``, the last batch with
    copies until then; only the sentinel brings it past ``last``, the greatest hour of all copies.
    """

    def __init__(self, batch: int, before: int, base: int, last: int, span: int = SPAN):
        self.batch, self.before, self.base, self.last, self.span = batch, before, base, last, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "timer long, open binary")

    def _at(self, hour):
        """Event time of an hour, or of an array of hours."""
        return (hour - self.base + FIRST_HOUR) * HOUR_MS

    def _ends(self, start):
        """When a window's timer goes off: as soon as the watermark is past its last hour."""
        return self._at(start + self.span + 1) - 1

    def _parted(self, windows: np.ndarray, watermark: int) -> tuple[np.ndarray, Iterator[pd.DataFrame]]:
        """The windows that the watermark leaves open, and the rows of the others."""
        over = self._ends(windows["start"]) <= watermark
        return windows[~over], self._told(windows[over], self.batch if watermark > self._at(self.last) else self.before)

    def _keep(self, windows: np.ndarray, timer: int | None) -> None:
        """Store the windows, and see to it that a timer goes off when the first of them ends."""
        if not len(windows):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.state.clear()
            return
        ends = self._ends(int(windows["start"].min()))
        if timer != ends:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.state.update((ends, windows.tobytes()))

    def _told(self, windows: np.ndarray, batch: int) -> Iterator[pd.DataFrame]:
        if len(windows):
            values = (windows["click"], windows["start"], batch, windows["repeats"], windows["conflicts"], windows["crc"], [h.tobytes() for h in windows["hash"].astype(">u8")])
            yield pd.DataFrame({c.split()[0]: v for c, v in zip(CLOSED.split(", "), values, strict=True)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if key[0] < 0:  # the sentinel
            return
        held, past = self.state.get(), timerValues.getCurrentWatermarkInMs()
        open_, over = self._parted(np.frombuffer(held[1], WINDOW) if held else np.zeros(0, WINDOW), past)
        column = lambda c: np.concatenate([p[c].to_numpy(np.int64) for p in parts])
        digest = np.frombuffer(b"".join(x for p in parts for x in p["hash"]), ">u8").astype("<u8").reshape(-1, 4)
        hour = column("hour")
        timely = self._at(hour) > past  # Spark itself drops what was late a batch ago
        now, closed = fold(open_, column("click_id")[timely], hour[timely], digest[timely], column("crc")[timely], column("n")[timely], self.span)
        self._keep(now, held[0] if held else None)
        yield from over
        yield from self._told(closed, self.batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if not held:
            return
        open_, over = self._parted(np.frombuffer(held[1], WINDOW), timerValues.getCurrentWatermarkInMs())
        self._keep(open_, None)  # this timer is gone by itself
        yield from over

    def close(self) -> None:
        pass


# ---- the stream


def windows(clicks: DataFrame, batches: int = BATCHES, span: int = SPAN, late: int = LATE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash of every window."""
    spark = clicks.sparkSession
    root = storage.new_path(spark, "clicks")
    written = write_batches(clicks, f"{root}/in", batches, group_rows)
    if not written:
        return spark.createDataFrame([], CLOSED).withColumn("hash", F.hex("hash"))
    base, last, groups, full = written
    session = spark.newSession()  # the settings of the stream are not the user's
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_A_TASK))
    settings = {"providerClass": ROCKS, "rocksdb.changelogCheckpointing.enabled": "true", "rocksdb.allowFAllocate": "false", "unloadOnCommit": "true"}
    for key, value in settings.items():
        session.conf.set(f"spark.sql.streaming.stateStore.{key}", value)
    session.conf.set("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false")  # twice the files, for a checkpoint that ends with the query
    session.conf.set("spark.sql.shuffle.partitions", str(parts))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    for batch in range(batches):
        session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(batch == batches - 1).lower())
        before = max((b for b in full if b < batch), default=batch)
        run_batch(session, root, Expiry(batch, before, base, last, span), batches, late)
    # the sink's own log says which files count
    return spark.read.schema(CLOSED).parquet(f"{root}/closed").withColumn("hash", F.lower(F.hex("hash")))


def run_batch(session: SparkSession, root: str, expiry: Expiry, batches: int, late: int) -> None:
    """Start the stream on its checkpoint and let it take one batch, after closing what the earlier ones end."""
    seen = [*range(expiry.batch + 1), *([batches] if expiry.batch == batches - 1 else [])]  # the last one brings the sentinel
    rows = session.readStream.schema(FED).parquet(f"{root}/in/batch={{{','.join(map(str, seen))}}}")
    moment = F.timestamp_millis((F.col("hour") - F.lit(expiry.base - FIRST_HOUR)) * F.lit(HOUR_MS))
    # a row exactly at the watermark would be late, so it stays a millisecond behind
    timed = rows.withColumn("at", moment).withWatermark("at", f"{late * HOUR_MS + 1} milliseconds")
    out = timed.groupBy("part").transformWithStateInPandas(expiry, CLOSED, "Append", "EventTime")
    query = out.writeStream.format("parquet").option("path", f"{root}/closed").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
