import hashlib
import math
import random
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest

from rillmark.llm import expiry, queries

SF = "/root/testdata/sf0.001"


def brute(rows, batches=10):
    """Windows by a plain loop; rows are (click_id, ts, arrived_at, client_id, kind, value, props), times in microseconds."""
    copies = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or arrived is None:
            continue
        for j in range(click % 3 + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = arrived // 3_600_000_000 + 6 * j * (c % 10)
            cents = "" if value is None else str(math.floor(100 * value + 0.5))
            told = "|".join(["" if client is None else str(client), kind or "", cents, "" if ts is None else str(ts), props or "", str(c % 3)])
            copies.append((hour + c // 10 % 200, click, hour, hashlib.sha256(told.encode()).hexdigest()))
    low, high = min(x[0] for x in copies), max(x[0] for x in copies)
    dealt = [[] for _ in range(batches)]
    for later, *rest in copies:
        dealt[(later - low) * batches // (high - low + 1)].append(tuple(rest))
    most, held, out = None, {}, []
    for b, batch in enumerate(dealt):
        for click, hour, digest in sorted(x for x in batch if most is None or x[1] >= most - 24):
            window = held.get(click)
            if window and hour <= window[0] + 48:
                window[2] += 1
                if digest != window[1]:
                    window[3] += 1
                    window[4] += zlib.crc32(digest.encode())
            else:
                if window:
                    out.append((click, window[0], b, *window[2:], window[1]))
                held[click] = [hour, digest, 0, 0, 0]
        most = max([x[1] for x in batch] + ([] if most is None else [most]))
        for click in [k for k, w in held.items() if b == batches - 1 or w[0] + 48 < most - 24]:
            window = held.pop(click)
            out.append((click, window[0], b, *window[2:], window[1]))
    return sorted(out)


def shown(df):
    return sorted(tuple(r[c] for c in ("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash")) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT click_id, epoch_us(ts), epoch_us(arrived_at), client_id, kind, value, props FROM '{SF}/clicks.parquet'").fetchall()
    assert shown(queries.op12_expiring_clicks(spark, SF)) == brute(rows)


def test_hot_click_and_odd_rows(spark):
    """A third of the rows has one click_id; null fields, times before 1970, a zone that is not UTC, clashing columns."""
    rng = random.Random(4)
    start, rows = datetime(1969, 11, 1), []
    for i in range(600):
        click = rng.choice([7, rng.randrange(-5, 40), rng.choice([None, i])])
        moment = start + timedelta(minutes=rng.randrange(60 * 24 * 150), microseconds=rng.randrange(10**6))
        rows.append((click, rng.choice([moment, None]), moment if rng.random() < 0.95 else None, rng.choice([1, None]), rng.choice(["view", None]), rng.choice([None, 1.005, -2.345, 0.0]), rng.choice(['{"k": 1}', None, ""]), "x"))
    rows += rows[:100]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone",)}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour string")
        got = shown(expiry.windows(clicks, group_rows=50))
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept["spark.sql.session.timeZone"])
    micros = lambda t: None if t is None else (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert got == brute([(r[0], micros(r[1]), micros(r[2]), *r[3:7]) for r in rows])
    assert expiry.windows(clicks.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_fold_in_parts(seed):
    """Many clicks at once, in batches, against a loop over sorted copies."""
    rng = np.random.default_rng(seed)
    held, open_, closed = {}, np.zeros(0, expiry.WINDOW), []
    want = []
    for b in range(4):
        m = int(rng.integers(1, 80))
        click, hour, kind, n = rng.integers(0, 8, m), rng.integers(60 * b, 60 * b + 200, m), rng.integers(0, 3, m), rng.integers(1, 4, m)
        digest = np.stack([kind, kind * 0, kind * 0, kind], axis=1).astype("u8")
        order = rng.permutation(m)
        open_, ended = expiry.fold(open_, click[order], hour[order], digest[order], kind[order] + 10, n[order])
        closed += [tuple(int(w[c]) for c in ("click", "start", "repeats", "conflicts", "crc")) for w in ended]
        for c, h, k, many in sorted(zip(click.tolist(), hour.tolist(), kind.tolist(), n.tolist(), strict=True)):
            for _ in range(many):
                w = held.get(c)
                if w and h <= w[0] + 48:
                    w[2] += 1
                    if w[1] != k:
                        w[3], w[4] = w[3] + 1, w[4] + k + 10
                else:
                    if w:
                        want.append((c, w[0], *w[2:]))
                    held[c] = [h, k, 0, 0, 0]
    assert sorted(closed) == sorted(want)
    assert sorted((int(w["click"]), int(w["start"]), int(w["repeats"]), int(w["conflicts"]), int(w["crc"])) for w in open_) == sorted((c, w[0], *w[2:]) for c, w in held.items())


def test_each_store_is_visited_once_a_batch(spark, monkeypatch):
    """Ten batches, one of them empty, take a pass each and the last one two; what closed after a batch says so."""
    roots, new_path = [], expiry.storage.new_path
    monkeypatch.setattr(expiry.storage, "new_path", lambda *a: roots.append(new_path(*a)) or roots[-1])
    rng = random.Random(5)
    start, rows = datetime(2024, 1, 1), []
    for i in range(400):
        click, day = rng.randrange(30), rng.choice([rng.randrange(20), 90 + rng.randrange(20)])
        moment = start + timedelta(days=day, minutes=rng.randrange(60 * 24))
        rows.append((click, moment, moment, i % 3, "view", 0.5, None))
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string")
    got = shown(expiry.windows(clicks, group_rows=50))
    micros = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert got == brute([(r[0], micros(r[1]), micros(r[2]), *r[3:]) for r in rows])
    path = Path(roots[0].removeprefix("file://"))
    batches = len(list(path.glob("in/batch=*"))) - 1
    assert batches < 10
    assert len([p for p in path.glob("checkpoint/commits/*") if p.name.isdigit()]) == batches + 1
