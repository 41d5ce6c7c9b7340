"""Expiring deduplication against a fold row by row."""

import hashlib
import math
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest

from gneiss.llm import expiring

EPOCH = datetime(1970, 1, 1)


def fold_by_rows(state, rows, span):
    """(closed) after taking (id, hour, hash) rows in order; ``state`` maps ids to [start, hash, repeats, conflicts, crc]."""
    closed = []
    for click, hour, digest in sorted(rows):
        window = state.get(click)
        if window and hour <= window[0] + span:
            window[2] += 1
            if digest != window[1]:
                window[3] += 1
                window[4] += zlib.crc32(digest.hex().encode())
            continue
        if window:
            closed.append((click, *window))
        state[click] = [hour, digest, 0, 0, 0]
    return closed


def as_rows(windows):
    raw = windows.hashes.astype(">u8").tobytes()
    return [(c, s, raw[32 * i : 32 * i + 32], *rest) for i, (c, s, *rest) in enumerate(windows.numbers.T.tolist())]


@pytest.mark.parametrize("seed", range(30))
def test_fold(seed):
    rng = np.random.default_rng(seed)
    hashes = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    state, now = {}, expiring.Windows.none()
    for step in range(4):
        n = int(rng.integers(0, 60))
        rows = [(int(rng.integers(0, 9)), int(rng.integers(step * 10, step * 10 + 60)), hashes[rng.integers(0, 3)]) for _ in range(n)]
        shut = fold_by_rows(state, rows, 15)
        distinct = sorted(set(rows), key=lambda r: rng.random())
        counts = np.array([rows.count(r) for r in distinct], np.int64)
        raw = np.frombuffer(b"".join(r[2] for r in distinct), ">u8").astype(np.uint64).reshape(-1, 4)
        ids, hours = (np.array([r[i] for r in distinct], np.int64) for i in (0, 1))
        crcs = np.array([zlib.crc32(r[2].hex().encode()) for r in distinct], np.int64)
        now, closed = expiring.fold(now, ids, hours, raw, crcs, counts, 15)
        assert sorted(x for w in closed for x in as_rows(w)) == sorted(shut)
        assert as_rows(now) == sorted((k, *v) for k, v in state.items())
        again = expiring.Windows.unpack(now.pack())
        assert as_rows(again) == as_rows(now)


def brute(clicks, batches):
    made = []
    for click, ts, arrived, client, kind, value, props in clicks:
        if click is None or arrived is None:
            continue
        base = (arrived - EPOCH) // timedelta(hours=1)
        for j in range(click % 3 + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = base + 6 * j * (c % 10)
            parts = (client, kind, None if value is None else math.floor(100 * value + 0.5), None if ts is None else (ts - EPOCH) // timedelta(microseconds=1), props, c % 3)
            digest = hashlib.sha256("|".join("" if p is None else str(p) for p in parts).encode()).digest()
            made.append((hour + c // 10 % 200, (click, hour, digest)))
    low, high = min(m[0] for m in made), max(m[0] for m in made)
    state, out, top = {}, [], None
    for b in range(batches):
        rows = [r for order, r in made if (order - low) * batches // (high - low + 1) == b]
        out += [(b, *w) for w in fold_by_rows(state, [r for r in rows if top is None or r[1] >= top - 48], 72)]
        top = max([top, *(r[1] for r in rows)], key=lambda x: -1 if x is None else x)
        for k in [k for k, w in state.items() if b == batches - 1 or w[0] + 72 < top - 48]:
            out.append((b, k, *state.pop(k)))
    return sorted((click, start, b, repeats, conflicts, crc, digest.hex()) for b, click, start, digest, repeats, conflicts, crc in out)


SCHEMA = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string"


def test_stream(spark):
    rng, begin = np.random.default_rng(4), datetime(2024, 1, 1)
    clicks = []
    for i in range(600):
        click = 7 if i % 3 == 0 else int(rng.integers(0, 80))  # one click has a third of the rows
        at = begin + timedelta(hours=float(rng.integers(0, 900)))
        clicks.append((click, at - timedelta(seconds=2), at, int(rng.integers(0, 3)), ["click", None, "a|b"][i % 3], [1.005, -2.5, None][i % 3 - 1], None if i % 5 else "x" * 20_000))
    clicks += clicks[:50] + [(None, begin, begin, 1, "k", 1.0, "p"), (5, begin, None, 1, "k", 1.0, "p"), (5, None, begin, None, None, None, None)]
    df = spark.createDataFrame(clicks, SCHEMA).selectExpr("*", "1 as hour", "2 as batch", "3 as shard")
    got = [tuple(r) for r in expiring.in_batches(spark, df, 4).collect()]
    assert sorted(got) == brute(clicks, 4)


def test_no_rows(spark):
    none = spark.createDataFrame([(None, None, None, None, None, None, None)], SCHEMA)
    assert expiring.in_batches(spark, none).columns == ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]
    assert expiring.in_batches(spark, none).count() == 0


BASE = datetime(2024, 1, 1)


def few(hours):
    return [(click, BASE + timedelta(hours=h), BASE + timedelta(hours=h), 1, "k", 1.0, "p") for click, h in hours]


def test_busy_clicks_are_counted_together(spark, monkeypatch):
    seen, combined = [], expiring.combined
    monkeypatch.setattr(expiring, "combined", lambda rows: seen.append(1) or combined(rows))
    clicks = few([(i % 40 if i % 3 else 3, i * 7 % 400) for i in range(300)])
    df = spark.createDataFrame(clicks, SCHEMA)
    for busy_rows, calls in ((200, 0), (50, 3)):
        seen.clear()
        assert sorted(tuple(r) for r in expiring.in_batches(spark, df, 3, busy_rows).collect()) == brute(clicks, 3)
        assert len(seen) == calls


def test_one_micro_batch_for_each_start(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(expiring, "scratch", lambda spark: f"file://{tmp_path}")
    clicks = few([(i, i * 10) for i in range(60)])
    got = expiring.in_batches(spark, spark.createDataFrame(clicks, SCHEMA), 3)
    assert sorted(tuple(r) for r in got.collect()) == brute(clicks, 3)
    assert sorted(p.name for p in (tmp_path / "state" / "commits").glob("[0-9]*")) == ["0", "1", "2"]


def test_batches_without_rows(spark):
    clicks = few([(i, i * 10) for i in range(30)] + [(5, 4000), (31, 4010)])
    got = expiring.in_batches(spark, spark.createDataFrame(clicks, SCHEMA), 6)
    assert sorted(tuple(r) for r in got.collect()) == brute(clicks, 6)


class Kept:
    """A handle with a map state and timers, in memory."""

    def __init__(self):
        self.held, self.timers = {}, []

    def getMapState(self, *names):
        return self

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def containsKey(self, key):
        return key in self.held

    def removeKey(self, key):
        del self.held[key]

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, due):
        self.timers.append(due)

    def deleteTimer(self, due):
        self.timers.remove(due)


def test_state_in_parts(monkeypatch):
    monkeypatch.setattr(expiring, "PART_WINDOWS", 10)
    shard, kept = expiring.Shard(1, False, 72), Kept()
    shard.init(kept)
    for n, parts in ((35, 4), (10, 1), (21, 3), (0, 0)):
        numbers = np.arange(5 * n, dtype=np.int64).reshape(5, n)
        now = expiring.Windows(numbers, np.arange(4 * n, dtype=np.uint64).reshape(n, 4))
        shard._store(now)
        assert sorted(kept.held) == [(i,) for i in range(parts)] and len(kept.timers) == bool(n)
        open_, gone = shard._load(0)
        assert as_rows(open_) == as_rows(now) and not len(gone)


def test_shards_grow_with_rows():
    assert expiring.shards_for(10) == 64 and expiring.shards_for(10**9) == 20_000
