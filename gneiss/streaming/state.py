"""Session states in the engine's own state store.

A session's counter, its first and last times and first user stand in a value state, its newest turns in a
list state that is capped; with ``idle_days`` both are dropped once a session has had no turn for so long
(by the clock). Before the exchange each task sums its own turns up by session, newest turns alone
kept, so that a session with a third of all turns sends as little as any other. A task holds the sums of
``HELD`` bytes of turns at most, gives them out and begins anew; record batches are small, so that what a
Python worker holds doesn't grow with the turns that arrive.

Late turns count, and take their place by time among those that are kept. Repeated turns count each time: a
source that sends again is told apart by its checkpoint, not by content. Of turns of one time the one
that sorts last as text is the newer; of users of the first time the smallest. Turns without a session or a time
are left out. States are the same as those of ``sessions.session_state`` over all turns that have arrived.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from gneiss import schemas
from gneiss.operators import sessions
from gneiss.streaming import streams

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # With a clock for idle sessions a query would otherwise run empty batches without an end.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # What a Python worker gets at a time; sums go on from one record batch to the next.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
PARTS = "session_id string, n bigint, first_at bigint, user_id string, last_at bigint, ats array<bigint>, turns array<string>"
OUT = "session_id string, user_id string, turn_count int, ats array<bigint>, turns array<string>, first_at bigint, last_at bigint"
DAY_MS = 86_400_000
#: Bytes of turns, about, whose sums a task holds. A session or turn that is held costs so many besides its text.
HELD, EACH = 4_000_000, 256


@contextmanager
def state_store(spark: SparkSession):
    """The settings that state of this kind needs, while a query starts."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def newest(pairs: list[tuple[int, str | None]], cap: int) -> list[tuple[int, str | None]]:
    return sorted(pairs, key=lambda p: (p[0], p[1] or ""))[-cap:]


def earlier(first: int | None, user: str | None, at: int, own: str | None) -> tuple[int, str | None]:
    """The first time and its user, of two; of users of one time the smallest that is known."""
    if first is None or at < first or at == first and own is not None and (user is None or own < user):
        return at, own
    return first, user


def parts(batches, cap: int, held: int = HELD):
    """Record batches of ``PARTS`` of those of (session_id, user_id, at, turn)."""
    import pyarrow as pa

    text, number = pa.string(), pa.int64()
    schema = pa.schema(list(zip((c.split()[0] for c in PARTS.split(", ")), (text, number, number, text, number, pa.list_(number), pa.list_(text)), strict=True)))

    def given(sums):
        n, first, user, last, kept = zip(*sums.values(), strict=True)
        kept = [newest(k, cap) for k in kept]
        columns = [list(sums), n, first, user, last, [[a for a, _ in k] for k in kept], [[t for _, t in k] for k in kept]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    sums, size = {}, 0
    for batch in batches:
        for session, user, at, turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            known = sums.get(session)
            if known is None:
                sums[session] = [1, at, user, at, [(at, turn)]]
                size += EACH
            else:
                known[0] += 1
                known[1:3] = earlier(known[1], known[2], at, user)
                known[3] = max(known[3], at)
                known[4].append((at, turn))
            size += EACH + len(turn or "")
            if known and len(known[4]) > 2 * cap:
                size -= sum(EACH + len(t or "") for _, t in known[4])
                known[4] = newest(known[4], cap)
                size += sum(EACH + len(t or "") for _, t in known[4])
            if size > held:
                yield given(sums)
                sums, size = {}, 0
    if sums:
        yield given(sums)


def summed(rows: DataFrame, cap: int) -> DataFrame:
    """``PARTS`` of (session_id, user_id, at, turn): what a task adds to each session."""
    return rows.select("session_id", "user_id", "at", "turn").mapInArrow(lambda batches: parts(batches, cap), PARTS)


class Sessions(StatefulProcessor):
    def __init__(self, cap: int, ttl: int | None):
        self.cap, self.ttl = cap, ttl

    def init(self, handle) -> None:
        self.facts = handle.getValueState("facts", "n bigint, first_at bigint, user_id string, last_at bigint", self.ttl)
        self.turns = handle.getListState("turns", "at bigint, turn string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, first, user, last = self.facts.get() or (0, None, None, None)
        kept = [(at, turn) for at, turn in self.turns.get()] if n and self.turns.exists() else []
        for _, more, begin, own, end, ats, turns in rows:
            n += more
            first, user = earlier(first, user, begin, own)
            last = end if last is None else max(last, end)
            kept = newest(kept + list(zip(ats, turns, strict=True)), self.cap)
        self.facts.update((n, first, user, last))
        self.turns.put(kept)
        yield Row(session_id=key[0], user_id=user, turn_count=n, ats=[a for a, _ in kept], turns=[t for _, t in kept], first_at=first, last_at=last)

    def close(self) -> None:
        pass


def session_states(turns: DataFrame, cap: int = sessions.CAP, idle_days: float | None = None) -> DataFrame:
    """A stream of the new state of every session that a stream of ``turns`` (session_id, user_id, timestamp, turn) touches."""
    rows = turns.where("session_id is not null and timestamp is not null").select("session_id", "user_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), F.to_json("turn").alias("turn"))
    ttl = None if idle_days is None else max(1, int(idle_days * DAY_MS))
    found = summed(rows, cap).groupBy("session_id").transformWithState(Sessions(cap, ttl), OUT, "Update", "None" if ttl is None else "ProcessingTime")
    kind = turns.schema["turn"].dataType
    return found.select(
        "session_id", "user_id", "turn_count", F.transform("turns", lambda t: F.from_json(t, kind)).alias("turns"),
        F.timestamp_micros("first_at").alias("created_at"), F.timestamp_micros("last_at").alias("updated_at"),
    )


def _newest_parts(parts: DataFrame) -> DataFrame:
    columns = [c for c in parts.columns if c not in ("session_id", "part")]
    return parts.groupBy("session_id").agg(F.max_by(F.struct(*columns), "part").alias("s")).select("session_id", *[F.col(f"s.{c}").alias(c) for c in columns])


def keep_sessions(turns: DataFrame, path: str, checkpoint: str, cap: int = sessions.CAP, idle_days: float | None = None, every: int = 16) -> StreamingQuery:
    """Keep the states of sessions up to date under ``path``: each batch writes those that it touched."""

    def keep(batch: DataFrame, number: int) -> None:
        streams._keep(batch, number, path, _newest_parts, every)

    with state_store(turns.sparkSession):
        return session_states(turns, cap, idle_days).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All states that ``keep_sessions`` has left under ``path``; none where nothing has been kept yet."""
    parts = streams._read(spark, path, *streams._live(spark, path))
    return spark.createDataFrame([], schemas.CHAT_SESSIONS) if parts is None else _newest_parts(parts)
