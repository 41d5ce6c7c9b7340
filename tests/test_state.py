"""Session states in the state store against the batch query over all turns."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from gneiss.operators import sessions
from gneiss.streaming import state

TURN = "struct<turn_id: int, query: string, response: string>"
SCHEMA = f"session_id string, user_id string, timestamp timestamp, turn {TURN}"
BEGIN = dt.datetime(2024, 5, 1)


def turn(session, user, second, n):
    return (session, user, BEGIN + dt.timedelta(seconds=second), (n, f"q{n}", "r"))


def as_rows(df):
    return {r["session_id"]: (r["user_id"], r["turn_count"], [t["turn_id"] for t in r["turns"]], r["created_at"], r["updated_at"]) for r in df.collect()}


def run(spark, tmp_path, batches, **how):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        state.keep_sessions(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 5, every=2, **how).awaitTermination()
    return state.kept_sessions(spark, str(tmp_path / "out"))


def test_states_equal_the_batch_query(spark, tmp_path):
    """Restarts, late turns and a busy session; most sessions stay as they are in a batch."""
    first = [turn("busy", f"u{i % 3}", 100 + i, i) for i in range(400)] + [turn("s", None, 5, 1), turn("t", "b", 7, 1)]
    late = [turn("busy", "early", 3, 1000), turn("busy", "x", 498, 1001), turn("s", "z", 5, 2), (None, "u", BEGIN, (1, "q", "r")), ("n", "u", None, (1, "q", "r"))]
    last = [turn("new", "n", 1, 1), turn("t", "a", 9, 2), turn("t", "a", 9, 2)]
    got = as_rows(run(spark, tmp_path, [first, late, last]))
    every = spark.createDataFrame([r for r in first + late + last if r[0] and r[2]], SCHEMA)
    want = as_rows(sessions.session_state(every, 5))
    want["s"] = ("z", *want["s"][1:])  # of users of one time the smallest that is known
    want["busy"] = (*want["busy"][:2], got["busy"][2], *want["busy"][3:])  # two turns of one time
    assert got == want
    assert got["busy"][0] == "early" and got["busy"][1] == 402 and got["t"][1:3] == (3, [1, 2, 2])
    assert sorted(got["busy"][2]) == [396, 397, 398, 399, 1001]


def test_idle_sessions_begin_anew(spark, tmp_path):
    got = as_rows(run(spark, tmp_path, [[turn("s", "a", 1, 1)], [turn("s", "b", 9, 2)]], idle_days=1e-6))
    assert got["s"][:3] == ("b", 1, [2])


def test_tasks_sum_up_before_the_exchange(spark):
    rows = spark.createDataFrame([turn("busy", "u", i, i) for i in range(5000)], SCHEMA).repartition(2)
    parts = state.summed(rows.select("session_id", "user_id", F.unix_micros("timestamp").alias("at"), F.to_json("turn").alias("turn")), 5).collect()
    assert len(parts) <= 4 and sum(r["n"] for r in parts) == 5000 and all(len(r["turns"]) == 5 for r in parts)


def test_nothing_kept(spark, tmp_path):
    assert state.kept_sessions(spark, str(tmp_path / "none")).count() == 0


def test_sums_go_on_from_one_record_batch_to_the_next(spark):
    rows = spark.createDataFrame([turn("busy", "u", i, i) for i in range(5000)], SCHEMA).repartition(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        parts = state.summed(rows.select("session_id", "user_id", F.unix_micros("timestamp").alias("at"), F.to_json("turn").alias("turn")), 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(parts) <= 2 and sum(r["n"] for r in parts) == 5000 and all(len(r["turns"]) == 5 for r in parts)


def test_workers_get_small_record_batches(spark):
    long = spark.range(6000).repartition(1).select("id", F.repeat(F.lit("x"), 10_000).alias("turn"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"]) for b in batches)
    with state.state_store(spark):
        got = long.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    assert sum(r["n"] for r in got) == 6000 and max(r["n"] for r in got) <= 500 and max(r["bytes"] for r in got) < 5_000_000


def test_a_task_holds_few_turns_and_loses_none():
    rng, cap = random.Random(1), 3
    rows = [(f"s{int(rng.paretovariate(0.7)) % 90}", rng.choice([None, "a", "b"]), rng.randrange(60), rng.choice([None, "t" * rng.randrange(90)])) for _ in range(4000)]
    kind = pa.schema([("session_id", pa.string()), ("user_id", pa.string()), ("at", pa.int64()), ("turn", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 50], strict=True), kind, strict=True)], schema=kind) for k in range(0, 4000, 50)]
    given = list(state.parts(iter(batches), cap, 9000))
    assert len(given) > 5 and max(b.nbytes for b in given) < 9000 and max(b.num_rows for b in given) <= 9000 // state.EACH
    order = lambda p: (p[0], p[1] or "")
    for session in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == session]
        sums = [r for b in given for r in b.to_pylist() if r["session_id"] == session]
        first = min(r[2] for r in own)
        assert sum(r["n"] for r in sums) == len(own) and min(r["first_at"] for r in sums) == first and max(r["last_at"] for r in sums) == max(r[2] for r in own)
        assert min((r["user_id"] for r in sums if r["first_at"] == first and r["user_id"]), default=None) == min((r[1] for r in own if r[2] == first and r[1]), default=None)
        kept = [p for r in sums for p in zip(r["ats"], r["turns"], strict=True)]
        assert sorted(kept, key=order)[-cap:] == sorted(((r[2], r[3]) for r in own), key=order)[-cap:]
