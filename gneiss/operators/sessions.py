"""Chat sessions and audit events: validation, capped state, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns that a session keeps; its counter goes on.
CAP = 50
TTL_DAYS = 30


def validated_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) turn events; defaults fill what is missing before the test."""
    filled = turns.withColumns(
        {
            "user_id": F.coalesce("user_id", F.lit("anonymous")),
            "turn_id": F.coalesce("turn_id", F.lit(1)),
            "latency_ms": F.coalesce("latency_ms", F.lit(0.0)),
        }
    )
    rating = F.col("feedback.rating")
    ok = (
        (F.length(F.coalesce("session_id", F.lit(""))) >= 1)
        & (F.length(F.coalesce("query", F.lit(""))) >= 1)
        & F.col("response").isNotNull()
        & (F.col("turn_id") >= 1)
        & (F.col("latency_ms") >= 0)
        & (F.col("feedback").isNull() | (F.coalesce(rating.between(1, 5), F.lit(False)) & (F.length(F.coalesce("feedback.comment", F.lit(""))) <= 500)))
    )
    ok = F.coalesce(ok, F.lit(False))
    return filled.where(ok), filled.where(~ok)


def audit_is_valid():
    """Whether an audit event meets its constraints."""
    parts = [F.length(F.coalesce("query", F.lit(""))) >= 1, F.coalesce("result_count", F.lit(0)) >= 0]
    parts += [F.coalesce(f"{n}_latency_ms", F.lit(0.0)) >= 0 for n in ("vector", "keyword", "rerank", "total")]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return F.coalesce(out, F.lit(False))


def last_turns(turns: DataFrame, n: int = CAP, key: str = "session_id", order: str = "turn") -> DataFrame:
    """The newest ``n`` turns of each session, as rows."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n).drop("recency")


def session_state(turns: DataFrame, cap: int = CAP) -> DataFrame:
    """Sessions from turn events: counter, first and last times, first user, newest turns.

    ``turns`` has session_id, user_id, timestamp and a struct ``turn``. Only the newest ``cap``
    turns are gathered, after a ranked cut, so a busy session stays small.
    """
    facts = turns.groupBy("session_id").agg(F.count("*").cast("int").alias("turn_count"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"), F.min_by("user_id", "timestamp").alias("user_id"))
    kept = last_turns(turns, cap, "session_id", "timestamp").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "turn"))).alias("t"))
    return facts.join(kept, "session_id").select("session_id", "user_id", "turn_count", F.transform("t", lambda x: x["turn"]).alias("turns"), "created_at", "updated_at")


def merged_state(old: DataFrame, new: DataFrame, cap: int = CAP) -> DataFrame:
    """Upsert of session states: set on insert, push with a cap, add, set always."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.session_id") == F.col("n.session_id"), "full_outer")
    empty = F.array().cast(new.schema["turns"].dataType)
    turns = F.concat(F.coalesce("o.turns", empty), F.coalesce("n.turns", empty))
    return both.select(
        F.coalesce("o.session_id", "n.session_id").alias("session_id"),
        F.coalesce("o.user_id", "n.user_id").alias("user_id"),
        (F.coalesce("o.turn_count", F.lit(0)) + F.coalesce("n.turn_count", F.lit(0))).alias("turn_count"),
        F.slice(turns, F.greatest(F.size(turns) - cap + 1, F.lit(1)), F.lit(cap)).alias("turns"),
        F.coalesce("o.created_at", "n.created_at").alias("created_at"),
        F.coalesce("n.updated_at", "o.updated_at").alias("updated_at"),
    )


def retained(audit: DataFrame, days: int = TTL_DAYS, now=None, ts: str = "timestamp") -> DataFrame:
    """Events that haven't expired at ``now`` (a column; by default the newest event's time)."""
    if now is None:
        now = F.lit(audit.agg(F.max(ts)).first()[0])
    return audit.where(F.col(ts) > now - F.expr(f"interval {days} days"))
