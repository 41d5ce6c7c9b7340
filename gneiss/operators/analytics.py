"""Log analytics: latency by mode, frequent queries, sessions and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_by_mode(audit: DataFrame) -> DataFrame:
    """Counts and latencies of each query type, the most used first."""
    means = [F.round(F.avg(f"{n}_latency_ms"), 2).alias(f"avg_{n}_ms") for n in ("total", "vector", "keyword", "rerank")]
    out = audit.groupBy("query_type").agg(F.count("*").alias("total_queries"), *means, F.max("total_latency_ms").alias("max_total_ms"), F.min("total_latency_ms").alias("min_total_ms"))
    return out.orderBy(F.desc("total_queries"), "query_type")


def top_queries(audit: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent queries with mean latency and number of results."""
    out = audit.groupBy("query").agg(F.count("*").alias("frequency"), F.round(F.avg("total_latency_ms"), 2).alias("avg_latency_ms"), F.round(F.avg("result_count"), 1).alias("avg_result_count"))
    return out.orderBy(F.desc("frequency"), F.asc_nulls_first("query")).limit(limit)


def session_summary(sessions: DataFrame, limit: int | None = 20) -> DataFrame:
    """Each session with its turns' mean latency; null without turns. The latest first."""
    total = F.aggregate(F.filter("turns.latency_ms", lambda x: x.isNotNull()), F.lit(0.0), lambda acc, x: acc + x)
    known = F.size(F.filter("turns.latency_ms", lambda x: x.isNotNull()))
    mean = F.when(known > 0, F.round(total / known, 2))
    out = sessions.select("session_id", "user_id", "turn_count", "created_at", "updated_at", mean.alias("avg_turn_latency_ms"))
    return out.orderBy(F.desc("updated_at"), "session_id").limit(limit) if limit else out


def feedback_distribution(sessions: DataFrame) -> DataFrame:
    """Number of turns with each rating, from the lowest."""
    rated = sessions.select(F.explode("turns").alias("turn")).where("turn.feedback is not null")
    return rated.groupBy(F.col("turn.feedback.rating").alias("rating")).agg(F.count("*").alias("count")).orderBy("rating")


def feedback_average(distribution: DataFrame) -> DataFrame:
    """Mean rating and number of ratings; zeros if there are none."""
    mean = F.coalesce(F.round(F.sum(F.col("rating") * F.col("count")) / F.sum("count"), 2), F.lit(0.0))
    return distribution.agg(mean.alias("average_rating"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_feedback"))


def corpus_stats(chunks: DataFrame, sessions: DataFrame, audit: DataFrame) -> DataFrame:
    """One row of counts: chunks by type, sessions and audit events."""
    of = chunks.agg(F.count("*").alias("total_chunks"), F.count_if(F.col("chunk_type") == "text").alias("text_chunks"), F.count_if(F.col("chunk_type") == "table").alias("table_chunks"))
    return of.join(sessions.agg(F.count("*").alias("sessions"))).join(audit.agg(F.count("*").alias("audit_logs")))


def latency_percentiles(audit: DataFrame) -> DataFrame:
    """P95 and P99 of total latency by query type: planned in the design, an extension here."""
    return audit.groupBy("query_type").agg(F.round(F.percentile("total_latency_ms", 0.95), 6).alias("p95_ms"), F.round(F.percentile("total_latency_ms", 0.99), 6).alias("p99_ms"))


def share_by_type(chunks: DataFrame) -> DataFrame:
    """Number and share of chunks of each type: an extension."""
    from pyspark.sql import Window

    counted = chunks.groupBy("chunk_type").agg(F.count("*").alias("chunks"))
    total = F.sum("chunks").over(Window.partitionBy())
    return counted.select("chunk_type", "chunks", F.round(F.col("chunks") / total, 6).alias("share"))


def storage_report(spark, path: str, quota_mb: float = 512.0) -> DataFrame:
    """Size of a stored table against a quota."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    mb = F.coalesce(F.sum("length"), F.lit(0)) / F.lit(1024.0 * 1024.0)
    return files.agg(F.count("*").alias("files"), F.round(mb, 3).alias("size_mb"), F.round(100 * mb / quota_mb, 3).alias("percent_of_quota"))
