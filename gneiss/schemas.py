"""Schemas of the relational and nested records."""

from __future__ import annotations

from pyspark.sql import types as T

FEEDBACK = T.StructType([T.StructField("rating", T.IntegerType()), T.StructField("comment", T.StringType())])

TURN = T.StructType(
    [
        T.StructField("turn_id", T.IntegerType()),
        T.StructField("query", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("retrieved_chunk_ids", T.ArrayType(T.StringType())),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("feedback", FEEDBACK),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

CHAT_SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("turn_count", T.IntegerType()),
        T.StructField("turns", T.ArrayType(TURN)),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

AUDIT_LOGS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("chunk_type_filter", T.StringType()),
        T.StructField("vector_latency_ms", T.DoubleType()),
        T.StructField("keyword_latency_ms", T.DoubleType()),
        T.StructField("rerank_latency_ms", T.DoubleType()),
        T.StructField("total_latency_ms", T.DoubleType()),
        T.StructField("result_count", T.IntegerType()),
        T.StructField("top_scores", T.ArrayType(T.DoubleType())),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

MANUAL_CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("chunk_type", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("chapter_path", T.StringType()),
        T.StructField("content", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)

BENCHMARK_CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("expected_files", T.ArrayType(T.StringType())),
        T.StructField("required_keywords", T.ArrayType(T.StringType())),
        T.StructField("expected_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("expected_chunk_ids", T.ArrayType(T.StringType())),
    ]
)

_JUDGED = T.StructType([T.StructField("reasoning", T.StringType()), T.StructField("score", T.IntegerType())])
JUDGE_METRICS = ("context_relevance", "faithfulness", "answer_relevance", "completeness")
JUDGE_REPORT = T.StructType([*[T.StructField(m, _JUDGED) for m in JUDGE_METRICS], T.StructField("verdict", T.StringType()), T.StructField("summary_critique", T.StringType())])

ATOMIC_CHECK = T.StructType([T.StructField("statement", T.StringType()), T.StructField("is_supported_by_context", T.BooleanType()), T.StructField("citation_quote", T.StringType())])
LEAKAGE_REPORT = T.StructType(
    [
        T.StructField("atomic_checks", T.ArrayType(ATOMIC_CHECK)),
        T.StructField("total_claims", T.IntegerType()),
        T.StructField("leaked_claims", T.IntegerType()),
        T.StructField("leakage_rate", T.DoubleType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("audit_summary", T.StringType()),
    ]
)
