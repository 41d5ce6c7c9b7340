"""The driver's tables seen as the engine's entities, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import index as postings
from gneiss.operators.retrieval import of_type
from gneiss.sources.readers import table

_indexes: dict = {}

CHUNKS_SQL = """chunks AS (
  SELECT d.doc_id AS chunk_id, d.source AS source_file, CASE WHEN coalesce(e.label, d.doc_id) % 2 = 0 THEN 'text' ELSE 'table' END AS chunk_type,
         d.lang || ' / ' || d.source AS chapter_path, d.text AS content, e.embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

AUDIT_SQL = """audit AS (
  SELECT event_id, user_id::varchar AS session_id, coalesce(json_extract_string(props, '$.k'), '') AS query, event_type AS query_type,
         value AS total_latency_ms, value / 4 AS vector_latency_ms, value / 8 AS keyword_latency_ms, value / 2 AS rerank_latency_ms,
         (event_id % 7)::int AS result_count, ts AS "timestamp"
  FROM events)"""

MANUALS_SQL = r"""manuals AS (
  SELECT page_id % 10 AS manual, 'p_' || page_id || '.md' AS source_file,
    replace(replace(replace(replace(replace(html, '<h1>', chr(10) || '# '), '</h1>', chr(10)), '<ul>', '<table>'), '</ul>', '</table>'), '<article>', chr(10) || '## ' || (page_id % 3) || chr(10)) AS text
  FROM pages)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks: all documents, with their vectors where they have one; the parity of the
    label, else of the id, gives the type."""
    docs, vecs = table(spark, d, "documents"), table(spark, d, "embeddings")
    joined = docs.join(vecs, docs.doc_id == vecs.vec_id, "left")
    return joined.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("source_file"),
        F.when(F.coalesce("label", "doc_id") % 2 == 0, "text").otherwise("table").alias("chunk_type"),
        F.concat("lang", F.lit(" / "), "source").alias("chapter_path"),
        F.col("text").alias("content"),
        "embedding",
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as far as keyword search needs them."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat("lang", F.lit(" / "), "source").alias("chapter_path"), F.col("text").alias("content"))


def index(spark: SparkSession, d: str, chunk_type: str | None = None) -> postings.Index:
    """The index of all chunks, or of a type: made when it is first asked for, as a store makes it at
    ingest, and again when the table has changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    changed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    name = (spark.sparkContext.applicationId, d, chunk_type, changed)
    if name not in _indexes:
        _indexes[name] = postings.build(texts(spark, d) if chunk_type is None else of_type(chunks(spark, d), chunk_type))
    return _indexes[name]


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Audit events: the value is the total latency, and parts of it the stages'."""
    return as_audit(table(spark, d, "events"))


def as_audit(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("query"),
        F.col("event_type").alias("query_type"),
        F.col("value").alias("total_latency_ms"),
        (F.col("value") / 4).alias("vector_latency_ms"),
        (F.col("value") / 8).alias("keyword_latency_ms"),
        (F.col("value") / 2).alias("rerank_latency_ms"),
        (F.col("event_id") % 7).cast("int").alias("result_count"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Turn events of conversations; a turn's number stands for its time in seconds."""
    c = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.col("turn"))
    turn = F.struct(
        F.col("turn").cast("int").alias("turn_id"),
        F.col("text").alias("query"),
        F.col("role").alias("response"),
        F.length("text").cast("double").alias("latency_ms"),
        F.when(F.col("turn") % 2 == 1, F.struct((1 + F.length("text") % 5).cast("int").alias("rating"))).alias("feedback"),
    )
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("user_id"), at.alias("timestamp"), turn.alias("turn"))


def manuals(spark: SparkSession, d: str) -> DataFrame:
    """Markdown files made of pages: headings and tables stand for titles and lists."""
    p = table(spark, d, "pages")
    text = F.col("html")
    for old, new in (("<h1>", F.lit("\n# ")), ("</h1>", F.lit("\n")), ("<ul>", F.lit("<table>")), ("</ul>", F.lit("</table>"))):
        text = F.replace(text, F.lit(old), new)
    text = F.replace(text, F.lit("<article>"), F.concat(F.lit("\n## "), (F.col("page_id") % 3).cast("string"), F.lit("\n")))
    return p.select((F.col("page_id") % 10).alias("manual"), F.concat(F.lit("p_"), F.col("page_id").cast("string"), F.lit(".md")).alias("source_file"), text.alias("text"))


def vector_of(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []
