"""Hybrid retrieval: vector and keyword ranks, fused by reciprocal ranks, then re-ranked.

Every ordering ends with the id, so results don't depend on partitions. Wide columns (content)
join only the hits that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.config import Retrieval
from gneiss.functions import models
from gneiss.functions.frames import in_blocks
from gneiss.functions.vectors import PLACES, nearest, sigmoid
from gneiss.operators import index as postings
from gneiss.operators import lexical

ALL_TYPES = "全部"
FACTS = ["source_file", "chunk_type", "chapter_path", "content"]


def of_type(chunks: DataFrame, chunk_type: str | None) -> DataFrame:
    """Chunks of a type; none or the word for all keeps every type."""
    return chunks if chunk_type in (None, ALL_TYPES) else chunks.where(F.col("chunk_type") == chunk_type)


def ranked(scored: DataFrame, score: str, name: str, k: int, key: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows with their ranks; the limit is taken before the one-task window."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(vector: DataFrame, keyword: DataFrame, keys: list[str], rrf_k: int = 60) -> DataFrame:
    """Full outer join of two ranked lists; a missing rank adds nothing."""
    both = vector.join(keyword, keys, "full_outer")

    def part(rank):
        return F.coalesce(1.0 / (F.lit(float(rrf_k)) + F.col(rank)), F.lit(0.0))

    return both.withColumn("rrf_score", F.round(part("rank_vec") + part("rank_kw"), PLACES))


def keyword_ranks(chunks: DataFrame, queries: dict, k: int, ranking: str = "bm25", key: str = "chunk_id", block: int = 40, index: postings.Index | None = None) -> DataFrame:
    """(query_id, key, rank_kw) of the ``k`` best matches of each query, in blocks of queries.

    Queries with the same lexemes are scored once. With an ``index`` of the chunks only its blocks are
    read, a thousand queries at a time; without one, all texts for each block of queries.
    """
    spark = chunks.sparkSession
    block = block if index is None else 1000
    asked = {q: tuple(lexical.query_terms(t)) for q, t in queries.items()}
    texts = sorted(set(asked.values()) - {()})
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)

    def ranked_blocks():
        for lo in range(0, max(1, len(texts)), block):
            own = {lo + i: list(t) for i, t in enumerate(texts[lo : lo + block])}
            if index is not None:
                yield postings.top(spark, index, own, k, ranking, key).select(F.col("query_id").alias("text_id"), key, "rank_kw")
                continue
            scored = lexical.score_all(chunks, own, ranking, key)
            yield scored.withColumn("rank_kw", F.row_number().over(order).cast("bigint")).where(F.col("rank_kw") <= k).select(F.col("query_id").alias("text_id"), key, "rank_kw")

    of = {t: i for i, t in enumerate(texts)}
    pairs = spark.createDataFrame([(q, of[t]) for q, t in sorted(asked.items()) if t], "query_id bigint, text_id bigint")
    return in_blocks(spark, ranked_blocks()).join(F.broadcast(pairs), "text_id").select("query_id", key, "rank_kw")


def hybrid(chunks: DataFrame, queries: dict, vectors: dict, limit: int, settings: Retrieval | None = None, chunk_type: str | None = None, key: str = "chunk_id", index: postings.Index | None = None) -> DataFrame:
    """(query_id, key, rank_vec, rank_kw, rrf_score, rank) of the ``limit`` best of each query.

    ``index`` is one of the chunks of that type, and spares a scan of the texts.
    """
    settings = settings or Retrieval()
    pool = of_type(chunks, chunk_type)
    fetch = settings.fetch_k(limit)
    near = nearest(pool, vectors, fetch, key, floor=settings.floor).select("query_id", key, F.col("rank_vec").cast("bigint").alias("rank_vec"))
    fused = fuse(near, keyword_ranks(pool, queries, fetch, key=key, index=index), ["query_id", key], settings.rrf_k)
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), key)
    return fused.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def vector_only(chunks: DataFrame, vectors: dict, limit: int, chunk_type: str | None = None, key: str = "chunk_id") -> DataFrame:
    """Nearest chunks in the shape of fused hits: the other ranks and scores are null."""
    near = nearest(of_type(chunks, chunk_type), vectors, limit, key)
    return near.select("query_id", key, "cosine_similarity", F.lit(None).cast("bigint").alias("rank_vec"), F.lit(None).cast("bigint").alias("rank_kw"), F.lit(None).cast("double").alias("rrf_score"))


def search(chunks: DataFrame, query: str, vector: list[float], settings: Retrieval | None = None, chunk_type: str | None = None, use_hybrid: bool = True, index: postings.Index | None = None) -> DataFrame:
    """What the search page shows: hits of one query with their facts, re-ranked if set.

    A blank query has no hit.
    """
    settings = settings or Retrieval(floor=0.3)
    if not query.strip():
        vectors, queries = {}, {0: ""}
    else:
        vectors, queries = {0: vector}, {0: query}
    if use_hybrid and vectors:
        found = hybrid(chunks, queries, vectors, settings.pool, settings, chunk_type, index=index).drop("rank")
        sims = nearest(of_type(chunks, chunk_type), vectors, settings.fetch_k(settings.pool)).select("query_id", "chunk_id", "cosine_similarity")
        found = found.join(sims, ["query_id", "chunk_id"], "left")
    else:
        found = vector_only(chunks, vectors, settings.pool, chunk_type)
    full = found.join(chunks.select("chunk_id", *FACTS), "chunk_id")
    return rerank(full, query, settings.top_k) if settings.rerank else full


def rerank(hits: DataFrame, query: str, top_n: int, logit=None, key: str = "chunk_id", scorer=None, batch: int = 32) -> DataFrame:
    """Hits by the sigmoid of a cross-scorer's logit; ties keep the fused order.

    ``logit`` gives it as a Column of the content, by default by late interaction of words. ``scorer``, a function from a list of (query,
    content) pairs to a list of numbers such as a cross-encoder's, is called in batches instead.
    """
    if scorer is not None:
        raw = models.pair_scores(query, scorer, batch)(F.coalesce(F.col("content"), F.lit("")))
    else:
        raw = (logit or (lambda content: models.late_interaction(query, content)))(F.col("content"))
    scored = hits.withColumn("raw_rerank_score", F.round(raw, PLACES))
    scored = scored.withColumn("rerank_score", F.round(sigmoid(F.col("raw_rerank_score")), PLACES))
    order = [F.desc("rerank_score"), F.desc_nulls_last("rrf_score"), key]
    return scored.orderBy(*order).limit(top_n)


def audit_score(rerank, rrf, cosine):
    """The score that the log keeps: the first of the three that is neither null nor zero."""
    return F.coalesce(F.nullif(rerank, F.lit(0.0)), F.nullif(rrf, F.lit(0.0)), F.nullif(cosine, F.lit(0.0)), F.lit(0.0))


#: Tokens that an answer may have, by how detailed it is to be.
STYLES = {"brief": 400, "standard": 1000, "deep": 2500}


def answered(prompts: DataFrame, backends: list, failed: str = "", **how) -> DataFrame:
    """Prompts with the answer of the first model that gives one; see ``models.with_answer``.

    Each backend takes a prompt; temperature and the like are its own settings.
    """
    return models.with_answer(prompts, backends, failed=failed, wait_for_quota=True, **how)


def prompt_blocks(hits: DataFrame, query: str, rank: str = "rank", style_tokens: int = STYLES["standard"]) -> DataFrame:
    """(query_id, prompt): numbered sources with their scores, then the question."""
    block = F.concat(
        F.format_string("[%d] %s", F.col(rank).cast("int"), F.coalesce("source_file", F.lit(""))),
        F.when(F.coalesce("chapter_path", F.lit("")) != "", F.concat(F.lit(" ("), F.col("chapter_path"), F.lit(")"))).otherwise(""),
        F.lit(", "),
        F.coalesce("chunk_type", F.lit("")),
        F.lit("\n"),
        F.coalesce("content", F.lit("")),
    )
    gathered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("blocks"))
    context = F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n---\n\n")
    return gathered.select("query_id", F.concat(context, F.lit(f"\n\nQuestion ({style_tokens} tokens at most): {query}")).alias("prompt"))


def rendered(hits: DataFrame) -> DataFrame:
    """Hits as Markdown lines; a list in which a hit has no rank is named as such."""
    rank = F.coalesce(F.col("rank_kw").cast("string"), F.lit("未入榜"))
    vec = F.coalesce(F.col("rank_vec").cast("string"), F.lit("未入榜"))
    preview = F.when(F.length("content") > 250, F.concat(F.substring("content", 1, 250), F.lit("..."))).otherwise(F.col("content"))
    return hits.withColumn("markdown", F.format_string("### %s `%s`\n- vector rank %s, keyword rank %s, fused %.5f\n\n%s", "source_file", "chunk_type", vec, rank, F.bround(F.coalesce("rrf_score", F.lit(0.0)), 5), preview))
