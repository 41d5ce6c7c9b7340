"""Registry of the engine's queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.config import Chunking, Retrieval
from gneiss.functions import pq, text
from gneiss.functions.frames import broadcast_if_small, in_blocks, scratch, stored
from gneiss.functions.stemming import STOP_WORDS
from gneiss.functions.vectors import centroids, nearest, nearest_in_lists, with_list
from gneiss.operators import analytics, evaluation, ingest, lexical, merge, retrieval, sessions, support
from gneiss.operators import index as postings
from gneiss.plans import views
from gneiss.plans.views import AUDIT_SQL, CHUNKS_SQL, MANUALS_SQL
from gneiss.sources import versions
from gneiss.sources.benchmark import builtin_cases
from gneiss.sources.readers import benchmark_cases, table
from gneiss.streaming import state, streams

QUERIES: dict = {}
ORACLES: dict = {}

#: What is asked, by turns where there are many queries, and the lexemes of each.
TEXTS = ["the ther and the thin", "Anea, thor", "erst of all the thing", "was it thinly ther, or anea?"]
LEXEMES = [["ther", "thin"], ["anea", "thor"], ["erst", "thing"], ["anea", "ther", "thin"]]
#: The words of the tables that have these lexemes.
FORMS = {
    "ther": ["ther", "therly", "therlyed", "therlying"],
    "thin": ["thin", "thinly", "thinlyed", "thinlying"],
    "anea": ["anea", "aneaed", "aneaes", "aneaing", "aneaingly"],
    "thor": ["thor", "thorly", "thorlyed", "thorlying"],
    "erst": ["erst", "ersted", "erstedly", "erstes", "ersting", "erstingly", "erstly", "erstlying"],
    "thing": ["thing", "thinged", "thingedly", "thinges", "thinging", "thingingly", "thingly", "thinglyed", "thinglying"],
}
FLOOR = 0.1


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------ vector search

_SIM = "round(list_cosine_similarity(c.embedding::double[], q.embedding::double[]), 9)"


def _topk_sql(k: int, where: str = "true", floor: float | None = None) -> str:
    bar = f"WHERE s >= {floor}" if floor is not None else ""
    return f"""WITH {CHUNKS_SQL}, s AS (
      SELECT c.chunk_id, {_SIM} AS s FROM chunks c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE c.embedding IS NOT NULL AND {where})
    SELECT chunk_id, s AS cosine_similarity, row_number() OVER (ORDER BY s DESC, chunk_id)::int AS rank_vec FROM s {bar}
    ORDER BY s DESC, chunk_id LIMIT {k}"""


def _near(spark, d, k, floor=None, chunk_type=None):
    pool = retrieval.of_type(views.chunks(spark, d), chunk_type)
    return nearest(pool, {0: views.vector_of(spark, d, 0)}, k, floor=floor).drop("query_id")


@query(_topk_sql(10))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 10)


@query(_topk_sql(50, floor=FLOOR))
def cosine_topk_floor(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 50, FLOOR)


@query(_topk_sql(10, "c.chunk_type = 'text'"))
def cosine_topk_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 10, chunk_type="text")


def _every_hundredth(spark: SparkSession, d: str, block: int = 1000):
    """Blocks of query vectors: every row whose id is divisible by 100."""
    rows = table(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0).select("vec_id", "embedding")
    blocks = max(1, ceil(rows.count() / block))
    for b in range(blocks):
        yield {r[0]: list(r[1]) for r in rows.where(F.pmod(F.floor(F.col("vec_id") / 100), F.lit(blocks)) == b).collect()}


@query(f"""WITH {CHUNKS_SQL}, s AS (
  SELECT q.vec_id AS query_id, c.chunk_id, {_SIM} AS s FROM chunks c, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE c.embedding IS NOT NULL), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id)::int AS rank_vec FROM s)
SELECT query_id, chunk_id, s AS cosine_similarity, rank_vec FROM r WHERE rank_vec <= 5""")
def cosine_topk_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return in_blocks(spark, (nearest(views.chunks(spark, d), block, 5) for block in _every_hundredth(spark, d)))


@query("SELECT len(embedding)::int AS dims, count(*) AS vectors FROM embeddings GROUP BY 1")
def vector_dims_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("vectors"))


# ------------------------------------------------------------------ keyword search

_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(STOP_WORDS)) + "]"
_FORMS_SQL = "forms(lexeme, word) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, own in FORMS.items() for w in own) + ")"
_ASKED = "asked(text_id, lexeme) AS (VALUES " + ", ".join(f"({i}, '{k}')" for i, own in enumerate(LEXEMES) for k in own) + ")"
_MATCH = f"""{_FORMS_SQL}, {_ASKED}, held AS (
  SELECT chunk_id, list_filter({_TOK.format('chapter_path')}, lambda t: NOT list_contains({_STOP}, t)) AS a, list_filter({_TOK.format('content')}, lambda t: NOT list_contains({_STOP}, t)) AS b FROM chunks), size AS (
  SELECT chunk_id, len(a) + len(b) AS length FROM held), one AS (
  SELECT chunk_id, 'a' AS field, unnest(a) AS word FROM held UNION ALL SELECT chunk_id, 'b', unnest(b) FROM held), m AS (
  SELECT chunk_id, lexeme, count(*) FILTER (WHERE field = 'a') AS ta, count(*) FILTER (WHERE field = 'b') AS tb FROM one JOIN forms USING (word) GROUP BY ALL), need AS (
  SELECT text_id, count(*) AS n FROM asked GROUP BY 1)"""
_BM25 = """stats AS (
  SELECT count(*)::double AS n, avg(length) AS mean FROM size), df AS (
  SELECT lexeme, count(*)::double AS df FROM m GROUP BY 1), kw AS (
  SELECT text_id, chunk_id, round(sum(ln(1.0 + (stats.n - df + 0.5) / (df + 0.5)) * (ta + tb) * 2.2 / ((ta + tb) + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS bm25
  FROM asked JOIN m USING (lexeme) JOIN df USING (lexeme) JOIN size USING (chunk_id) JOIN need USING (text_id), stats GROUP BY text_id, chunk_id HAVING count(*) = max(need.n))"""
_WTF = """wtf AS (
  SELECT text_id, chunk_id, round(sum(1.0 * ta / (ta + 1.0) + 0.4 * tb / (tb + 1.0)), 9)::double AS wtf
  FROM asked JOIN m USING (lexeme) JOIN need USING (text_id) GROUP BY text_id, chunk_id HAVING count(*) = max(need.n))"""


@query(f"SELECT doc_id, len({_TOK.format('text')})::int AS n_tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(f"""WITH {CHUNKS_SQL}, p AS (
  SELECT DISTINCT chunk_id, unnest(list_concat({_TOK.format('chapter_path')}, {_TOK.format('content')})) AS term FROM chunks)
SELECT term, count(*) AS df FROM p GROUP BY term""")
def postings_df(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(views.texts(spark, d))


@query(f"WITH {CHUNKS_SQL}, {_MATCH} SELECT chunk_id, lexeme AS term, ta AS in_path, tb AS in_content FROM m")
def lexeme_postings(spark: SparkSession, d: str) -> DataFrame:
    # A chunk stands in as many rows as it has vectors, or in one; that is looked up for postings, not for texts.
    vectors = table(spark, d, "embeddings").select("vec_id")
    held = lexical.postings(views.texts(spark, d), terms=list(FORMS)).join(vectors, F.col("chunk_id") == F.col("vec_id"), "left")
    counts = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("tf"))), F.lit(0)).alias(n) for f, n in (("A", "in_path"), ("B", "in_content"))]
    return held.groupBy("chunk_id", "term").agg(*counts)


@query(f"WITH {CHUNKS_SQL}, {_MATCH} SELECT lexeme AS term, count(*) AS df, sum(ta)::bigint AS in_path, sum(tb)::bigint AS in_content FROM m GROUP BY lexeme")
def index_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What the stored index has of some lexemes, summed up over its blocks; it is made here if it isn't yet."""
    blocks = postings.own_blocks(spark, views.index(spark, d), list(FORMS))
    held = postings.places(F.col("packed"), lambda slot, ta, tb: F.struct(ta.alias("a"), tb.alias("b")))
    counts = [F.sum(F.aggregate(held, F.lit(0).cast("bigint"), lambda n, p: n + p[f])).alias(name) for f, name in (("a", "in_path"), ("b", "in_content"))]
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), *counts)


@query(f"WITH {CHUNKS_SQL}, {_MATCH}, {_WTF} SELECT text_id, chunk_id, wtf FROM wtf")
def stored_postings_match(spark: SparkSession, d: str) -> DataFrame:
    """All matches of all texts from the stored index."""
    asked = {i: lexical.query_terms(t) for i, t in enumerate(TEXTS)}
    return postings.matches(spark, views.index(spark, d), asked).select(F.col("query_id").cast("int").alias("text_id"), "chunk_id", F.col("score").alias("wtf"))


@query(f"WITH {CHUNKS_SQL}, {_MATCH}, {_WTF} SELECT chunk_id FROM wtf WHERE text_id = 0")
def keyword_and_match(spark: SparkSession, d: str) -> DataFrame:
    return postings.matches(spark, views.index(spark, d), {0: lexical.query_terms(TEXTS[0])}).select("chunk_id")


@query(f"""WITH {CHUNKS_SQL}, {_MATCH}, {_WTF}
SELECT chunk_id, wtf, row_number() OVER (ORDER BY wtf DESC, chunk_id)::int AS rank_kw FROM wtf WHERE text_id = 0 ORDER BY wtf DESC, chunk_id LIMIT 30""")
def keyword_wtf_rank(spark: SparkSession, d: str) -> DataFrame:
    best = postings.top(spark, views.index(spark, d), {0: lexical.query_terms(TEXTS[0])}, 30, "wtf")
    return best.select("chunk_id", F.col("score").alias("wtf"), F.col("rank_kw").cast("int").alias("rank_kw"))


@query(f"WITH {CHUNKS_SQL}, {_MATCH}, {_WTF} SELECT chunk_id, wtf FROM wtf WHERE text_id = 3")
def keyword_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index: one pass over all texts."""
    return lexical.match_all(views.texts(spark, d), lexical.query_terms(TEXTS[3]))


@query(f"WITH {CHUNKS_SQL}, {_MATCH}, {_BM25} SELECT chunk_id, bm25, row_number() OVER (ORDER BY bm25 DESC, chunk_id)::int AS rank_kw FROM kw WHERE text_id = 0 ORDER BY bm25 DESC, chunk_id LIMIT 30")
def keyword_bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    best = postings.top(spark, views.index(spark, d), {0: lexical.query_terms(TEXTS[0])}, 30)
    return best.select("chunk_id", F.col("score").alias("bm25"), F.col("rank_kw").cast("int").alias("rank_kw"))


@query(f"""WITH {CHUNKS_SQL}, {_MATCH}, {_BM25}, r AS (SELECT text_id, chunk_id, row_number() OVER (PARTITION BY text_id ORDER BY bm25 DESC, chunk_id) AS rank_kw FROM kw)
SELECT text_id AS query_id, chunk_id, rank_kw FROM r WHERE rank_kw <= 20""")
def keyword_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Several texts, and one of stop words alone, which matches nothing."""
    return retrieval.keyword_ranks(views.chunks(spark, d), dict(enumerate([*TEXTS, "the and of it"])), 20, index=views.index(spark, d))


# ------------------------------------------------------------------ hybrid search


def _hybrid_sql(select: str, where: str = "true", queries: str = "vec_id = 0", limit: int = 15) -> str:
    return f"""WITH {CHUNKS_SQL.replace('chunks AS', 'every AS')}, chunks AS (SELECT * FROM every WHERE {where}), {_MATCH}, {_BM25},
    q AS (SELECT vec_id AS query_id, (vec_id // 100) % {len(TEXTS)} AS text_id, embedding FROM embeddings WHERE {queries}), s AS (
      SELECT q.query_id, c.chunk_id, {_SIM} AS s FROM chunks c, q WHERE c.embedding IS NOT NULL), v AS (
      SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank_vec FROM s WHERE s >= {FLOOR}) WHERE rank_vec <= 30), k AS (
      SELECT q.query_id, z.* FROM q JOIN (SELECT text_id, chunk_id, row_number() OVER (PARTITION BY text_id ORDER BY bm25 DESC, chunk_id) AS rank_kw FROM kw) z USING (text_id) WHERE rank_kw <= 30), f AS (
      SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, rank_vec, rank_kw,
        round(coalesce(1.0::double / (60.0::double + rank_vec), 0) + coalesce(1.0::double / (60.0::double + rank_kw), 0), 9) AS rrf_score
      FROM v FULL OUTER JOIN k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id), r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f)
    SELECT {select} FROM r WHERE rank <= {limit}"""


_HITS = "chunk_id, rank_vec, rank_kw, rrf_score"


def _hybrid(spark, d, chunk_type=None):
    return retrieval.hybrid(views.chunks(spark, d), {0: TEXTS[0]}, {0: views.vector_of(spark, d, 0)}, 15, Retrieval(floor=FLOOR), chunk_type, index=views.index(spark, d, chunk_type))


@query(_hybrid_sql(_HITS))
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("chunk_id", "rank_vec", "rank_kw", "rrf_score")


@query(_hybrid_sql(_HITS, "chunk_type = 'text'"))
def hybrid_rrf_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, "text").select("chunk_id", "rank_vec", "rank_kw", "rrf_score")


@query(_hybrid_sql("query_id, rank, " + _HITS, queries="vec_id % 100 = 0", limit=10))
def hybrid_rrf_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector with one of the texts."""
    pool = views.chunks(spark, d)

    def blocks():
        for block in _every_hundredth(spark, d):
            asked = {q: TEXTS[q // 100 % len(TEXTS)] for q in block}
            yield retrieval.hybrid(pool, asked, block, 10, Retrieval(floor=FLOOR), index=views.index(spark, d)).select("query_id", "rank", "chunk_id", "rank_vec", "rank_kw", "rrf_score")

    return in_blocks(spark, blocks())


@query(f"""WITH t AS ({_topk_sql(10)}) SELECT chunk_id, cosine_similarity, NULL::bigint AS rank_vec, NULL::bigint AS rank_kw, NULL::double AS rrf_score FROM t""")
def vector_only_shape(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_only(views.chunks(spark, d), {0: views.vector_of(spark, d, 0)}, 10).drop("query_id")


#: What the re-ranker is asked: inflected forms, and a word that no text has.
RERANK_TEXT = "therlying thinly erstes anea"


def _rerank_sql(words: list[str]) -> str:
    grams = "list_distinct(list_transform(range(1, length({0}) + 1), lambda i: ('<' || {0} || '>')[i:i + 2]))".format
    return f"""hits AS ({_hybrid_sql(_HITS)}), w AS (SELECT unnest({words}) AS q), texts AS (
  SELECT h.*, list_distinct({_TOK.format('text')}) AS own FROM hits h JOIN documents d ON d.doc_id = h.chunk_id), near AS (
  SELECT chunk_id, q, max(len(list_intersect({grams('q')}, {grams('t')})) / sqrt(len({grams('q')}) * len({grams('t')}))) AS s
  FROM (SELECT chunk_id, unnest(own) AS t FROM texts), w GROUP BY ALL), l AS (
  SELECT chunk_id, rrf_score, round(8.0::double * coalesce(avg(s), 0) - 4.0, 9) AS raw_rerank_score FROM hits LEFT JOIN near USING (chunk_id) GROUP BY ALL), rr AS (
  SELECT chunk_id, rrf_score, raw_rerank_score, round(1.0::double / (1.0::double + exp(-raw_rerank_score)), 9) AS rerank_score FROM l)"""


@query(f"WITH {_rerank_sql(['therlying', 'thinly', 'erstes', 'anea'])} SELECT * FROM rr ORDER BY rerank_score DESC, rrf_score DESC NULLS LAST, chunk_id LIMIT 5")
def rerank_topn(spark: SparkSession, d: str) -> DataFrame:
    hits = _hybrid(spark, d).select("chunk_id", "rrf_score")
    full = hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    return retrieval.rerank(full, RERANK_TEXT, 5).select("chunk_id", "rrf_score", "raw_rerank_score", "rerank_score")


_SEARCH = _rerank_sql(["ther", "thin"])


@query(f"WITH {_SEARCH} SELECT chunk_id, rrf_score, rerank_score FROM rr ORDER BY rerank_score DESC, rrf_score DESC NULLS LAST, chunk_id LIMIT 4")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The pool of candidates goes to the reranker, which keeps the best four."""
    settings = Retrieval(floor=FLOOR, rerank=True, top_k=4)
    return retrieval.search(views.chunks(spark, d), TEXTS[0], views.vector_of(spark, d, 0), settings, index=views.index(spark, d)).select("chunk_id", "rrf_score", "rerank_score")


@query("SELECT 0::bigint AS chunk_id, 0.0::double AS cosine_similarity WHERE false")
def blank_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(views.chunks(spark, d), "   ", views.vector_of(spark, d, 0), use_hybrid=False).select("chunk_id", "cosine_similarity")


@query(rf"""WITH h AS ({_hybrid_sql('query_id, ' + _HITS)})
SELECT h.chunk_id, '### ' || d.source || ' `' || CASE WHEN coalesce(e.label, d.doc_id) % 2 = 0 THEN 'text' ELSE 'table' END || '`' || chr(10) || '- vector rank ' || coalesce(rank_vec::varchar, '未入榜') || ', keyword rank ' || coalesce(rank_kw::varchar, '未入榜')
  || ', fused ' || printf('%.5f', rrf_score) || chr(10) || chr(10) || CASE WHEN length(d.text) > 250 THEN left(d.text, 250) || '...' ELSE d.text END AS markdown
FROM h JOIN documents d ON d.doc_id = h.chunk_id LEFT JOIN embeddings e ON e.vec_id = h.chunk_id""")
def rendered_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _hybrid(spark, d).join(views.chunks(spark, d).drop("embedding"), "chunk_id")
    return retrieval.rendered(hits).select("chunk_id", "markdown")


@query()
def inverted_list_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector by the approximate index, which holds every row."""
    chunks, path = views.chunks(spark, d).select("chunk_id", "embedding"), scratch(spark)
    index = centroids(chunks)
    with_list(chunks, index).write.partitionBy("list").parquet(path)
    listed = spark.read.parquet(path)
    return in_blocks(spark, (nearest_in_lists(listed, index, block, 10) for block in _every_hundredth(spark, d)))


def _quantised(spark: SparkSession, d: str):
    """(stored codes, quantizer, number of vectors, rows that a query scores exactly: a tenth, a hundred at most)."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    quantizer, n = pq.fit(rows), rows.count()
    return pq.store(rows, quantizer), quantizer, n, max(1, min(100, n // 10))


@query()
def quantised_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector by product quantisation on inverted lists."""
    stored, quantizer, _, keep = _quantised(spark, d)
    return in_blocks(spark, (pq.nearest(stored, quantizer, block, 10, keep) for block in _every_hundredth(spark, d)))


@query("""SELECT count(*) FILTER (WHERE vec_id % 100 = 0) AS queries, count(*) AS vectors, true AS recall_of_nine_tenths, true AS a_tenth_scored FROM embeddings""")
def quantised_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ten nearest of each query are found to nine tenths, while a tenth of the vectors is scored exactly at most."""
    stored, quantizer, n, keep = _quantised(spark, d)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")

    def blocks():
        for block in _every_hundredth(spark, d):
            exact = nearest(rows, block, 10).select("query_id", "chunk_id", F.lit(True).alias("exact"))
            near = pq.nearest(stored, quantizer, block, 10, keep).select("query_id", "chunk_id", F.lit(True).alias("near"))
            scored = pq.survivors(stored, quantizer, block, keep, pq.PROBES).groupBy("query_id").agg(F.count("*").alias("scored"))
            found = exact.join(near, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("exact").alias("exact"), F.count("near").alias("near"))
            yield found.join(scored, "query_id", "left")

    every = in_blocks(spark, blocks())
    return every.agg(F.count("*").alias("queries"), F.lit(n).alias("vectors"), (F.sum("near") >= 0.9 * F.sum("exact")).alias("recall_of_nine_tenths"), (F.max("scored") <= n / 10).alias("a_tenth_scored"))


@query("""SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE NULL END, 0.0), nullif(CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END, 0.0), nullif(value / 2, 0.0), 0.0) AS score FROM events""")
def audit_score_pick(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rerank = F.when(F.col("event_id") % 3 == 0, F.lit(0.0))
    rrf = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0)
    return e.select("event_id", retrieval.audit_score(rerank, rrf, F.col("value") / 2).alias("score"))


# ------------------------------------------------------------------ log analytics


@query(f"""WITH {AUDIT_SQL} SELECT query_type, count(*) AS total_queries, round(avg(total_latency_ms), 2) AS avg_total_ms, round(avg(vector_latency_ms), 2) AS avg_vector_ms,
  round(avg(keyword_latency_ms), 2) AS avg_keyword_ms, round(avg(rerank_latency_ms), 2) AS avg_rerank_ms, max(total_latency_ms) AS max_total_ms, min(total_latency_ms) AS min_total_ms FROM audit GROUP BY query_type""")
def latency_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return analytics.latency_by_mode(views.audit(spark, d))


@query(f"""WITH {AUDIT_SQL} SELECT query, count(*) AS frequency, round(avg(total_latency_ms), 2) AS avg_latency_ms, round(avg(result_count), 1) AS avg_result_count
  FROM audit GROUP BY query ORDER BY frequency DESC, query LIMIT 10""")
def top_queries(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_queries(views.audit(spark, d))


def _newest():
    """The numbers of a session's kept turns, from the newest."""
    return F.array_join(F.reverse(F.transform("turns", lambda t: t["turn_id"].cast("string"))), ",").alias("newest")


def _sessions(spark, d):
    return sessions.session_state(views.turns(spark, d))


@query("""SELECT conv_id::varchar AS session_id, count(*)::int AS turn_count, round(avg(length(text)), 2) AS avg_turn_latency_ms, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.session_summary(_sessions(spark, d), limit=None)
    return out.select("session_id", "turn_count", "avg_turn_latency_ms", F.unix_seconds("updated_at").alias("last_turn"))


@query("SELECT (1 + length(text) % 5)::int AS rating, count(*) AS count FROM conversations WHERE turn % 2 = 1 GROUP BY 1")
def feedback_distribution(spark: SparkSession, d: str) -> DataFrame:
    return analytics.feedback_distribution(_sessions(spark, d))


@query("SELECT coalesce(round(avg(1 + length(text) % 5), 2), 0.0) AS average_rating, count(*) AS total_feedback FROM conversations WHERE turn % 2 = 1")
def feedback_average(spark: SparkSession, d: str) -> DataFrame:
    return analytics.feedback_average(analytics.feedback_distribution(_sessions(spark, d)))


@query(f"""WITH {CHUNKS_SQL} SELECT count(*) AS total_chunks, count(*) FILTER (WHERE chunk_type = 'text') AS text_chunks, count(*) FILTER (WHERE chunk_type = 'table') AS table_chunks,
  (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM events) AS audit_logs FROM chunks""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.corpus_stats(views.chunks(spark, d), table(spark, d, "conversations").select("conv_id").distinct(), table(spark, d, "events"))


@query(f"WITH {AUDIT_SQL} SELECT query_type, round(quantile_cont(total_latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(total_latency_ms, 0.99), 6) AS p99_ms FROM audit GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.latency_percentiles(views.audit(spark, d))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_type, count(*) AS chunks, round(count(*)::double / (SELECT count(*) FROM chunks), 6) AS share FROM chunks GROUP BY 1")
def path_share_by_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.share_by_type(views.chunks(spark, d))


# ------------------------------------------------------------------ sessions


@query("""SELECT conv_id::varchar AS session_id, arg_min(role, turn) AS user_id, count(*)::int AS turn_count, array_to_string(list(turn ORDER BY turn DESC)[1:3], ',') AS newest, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def session_upsert_state(spark: SparkSession, d: str) -> DataFrame:
    out = sessions.session_state(views.turns(spark, d), 3)
    return out.select("session_id", "user_id", "turn_count", _newest(), F.unix_seconds("created_at").alias("first_turn"), F.unix_seconds("updated_at").alias("last_turn"))


@query("""SELECT conv_id::varchar AS session_id, arg_min(role, turn) AS user_id, count(*)::int AS turn_count, array_to_string(list(turn ORDER BY turn DESC)[1:3], ',') AS newest, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def session_state_store(spark: SparkSession, d: str) -> DataFrame:
    """The same states kept in the state store, over three starts; two thirds of the turns come late."""
    turns, arriving, out, at = views.turns(spark, d), scratch(spark), scratch(spark), scratch(spark)
    for k in (2, 0, 1):
        turns.where(F.col("turn.turn_id") % 3 == k).write.mode("append").parquet(arriving)
        state.keep_sessions(spark.readStream.schema(turns.schema).parquet(arriving), out, at, 3).awaitTermination()
    kept = state.kept_sessions(spark, out)
    return kept.select("session_id", "user_id", "turn_count", _newest(), F.unix_seconds("created_at").alias("first_turn"), F.unix_seconds("updated_at").alias("last_turn"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.last_turns(table(spark, d, "conversations"), 3, "conv_id").select("conv_id", "turn", "role")


@query("SELECT event_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def ttl_retained(spark: SparkSession, d: str) -> DataFrame:
    return sessions.retained(table(spark, d, "events"), 7, ts="ts").select("event_id", "event_type")


@query("SELECT conv_id::varchar AS session_id, turn::int AS turn_id, length(text)::double AS latency_ms FROM conversations")
def turn_unwind(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("session_id", F.explode("turns").alias("t")).select("session_id", "t.turn_id", "t.latency_ms")


@query(f"WITH {AUDIT_SQL} SELECT (length(query) >= 1 AND total_latency_ms >= 40) AS valid, count(*) AS events FROM audit GROUP BY 1")
def audit_valid_split(spark: SparkSession, d: str) -> DataFrame:
    late = views.audit(spark, d).withColumn("total_latency_ms", F.col("total_latency_ms") - 40)
    return late.groupBy(sessions.audit_is_valid().alias("valid")).agg(F.count("*").alias("events"))


# ------------------------------------------------------------------ text

_SENT = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({}, '([。！？\n])', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


@query(f"SELECT doc_id, len({_SENT.format('text')})::int AS sentences FROM documents")
def sentence_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"))


@query(rf"""WITH s AS (SELECT doc_id, {_SENT.format('text')} AS x FROM documents), u AS (
  SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM s), c AS (
  SELECT doc_id, t, i, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM u), j AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS p FROM c WHERE after < 250 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN p IS NULL THEN '' WHEN regexp_matches(p, '[。！？.!?]$') THEN p ELSE p || '。' END AS prefix FROM documents d LEFT JOIN j USING (doc_id)""")
def overlap_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.overlap_prefix(F.col("text")).alias("prefix"))


@query(r"""SELECT page_id, left(regexp_replace(regexp_replace(replace(html, '<p>', '<p style="x">'), '\s+style=''[^'']*''', '', 'g'), '\s+style="[^"]*"', '', 'g'), 3500) AS clean FROM pages""")
def clean_for_embedding(spark: SparkSession, d: str) -> DataFrame:
    styled = F.replace(F.col("html"), F.lit("<p>"), F.lit('<p style="x">'))
    return table(spark, d, "pages").select("page_id", text.clean_for_embedding(styled).alias("clean"))


@query("""WITH l AS (SELECT source, doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents), f AS (
  SELECT source, b, trim(string_split(text, chr(10))[1]) AS line FROM l WHERE b IS NOT NULL)
SELECT source AS source_file, count(*) AS pairs, count(*) FILTER (WHERE length(line) > 0 AND contains(b, line)) AS overlapping FROM f GROUP BY source""")
def adjacent_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return evaluation.overlap_check(docs.select(F.col("source").alias("source_file"), F.col("doc_id").alias("chunk_index"), F.lit("text").alias("chunk_type"), F.col("text").alias("content")))


@query("SELECT source, row_number() OVER (ORDER BY substr(source, 4)::int)::int AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select("source").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(text.natural_key(F.col("source")), "source")))


# ------------------------------------------------------------------ ingest

_LINES = MANUALS_SQL + r""", ord AS (
  SELECT *, row_number() OVER (PARTITION BY manual ORDER BY regexp_extract(source_file, '\d+')::bigint) AS file_ord FROM manuals), ln AS (
  SELECT manual, source_file, file_ord, unnest(x) AS v, unnest(range(len(x))) AS line FROM (
    SELECT *, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM ord)), mk AS (
  SELECT *, CASE WHEN regexp_matches(v, '^(#{1,6})[ \t]+(.*?)[ \t]*$') AND regexp_extract(v, '^(#{1,6})[ \t]+(.*?)[ \t]*$', 2) <> '' THEN length(regexp_extract(v, '^(#{1,6})[ \t]+', 1)) ELSE 0 END AS level,
    regexp_extract(v, '^(#{1,6})[ \t]+(.*?)[ \t]*$', 2) AS title FROM ln), st AS (
  SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS h1,
    last_value(CASE WHEN level = 2 THEN title WHEN level = 1 THEN '' END IGNORE NULLS) OVER w AS h2,
    sum((level > 0)::int) OVER (PARTITION BY manual, file_ord ORDER BY line) AS section
  FROM mk WINDOW w AS (PARTITION BY manual ORDER BY file_ord, line)), pt AS (
  SELECT *, list_filter([h1, h2], lambda t: t IS NOT NULL AND t <> '') AS titles FROM st), sec AS (
  SELECT manual, source_file, section::bigint AS section, regexp_replace(string_agg(v, chr(10) ORDER BY line), '^\s+|\s+$', '', 'g') AS text,
    arg_max(CASE WHEN len(titles) = 0 THEN '未分類章節' WHEN length(array_to_string(titles, ' / ')) > 150 AND len(titles) > 2 THEN titles[1] || ' / ... / ' || titles[-1] ELSE array_to_string(titles, ' / ') END, line) AS chapter_path
  FROM pt GROUP BY ALL), sections AS (SELECT * FROM sec WHERE text <> '')"""


@query(f"WITH {_LINES} SELECT manual, source_file, section, length(text)::int AS chars, sha256(text) AS text_sha256 FROM sections")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sections(views.manuals(spark, d)).select("manual", "source_file", "section", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {_LINES} SELECT manual, source_file, section, chapter_path FROM sections")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sections(views.manuals(spark, d)).select("manual", "source_file", "section", "chapter_path")


@query(rf"""WITH {_LINES}, t AS (SELECT source_file, unnest(regexp_extract_all(text, '(?i)(<table(?:\s+[^>]*)?>(?:.|\n)*?</table>)')) AS x FROM sections)
SELECT source_file, count(*) AS tables, sum(length(x))::bigint AS chars FROM t GROUP BY 1""")
def table_isolation(spark: SparkSession, d: str) -> DataFrame:
    parts = ingest.pieces(ingest.sections(views.manuals(spark, d)))
    return parts.where("chunk_type = 'table'").groupBy("source_file").agg(F.count("*").alias("tables"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, CASE WHEN length(lang || ' / ' || source || ' / ' || text) > 150 THEN lang || ' / ... / ' || text ELSE lang || ' / ' || source || ' / ' || text END AS path FROM (SELECT doc_id, lang, source, trim(text, ' ') AS text FROM documents) WHERE text <> ''")
def breadcrumb_from_map(spark: SparkSession, d: str) -> DataFrame:
    """Paths of maps from levels to titles; the text stands for a very long title."""
    meta = F.create_map(F.lit("H1"), F.col("lang"), F.lit("H2"), F.col("source"), F.lit("H4"), F.col("text"))
    return table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", ingest.path_of(meta).alias("path"))


@query("""SELECT doc_id, regexp_replace(source || '.md', '\\.[^.]*$', '') || '_c' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS chunk_id FROM documents""".replace("\\\\", "\\"))
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, d, "documents").select("doc_id", text.chunk_id(F.concat("source", F.lit(".md")), at).alias("chunk_id"))


@query()
def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("piece_id"), "text")
    return ingest.semantic_chunks(rows).select("piece_id", "chunk", F.length("text").alias("chars"))


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(ingest.recursive_chunks()("text")).alias("chunk", "text"))
    return rows.select("doc_id", "chunk", F.length("text").alias("chars"))


@query()
def ingest_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest(views.manuals(spark, d), Chunking()).select("chunk_id", "source_file", "chunk_type", "chunk_index", "chapter_path", F.length("content").alias("chars"), F.size("embedding").alias("dims"))


# ------------------------------------------------------------------ merge


@query("""WITH o AS (SELECT doc_id AS chunk_id, source AS source_file, lang AS chapter_path, text AS content FROM documents), n AS (
  SELECT doc_id + 50 AS chunk_id, 'new' AS source_file, 'new / ' || lang AS chapter_path, text AS content FROM documents)
SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, coalesce(o.source_file, n.source_file) AS source_file,
  CASE WHEN n.chunk_id IS NOT NULL THEN n.chapter_path ELSE o.chapter_path END AS chapter_path,
  CASE WHEN n.chunk_id IS NOT NULL THEN n.content ELSE o.content END AS content FROM o FULL OUTER JOIN n ON o.chunk_id = n.chunk_id""")
def chunk_upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """All documents, and all again under other ids: some of these are new, most replace a row."""
    docs = table(spark, d, "documents")
    old = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.col("lang").alias("chapter_path"), F.col("text").alias("content"))
    new = docs.select((F.col("doc_id") + 50).alias("chunk_id"), F.lit("new").alias("source_file"), F.concat(F.lit("new / "), "lang").alias("chapter_path"), F.col("text").alias("content"))
    return merge.upsert(old, new)


@query("""WITH o AS (SELECT doc_id AS chunk_id, source AS source_file, lang AS chapter_path, text AS content FROM documents), n AS (
  SELECT doc_id + 50 AS chunk_id, 'new' AS source_file, 'new / ' || lang AS chapter_path, text AS content FROM documents)
SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, coalesce(o.source_file, n.source_file) AS source_file,
  CASE WHEN n.chunk_id IS NOT NULL THEN n.chapter_path ELSE o.chapter_path END AS chapter_path,
  CASE WHEN n.chunk_id IS NOT NULL THEN n.content ELSE o.content END AS content FROM o FULL OUTER JOIN n ON o.chunk_id = n.chunk_id""")
def chunk_upsert_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same into a stored table, of which each merge rewrites the buckets that it touches."""
    docs, path = table(spark, d, "documents"), scratch(spark)
    old = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.col("lang").alias("chapter_path"), F.col("text").alias("content"))
    new = docs.select((F.col("doc_id") + 50).alias("chunk_id"), F.lit("new").alias("source_file"), F.concat(F.lit("new / "), "lang").alias("chapter_path"), F.col("text").alias("content"))
    for rows in (old, new):
        versions.upsert(rows, path, old.schema)
    return versions.read(spark, path, old.schema)


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS total, count(DISTINCT chunk_id) AS distinct_keys, (count(*) = count(DISTINCT chunk_id) AND count(*) > 0) AS passed FROM chunks")
def chunk_key_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.uniqueness_check(views.chunks(spark, d))


# ------------------------------------------------------------------ evaluation

_HELD_SQL = "held AS (SELECT b.item_id, d.doc_id, d.source, strpos(d.text, b.text)::int AS place, length(b.text)::int AS chars FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


#: Benchmark items of under three tokens that are broadcast at once, about.
SHORT_BLOCK = 10_000


def contained(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, doc_id, source, place, chars): benchmark items that stand in documents.

    Documents meet items on a hashed window of the tokens inside an item, five of them or as many as
    it has between the first and the last; then the text itself is looked up. Only the documents
    that are met are read again; which ones is written, so that no text is searched twice. Items of under three tokens have no inner token: they are looked up
    in every document, in blocks of a counted number.
    """
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").where("text is not null")
    words = text.tokens(F.col("text"))
    keyed = items.select("item_id", F.col("text").alias("item"), words.alias("w"))
    inner = F.least(F.size("w") - 2, F.lit(5))
    long = keyed.where(F.size("w") >= 3).select("item_id", inner.alias("size"), F.xxhash64(F.slice("w", F.lit(2), inner)).alias("window"))
    sizes = sorted(r["size"] for r in long.select("size").distinct().collect())  # five at most

    def windows(k: int):
        starts = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(k))))), lambda h: F.struct(F.lit(k).alias("size"), h.alias("window")))

    full = docs.select("doc_id", "source", "text")
    found = full.limit(0).select("*", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit("").alias("item"))
    if sizes:
        dealt = docs.select("doc_id", words.alias("w")).select("doc_id", F.explode_outer(F.concat(*map(windows, sizes))).alias("x")).select("doc_id", "x.size", "x.window")
        pairs = stored(dealt.join(broadcast_if_small(long), ["size", "window"]).select("doc_id", "item_id").distinct())
        texts = broadcast_if_small(pairs.join(items.select("item_id", F.col("text").alias("item")), "item_id"), 50_000)
        found = full.join(texts, "doc_id").select("doc_id", "source", "text", "item_id", "item")
    short = keyed.where(F.size("w") < 3).select("item_id", "item")
    blocks = ceil(short.count() / SHORT_BLOCK)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == k) if blocks > 1 else short
        found = found.unionByName(full.join(F.broadcast(block), F.contains("text", "item")))
    return found.where(F.contains("text", "item")).select("item_id", "doc_id", "source", F.expr("position(item in text)").alias("place"), F.length("item").alias("chars"))


@query(f"WITH {_HELD_SQL} SELECT item_id, doc_id FROM held")
def benchmark_containment(spark: SparkSession, d: str) -> DataFrame:
    return contained(spark, d).select("item_id", "doc_id")


@query(f"WITH {_HELD_SQL} SELECT item_id, count(*) AS documents, min(place) AS first_place, true AS supported FROM held GROUP BY 1 UNION ALL SELECT item_id, 0, NULL, false FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM held)")
def context_support(spark: SparkSession, d: str) -> DataFrame:
    of = contained(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("place").alias("first_place"))
    every = table(spark, d, "benchmark").select("item_id").join(of, "item_id", "left")
    return every.select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_place", F.col("documents").isNotNull().alias("supported"))


_FLAGS_SQL = f"""{_HELD_SQL}, {CHUNKS_SQL}, cases AS (
  SELECT b.item_id AS case_id, e.embedding, ['src' || (b.item_id % 20)] AS files, {_TOK.format('b.text')}[1:3] AS words,
    (SELECT coalesce(list(doc_id), []) FROM held h WHERE h.item_id = b.item_id) AS ids
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id), s AS (
  SELECT q.case_id, q.ids, q.files, q.words, c.chunk_id, c.source_file, c.content, {_SIM} AS s FROM cases q, chunks c WHERE c.embedding IS NOT NULL), r AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, chunk_id) AS rank FROM s), flags AS (
  SELECT case_id, chunk_id, rank, greatest(len(ids), len(files), 1) AS targets,
    (list_contains(ids, chunk_id) OR (list_contains(files, source_file) AND len(list_filter(words, lambda w: contains(lower(content), w))) >= least(2, len(words)))) AS relevant
  FROM r WHERE rank <= 10)"""
_METRICS_SQL = f"""{_FLAGS_SQL}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k), pk AS (
  SELECT case_id, k, count(*) FILTER (WHERE relevant AND rank <= k) AS hits, max(targets) AS targets, min(rank) FILTER (WHERE relevant AND rank <= k) AS first_rank FROM flags, ks GROUP BY 1, 2), metrics AS (
  SELECT case_id, k, hits, least(1.0::double, hits::double / targets) AS recall, hits::double / k AS precision, (hits > 0)::int::double AS hit, coalesce(1.0::double / first_rank, 0) AS mrr FROM pk)"""


def _flags(spark: SparkSession, d: str, k: int = 10, block: int = 1000) -> DataFrame:
    """Whether each case's nearest chunks are relevant; cases are run in blocks of queries."""
    chunks = views.chunks(spark, d)
    items = table(spark, d, "benchmark")
    vectors = table(spark, d, "embeddings")
    asked = items.join(vectors, items.item_id == vectors.vec_id).select("item_id", "embedding")
    blocks = max(1, ceil(asked.count() / block))
    dealt = (asked.where(F.pmod("item_id", F.lit(blocks)) == b) for b in range(blocks))
    near = in_blocks(spark, (nearest(chunks, {r[0]: list(r[1]) for r in some.collect()}, k) for some in dealt))
    ids = contained(spark, d).groupBy("item_id").agg(F.collect_set("doc_id").alias("ids"))
    cases = items.join(ids, "item_id", "left").select(
        F.col("item_id").alias("query_id"),
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"),
        F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("files"),
        F.slice(text.tokens(F.col("text")), 1, 3).alias("words"),
    )
    full = near.join(chunks.select("chunk_id", "source_file", "content"), "chunk_id").join(cases, "query_id")
    relevant = evaluation.is_relevant(F.col("chunk_id").cast("string"), F.col("source_file"), F.col("content"), F.transform("ids", lambda i: i.cast("string")), F.col("files"), F.col("words"))
    return full.select(F.col("query_id").alias("case_id"), "chunk_id", F.col("rank_vec").cast("bigint").alias("rank"), evaluation.targets(F.transform("ids", lambda i: i.cast("string")), F.col("files")).alias("targets"), relevant.alias("relevant"))


def _metrics(spark, d):
    return evaluation.metrics_at_k(_flags(spark, d), [10, 5, 1, 3, 3])


@query(f"WITH {_FLAGS_SQL} SELECT case_id, chunk_id, rank, targets::int AS targets, relevant FROM flags")
def relevance_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


@query(f"WITH {_METRICS_SQL} SELECT case_id, k, recall FROM metrics")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("case_id", "k", "recall")


@query(f"WITH {_METRICS_SQL} SELECT case_id, k, precision FROM metrics")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("case_id", "k", "precision")


@query(f"WITH {_METRICS_SQL} SELECT case_id, k, hit FROM metrics")
def hit_rate_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("case_id", "k", "hit")


@query(f"WITH {_METRICS_SQL} SELECT case_id, k, mrr FROM metrics")
def mrr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("case_id", "k", "mrr")


@query(f"WITH {_METRICS_SQL} SELECT k, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(hit), 9) AS hit_rate, round(avg(mrr), 9) AS mrr FROM metrics GROUP BY k")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(_metrics(spark, d))


@query(f"""WITH {CHUNKS_SQL}, cases AS (
  SELECT b.item_id, e.embedding, coalesce(CASE b.item_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' END, 'text') AS kind FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id), s AS (
  SELECT q.item_id, c.chunk_id, {_SIM} AS s FROM cases q JOIN chunks c ON c.chunk_type = q.kind WHERE c.embedding IS NOT NULL), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, chunk_id)::int AS rank_vec FROM s)
SELECT item_id AS query_id, chunk_id, s AS cosine_similarity, rank_vec FROM r WHERE rank_vec <= 3""")
def candidates_by_case_type(spark: SparkSession, d: str) -> DataFrame:
    """Cases with a type of their own keep it; the others take the general filter."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    kind = F.when(F.col("item_id") % 3 == 0, "text").when(F.col("item_id") % 3 == 1, "table")
    cases = table(spark, d, "benchmark").select("item_id").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), "embedding", kind.alias("expected_type"))
    return evaluation.candidates(views.chunks(spark, d), cases, 3, "text")


@query("SELECT * FROM (VALUES ('TC-01', 'text', 2, 3), ('TC-02', 'table', 1, 3), ('TC-03', 'text', 1, 3), ('TC-04', 'text', 3, 3), ('TC-05', 'text', 2, 3), ('TC-06', 'text', 2, 3), ('TC-07', 'text', 1, 3)) AS t(id, expected_type, files, keywords)")
def builtin_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return builtin_cases(spark).select("id", "expected_type", F.size("expected_files").alias("files"), F.size("required_keywords").alias("keywords"))


@query("SELECT item_id::varchar AS id, text AS query, ['src' || (item_id % 20)] AS expected_files FROM benchmark")
def json_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Cases as they are read back from files that hold a JSON array each, of a bounded size."""
    items, path = table(spark, d, "benchmark"), scratch(spark)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, ceil(items.count() / 1000))))
    case = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("expected_files"))
    items.groupBy(block.alias("block")).agg(F.to_json(F.collect_list(case)).alias("value")).write.partitionBy("block").text(path)
    return benchmark_cases(spark, path).select("id", "query", "expected_files")


@query(f"WITH {_METRICS_SQL} SELECT k::varchar AS k, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(hit), 9) AS hit_rate, round(avg(mrr), 9) AS mrr FROM metrics GROUP BY 1")
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary as it is read back from the report's JSON."""
    path, metrics = scratch(spark), stored(_metrics(spark, d))
    evaluation.write_report(evaluation.summary(metrics), metrics, path)
    return spark.read.schema("k string, recall double, precision double, hit_rate double, mrr double").json(f"{path}/summary")


_EMBEDDED = "SELECT count(*) AS total, count(embedding) AS embedded, bool_and(len(embedding) = 64) AS dims_ok FROM chunks"


@query(f"WITH {CHUNKS_SQL}, c AS ({_EMBEDDED}) SELECT *, total = embedded AND total >= 300 AND dims_ok AS passed FROM c")
def embedding_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.embedding_check(views.chunks(spark, d), 64)


_TABLES = "SELECT count(*) AS tables, bool_and(starts_with(lower(trim(content)), '<table') AND ends_with(lower(trim(content)), '</table>')) AS passed FROM chunks WHERE chunk_type = 'table'"


@query(f"WITH {CHUNKS_SQL} {_TABLES}")
def table_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.table_check(views.chunks(spark, d))


_BEST = f"SELECT coalesce(bool_or(s > 0.3 AND (contains(lower(content), 'the') OR contains(lower(content), 'que'))), false) AS passed FROM (SELECT content, {_SIM} AS s FROM chunks c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE c.embedding IS NOT NULL AND {{}} ORDER BY s DESC, chunk_id LIMIT 1)"


def _best_hit(spark, d, chunk_type=None):
    hits = _near(spark, d, 1, chunk_type=chunk_type)
    return evaluation.top_hit_check(hits.join(views.chunks(spark, d).select("chunk_id", "content"), "chunk_id"), 0.3, "the", "que")


@query(f"WITH {CHUNKS_SQL} {_BEST.format('true')}")
def top_hit_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return _best_hit(spark, d)


@query(f"""WITH {CHUNKS_SQL}, e AS ({_EMBEDDED}), t AS ({_TABLES}), b AS ({_BEST.format('true')}), x AS ({_BEST.format("chunk_type = 'table'")}), u AS (
  SELECT count(*) = count(DISTINCT chunk_id) AND count(*) > 0 AS passed FROM chunks), every AS (
  SELECT total = embedded AND total >= 300 AND dims_ok AS passed FROM e UNION ALL SELECT passed FROM t UNION ALL SELECT passed FROM b UNION ALL SELECT passed FROM x UNION ALL SELECT passed FROM u)
SELECT count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM every""")
def acceptance_tally(spark: SparkSession, d: str) -> DataFrame:
    chunks = views.chunks(spark, d)
    checks = [evaluation.embedding_check(chunks, 64), evaluation.table_check(chunks), _best_hit(spark, d), _best_hit(spark, d, "table"), evaluation.uniqueness_check(chunks)]
    every = checks[0].select("passed")
    for check in checks[1:]:
        every = every.union(check.select("passed"))
    return evaluation.tally(every)


# ------------------------------------------------------------------ judgement


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM labels""")
def judge_verdict(spark: SparkSession, d: str) -> DataFrame:
    def metric(score):
        return F.struct(F.lit("").alias("reasoning"), score.cast("int").alias("score"))

    good, clean = F.when(F.col("quality") == 1, 5).otherwise(2), F.when(F.col("toxic") == 0, 4).otherwise(1)
    report = F.to_json(F.struct(metric(good).alias("context_relevance"), metric(clean).alias("faithfulness"), metric(good).alias("answer_relevance"), metric(clean).alias("completeness")))
    return evaluation.judged(table(spark, d, "labels").select("doc_id", report.alias("report"))).select("doc_id", "verdict")


@query(f"""WITH {_HELD_SQL}, c AS (SELECT item_id % 10 AS report_id, item_id IN (SELECT item_id FROM held) AS ok FROM benchmark)
SELECT report_id, count(*)::int AS total_claims, count(*) FILTER (WHERE NOT ok)::int AS leaked_claims, count(*) FILTER (WHERE NOT ok)::double / count(*) AS leakage_rate,
  CASE WHEN count(*) FILTER (WHERE NOT ok) = 0 THEN 'PASS_ISOLATED' ELSE 'FAIL_LEAKAGE_DETECTED' END AS verdict FROM c GROUP BY 1""")
def leakage_rate(spark: SparkSession, d: str) -> DataFrame:
    seen = context_support(spark, d).select("item_id", "supported")
    check = F.struct(F.col("item_id").cast("string").alias("statement"), F.col("supported").alias("is_supported_by_context"), F.lit("").alias("citation_quote"))
    reports = seen.groupBy((F.col("item_id") % 10).alias("report_id")).agg(F.to_json(F.struct(F.collect_list(check).alias("atomic_checks"))).alias("report"))
    return evaluation.leakage(reports)


@query(rf"""WITH h AS ({_hybrid_sql('query_id, chunk_id, rank')}), b AS (
  SELECT h.query_id, h.rank, '[' || h.rank || '] ' || d.source || ' (' || d.lang || ' / ' || d.source || '), ' || CASE WHEN coalesce(e.label, d.doc_id) % 2 = 0 THEN 'text' ELSE 'table' END || chr(10) || d.text AS t
  FROM h JOIN documents d ON d.doc_id = h.chunk_id LEFT JOIN embeddings e ON e.vec_id = h.chunk_id)
SELECT query_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question (1000 tokens at most): the ther and the thin' AS prompt FROM b GROUP BY query_id""")
def prompt_blocks(spark: SparkSession, d: str) -> DataFrame:
    hits = _hybrid(spark, d).select("query_id", "chunk_id", "rank").join(views.chunks(spark, d).drop("embedding"), "chunk_id")
    return retrieval.prompt_blocks(hits, TEXTS[0])


#: Three kinds of quotes of each benchmark item: as it is, with every seventh token changed and one left out, and backwards.
_CLAIMS = f"""toks AS (SELECT item_id, {_TOK.format('text')} AS x FROM benchmark), claims AS (
  SELECT item_id * 10 AS claim_id, x AS q FROM toks UNION ALL
  SELECT item_id * 10 + 1, list_transform(list_filter(x, lambda t, i: i <> 5), lambda t, i: CASE WHEN i % 7 = 0 THEN 'changed' ELSE t END) FROM toks UNION ALL
  SELECT item_id * 10 + 2, list_reverse(x) FROM toks)"""


@query(f"""WITH {_CLAIMS}, c AS (SELECT *, least(3, len(q)) AS size FROM claims WHERE len(q) > 0), d AS (
  SELECT doc_id, {_TOK.format('text')} AS t FROM documents), cs AS (
  SELECT claim_id, size, unnest(range(1, len(q) - size + 2)) AS pl, q FROM c), cg AS (
  SELECT claim_id, size, pl, array_to_string(q[pl:pl + size - 1], ' ') AS g FROM cs), ds AS (
  SELECT doc_id, size, unnest(range(1, len(t) - size + 2)) AS place, t FROM d, (SELECT DISTINCT size FROM c)), dg AS (
  SELECT doc_id, size, place, array_to_string(t[place:place + size - 1], ' ') AS g FROM ds), met AS (
  SELECT claim_id, doc_id, floor((place - pl) / 8.0)::int AS band, count(*) AS seeds FROM cg JOIN dg USING (size, g) GROUP BY ALL), best AS (
  SELECT claim_id, doc_id, band FROM met QUALIFY row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY seeds DESC, band) = 1), s AS (
  SELECT claim_id, doc_id, round(len(list_filter(q, lambda w, i: list_contains(t[greatest(1, i + (band - 1) * 8):greatest(0, i + (band - 1) * 8 + 23)], w)))::double / len(q), 9) AS support
  FROM best JOIN c USING (claim_id) JOIN d USING (doc_id))
SELECT claim_id, doc_id, support, support >= 0.8 AS supported FROM s""")
def quoted_claims(spark: SparkSession, d: str) -> DataFrame:
    """How far each document bears out verbatim, edited and invented quotes of benchmark items."""
    items = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("x"))
    kept = F.filter("x", lambda t, i: i != 4)
    kinds = [F.col("x"), F.transform(kept, lambda t, i: F.when((i + 1) % 7 == 0, "changed").otherwise(t)), F.reverse("x")]
    claims = items.select("item_id", F.posexplode(F.array(*kinds)).alias("k", "q")).select((F.col("item_id") * 10 + F.col("k")).alias("claim_id"), F.array_join("q", " ").alias("quote"))
    found = support.support(claims, table(spark, d, "documents"), key="doc_id")
    return found.withColumn("supported", F.col("support") >= support.ENOUGH)


# ------------------------------------------------------------------ streams


@query("""WITH e AS (SELECT event_id, event_type, ts::date AS day FROM events), m AS (SELECT max(day) AS top FROM e)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, count(*) AS events FROM e, m WHERE day >= top - INTERVAL 7 DAY GROUP BY ALL""")
def expiring_days(spark: SparkSession, d: str) -> DataFrame:
    """Events stored by day in two batches, the later half first; days that have expired are neither kept nor taken."""
    events, path = table(spark, d, "events").select("event_id", "event_type", "ts"), scratch(spark)
    middle = F.lit(events.agg(F.expr("timestamp_micros(cast((unix_micros(cast(min(ts) as timestamp)) + unix_micros(cast(max(ts) as timestamp))) / 2 as bigint))")).first()[0])
    late = F.col("ts").cast("timestamp") >= middle
    for k, rows in enumerate((events.where(late), events.where(~late))):
        versions.append(rows, path, "ts", 7, k)
    versions.vacuum(spark, path, 1)
    stored = versions.read(spark, path, events.schema)
    return stored.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"))


@query(f"WITH {AUDIT_SQL} SELECT query_type, strftime(\"timestamp\", '%Y-%m-%d') AS day, count(*) AS events FROM audit WHERE length(query) >= 1 AND total_latency_ms >= 0 GROUP BY ALL")
def audit_stream_append(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "events")
    arriving = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    out, at = scratch(spark), scratch(spark)
    streams.append_audit(views.as_audit(arriving), out, at).awaitTermination()
    stored = spark.read.parquet(out)
    return stored.groupBy("query_type", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"))


@query("""SELECT conv_id::varchar AS session_id, count(*)::int AS turn_count, array_to_string(list(turn ORDER BY turn DESC)[1:3], ',') AS newest, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def session_state_stream(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "conversations")
    arriving = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/conversations.parquet*")
    out, at = scratch(spark), scratch(spark)
    turn = F.struct(F.col("turn").cast("int").alias("turn_id"), F.col("text").alias("query"))
    rows = arriving.select(F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("user_id"), F.timestamp_seconds("turn").alias("timestamp"), turn.alias("turn"))
    streams.upsert_sessions(rows, out, at, 3).awaitTermination()
    return streams.stored_sessions(spark, out, 3).select("session_id", "turn_count", _newest(), F.unix_seconds("updated_at").alias("last_turn"))


