"""Ranking, fusion, re-ranking and retrieval metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.config import MissingSetting, Retrieval, setting
from gneiss.functions import models, vectors
from gneiss.operators import evaluation, lexical, retrieval

CHUNK = "chunk_id bigint, source_file string, chunk_type string, chapter_path string, content string, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"f{i % 3}", "text" if i % 2 else "table", f"p {i % 4}", "the cat and the dog " * (i % 5) + f"w{i}", rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100, "f", "text", None, None, None), (101, "f", "text", "p", "and the", [0.0] * 8), (102, "f", "text", "p", "x", [1.0])]
    return spark.createDataFrame(rows, CHUNK).cache()


def test_nearest_is_exact(chunks):
    pool = [r for r in chunks.collect() if r.embedding and len(r.embedding) == 8 and any(r.embedding)]
    query = list(np.random.default_rng(9).normal(size=8))
    cos = {r.chunk_id: round(float(np.dot(r.embedding, query) / np.linalg.norm(r.embedding) / np.linalg.norm(query)), 9) for r in pool}
    expected = sorted(cos, key=lambda k: (-cos[k], k))[:7]
    found = vectors.nearest(chunks, {3: query}, 7).orderBy("rank_vec").collect()
    assert [r.chunk_id for r in found] == expected
    assert vectors.nearest(chunks, {3: query}, 50, floor=0.4).count() == sum(v >= 0.4 for v in cos.values())
    assert vectors.nearest(chunks, {}, 5).count() == 0
    same = chunks.where(F.size("embedding") == 8).select(F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 9).alias("s"), "chunk_id")
    assert all(abs(r.s - cos[r.chunk_id]) < 1e-8 for r in same.where("s is not null").collect())


def test_approximate_recall(chunks):
    some = chunks.where("size(embedding) = 8 and chunk_id < 60")
    exact = {r.chunk_id for r in vectors.nearest(some, {0: [1.0] * 8}, 5).collect()}
    unit = some.withColumn("embedding", F.expr("transform(embedding, x -> cast(try_divide(x, sqrt(aggregate(embedding, 0D, (a, v) -> a + v * v))) as float))"))
    near = {r.chunk_id for r in vectors.approximate_nearest(unit, [8**-0.5] * 8, 5, tables=20, width=4.0).collect()}
    assert len(exact & near) >= 4


def test_inverted_lists_recall(spark):
    """Ten nearest of sixty queries among clustered vectors; every row stands in a list."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(40, 16))
    rows = [(i, (middle[i % 40] + 0.6 * rng.normal(size=16)).tolist()) for i in range(3000)] + [(9000, None), (9001, [1.0]), (9002, [0.0] * 16)]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    index = vectors.centroids(df, lists=32, sample=1000)
    listed = vectors.with_list(df, index).cache()
    assert listed.where("list is null").count() == 2 and listed.count() == 3003
    queries = {k: rows[k * 50][1] for k in range(60)}
    exact = {(r.query_id, r.chunk_id) for r in vectors.nearest(df, queries, 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in vectors.nearest_in_lists(listed, index, queries, 10, probes=8).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    every = {(r.query_id, r.chunk_id, r.rank_vec) for r in vectors.nearest_in_lists(listed, index, queries, 10, probes=32).collect()}
    assert every == {(r.query_id, r.chunk_id, r.rank_vec) for r in vectors.nearest(df, queries, 10).collect()}
    assert vectors.nearest_in_lists(listed, index, {}, 5).count() == 0
    empty = df.limit(0)
    assert vectors.with_list(empty, vectors.centroids(empty)).count() == 0


def test_inverted_lists_on_the_tables(spark):
    """Recall against brute force over the driver's own vectors."""
    from gneiss.plans import catalog

    d = "/root/testdata/sf0.1"
    chunks = catalog.views.chunks(spark, d)
    queries = {k: v for block in catalog._every_hundredth(spark, d) for k, v in block.items()}
    exact = {(r.query_id, r.chunk_id) for r in vectors.nearest(chunks, queries, 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in catalog.inverted_list_topk(spark, d).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_fusion(spark):
    v = spark.createDataFrame([(0, 7, 1), (0, 8, 5)], "query_id bigint, chunk_id bigint, rank_vec bigint")
    k = spark.createDataFrame([(0, 7, 2), (0, 9, 1)], "query_id bigint, chunk_id bigint, rank_kw bigint")
    got = {r.chunk_id: r.rrf_score for r in retrieval.fuse(v, k, ["query_id", "chunk_id"]).collect()}
    assert got == {7: round(1 / 61 + 1 / 62, 9), 8: round(1 / 65, 9), 9: round(1 / 61, 9)}


def test_search_shapes(chunks):
    query = [1.0] * 8
    hits = retrieval.search(chunks, "the cat", query, Retrieval(floor=-1.0, rerank=True, top_k=4)).collect()
    assert len(hits) == 4 and hits[0].rerank_score >= hits[-1].rerank_score
    assert retrieval.search(chunks, "  ", query).count() == 0
    only = retrieval.search(chunks, "the", query, use_hybrid=False, chunk_type="text").collect()
    assert {r.chunk_type for r in only} == {"text"} and all(r.rank_vec is None for r in only)
    shown = retrieval.rendered(retrieval.search(chunks, "the", query, use_hybrid=False)).first()
    assert "未入榜" in shown.markdown
    assert retrieval.of_type(chunks, "全部").count() == chunks.count()


def test_keyword_needs_all_lexemes(chunks):
    found = {r.chunk_id for r in lexical.match_all(chunks, lexical.query_terms("the cats and dogged")).collect()}
    assert found == {r.chunk_id for r in chunks.collect() if r.content and "cat" in r.content}
    assert lexical.match_all(chunks, []).count() == 0 and lexical.bm25(chunks, ["nowher"]).count() == 0
    assert lexical.query_terms("The cats, the CAT!") == ["cat"] and lexical.query_terms("the and of") == []


def test_forms_of_lexemes(spark):
    rows = [(1, "p", "Connected connections, connecting the connect skies lying"), (2, "sky", "lie lies console consoling concern")]
    df = spark.createDataFrame(rows, "chunk_id bigint, chapter_path string, content string")
    forms = lexical.forms_of(df, ["connect", "sky", "lie", "consol"])
    assert forms == {"connect": ["connect", "connected", "connecting", "connections"], "sky": ["skies", "sky"], "lie": ["lie", "lies", "lying"], "consol": ["consol", "console", "consoling"]}
    assert {r.chunk_id for r in lexical.match_all(df, lexical.query_terms("the skies lying")).collect()} == {1, 2}


def test_stems_of_a_published_sample():
    from gneiss.functions.stemming import stem

    sample = """consist consisted consistency consistent consistently consisting consists:consist consolation consolations:consol consolidate
    consolidated:consolid conspicuous conspicuously:conspicu conspiracy:conspiraci conspire conspired:conspir knaves knave:knave knavish:knavish
    kneel kneeled kneels:kneel knives:knive knife:knife knightly knights:knight knitted:knit happy:happi flies:fli dying:die gas:gas gaps:gap
    agreed:agre boy:boy cry:cri by:by relational:relat luxuriated:luxuri generate generated:generat hopping:hop hoping:hope sky:sky news:news
    inning innings:inning exceed exceeds:exceed generously:generous"""
    for words, expected in __import__("re").findall(r"([a-z\s]+):(\w+)", sample):
        for w in words.split():
            assert stem(w) == expected, w


def test_cross_scorer_in_batches(spark):
    sizes = []

    def scorer(pairs):
        assert len(pairs) <= 2 and all(q == "a cat" for q, _ in pairs)
        return [float(len(c)) for _, c in pairs]

    df = spark.createDataFrame([(1, "xx", 0.1), (2, "x", 0.2), (3, None, None), (4, "xxxx", 0.0)], "chunk_id bigint, content string, rrf_score double")
    assert [r.chunk_id for r in retrieval.rerank(df, "a cat", 3, scorer=scorer, batch=2).collect()] == [4, 1, 2] and not sizes


def test_stored_postings_match_the_scan(spark, chunks):
    lexical.store_postings(lexical.postings(chunks), "gneiss_test_postings", 4)
    try:
        stored = spark.table("gneiss_test_postings")
        for terms in (["cat", "dog"], ["p", "w7"], ["nowher"], []):
            assert sorted(map(tuple, lexical.match_stored(stored, terms).collect())) == sorted(map(tuple, lexical.match_all(chunks, terms).collect()))
    finally:
        spark.sql("DROP TABLE gneiss_test_postings")


def test_chain_of_embedders(spark):
    def down(texts):
        raise ConnectionError("down")

    one, short = models.hash_embedder(4), lambda texts: [[1.0]] * (len(texts) - 1)
    chain = models.embedder_chain([down, short, models.hash_embedder(8), one], width=4)
    assert chain(["a", "b"]) == one(["a", "b"]) and chain([]) == []
    with pytest.raises(ConnectionError):
        models.embedder_chain([short, down])(["a"])
    with pytest.raises(ValueError, match="0 vectors"):
        models.embedder_chain([down, short])(["a"])
    df = spark.createDataFrame([(1, "x y"), (2, None)], "chunk_id int, content string")
    assert [list(r.embedding) for r in models.with_embedding(df, chain).orderBy("chunk_id").collect()] == [list(map(float, v)) for v in one(["x y", ""])]
    assert models.hub_name("bge-m3") == "BAAI/bge-m3" and models.hub_name("a/b") == "a/b"


def test_builtin_cases(spark):
    from gneiss.sources.benchmark import builtin_cases

    cases = builtin_cases(spark).collect()
    assert len(cases) == 7 and [c.id for c in cases if c.expected_type == "table"] == ["TC-02"]
    assert all(len(c.required_keywords) == 3 and 1 <= len(c.expected_files) <= 3 for c in cases)


def test_metrics_golden(spark):
    flags = [(1, r + 1, f, 2) for r, f in enumerate([False, True, False, True, True])]
    df = spark.createDataFrame(flags, "case_id int, rank int, relevant boolean, targets int")
    got = {r.k: (r.hits, r.recall, round(r.precision, 4), r.hit, r.mrr) for r in evaluation.metrics_at_k(df, [10, 5, 3, 1, 3]).collect()}
    assert got == {1: (0, 0.0, 0.0, 0.0, 0.0), 3: (1, 0.5, 0.3333, 1.0, 0.5), 5: (3, 1.0, 0.6, 1.0, 0.5), 10: (3, 1.0, 0.3, 1.0, 0.5)}
    assert {r.k: r.hit_rate for r in evaluation.summary(evaluation.metrics_at_k(df, [1, 5])).collect()} == {1: 0.0, 5: 1.0}


def test_relevance_rules(spark):
    rows = [("c1", "f1", "Alpha beta", ["c1"], None, None, True), ("c2", "f1", "Alpha beta gamma", None, ["f1"], ["ALPHA", "beta", "zeta"], True), ("c2", "f1", "Alpha", None, ["f1"], ["alpha", "beta", "zeta"], False), ("c2", "f2", "Alpha beta", None, ["f1"], None, False), ("c2", "f2", None, None, None, None, True), ("c2", None, "x", None, ["f1"], None, False)]
    df = spark.createDataFrame(rows, "c string, f string, t string, ids array<string>, files array<string>, words array<string>, e boolean")
    out = df.select(evaluation.is_relevant(F.col("c"), F.col("f"), F.col("t"), F.col("ids"), F.col("files"), F.col("words")).alias("r"), "e").collect()
    assert [r.r for r in out] == [r.e for r in out]


def test_rerank_ties_keep_the_fused_order(spark):
    rows = [(1, "a cat", 0.01), (2, "a cat", 0.03), (3, "no", 0.5), (4, None, None)]
    df = spark.createDataFrame(rows, "chunk_id bigint, content string, rrf_score double")
    assert [r.chunk_id for r in retrieval.rerank(df, "cat", 3).collect()] == [2, 1, 3]


def test_score_pick_sigmoid_and_settings(spark, monkeypatch):
    row = spark.sql("SELECT 0.0D a, 0.02D b, 0.9D c").select(retrieval.audit_score(F.col("a"), F.col("b"), F.col("c"))).first()
    assert row[0] == 0.02
    s = [r[0] for r in spark.createDataFrame([(0.0,), (0.85,), (1000.0,), (-1000.0,)], "x double").select(vectors.sigmoid(F.col("x"))).collect()]
    assert s[0] == 0.5 and round(s[1], 5) == 0.70057 and s[2:] == [1.0, 0.0]
    assert Retrieval().fetch_k(3) == 30 and Retrieval().fetch_k(20) == 40 and Retrieval(rerank=True).pool == 15
    monkeypatch.setenv("X_CONN", "env")
    assert setting("X_CONN", "given") == "given" and setting("X_CONN") == "env" and setting("X_NONE", default="d") == "d"
    with pytest.raises(MissingSetting):
        setting("X_NONE", required=True)


def test_retries():
    seen, naps = [], []

    def fails(message):
        def call():
            seen.append(message)
            raise RuntimeError(message)

        return call

    assert models.with_retries([fails("503 unavailable"), lambda: "light"], 3, 1.5, naps.append) == "light"
    assert len(seen) == 3 and naps == [1.5, 3.0]
    for message, times in (("quota exceeded", 1), ("bad key", 1), ("timeout", 2)):
        seen.clear()
        with pytest.raises(RuntimeError):
            models.with_retries([fails(message)], 2, 0.0, naps.append)
        assert len(seen) == times
    seen.clear()
    with pytest.raises(RuntimeError):
        models.with_retries([fails("quota")], 2, 0.0, naps.append, wait_for_quota=True)
    assert len(seen) == 2


def test_answers_of_several_models(spark):
    def busy(prompt):
        raise RuntimeError("quota")

    def light(prompt):
        if "?" not in prompt:
            raise RuntimeError("no question")
        return prompt.upper()

    df = spark.createDataFrame([(1, "why?"), (2, "so"), (3, None)], "query_id int, prompt string")
    out = {r.query_id: r.answer for r in models.with_answer(df, [busy, light], failed="none").collect()}
    assert out == {1: "WHY?", 2: "none", 3: "none"}


def test_many_queries_in_one_pass(chunks):
    queries = {3: "the cat", 5: "dog", 7: "", 9: "nowhere", 11: "and p"}
    got = {}
    for r in retrieval.keyword_ranks(chunks, queries, 4, block=2).collect():
        got.setdefault(r.query_id, {})[r.rank_kw] = r.chunk_id
    for q, words in queries.items():
        alone = retrieval.ranked(lexical.bm25(chunks, lexical.query_terms(words)), "bm25", "rank_kw", 4).collect()
        assert got.get(q, {}) == {r.rank_kw: r.chunk_id for r in alone}


def test_many_short_items_are_found(spark, tmp_path):
    from gneiss.plans.catalog import benchmark_containment

    items = [(i, f"w{i}.") for i in range(10_050)] + [(20_000, "one two three four five six seven eight"), (20_001, None)]
    docs = [(1, "s", "x w7. y w10049. z"), (2, "s", "so one two three four five six seven eight"), (3, "s", None)]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(tuple(r) for r in benchmark_containment(spark, str(tmp_path)).collect()) == [(7, 1), (10_049, 1), (20_000, 2)]


def _odd_chunks(spark):
    rows = [(1, "Pumps / a", "pump pumping the valve"), (1, "p", "pump valve valve"), (None, "the", "x9 pump"), (None, None, "pump"), (2, None, None), (3, "", "and the"), (4, "Öl", "öl ÖL " * 600)]
    return spark.createDataFrame(rows, "chunk_id bigint, chapter_path string, content string")


def test_postings_are_counted_in_their_rows(spark):
    """Words aren't shuffled: the one exchange brings postings of a repeated key together."""
    chunks = _odd_chunks(spark)
    held = lexical.postings(chunks)
    assert held._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = [(1, "A", "p", 1), (1, "A", "pump", 1), (1, "B", "pump", 3), (1, "B", "valv", 3), (4, "A", "öl", 1), (4, "B", "öl", 1200), (None, "B", "pump", 2), (None, "B", "x9", 1)]
    assert sorted(map(tuple, held.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, lexical.postings(chunks, terms=["pump", "nowher"]).collect()), key=str) == sorted((w for w in want if w[2] == "pump"), key=str)
    assert ("B", "the", 1) in {tuple(r)[1:] for r in lexical.postings(chunks, english=False).where("chunk_id = 1").collect()}


def test_document_frequencies_count_a_key_once(spark):
    chunks = _odd_chunks(spark)
    got = {r["term"]: r["df"] for r in lexical.document_frequencies(chunks).collect()}
    assert got == {"pumps": 1, "a": 1, "pump": 2, "pumping": 1, "the": 3, "valve": 1, "p": 1, "x9": 1, "and": 1, "öl": 1}
