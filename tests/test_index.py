"""The stored index against scans of all texts; what it opens and what it passes by."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.functions import models
from gneiss.operators import index, lexical, retrieval

SCHEMA = "chunk_id bigint, chapter_path string, content string"


def corpus(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    words = ["pump", "pumps", "pumping", "valve", "valves", "the", "licensing", "license", "Öl", "x9", "and", "filter", "filters"]
    weights = np.array([9, 5, 3, 6, 4, 20, 1, 2, 2, 1, 15, 3, 2], float)
    rows = [(i, f"{words[rng.integers(0, 13)]} / p", " ".join(rng.choice(words, rng.integers(1, 80), p=weights / weights.sum()))) for i in range(n)]
    rows += [(n, None, None), (n + 1, "", ""), (5, "pump", "pump valve"), (5, "pump", "pump valve"), (None, "valve", "pumped"), (n + 2, "p", "valve pump " * 5000), (n + 3, None, "the and")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def chunks(spark):
    return corpus(spark).cache()


@pytest.fixture(scope="module")
def stored(spark, chunks, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/it"
    made = index.build(chunks, path, block=16, buckets=5)
    assert index.stored(spark, path) == made
    return made


QUERIES = {1: ["pump"], 2: ["pump", "valv"], 3: ["licens", "öl"], 4: ["nowher", "pump"], 5: [], 6: ["filter", "pump", "valv", "x9"]}


@pytest.mark.parametrize("ranking", ["bm25", "wtf"])
def test_best_are_those_of_a_scan(spark, chunks, stored, ranking):
    want = {}
    for r in lexical.score_all(chunks, QUERIES, ranking).collect():
        want.setdefault(r["query_id"], []).append(r["score"])
    for k in (1, 10, 100):
        got = {}
        for r in index.top(spark, stored, QUERIES, k, ranking, first=2).orderBy("query_id", "rank_kw").collect():
            got.setdefault(r["query_id"], []).append(r["score"])
        assert got == {q: sorted(s, reverse=True)[:k] for q, s in want.items()}
    assert set(want) == {1, 2, 3, 6}


def test_matches_are_those_of_a_scan(spark, chunks, stored):
    key = lambda r: (r["query_id"], r["chunk_id"] is None, r["chunk_id"] or 0, r["score"])
    got = sorted(index.matches(spark, stored, QUERIES).collect(), key=key)
    want = sorted(lexical.score_all(chunks, QUERIES, "wtf").collect(), key=key)
    assert list(map(key, got)) == list(map(key, want))


def test_ranges_are_passed_by(spark, chunks):
    """Where some chunks are about what is asked, ranges that can't reach their scores stay closed."""
    about = spark.range(8).select((F.col("id") + 90_000).alias("chunk_id"), F.lit("pump / valve").alias("chapter_path"), F.expr("repeat('pump valve ', 10 + cast(id as int))").alias("content"))
    whole = chunks.unionByName(about)
    own, seen = index.build(whole, block=16), {}
    got = [r["score"] for r in index.top(spark, own, {1: ["pump", "valv"]}, 5, first=4, opened=seen).orderBy("rank_kw").collect()]
    assert got == [r["score"] for r in lexical.score_all(whole, {1: ["pump", "valv"]}).orderBy(F.desc("score")).limit(5).collect()]
    assert 4 <= seen["opened"] < seen["ranges"] / 2


def test_only_own_buckets_are_read(spark, stored):
    blocks = index.own_blocks(spark, stored, ["pump"])
    assert len({p.split("bucket=")[1].split("/")[0] for p in (r[0] for r in blocks.select(F.input_file_name()).distinct().collect())}) == 1
    plan = blocks.select("term", "range", "max_bm25")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "In(term" in plan.replace("EqualTo(term", "In(term") and "postings" not in plan.split("ReadSchema")[1]


def test_a_lexeme_in_every_chunk_has_many_blocks(spark, stored):
    sizes = [r["n"] for r in index.own_blocks(spark, stored, ["pump"]).select("n").collect()]
    assert len(sizes) > 50 and max(sizes) < 80


def test_statistics_and_odd_indexes(spark, chunks, stored):
    assert stored.n == chunks.count()
    none = index.build(chunks.limit(0))
    assert index.top(spark, none, QUERIES, 3).count() == 0 and none.n == 0
    mute = index.build(spark.createDataFrame([("a.b", None, "the"), ("c", "", None)], "id string, chapter_path string, content string"), key="id")
    assert mute.n == 2 and index.matches(spark, mute, QUERIES, key="id").dtypes[1] == ("id", "string")
    one = index.build(spark.createDataFrame([("a.b", None, "pumps", 1)], "id string, chapter_path string, content string, term int"), key="id")
    assert [tuple(r)[:2] for r in index.top(spark, one, {7: ["pump"]}, 3, key="id").collect()] == [(7, "a.b")]


def test_hybrid_by_index_equals_hybrid_by_scan(spark, chunks, stored):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(0, 1500, 2)], "chunk_id bigint, embedding array<float>")
    pool = chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"]).join(vectors, "chunk_id", "left").cache()
    own = index.build(pool, block=32)
    asked, near = {0: "the pumping valves", 1: "licensed Öl"}, {0: [1.0, 0, 0, 0], 1: [0, 1.0, 0, 1]}
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(retrieval.hybrid(pool, asked, near, 10, index=own)) == rows(retrieval.hybrid(pool, asked, near, 10))


def test_reranking_knows_inflected_words(spark):
    rows = [(1, "Licensing terms; maintenance of the procedures"), (2, "nothing of that"), (3, "licensed, maintained, a procedure"), (4, None), (5, ""), (6, "LICENSING")]
    hits = spark.createDataFrame(rows, "chunk_id bigint, content string").withColumn("rrf_score", F.lit(0.1))
    got = retrieval.rerank(hits, "licensing maintenance procedures", 6).collect()
    assert [r["chunk_id"] for r in got[:4]] == [1, 3, 6, 2] and got[0]["raw_rerank_score"] == 4.0 and got[-1]["raw_rerank_score"] == -4.0
    assert {r["raw_rerank_score"] for r in retrieval.rerank(hits, "the and of", 6).collect()} == {-4.0}
    assert models.grams("ab") == {"<ab", "ab>"} and models.grams("a") == {"<a>"}


def test_nothing_is_shuffled_to_build(spark, chunks, stored):
    """A posting is written once, where its chunk is; keys and lengths are kept once for each range."""
    assert "Exchange" not in index._blocks(chunks, "chunk_id", 16)._jdf.queryExecution().executedPlan().toString()
    ranges = stored.ranges(spark).collect()
    assert max(len(r["rows"]) for r in ranges) <= 16 and len({x for r in ranges for x in r["rows"]}) == chunks.count()
    held = {(r["range"], s) for r in stored.blocks(spark).collect() for s in r["packed"][::2]}
    assert held == {(r["range"], i) for r in ranges for i, n in enumerate(r["lengths"]) if n}
