"""Product quantisation on inverted lists against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.functions import pq, vectors

SCHEMA = "chunk_id bigint, embedding array<float>"


def table_of(spark, x):
    odd = [(9000, None), (9001, [1.0]), (9002, [0.0] * x.shape[1]), (5, x[5].tolist())]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    return table_of(spark, np.random.default_rng(2).normal(size=(2500, 32))).cache()


def recall(spark, df, near, queries):
    exact = {(r.query_id, r.chunk_id) for r in vectors.nearest(df, queries, 10).collect()}
    return len(exact & {(r.query_id, r.chunk_id) for r in near.collect()}) / len(exact)


def test_recall_without_clusters(spark, plain):
    """The hardest case: a twenty-fifth of the rows is scored."""
    quantizer = pq.fit(plain, sample=1500)
    stored = pq.store(plain, quantizer)
    queries = {q: np.random.default_rng(q).normal(size=32).tolist() for q in range(30)}
    assert recall(spark, plain, pq.nearest(stored, quantizer, queries, 10, 100), queries) >= 0.9
    counts = pq.survivors(stored, quantizer, queries, 100, pq.PROBES).groupBy("query_id").count().collect()
    assert len(counts) == 30 and all(r["count"] <= 100 for r in counts)


def test_recall_with_clusters(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 32))[np.arange(2000) % 40] + 0.5 * rng.normal(size=(2000, 32))
    df = table_of(spark, x)
    quantizer = pq.fit(df, sample=1000)
    queries = {q: x[q * 60].tolist() for q in range(30)}
    assert recall(spark, df, pq.nearest(pq.store(df, quantizer), quantizer, queries, 10, 60, probes=8), queries) >= 0.9


def test_all_rows_scored_is_exact(spark, plain):
    quantizer = pq.fit(plain, parts=8, lists=8)
    stored, queries = pq.store(plain, quantizer), {3: [1.0] * 32, 4: [-1.0, 2.0] * 16}
    key = lambda df: [tuple(r) for r in df.select("query_id", "chunk_id", "cosine_similarity").orderBy("query_id", "rank_vec").collect()]
    assert key(pq.nearest(stored, quantizer, queries, 12, 3000, probes=8)) == key(vectors.nearest(plain, queries, 12))


def test_sums_of_table_entries(plain):
    x = pq.unit(np.random.default_rng(1).normal(size=(50, 32)))
    quantizer = pq.fit(plain)
    codes, tables = quantizer.codes(x), quantizer.tables(x[:4])
    whole = np.stack([quantizer.parts[p][codes[:, p]] for p in range(16)], axis=1).reshape(50, 32)
    got = sum(tables[:, p][:, codes[:, p]] for p in range(16))
    assert np.allclose(got, x[:4] @ whole.T) and (np.linalg.norm(whole - x, axis=1) < 0.8).all()


def test_first_step_reads_codes_only(spark, plain):
    stored = pq.store(plain, pq.fit(plain))
    plan = pq.survivors(stored, pq.fit(plain), {0: [1.0] * 32}, 10, 4)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1].split("\n")[0] and "list" in plan.split("PartitionFilters")[1].split("]")[0]


def test_odd_tables(spark, plain):
    none = plain.limit(0)
    assert pq.fit(none) is None and pq.fit(plain.where("chunk_id >= 9000 and chunk_id <> 9001")) is None
    assert pq.store(none, None).count() == 0 and pq.nearest(pq.store(none, None), None, {0: [1.0]}, 5).count() == 0
    quantizer = pq.fit(plain)
    stored = pq.store(plain, quantizer)
    assert stored.count() == 2501 and pq.nearest(stored, quantizer, {}, 5).count() == 0 and pq.nearest(stored, quantizer, {0: [1.0, 2.0]}, 5).count() == 0
    few = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "k string, v array<double>").select("*", F.lit(1).alias("list"))
    small = pq.fit(few, key="k", vector="v")
    assert [r["k"] for r in pq.nearest(pq.store(few, small, key="k", vector="v"), small, {1: [1.0, 0.1, 0.0]}, 1, 2, key="k", vector="v").collect()] == ["a"]


def test_a_task_holds_few_scores_at_once():
    from gneiss.functions.vectors import CELLS, in_turn

    for queries, rows in ((1000, 10_000), (1000, 7), (3, 5_000_000), (0, 9), (1, 0)):
        parts = in_turn(queries, rows)
        assert [q for p in parts for q in range(queries)[p]] == list(range(queries))
        assert all(len(range(queries)[p]) * rows <= max(CELLS, rows) for p in parts)
