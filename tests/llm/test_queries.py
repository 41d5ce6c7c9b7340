"""The registered corpus queries and the pipeline on the driver's tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import queries
from gneiss.llm.common import table
from tests.test_catalog import DATA, duck, rows_of  # noqa: F401

MORE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in queries.ORACLES:
        rel = duck.sql(queries.ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows_of(list(rel.columns), rel.fetchall())
    else:
        assert got


def test_pipeline_stages(spark):
    docs = table(spark, MORE, "documents")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, MORE).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= left.count()
        assert out.join(left, "doc_id", "left_anti").count() == 0
        left = out
    labels = table(spark, MORE, "labels")
    judged = left.join(labels, "doc_id")
    assert judged.where("quality = 0 or toxic = 1").count() <= 0.05 * judged.count() + 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, MORE)
    assert pieces.select("doc_id").distinct().count() == left.count()
    assert pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_pipeline_of_few_rows(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, DATA, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
