"""Tables that change by parts: upserts, failed and outdated writers, expiry of days."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gneiss.operators import merge
from gneiss.sources import versions

SCHEMA = "chunk_id string, source_file string, chapter_path string, content string"


def chunks(spark, ids, mark):
    return spark.createDataFrame([(f"c{i}", mark, f"{mark} path", f"{mark} text {i}") for i in ids], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return {str(p): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    old, new = chunks(spark, range(2000), "old"), chunks(spark, [3, 5000], "new")
    versions.upsert(old, path, SCHEMA, buckets=16)
    first = files(path)
    made = versions.upsert(new, path, SCHEMA, buckets=16)
    written = sum(n for f, n in files(path).items() if f not in first)
    assert len(made["parts"]) == 16 and written < 0.25 * sum(first.values())
    assert rows(versions.read(spark, path, SCHEMA)) == rows(merge.upsert(old, new))
    before = versions.version(spark, path, 0)
    assert rows(versions.read(spark, path, SCHEMA, before)) == rows(old)


def test_failed_and_outdated_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(chunks(spark, range(50), "old"), path, SCHEMA, buckets=4)
    kept = rows(versions.read(spark, path, SCHEMA))
    broken = chunks(spark, [1], "new").withColumn("content", F.expr("cast(raise_error('lost') as string)"))
    with pytest.raises(Exception, match="lost"):
        versions.upsert(broken, path, SCHEMA, buckets=4)
    assert rows(versions.read(spark, path, SCHEMA)) == kept and versions.versions(spark, path) == [0]
    with pytest.raises(versions.Outdated):
        versions.commit(spark, path, {"number": 0, "parts": {}})
    assert rows(versions.read(spark, path, SCHEMA)) == kept and not [f for f in os.listdir(tmp_path / "t" / "versions") if f.startswith(".") and not f.endswith(".crc")]
    lost = versions.vacuum(spark, path)
    assert all(f not in str(versions.version(spark, path)) for f in lost) and rows(versions.read(spark, path, SCHEMA)) == kept


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path, SCHEMA).count() == 0 and versions.vacuum(spark, path) == []
    versions.upsert(chunks(spark, [], "x"), path, SCHEMA)
    assert versions.read(spark, path, SCHEMA).count() == 0
    assert versions.append(spark.createDataFrame([], "timestamp timestamp"), str(tmp_path / "e"))["parts"] == {}


EVENTS = "event_id int, timestamp timestamp"


def events(spark, days):
    return spark.createDataFrame([(i, None if d is None else dt.datetime(2024, 3, 1) + dt.timedelta(days=d)) for i, d in enumerate(days)], EVENTS)


def test_days_expire_and_readers_see_one_state(spark, tmp_path):
    path = str(tmp_path / "e")
    versions.append(events(spark, [0, 0.5, 9, 20]), path, days=10, batch=0)
    assert sorted(versions.version(spark, path)["parts"]) == ["2024-03-21"]  # what is before the watermark's day isn't taken
    versions.append(events(spark, [11, 12, 20.5, None]), path, days=10, batch=1)
    reader = versions.read(spark, path, EVENTS)
    again = versions.append(events(spark, [11, 12, 20.5, None]), path, days=10, batch=1)
    assert again["number"] == 1 and sorted(again["parts"]) == ["2024-03-12", "2024-03-13", "2024-03-21"]
    versions.append(events(spark, [22.1, 1]), path, days=10, batch=2)
    assert reader.count() == 4  # the version that it began with
    assert versions.vacuum(spark, path) == [] and reader.count() == 4
    versions.append(events(spark, [23, 22]), path, days=10, batch=3)
    gone = versions.vacuum(spark, path)
    assert [g.split("__part=")[1] for g in gone] == ["2024-03-12"] and not list(Path(path).rglob("*__part=2024-03-12"))
    assert sorted(versions.version(spark, path)["parts"]) == ["2024-03-21", "2024-03-23", "2024-03-24"]
    assert versions.read(spark, path, EVENTS).agg(F.min("timestamp")).first()[0] >= dt.datetime(2024, 3, 14)


def test_merge_shuffles_each_row_once(spark):
    """Repeated and null keys are merged as before, and neither a join nor a second exchange is planned."""
    schema = "chunk_id bigint, source_file string, chapter_path string, content string"
    old = spark.createDataFrame([(1, "a", "p", "x"), (2, None, "p", "y"), (None, "z", "p", "null")], schema)
    new = spark.createDataFrame([(2, "b", "q", "u"), (2, "c", "r", "v"), (3, "d", "q", None), (None, "e", "q", "w")], schema)
    made = merge.upsert(old, new)
    expected = [(1, "a", "p", "x"), (2, "c", "r", "v"), (3, "d", "q", None), (None, "z", "p", "null"), (None, "e", None, None)]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(expected, key=str)
    dealt = merge.upsert(*(df.withColumn("part", F.col("chunk_id") % 2) for df in (old, new)), by="part")
    assert sorted(map(tuple, dealt.drop("part").collect()), key=str) == sorted(expected, key=str)
    for df in (made, dealt):
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1
