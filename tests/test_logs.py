"""Sessions, audit analytics, merge, judgement, sources and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gneiss import schemas
from gneiss.operators import analytics, evaluation, merge, sessions
from gneiss.sources import readers
from gneiss.streaming import streams


def turn_rows(spark, n, sid="s"):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(sid, f"u{i}", t0 + dt.timedelta(seconds=i), (i, "q", "r", [], float(i), None, None)) for i in range(1, n + 1)]
    turn = schemas.TURN.simpleString()
    return spark.createDataFrame(rows, f"session_id string, user_id string, timestamp timestamp, turn {turn}")


def test_cap_and_counter(spark):
    s = sessions.session_state(turn_rows(spark, 60)).first()
    assert s.turn_count == 60 and len(s.turns) == 50 and [t.turn_id for t in s.turns] == list(range(11, 61)) and s.user_id == "u1"


def test_merged_state(spark):
    old = sessions.session_state(turn_rows(spark, 45))
    new = sessions.session_state(turn_rows(spark, 10).unionByName(turn_rows(spark, 2, "t")))
    out = {r.session_id: r for r in sessions.merged_state(old, new).collect()}
    assert out["s"].turn_count == 55 and len(out["s"].turns) == 50 and out["t"].turn_count == 2


def test_latency_golden(spark):
    rows = [("hybrid", 210.5, 45.2, 12.1, 153.2), ("hybrid", 185.2, 40.1, 10.5, 134.6), ("vector", 55.4, 55.4, 0.0, 0.0), ("keyword", 15.6, 0.0, 15.6, 0.0)]
    df = spark.createDataFrame(rows, "query_type string, total_latency_ms double, vector_latency_ms double, keyword_latency_ms double, rerank_latency_ms double")
    out = [tuple(r) for r in analytics.latency_by_mode(df).collect()]
    assert out[0] == ("hybrid", 2, 197.85, 42.65, 11.3, 143.9, 210.5, 185.2)
    assert ("vector", 1, 55.4, 55.4, 0.0, 0.0, 55.4, 55.4) in out and ("keyword", 1, 15.6, 0.0, 15.6, 0.0, 15.6, 15.6) in out


def test_feedback_golden(spark):
    turns = [(i + 1, "q", "r", [], lat, (rating, None), None) for i, (lat, rating) in enumerate([(210.5, 5), (185.2, 4), (340.0, 5)])]
    df = spark.createDataFrame([("s", "u", 3, turns, None, None), ("e", "u", 0, [], None, None)], schemas.CHAT_SESSIONS)
    dist = analytics.feedback_distribution(df)
    assert [tuple(r) for r in dist.collect()] == [(4, 1), (5, 2)]
    assert tuple(analytics.feedback_average(dist).first()) == (4.67, 3)
    assert tuple(analytics.feedback_average(dist.limit(0)).first()) == (0.0, 0)
    assert {r.session_id: r.avg_turn_latency_ms for r in analytics.session_summary(df).collect()} == {"s": 245.23, "e": None}


def test_validation(spark):
    turn = "session_id string, user_id string, turn_id int, query string, response string, latency_ms double, feedback struct<rating int, comment string>"
    rows = [("s", None, None, "q", "r", None, None), ("", "u", 1, "q", "r", 1.0, None), ("s", "u", 1, "", "r", 1.0, None), ("s", "u", 0, "q", "r", 1.0, None), ("s", "u", 1, "q", "r", -1.0, None), ("s", "u", 1, "q", "r", 1.0, (6, None)), ("s", "u", 1, "q", "r", 1.0, (5, "x" * 501)), ("s", "u", 2, "q", "r", 1.0, (5, "fine")), (None, None, None, None, None, None, None)]
    ok, bad = sessions.validated_turns(spark.createDataFrame(rows, turn))
    assert ok.count() == 2 and bad.count() == 7
    assert {(r.user_id, r.turn_id) for r in ok.collect()} == {("anonymous", 1), ("u", 2)}


def test_retention(spark):
    t = dt.datetime(2024, 3, 1)
    df = spark.createDataFrame([(t,), (t - dt.timedelta(days=29),), (t - dt.timedelta(days=30),), (t - dt.timedelta(days=31),)], "timestamp timestamp")
    assert sessions.retained(df).count() == 2


def test_upsert_keeps_what_is_fixed(spark):
    s = "chunk_id string, source_file string, chunk_type string, chunk_index int, chapter_path string, content string"
    old = spark.createDataFrame([("a", "f", "text", 0, "p", "old"), ("b", "f", "text", 1, "p", "stay")], s)
    new = spark.createDataFrame([("a", "g", "table", 9, None, "new"), ("c", "g", "text", 2, "q", "add"), ("c", "g", "text", 3, "q", "add2")], s)
    out = {r.chunk_id: tuple(r)[1:] for r in merge.upsert(old, new).collect()}
    assert out == {"a": ("f", "text", 0, None, "new"), "b": ("f", "text", 1, "p", "stay"), "c": ("g", "text", 3, "q", "add2")}
    again = merge.upsert(merge.upsert(old, new), new)
    assert {r.chunk_id: tuple(r)[1:] for r in again.collect()} == out


def test_snapshot_and_readers(spark, tmp_path):
    rows = [("a", "f", "text", 0, "p", "old", [1.0], None), ("b", "f", "table", 1, "p", "t", None, None)]
    merge.write_snapshot(spark.createDataFrame(rows, schemas.MANUAL_CHUNKS), str(tmp_path / "s"))
    assert readers.chunks(spark, str(tmp_path / "s")).where("chunk_type = 'text'").count() == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a b+c.md").write_text("# T\nx", encoding="utf-8")
    (tmp_path / "m" / "blank.md").write_text(" \n ")
    (tmp_path / "m" / "no.txt").write_text("x")
    assert [tuple(r) for r in readers.markdown_files(spark, str(tmp_path / "m")).collect()] == [("a b+c.md", "# T\nx")]
    with pytest.raises(Exception):
        readers.markdown_files(spark, str(tmp_path / "none")).count()
    (tmp_path / "b.json").write_text(json.dumps([{"id": "T1", "query": "q", "expected_files": ["f"], "required_keywords": [], "expected_type": "text", "description": ""}]))
    case = readers.benchmark_cases(spark, str(tmp_path / "b.json")).first()
    assert case.id == "T1" and case.expected_chunk_ids is None
    assert readers.collection_or_empty(spark, str(tmp_path / "gone"), schemas.AUDIT_LOGS).count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pdf").write_bytes(b"%PDF hello")
    assert readers.pdf_pages(spark, str(tmp_path / "p"), lambda b: b.decode()[5:]).first().text == "hello"
    assert analytics.storage_report(spark, str(tmp_path / "s")).first().files >= 2


def test_verdicts(spark):
    def report(*scores):
        return json.dumps({m: {"reasoning": "", "score": s} for m, s in zip(schemas.JUDGE_METRICS, scores)} | {"verdict": "PASS"})

    rows = [(1, report(5, 4, 4, 4)), (2, report(5, 5, 3, 5)), (3, report(6, 5, 5, 5)), (4, "not json"), (5, None)]
    out = {r.id: r.verdict for r in evaluation.judged(spark.createDataFrame(rows, "id int, report string")).collect()}
    assert out == {1: "PASS", 2: "FAIL", 3: None, 4: None, 5: None}

    def audit(*flags):
        return json.dumps({"atomic_checks": [{"statement": "s", "is_supported_by_context": f, "citation_quote": ""} for f in flags]})

    rows = [(1, audit(True, True, True)), (2, audit(True, False, True, True)), (3, None)]
    out = {r.id: (r.leakage_rate, r.verdict) for r in evaluation.leakage(spark.createDataFrame(rows, "id int, report string")).collect()}
    assert out == {1: (0.0, "PASS_ISOLATED"), 2: (0.25, "FAIL_LEAKAGE_DETECTED"), 3: (0.0, "PASS_ISOLATED")}


def test_acceptance_checks(spark):
    s = "chunk_id string, source_file string, chunk_type string, chunk_index int, content string, embedding array<float>"
    rows = [("a", "f", "text", 0, "one. two.", [1.0, 0.0]), ("b", "f", "text", 1, "two.\nthree", [1.0, 0.0]), ("c", "f", "table", 2, "<table>x</table>", [0.0, 1.0])]
    df = spark.createDataFrame(rows, s)
    assert evaluation.embedding_check(df, 2, 3).first().passed and not evaluation.embedding_check(df, 3, 3).first().passed
    assert evaluation.table_check(df).first().passed and evaluation.uniqueness_check(df).first().passed
    assert tuple(evaluation.overlap_check(df).first()) == ("f", 1, 1)
    assert not evaluation.uniqueness_check(df.limit(0)).first().passed
    hits = df.withColumn("cosine_similarity", F.lit(0.7))
    assert evaluation.top_hit_check(hits, 0.6, "ONE").first().passed and not evaluation.top_hit_check(hits, 0.8).first().passed
    checks = evaluation.table_check(df).select("passed").union(evaluation.embedding_check(df, 9).select("passed"))
    assert tuple(evaluation.tally(checks).first()) == (1, 1)


def test_session_stream_restarts(spark, tmp_path):
    """Two runs over arriving files give the same state as one batch over all."""
    src = str(tmp_path / "in")
    turn_rows(spark, 4).coalesce(1).write.parquet(src)
    schema = turn_rows(spark, 1).schema

    def run():
        q = streams.upsert_sessions(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "ck"), 3)
        q.awaitTermination()

    run()
    more = turn_rows(spark, 7).where("turn.turn_id > 4").unionByName(turn_rows(spark, 1, "t"))
    more.coalesce(1).write.mode("append").parquet(src)
    run()
    out = {r.session_id: r for r in streams.stored_sessions(spark, str(tmp_path / "out"), 3).collect()}
    assert out["s"].turn_count == 7 and [t.turn_id for t in out["s"].turns] == [5, 6, 7] and out["t"].turn_count == 1


def test_session_parts_are_merged(spark, tmp_path):
    """Every second batch makes a base; a batch that runs again changes nothing."""
    out = str(tmp_path / "out")
    state = lambda p: streams.merged_sessions(p, 3)
    for k in range(5):
        batch = turn_rows(spark, 2 * k + 2).where(f"turn.turn_id > {2 * k}").unionByName(turn_rows(spark, 1, f"t{k}"))
        for _ in range(2):
            streams._keep(sessions.session_state(batch, 3), k, out, state, 2)
    assert streams._live(spark, out) == (3, [4])
    got = {r.session_id: r for r in streams.stored_sessions(spark, out, 3).collect()}
    assert got["s"].turn_count == 10 and [t.turn_id for t in got["s"].turns] == [8, 9, 10] and got["s"].user_id == "u1" and len(got) == 6


def test_ingest_stream_equals_one_ingest(spark, tmp_path):
    from gneiss.operators import ingest

    (tmp_path / "in").mkdir()
    texts = {"a_1.md": "# T\n## U\nold text. And more.", "a_2.md": "new text.\n<table>x</table>", "a_10.md": "### V\nlast text."}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
        streams.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), every=2).awaitTermination()
    out = {r.chunk_id: (r.content, r.chapter_path, r.chunk_index) for r in streams.stored_chunks(spark, str(tmp_path / "out")).collect()}
    files = spark.createDataFrame([("manual", n, t) for n, t in texts.items()], "manual string, source_file string, text string")
    assert out == {r.chunk_id: (r.content, r.chapter_path, r.chunk_index) for r in ingest.ingest(files).collect()}
    assert out["a_2_c0"][1] == "T / U" and "And more." in out["a_2_c0"][0]


def test_events_are_appended_or_reported(spark, tmp_path):
    names = "query string, result_count int, vector_latency_ms double, keyword_latency_ms double, rerank_latency_ms double, total_latency_ms double, timestamp timestamp"
    t = dt.datetime(2024, 3, 1)
    df = spark.createDataFrame([("q", 1, 1.0, 1.0, 1.0, 3.0, t), ("", 1, 1.0, 1.0, 1.0, 3.0, t), ("q", None, None, None, None, None, t + dt.timedelta(days=1))], names)
    assert streams.append_events(df, str(tmp_path / "a")) == {"status": "success"} == streams.append_events(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).groupBy("day").count().count() == 2
    (tmp_path / "file").write_text("x")
    assert streams.append_events(df, str(tmp_path / "file"))["status"] == "error"


def test_bootstrap_and_fallbacks(spark, tmp_path, monkeypatch):
    from gneiss.sources import store

    assert store.bootstrap(spark, None)["status"] == "skipped"
    for _ in range(2):
        made = store.bootstrap(spark, str(tmp_path / "store"))
        assert made["status"] == "success" and made["indexes"]["chat_sessions"]["unique"] == ["session_id"] and made["indexes"]["search_audit_logs"]["days"] == 30
    assert spark.read.schema(schemas.CHAT_SESSIONS).parquet(str(tmp_path / "store/chat_sessions")).count() == 0
    (tmp_path / "file").write_text("x")
    assert store.bootstrap(spark, str(tmp_path / "file"))["status"] == "error"
    (tmp_path / "root" / "docs").mkdir(parents=True)
    (tmp_path / "root" / "docs" / "x.md").write_text("# X")
    monkeypatch.chdir(tmp_path)
    assert store.resolved("docs", str(tmp_path / "root")) == str(tmp_path / "root" / "docs") and store.resolved("none") == "none" and store.resolved("/abs") == "/abs"
    spark.range(1).selectExpr("id as a").write.parquet(str(tmp_path / "e"))
    spark.range(1).selectExpr("id as a", "'x' as b").write.mode("append").parquet(str(tmp_path / "e"))
    assert {r.b for r in store.evolving(spark, str(tmp_path / "e")).collect()} == {None, "x"}
    assert store.evolving(spark, str(tmp_path / "e"), schemas.FEEDBACK).columns == ["a", "b", "rating", "comment"]


def test_report_files(spark, tmp_path):
    s = spark.createDataFrame([(1, 0.5)], "k int, recall double")
    d = spark.createDataFrame([(1, "x")], "case_id int, candidates string")
    evaluation.write_report(s, d, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary")).schema["k"].dataType.simpleString() == "string"
    assert spark.read.json(str(tmp_path / "r/details")).columns == ["case_id"]


def test_report_searches_texts_once(spark, tmp_path, monkeypatch):
    """What the report, its details and the count before a broadcast share is worked out once: documents' windows are made in one stored pass."""
    from gneiss.functions import frames
    from gneiss.plans import catalog

    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return frames.stored(df)

    monkeypatch.setattr(catalog, "stored", kept)
    docs = spark.createDataFrame([(1, "s", "one two three four five six"), (2, "s", "nothing of it")], "doc_id bigint, source string, text string")
    items = spark.createDataFrame([(7, "two three four"), (8, "of")], "item_id bigint, text string")
    monkeypatch.setattr(catalog, "table", lambda spark, d, name: {"documents": docs, "benchmark": items}[name])
    found = catalog.contained(spark, "")
    assert sorted(map(tuple, found.collect())) == [(7, 1, "s", 5, 14), (8, 2, "s", 9, 2)]
    assert len(plans) == 1 and "xxhash64" in plans[0] and "xxhash64" not in found._jdf.queryExecution().optimizedPlan().toString()
