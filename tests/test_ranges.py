"""Ranges of a manual put together against one pass in order; incremental ingest against one ingest."""

import random

import pytest

from gneiss.config import Chunking
from gneiss.functions import models
from gneiss.operators import ingest
from gneiss.streaming import streams

FILES = "manual string, source_file string, text string"


def files_of(seed, n=14):
    """Manuals with headings of all levels, short and long texts, tables, blank files and repeated names."""
    rng = random.Random(seed)

    def body():
        kind = rng.random()
        if kind < 0.3:
            return "#" * rng.randint(1, 6) + f" H{rng.randint(0, 99)}"
        if kind < 0.45:
            return "<table>" + "x" * rng.randint(0, 30) + "</table>"
        if kind < 0.9:
            return " ".join("w" * rng.randint(1, 9) + rng.choice(["", ".", "!", "。"]) for _ in range(rng.randint(0, 6)))
        return " ".join(f"long{i}{rng.choice(['', '.'])}" for i in range(300))

    rows = [(f"m{i % 3}", f"f_{rng.randint(1, 12)}.md", "\n".join(body() for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return rows + [("m0", "f_3.md", "same"), ("m0", "f_3.md", "same"), ("m1", None, "no name"), (None, "f.md", "no manual"), ("m2", "f_0.md", " ")]


def in_one_pass(rows, settings):
    """(manual, source_file, place in the manual, path) and content of every chunk, line by line and chunk by chunk."""
    out = []
    for manual in sorted({m for m, _, _ in rows if m}):
        heads, plain, final = [None] * 6, "", ""
        for n, (_, name, text) in enumerate(r for r in rows if r[0] == manual):
            place, section, sections = 0, [], []
            for line in text.split("\n"):
                mark = line.split(" ")[0]
                if mark and set(mark) == {"#"} and len(line) > len(mark) + 1:
                    if section:
                        sections.append((path, section))
                    level = len(mark)
                    heads[level - 1 :] = [line[level + 1 :]] + [None] * (6 - level)
                    section = []
                path = " / ".join(h for h in heads if h) or "未分類章節"
                section.append(line)
            sections.append((path, section))
            for path, lines in sections:
                whole = "\n".join(lines).strip()
                for part in (p for p in __import__("re").split(ingest.TABLE, whole)):
                    if part.lower().startswith("<table"):
                        out.append((manual, name, n, place, path, "table", part))
                        place += 1
                        continue
                    for i, value in enumerate(ingest.split_recursive(part.strip(), settings.size, settings.overlap) if part.strip() else []):
                        prefix = ingest.prefix_of(final if i == 0 else plain, settings.prefix)
                        plain, final = value, f"{prefix}\n{value}" if prefix else value
                        out.append((manual, name, n, place, path, "text", final))
                        place += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_equal_one_pass(spark, monkeypatch, seed):
    for name, n in (("LINE_RANGE", 3), ("SECTION_RANGE", 2), ("CHUNK_RANGE", 2)):
        monkeypatch.setattr(ingest, name, n)
    rows, settings = files_of(seed), Chunking()
    df = spark.createDataFrame(rows, FILES).repartition(5)
    order = {(r["manual"], r["source_file"], r["text"], r["file_ord"]) for r in ingest.in_order(df).collect()}
    want = in_one_pass([(m, f, t) for m, f, t, n in sorted(order, key=lambda r: (r[0], r[3]))], settings)
    got = ingest.finished(ingest.plain_chunks(df, settings), settings).collect()
    assert sorted(map(str, ((w[1], w[3], w[4], w[5], w[6]) for w in want))) == sorted(str((r["source_file"], r["chunk_index"], r["chapter_path"], r["chunk_type"], r["content"])) for r in got)
    assert len(want) > 60


def test_a_long_file_is_dealt_to_many_tasks(spark):
    """Lines, chunks and their overlaps of one file of 60,000 lines, in ranges; nothing but sums is grouped by manual alone."""
    text = "\n".join(f"# h{i // 100}" if i % 100 == 0 else f"line {i}." for i in range(60_000))
    df = spark.createDataFrame([("m", "f.md", text)], FILES)
    lines = ingest._marked(ingest.in_order(df), None).groupBy("range").count().collect()
    assert len(lines) == 8 and max(r["count"] for r in lines) == ingest.LINE_RANGE
    made = ingest.plain_chunks(df)
    found = ingest.with_prefixes(made)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [manual#" in plan and all("range#" in x for x in plan.split("FlatMapGroupsInPandas [")[1:])
    assert found.where("content like '%line 59999.%'").first()["chapter_path"] == "h599" and found.count() == made.count() > 600


def test_many_short_chunks_reach_back(spark):
    """Overlaps over more ranges than one: every chunk has a few characters."""
    rows = [("m", i + 1, "table" if i % 7 == 3 else "text", i % 3 != 1, f"c{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "manual string, ord bigint, chunk_type string, first boolean, text string")
    want, plain, final = [], "", ""
    for _, _, kind, first, value in rows:
        if kind == "table":
            want.append(value)
            continue
        prefix = ingest.prefix_of(final if first else plain, 40)
        plain, final = value, f"{prefix}\n{value}" if prefix else value
        want.append(final)
    for n in (1, 2, 50):
        assert [r["content"] for r in ingest.with_prefixes(df, 40, chunk_range=n).orderBy("ord").collect()] == want


def ingested(spark, tmp_path, batches, seen):
    """Chunks after files have arrived in batches; ``seen`` gets the number of texts embedded in each."""
    (tmp_path / "in").mkdir()
    log = tmp_path / "embedded"
    embed = models.hash_embedder(4)

    def counted(texts):
        with open(log, "a") as f:
            f.write("x" * len(texts))
        return embed(texts)

    for files in batches:
        for name, text in files.items():
            (tmp_path / "in" / name).write_text(text)
        log.write_text("")
        streams.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), every=3, backend=counted).awaitTermination()
        seen.append(len(log.read_text()))
    return {r["chunk_id"]: (r["content"], r["chapter_path"], r["chunk_index"]) for r in streams.stored_chunks(spark, str(tmp_path / "out")).collect()}


def whole(spark, files):
    df = spark.createDataFrame([("manual", n, t) for n, t in files.items()], FILES)
    return {r["chunk_id"]: (r["content"], r["chapter_path"], r["chunk_index"]) for r in ingest.ingest(df, backend=models.hash_embedder(4)).collect()}


def test_files_in_order_embed_only_new_chunks(spark, tmp_path):
    rng, seen = random.Random(5), []
    files = {f"f_{i}.md": "\n".join(rng.choice(["# A", "## B", "short.", "<table>x</table>", "some words here. And more"]) + str(i) for _ in range(12)) for i in range(1, 6)}
    batches = [{n: t} for n, t in files.items()]
    got = ingested(spark, tmp_path, batches, seen)
    assert got == whole(spark, files)
    assert seen == [sum(k.startswith(n[:-3] + "_c") for k in got) for n in files]


def test_files_out_of_order_embed_only_changed_chunks(spark, tmp_path):
    seen = []
    files = {"f_1.md": "# T\nfirst text.", "f_3.md": "third text.\n## X\nmore", "f_4.md": "# Own\nfourth", "f_2.md": "## U\nsecond text."}
    got = ingested(spark, tmp_path, [{"f_1.md": files["f_1.md"], "f_3.md": files["f_3.md"]}, {"f_4.md": files["f_4.md"]}, {"f_2.md": files["f_2.md"]}], seen)
    assert got == whole(spark, files)
    assert seen[:2] == [3, 1] and 2 <= seen[2] <= 4 and got["f_3_c0"][1] == "T / U"


def test_a_batch_that_runs_again(spark, tmp_path):
    """The state of a failed attempt at the same batch is not taken for what came before."""
    files = {"f_1.md": "# T\nfirst.", "f_2.md": "second."}
    embed, out = models.hash_embedder(4), str(tmp_path / "out")
    for number, name in ((0, "f_1.md"), (1, "f_2.md"), (1, "f_2.md")):
        streams.absorb_files(spark.createDataFrame([("manual", name, files[name])], FILES), number, out, 2, backend=embed)
    assert {r["chunk_id"]: (r["content"], r["chapter_path"], r["chunk_index"]) for r in streams.stored_chunks(spark, out).collect()} == whole(spark, files)


def test_empty_stores(spark, tmp_path):
    assert streams.stored_chunks(spark, str(tmp_path / "none")).count() == 0 and "embedding" in streams.stored_chunks(spark, str(tmp_path / "none")).columns
    assert streams.stored_sessions(spark, str(tmp_path / "none")).count() == 0


def test_recursive_pieces_are_given_out_in_turn():
    import pandas as pd

    texts = pd.Series([f"text {i}. " * (i % 300) for i in range(1000)] + [None, ""])
    parts = list(ingest.pieces_in_turn(iter([texts, texts[:0], texts[:3]]), 900, 150))
    assert max(map(len, parts)) == ingest.TEXTS and sum(map(len, parts)) == 1005
    assert [x for p in parts for x in p] == [ingest.split_recursive(t or "", 900, 150) for t in [*texts, *texts[:3]]]


def test_tails_split_only_what_an_overlap_can_reach(spark):
    """Sentences are counted in the last chunks of a range alone, and only headings and starts of ranges are summed up."""
    chunks = spark.range(1, 3001).selectExpr("'m' AS manual", "id AS ord", "if(id % 3 = 0, 'table', 'text') AS chunk_type", "true AS first", "concat('Is ', id, '. No.') AS text", "(id - 1) div 2048 AS range")
    got = {r.range: [x.ord for x in r.tail] for r in ingest.tails(chunks, "range", 20).collect()}
    assert got == {0: [2047, 2048], 1: [2998, 2999]}
    plan = ingest.tails(chunks, "range", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_prefix_of_long_texts_reads_their_end():
    for value in ["a. " * 400 + "b" * 300 + ".", "x" * 2000, "One. " + "y" * 900, "甲。" * 700, "a.\n \n b.  c\n" * 200 + " end", " . " * 500]:
        for target in (1, 40, 250, 251):
            parts, kept, n = [s for s in map(str.strip, ingest.SENTENCE.split(value)) if s], [], 0
            while parts and n < target:
                kept.insert(0, parts.pop())
                n += len(kept[0])
            joined = " ".join(kept)
            assert ingest.prefix_of(value, target) == (joined if joined.endswith(tuple("。！？.!?")) else joined + "。")
