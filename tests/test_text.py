"""Text expressions and ingest against the worked examples and a plain ordered pass."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.operators import ingest


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_overlap_prefix(spark):
    for value, target, expected in [("A one. B two. C three", 10, "B two. C three。"), ("甲。乙！丙", 2, "乙！ 丙。"), ("  ", 250, ""), (None, 250, ""), ("no stop", 250, "no stop。")]:
        assert one(spark, lambda c, t=target: text.overlap_prefix(c, t), value) == expected
        if value is not None:
            assert ingest.prefix_of(value, target) == expected


def test_natural_order(spark):
    names = ["m_10.md", "m_2.md", "m_1.md", "M_03.md"]
    df = spark.createDataFrame([(n,) for n in names], "v string").orderBy(text.natural_key(F.col("v")))
    assert [r[0] for r in df.collect()] == ["m_1.md", "m_2.md", "M_03.md", "m_10.md"]


def test_breadcrumb(spark):
    def path(titles):
        return one(spark, text.breadcrumb, titles, "array<string>")

    assert path(["A", "B", "J"]) == "A / B / J"
    assert path(["", None]) == "未分類章節"
    assert path(["A", "B" * 150, "C"]) == "A / ... / C"
    assert len(path(["A" * 80, "B" * 80])) == 163
    meta = spark.sql("SELECT map('H2', 'B', 'H1', ' A ', 'x', 'y') AS m").select(ingest.path_of(F.col("m"))).first()[0]
    assert meta == "A / B"


def test_headings_carry_over_files(spark):
    rows = [(1, "m_2.md", "text of two"), (1, "m_1.md", "# A\n## B\n### C\nbody\n## D\nmore"), (1, "m_10.md", "  "), (2, "z.md", "plain")]
    out = ingest.sections(spark.createDataFrame(rows, "manual int, source_file string, text string")).orderBy("manual", "file_ord", "section").collect()
    assert [(r.source_file, r.chapter_path) for r in out] == [("m_1.md", "A"), ("m_1.md", "A / B"), ("m_1.md", "A / B / C"), ("m_1.md", "A / D"), ("m_2.md", "A / D"), ("z.md", "未分類章節")]


def test_tables_stand_alone(spark):
    rows = [(1, "f.md", "a <TABLE border='1'>x\ny</TABLE> b <table><tr></tr></table> c <tablex>q</table>")]
    files = spark.createDataFrame(rows, "manual int, source_file string, text string")
    out = sorted(ingest.chunked(files).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_type for r in out] == ["text", "table", "text", "table", "text"]
    assert [r.chunk_index for r in out] == [0, 1, 2, 3, 4]
    assert out[1].content == "<TABLE border='1'>x\ny</TABLE>"
    assert out[2].content == "a。\nb" and out[4].content == "a。 b。\nc <tablex>q</table>"
    assert out[0].chunk_id == "f_c0"


def test_prefixes_equal_an_ordered_pass(spark):
    import random

    rng = random.Random(3)
    rows, expected, plain, final = [], [], "", ""
    for i in range(60):
        kind = "table" if rng.random() < 0.2 else "text"
        first = rng.random() < 0.5
        value = " ".join("w" * rng.randint(1, 9) + rng.choice(["", ".", "!", "。"]) for _ in range(rng.randint(1, 60)))
        rows.append(("m", i, kind, first, value))
        if kind == "text":
            prefix = ingest.prefix_of(final if first else plain, 250)
            plain, final = value, f"{prefix}\n{value}" if prefix else value
            expected.append(final)
        else:
            expected.append(value)
    out = ingest.with_prefixes(spark.createDataFrame(rows, "manual string, ord bigint, chunk_type string, first boolean, text string")).orderBy("ord").collect()
    assert [r.content for r in out] == expected


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。;", max_size=3000))
def test_recursive_pieces_hold_the_text(value):
    parts = ingest.split_recursive(value, 100, 20)
    assert all(0 < len(p) <= 100 for p in parts)
    at = 0
    squeezed = value
    for p in parts:  # every piece stands in the text, none before the one before it
        found = squeezed.find(p, max(0, at - 100))
        assert found >= 0
        at = found
    assert set("".join(value.split())) <= set("".join("".join(parts).split()))


def test_semantic_chunks_hold_all_sentences(spark):
    value = "One two three. Four five six! Seven. 八九。十 eleven?"
    rows = spark.createDataFrame([("k", value), ("e", "")], "piece_id string, text string")
    out = sorted(ingest.semantic_chunks(rows).collect(), key=lambda r: r.chunk)
    assert " ".join(r.text for r in out) == "One two three. Four five six! Seven. 八九。 十 eleven?"
    assert {r.piece_id for r in out} == {"k"}


def test_semantic_cuts_stay_in_their_rows(spark):
    """Cuts are those of a plain pass over the default vectors; nothing is shuffled, and a row is cut by itself."""
    import math

    from gneiss.functions.models import hash_embedder

    values = [" ".join(f"w{i * i % 7} w{i % n} is here." for i in range(n)) for n in (1, 2, 40, 75)] + ["!!! ??? a. ... b. b.", "same. same.", "", None]
    keys = [0, 1, 2, 3, 4, 5, 6, 7]
    rows = spark.createDataFrame(list(zip(keys, values, strict=True)) + [(2, values[2])], "piece_id int, text string")
    made = ingest.semantic_chunks(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.schema.simpleString() == "struct<piece_id:int,chunk:bigint,text:string>"
    got = sorted(map(tuple, made.collect()))
    expected = []
    for key, value in [*zip(keys, values, strict=True), (2, values[2])]:
        parts = [s for s in map(str.strip, ingest.SENTENCE.split(value or "")) if s]
        vectors = hash_embedder()(parts)
        gaps = []
        for a, b in zip(vectors, vectors[1:]):
            size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            gaps.append(round(1 - (sum(x * y for x, y in zip(a, b)) / size if size else 0), 9))
        chunks = [[p] for p in parts[:1]]
        if gaps:
            place = (len(gaps) - 1) * 0.85
            low = sorted(gaps)[math.floor(place)]
            bar = low + (place - math.floor(place)) * (sorted(gaps)[math.ceil(place)] - low)
            for p, gap in zip(parts[1:], gaps):
                if gap > bar + 1e-12:
                    chunks.append([p])
                else:
                    chunks[-1].append(p)
        expected += [(key, n, " ".join(c)) for n, c in enumerate(chunks)]
    assert got == sorted(expected)
    assert len([r for r in got if r[0] == 3]) > 3


def test_clean_for_embedding(spark):
    assert one(spark, text.clean_for_embedding, "<td style='a'>x</td><td  style=\"b\">y</td>") == "<td>x</td><td>y</td>"
    assert len(one(spark, text.clean_for_embedding, "x" * 5000)) == 3500


def test_ingest_counts_and_vectors(spark):
    files = spark.createDataFrame([(1, "a.md", "# T\nSome text. More.\n<table><tr></tr></table>")], "manual int, source_file string, text string")
    made = ingest.ingest(files).cache()
    assert tuple(ingest.counts(made).first()) == (2, 1, 1)
    assert {len(r.embedding) for r in made.collect()} == {64}
    assert ingest.ingest(files.limit(0)).count() == 0
    assert ingest.chunked(files, kind="semantic").count() >= 2


def test_long_semantic_chunks_are_split(spark):
    """A semantic chunk beyond the safe length is cut again; shorter ones stay whole."""
    from gneiss.config import Chunking

    long, short = "word " * 700, "One sentence. Another one."
    files = spark.createDataFrame([("m", "a.md", long), ("m", "b.md", short)], "manual string, source_file string, text string")
    made = ingest.chunked(files, Chunking(prefix=1), kind="semantic").collect()
    of = {name: [r.content for r in made if r.source_file == name] for name in ("a.md", "b.md")}
    assert len(of["a.md"]) >= 4 and all(len(c) <= 2000 for c in of["a.md"])
    assert "".join(of["b.md"]).replace("\n", " ").endswith("Another one.")


def test_names_with_very_long_numbers(spark):
    names = ["m_" + "9" * 25 + ".md", "m_1" + "0" * 25 + ".md", "m_007.md", "m_10.md"]
    df = spark.createDataFrame([(n,) for n in names], "v string").orderBy(text.natural_key(F.col("v")))
    assert [r[0] for r in df.collect()] == ["m_007.md", "m_10.md", names[0], names[1]]
