"""Phrase mining against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import collocations

SCHEMA = "doc_id bigint, lang string, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least, first):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = []
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        if any(p[0] == lang and len(p) > len(words) + 1 and 100 * b >= 100 * a and any(list(p[1 + i : 1 + i + len(words)]) == words for i in range(len(p) - len(words))) for p, b in f.items() if b >= least):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        found.append((lang, -score, -a, " ".join(words).encode(), left, right, n[lang]))
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted(x for x in found if x[0] == lang)[:first]
        out += [(lang, i + 1, p.decode(), -a, left, right, k, -s) for i, (_, s, a, p, left, right, k) in enumerate(mine)]
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["new", "york", "NEW", "York", "the", "a", "é", "Émile", "x\x00y", "a\x0bb", "\x1f", "日本", "b c", "q"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", ": "]
    texts = ["".join(words[rng.integers(0, len(words))] + marks[rng.integers(0, len(marks))] for _ in range(rng.integers(0, 60))) for _ in range(120)]
    langs = ["en", "de", None, "en", "und"]
    rows = [(i, langs[i % 5], t) for i, t in enumerate(texts)]
    return rows + [(1, "en", None), (None, None, ""), (3, "fr", " \t . "), (4, "en", "a a a a a a a a " * 200), (5, "en", "one two three four five six\n" * 40), *rows[:9]]


@pytest.mark.parametrize("seed,least,slice_,group", [(0, 5, 10**6, 10**6), (1, 3, 40, 10**6), (2, 4, 10**6, 300)])
def test_mine(spark, monkeypatch, seed, least, slice_, group):
    monkeypatch.setattr(collocations, "SEGMENT_RUNS", 500)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("phrase"), F.lit(2).alias("utf8")).repartition(5)
    want = brute(rows, least, 25)
    assert sorted(map(tuple, collocations.mine(docs, least, 25, slice_, group).collect())) == want
    assert len(want) > 20 and any(x[2].count(" ") > 1 for x in want)


def test_counters_bound_counts_from_above(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("utf8"))
    few = collocations.heavy_cells(collocations.sketched(docs, 4, 2), 50).count()  # 16 counters: all are heavy
    fine = collocations.heavy_cells(collocations.sketched(docs, 40, 2), 50).count()
    assert few == 16 and 0 < fine < 200


def test_automata_match_whole_words():
    made = collocations.automata([("en", b"a b"), ("en", b"a"), ("de", b"a"), ("en", b"b a b")])
    assert sorted(v for _, v in made["en"].iter(" a b a b \n ab a \n b ")) == [0, 0, 1, 1, 1, 3]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", b"x y", big - 1), ("en", b"x", big), ("en", b"y", big + 7)], "lang string, phrase binary, f bigint")
    totals = spark.createDataFrame([("en", 10 * big)], "lang string, n bigint")
    got = collocations.scored(counts, totals, 100).first()
    assert got["score"] == 1000 * (big - 1) * 10 * big // (big * (big + 7))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.mine(none).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, "en", "a b")], SCHEMA)).count() == 0


def test_numbers_over_many_parts(spark):
    rows = [("en" if i % 3 else "de", f"p{i:04d}", i % 7, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "lang string, phrase string, score bigint, a bigint").repartition(9)
    got = {(r["lang"], r["rank"]): r["phrase"] for r in collocations.numbered(df, 30).collect()}
    for lang in ("en", "de"):
        want = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[2], -r[3], r[1]))[:30]
        assert [got[lang, i + 1] for i in range(30)] == [r[1] for r in want]
