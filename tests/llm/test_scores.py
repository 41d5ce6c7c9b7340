"""Toxicity, quality and language-model scores."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import boosting, ngram_lm, quality, toxicity
from gneiss.llm.common import held_out, table

DATA = "/root/testdata/sf0.01"


def rank_quality(score, y):
    """Probability that a positive row scores above a negative one."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(800) < 0.05)).astype(float)
    model = boosting.fit_calibrated(x[:600], y[:600])
    score = model.score(x[600:])
    assert ((score >= 0.5) == y[600:]).mean() > 0.85 and (0 <= score).all() and (score <= 1).all()
    assert (np.diff(model.probability) >= 0).all()
    additive = boosting.fit_additive(x[:600], y[:600])
    assert (0, 1) in additive.pairs and ((additive.score(x[600:]) >= 0.5) == y[600:]).mean() > 0.7  # main effects alone: a half


def test_additive_is_a_sum_of_tables():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 3)), (rng.random(300) < 0.5).astype(float)
    m = boosting.fit_additive(x, y, rounds=10)
    b, c = boosting.binned(x, m.cuts), boosting.binned(x, m.coarse)
    one = m.start + sum(t[b[7, j]] for j, t in enumerate(m.tables)) + sum(t[c[7, i], c[7, j]] for (i, j), t in zip(m.pairs, m.pair_tables))
    assert abs(m.score(x)[7] - 1 / (1 + math.exp(-one))) < 1e-12


@pytest.mark.parametrize("module,label,name", [(toxicity, "toxic", "toxicity"), (quality, "quality", "quality_score")])
def test_held_out_accuracy(spark, module, label, name):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    add = module.with_toxicity if module is toxicity else module.with_quality
    scored = add(docs.select("doc_id", "text", F.lit(1).alias(name)), module.fit(docs, labels), name)
    rows = scored.where(held_out(F.col("doc_id"))).join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").select(name, "y").collect()
    score, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert ((score >= (0.5 if module is toxicity else 0.3)) == y).mean() > 0.93
    assert rank_quality(score, y) > 0.8


@pytest.mark.parametrize("module,add", [(toxicity, "with_toxicity"), (quality, "with_quality")])
def test_odd_tables(spark, module, add):
    docs = spark.createDataFrame([(1, "you are fine"), (2, None), (3, ""), (None, "x" * 100_000), (1, "you are fine")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = module.fit(docs, none)
    out = getattr(module, add)(docs, model).collect()
    assert len(out) == 5 and len({r[2] for r in out}) == 1
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], none.schema)
    assert getattr(module, add)(docs.limit(0), module.fit(docs, nulls)).count() == 0
    some = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (2, 0, 0), (1, 0, 0)], none.schema)
    out = getattr(module, add)(docs, module.fit(docs, some)).collect()
    assert all(0 <= r[2] <= 1 for r in out) and out[0][2] == out[4][2]


def test_long_texts_take_linear_time():
    import time

    start = time.monotonic()
    lexicon = toxicity.Lexicon({"fool": 2.0}, {"stup": 1.0})
    for text in ("x" * 2_000_000, "a1" * 500_000, "ab@" * 300_000 + "!", "1" * 1_000_000 + "a", "stupid you " * 100_000):
        assert len(toxicity.features(text, lexicon)[0]) == toxicity.N_FEATURES
        quality.features(text)
    assert time.monotonic() - start < 60


def test_hidden_words_are_seen():
    lexicon = toxicity.Lexicon({}, {})
    count = lambda t: toxicity.OBFUSCATED.findall(t)
    assert count("you id1ot, b*tch") == ["id1ot", "b*tch"] and count("plain 4 text! 2nd x2") == []
    assert count("a1b2c") == ["a1b2c"] and count("1a 1a1") == []
    assert toxicity.features("you id1ot", lexicon)[0][13] > 0 == toxicity.features("you 1 ot", lexicon)[0][13]


def brute_scores(texts, order=3, alpha=0.4, least=2):
    docs = [t.split() for t in texts]
    counts = Counter(tuple(d[i : i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        s = 0.0
        for i in range(len(d)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - n + 1 : i + 1])
                if n == 1:
                    s += math.log(counts[gram] / total)
                elif counts[gram] >= least:
                    s += math.log(counts[gram] / counts[gram[:-1]])
                    break
                else:
                    s += math.log(alpha)
        out.append(s)
    return out


def test_backoff_equals_brute_force_in_many_blocks(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefg"), rng.integers(0, 40))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in ngram_lm.score(df, block_bytes=300, bucket_keys=60).collect()}
    for i, expected in enumerate(brute_scores(texts)):
        assert abs(out[i].log_score - expected) < 1e-9 and out[i].n_tokens == len(texts[i].split())


def test_backoff_of_repeated_rows_and_one_long_text(spark):
    """Rows that repeat fall into many blocks, one text stays in one."""
    texts = ["a b a c"] * 3000 + [" ".join(f"w{i % 50}" for i in range(30_000))]
    df = spark.createDataFrame([(min(i, 7), t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    made = ngram_lm.blocks(df, 2000).select("block", F.size("ids").alias("n")).collect()
    assert len(made) > 10 and sum(r.n for r in made) == 3001 and max(r.n for r in made) <= 2000 // 7 + 2
    out = ngram_lm.score(df, block_bytes=2000, bucket_keys=100).collect()
    expected = brute_scores(texts)
    assert len(out) == 3001 and sorted(round(r.log_score, 6) for r in out) == sorted(round(x, 6) for x in expected)
    large = spark.createDataFrame([(2**62 + 1, "x y"), (None, "x y")], "doc_id bigint, text string")
    assert {r.doc_id for r in ngram_lm.score(large).collect()} == {2**62 + 1, None}


def test_backoff_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "A b"), (None, "a B"), (5, " \t ")], "doc_id bigint, text string")
    out = ngram_lm.score(df).collect()
    assert len(out) == 5 and sorted(r.n_tokens for r in out) == [0, 0, 0, 2, 2]
    assert len({r.log_score for r in out if r.n_tokens}) == 1 and all(r.mean_log_score is None for r in out if not r.n_tokens)
    assert ngram_lm.score(df.limit(0)).count() == 0
    values = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert (ngram_lm.decode(ngram_lm.encode(values)) == values).all()
