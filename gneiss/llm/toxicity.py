"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learnt beside the trees: words and stems of four and six letters that occur in toxic
training documents far more often than chance allows. So words that no fixed list has, in any
language, count as soon as the labels show them.

Defined results: a null text counts as empty; an empty text gets the score of its (all but
zero) features; equal texts get equal scores; without any usable label every score is 0.5
less a hair, so nothing is predicted toxic; very long texts and runs of letters are read whole, in
linear time; all other columns pass through, and a column that already has the score's name is
replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log, log1p
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import boosting
from gneiss.llm.common import append_score, byte_counts, cut, label_sample

#: Most labelled rows from which the model is fitted.
MAX_TRAIN_ROWS = 20_000
#: Most learnt lexicon entries, the strongest.
MAX_LEXICON = 5_000

# English insults, and second-person pronouns of English, German, French, Spanish.
INSULTS = frozenset("asshole bastard bitch clown coward cretin crap creep damn dick disgusting dumb dumbass filth filthy fool freak fuck fucking garbage hate idiot idiotic imbecile jerk kill liar loser moron moronic pathetic pig scum shit shut stupid sucker trash ugly vermin vile whore worthless wretch".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú usted ustedes ti".split())
LEET = str.maketrans("013457@$!|", "oieastasii")

WORD = re.compile(r"[^\W\d_]+")
#: Letters with such characters between them. It starts at a run's first letter alone and takes
#: runs whole, so that one pass does.
OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*]++[^\W\d_]++)+")
NEAR = 6
STEMS = (4, 6)
FOLDS = 4


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]


def terms(text: str) -> set[str]:
    """The distinct words (w:) and stems (s:, of STEMS letters) of a text."""
    words = set(WORD.findall(text.lower()))
    return {f"w:{w}" for w in words} | {f"s:{w[:k]}" for w in words for k in STEMS if len(w) >= k}


def features(text: str, *lexicons: Lexicon) -> list[list[float]]:
    """The dense features of one whole text, for each lexicon; the time is linear in the text."""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words) or 1
    hidden = [x.translate(LEET) for x in OBFUSCATED.findall(low)]
    fixed = sum(map(INSULTS.__contains__, words))
    second = sum(map(SECOND_PERSON.__contains__, words))
    b = byte_counts(text)
    upper, lower, size = b[65:91].sum(), b[97:123].sum(), max(1, b.sum())
    marks = [
        upper / max(1, upper + lower),
        1000 * b[33] / size,
        1000 * b[63] / size,
        1000 * (b[34:48].sum() + b[58:63].sum() + b[91:97].sum() + b[123:127].sum() + b[64]) / size,
        100 * len(hidden) / n,
    ]
    out = []
    for lexicon in lexicons:
        lw, ls = lexicon.words, lexicon.stems
        hits = [i for i, w in enumerate(words) if w in lw or w[:4] in ls or w[:6] in ls]
        odds = [max(lw.get(words[i], 0.0), ls.get(words[i][:4], 0.0), ls.get(words[i][:6], 0.0)) for i in hits]
        masked = sum(h in lw or h in INSULTS for h in hidden)
        near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        head = [100 * len(hits) / n, log1p(len(hits)), sum(odds) / n, max(odds, default=0.0), 100 * fixed / n, log1p(fixed), near / (len(hits) or 1), 100 * second / n]
        out.append([*head, *marks, log1p(masked), log(n)])
    return out


N_FEATURES = 15


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: boosting.CalibratedTrees | None

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), 0.49)
        return self.trees.score(np.array([features(t, self.lexicon)[0] for t in texts]).reshape(-1, N_FEATURES))


def fold_of(doc_id: int) -> int:
    """The calibration fold of a training row, the same for all its copies."""
    return crc32(b"fold %d" % doc_id) % FOLDS


def _term_counts(sample: DataFrame) -> DataFrame:
    """(kind, term, a, b): in how many toxic and clean documents of each fold a term occurs; the
    kind is 0 for words, else the length of a stem with its mark."""

    def pairs(batches):
        import pyarrow as pa

        for batch in batches:
            counts = [Counter() for _ in range(2 * FOLDS)]
            for doc, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts[fold_of(doc) + (0 if y else FOLDS)].update(terms(text))
            keys = list(set().union(*counts))
            columns = [pa.array([c[k] for k in keys], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], ["term", *names])

    names = [f"{kind}{k}" for kind in "ab" for k in range(FOLDS)]
    made = sample.select("doc_id", "text", "y").mapInArrow(pairs, "term string, " + ", ".join(f"{c} bigint" for c in names))
    summed = made.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    return cut(summed.withColumn("kind", F.when(F.col("term").startswith("w:"), 0).otherwise(F.length("term"))))


def _learn_lexicon(counts: DataFrame, toxic: int, clean: int, folds: list[int], most: int) -> Lexicon:
    """Terms whose documents of these folds are toxic beyond chance, by a log-likelihood ratio.

    The bar rises with the number of terms tried, so that none is expected by luck. At most
    ``most`` terms are taken, the strongest, which bounds the model and what reaches the driver.
    """
    if not toxic or not clean:
        return Lexicon({}, {})
    a, b = (sum((F.col(f"{kind}{k}") for k in folds), F.lit(0)) for kind in "ab")
    counted = counts.select("term", "kind", a.alias("a"), b.alias("b")).where("a + b >= 3")
    rate = toxic / (toxic + clean)
    share = F.col("a") / (F.col("a") + F.col("b"))
    ratio = 2 * (F.col("a") * F.log(share / F.lit(rate)) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / F.lit(1 - rate))).otherwise(0.0))
    tried = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # a row for each kind
    bar = F.lit(0.0)
    for kind, n in tried.items():
        bar = F.when(F.col("kind") == kind, 2 * log(n + 1)).otherwise(bar)
    strong = counted.where((F.col("a") > 0) & (share >= 0.5)).withColumn("ratio", ratio).where(F.col("ratio") >= bar).orderBy(F.desc("ratio"), "term").limit(most)
    words, stems = {}, {}
    for r in strong.collect():  # at most ``most`` rows
        odds = log((r["a"] + 0.5) / (toxic - r["a"] + 0.5)) - log((r["b"] + 0.5) / (clean - r["b"] + 0.5))
        (words if r["kind"] == 0 else stems)[r["term"][2:]] = float(odds)
    return Lexicon(words, stems)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_terms: int = MAX_LEXICON) -> ToxicityModel:
    """Learn lexicon, trees and calibration from at most ``max_rows`` labelled rows.

    The margins for the calibration of a fold come from a lexicon and trees learnt without it.
    """
    sample = cut(label_sample(docs, labels, "toxic", max_rows))
    ys = np.array([(fold_of(r["doc_id"]), r["y"]) for r in sample.select("doc_id", "y").collect()]).reshape(-1, 2)  # at most max_rows rows
    toxic, clean = int((ys[:, 1] == 1).sum()), int((ys[:, 1] == 0).sum())
    if not toxic or not clean:
        return ToxicityModel(Lexicon({}, {}), None)
    counts, everything = _term_counts(sample), list(range(FOLDS))
    lexicons = [_learn_lexicon(counts, toxic, clean, everything, max_terms)]
    for k in everything:
        rest = ys[ys[:, 0] != k, 1]
        lexicons.append(_learn_lexicon(counts, int((rest == 1).sum()), int((rest == 0).sum()), [j for j in everything if j != k], max_terms))

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [sum(features(t, *lexicons), []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(measured, "doc_id bigint, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), FOLDS + 1, N_FEATURES), np.array([r["y"] for r in rows], float)
    fold = np.array([fold_of(r["doc_id"]) for r in rows])
    return ToxicityModel(lexicons[0], boosting.fit_calibrated(x[:, 0], y, fold, lambda k: x[:, 1 + k]))


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; higher is likelier toxic."""
    return append_score(docs, "text", lambda: model.score, name)
