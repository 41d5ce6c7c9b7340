"""Quality classifier: an additive model with pairwise interactions.

Cyclic boosted shallow trees learn one lookup table per feature; the strongest pairs get
two-way tables. Scoring adds up table cells for whole batches at a time.

Defined results: a null text counts as empty and gets the score of its features; equal texts
get equal scores; very long texts are read whole, in linear time; without any usable label every
text is kept with score 0.5; all other columns pass through, and a column that already has the
score's name is replaced.
"""

from __future__ import annotations

from collections import Counter
from math import log1p
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from gneiss.llm import boosting
from gneiss.llm.common import append_score, byte_counts, label_sample

#: Most labelled rows from which the model is fitted.
MAX_TRAIN_ROWS = 20_000

# Frequent function words of English, German, French, Spanish.
FUNCTION_WORDS = frozenset("the of and to a in is that for it was on be with as by at this from are der die das und zu in ein für nicht von den mit ist des auf sich le la les de et un une des du en que qui dans est pour par sur pas avec au el los las y que un una con para por se es al lo no".split())

N_FEATURES = 18


def features(text: str) -> list[float]:
    """The dense features of one whole text."""
    words = text.split()
    n = len(words) or 1
    b = byte_counts(text)
    size = max(1, int(b.sum()))
    letters = b[65:91].sum() + b[97:123].sum()
    symbols = b[35:39].sum() + b[42:44].sum() + b[60:63].sum() + b[64] + b[91:97].sum() + b[123] + b[125:127].sum()
    lines = text.split("\n")
    counts = Counter(words)
    top = max(counts.values(), default=0)
    adjacent = sum(map(eq, words, words[1:]))
    long_lines = [x for x in lines if len(x) > 20]
    return [
        log1p(n),
        size / n,
        len(counts) / n,
        top / n,
        adjacent / n,
        100 * b[124] / n,
        100 * symbols / n,
        100 * (b[33] + b[63]) / n,
        100 * b[44] / n,
        100 * b[46] / n,
        100 * b[48:58].sum() / n,
        b[65:91].sum() / max(1, letters),
        letters / size,
        b[128:].sum() / size,
        1 - len(set(long_lines)) / (len(long_lines) or 1),
        n / len(lines),
        sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        sum(map(str.isupper, words)) / n,
    ]


def score_texts(model: boosting.Additive | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return model.score(np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> boosting.Additive | None:
    """Fit on at most ``max_rows`` labelled rows; None if there is no label of either kind."""
    sample = label_sample(docs, labels, "quality", max_rows)

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(measured, "doc_id bigint, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    if not rows or len({r["y"] for r in rows}) < 2:
        return None
    return boosting.fit_additive(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float))


def with_quality(docs: DataFrame, model: boosting.Additive | None, name: str = "quality_score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; higher is likelier good."""
    return append_score(docs, "text", lambda: lambda texts: score_texts(model, texts), name)
