"""Keyword search over English lexemes: weighted postings, AND matching and two rankings.

Texts and queries lose their stop words, and words are told apart by their stems. ``wtf`` is the
sum over lexemes and fields of weight * tf / (tf + 1), with weight 1.0 for the chapter path and 0.4
for the content. ``bm25`` is Robertson and Zaragoza's, over both fields. Both are definitions of
this engine.

Only the words of a corpus that start like a query's are stemmed, each once; they give the forms of
the query's lexemes, and matching then compares forms inside the row, on the JVM.

Words are counted inside their row (``WordCounts``), so what is shuffled are postings, never words.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions import stemming, text
from gneiss.functions.frames import broadcast_if_small, scratch
from gneiss.functions.vectors import PLACES

WEIGHTS = {"A": 1.0, "B": 0.4}
#: Chunks whose words are counted at once.
ROWS = 500


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """Stems of words, in batches."""
    return words.map(stemming.stem, na_action="ignore")


class WordCounts:
    """Counts of two columns of words (lists), in batches; a word is made a term once for many batches.

    Terms are lexemes, or the words themselves if ``english`` is false; ``terms``, if given, are the only ones kept.
    """

    def __init__(self, english: bool = True, terms: list[str] | None = None):
        self.english, self.terms = english, None if terms is None else frozenset(terms)
        self.known: dict[str, str | None] = {}

    def term(self, word: str) -> str | None:
        if not self.english:
            return word
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = None if word in stemming.STOP_WORDS else stemming.stem(word)
        return self.known[word]

    def of(self, a: pa.ListArray, b: pa.ListArray):
        """(length of each row, owner, name, in a, in b): the last four by row and term, rows in order."""
        n, terms = len(a), {}
        fields, length = [], np.zeros(n, np.int64)
        for lists in (a, b):
            words = lists.flatten().dictionary_encode()
            made = [self.term(w) for w in words.dictionary.to_pylist()]
            places = [-2 if t is None else -1 if self.terms is not None and t not in self.terms else terms.setdefault(t, len(terms)) for t in made]
            codes = np.array(places, np.int64)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            length += np.bincount(owner[codes >= -1], minlength=n)
            fields.append((owner[codes >= 0], codes[codes >= 0]))
        width = max(1, len(terms))
        pairs = [o * width + c for o, c in fields]
        both = np.unique(np.concatenate(pairs))
        ta, tb = (np.bincount(np.searchsorted(both, p), minlength=len(both)).astype(np.int32) for p in pairs)
        return length, both // width, pa.array(list(terms), pa.string()).take(pa.array(both % width)), ta, tb


def slices(batches, rows: int = ROWS):
    """Batches cut into such of at most ``rows`` rows."""
    return (b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows))


def counted(chunks: DataFrame, key: str = "chunk_id", english: bool = True, terms: list[str] | None = None) -> DataFrame:
    """(key, term, ta, tb) of each row: how often a term stands in its path (a) and content (b)."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches):
        counts = WordCounts(english, terms)
        for batch in slices(batches):
            _, owner, names, ta, tb = counts.of(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), names, pa.array(ta), pa.array(tb)], [key, "term", "ta", "tb"])

    fields = chunks.select(key, text.tokens(F.col("chapter_path")).alias("a"), text.tokens(F.col("content")).alias("b"))
    return fields.mapInArrow(run, f"`{key}` {kind}, term string, ta int, tb int")


def postings(chunks: DataFrame, key: str = "chunk_id", english: bool = True, terms: list[str] | None = None) -> DataFrame:
    """(key, field, term, tf) of both fields; write it bucketed by term to serve many queries.

    Terms are lexemes, or plain tokens if ``english`` is false. If ``terms`` are given, no others are kept.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("tf")) for f, c in (("A", "ta"), ("B", "tb"))])
    dealt = counted(chunks, key, english, terms).select(key, "term", F.explode(F.filter(fields, lambda f: f["tf"] > 0)).alias("f"))
    return dealt.groupBy(key, "f.field", "term").agg(F.sum("f.tf").alias("tf"))


def document_frequencies(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, df): in how many chunks each token stands.

    A chunk's tokens are told apart inside its row, and rows are summed up by term before the exchange. Only chunks
    whose key is repeated meet, so that they count once.
    """
    repeated = broadcast_if_small(chunks.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("again")))
    same = F.col(key).eqNullSafe(F.col("again"))
    tokens = F.array_distinct(F.concat(text.tokens(F.col("chapter_path")), text.tokens(F.col("content"))))

    def dealt(rows):
        return rows.select(key, F.explode(tokens).alias("term"))

    once = dealt(chunks.join(repeated, same, "left_anti")).select("term")
    more = dealt(chunks.join(repeated, same, "left_semi")).distinct().select("term")
    return once.unionByName(more).groupBy("term").agg(F.count("*").alias("df"))


def store_postings(held: DataFrame, name: str, buckets: int = 64) -> None:
    """Keep postings as a table bucketed and sorted by term: lookups read one bucket, and joins by
    term aren't shuffled."""
    held.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)


def match_stored(held: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, wtf) from stored postings, equal to ``match_all`` on the chunks themselves."""
    weight = F.when(F.col("field") == "A", WEIGHTS["A"]).otherwise(WEIGHTS["B"])
    some = held.where(F.col("term").isin(terms) if terms else F.lit(False))
    scored = some.groupBy(key).agg(F.countDistinct("term").alias("n"), F.round(F.sum(weight * F.col("tf") / (F.col("tf") + 1.0)), PLACES).alias("wtf"))
    return scored.where(F.col("n") == len(set(terms))).select(key, "wtf")


def query_terms(query: str) -> list[str]:
    """Distinct lexemes of a query, as the texts' own are made; a query of stop words has none."""
    return sorted(set(stemming.lexemes(re.findall(r"[^\W_]+", query.lower()))))


def forms_of(chunks: DataFrame, terms: list[str]) -> dict[str, list[str]]:
    """The words of both fields that have each lexeme as their stem.

    What reaches the driver are the forms of the given lexemes, some dozens each.
    """
    own = {t: {t} if stemming.stem(t) == t and t not in stemming.STOP_WORDS else set() for t in terms}
    for word, one in stemming.SPECIAL.items():
        if one in own:
            own[one].add(word)
    if terms:
        heads = "^(?:" + "|".join(sorted({re.escape(stemming.head(t)) for t in terms})) + ")"
        fields = F.array_distinct(F.concat(text.words(F.col("chapter_path")), text.words(F.col("content"))))
        met = chunks.select(F.explode_outer(F.filter(fields, lambda t: t.rlike(heads))).alias("word")).where("word is not null").distinct()
        for r in met.withColumn("term", stems("word")).where(F.col("term").isin(terms)).collect():
            own[r["term"]].add(r["word"])
    return {t: sorted(own[t]) for t in terms}


def _form_counts(chunks: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, length, a0, b0, a1, ...): how often each lexeme stands in path (a) and content (b).

    Frequencies are counted inside the row, so nothing is shuffled to match.
    """
    forms = forms_of(chunks, terms)
    every = sorted({w for own in forms.values() for w in own})
    held = chunks.select(key, text.words(F.col("chapter_path")).alias("a"), text.words(F.col("content")).alias("b"))
    wanted = held.select(key, (F.size("a") + F.size("b")).alias("length"), *[F.filter(f, _is_one(every)).alias(f) for f in ("a", "b")])
    counts = [F.size(F.filter(f, _is_one(forms[t]))).alias(f"{f}{i}") for i, t in enumerate(terms) for f in ("a", "b")]
    return wanted.select(key, "length", *counts)


def _is_one(words: list[str]):
    return lambda t: t.isin(words) if words else F.lit(False)


def _bm25(facts, i: int, k1: float, b: float):
    tf = F.col(f"a{i}") + F.col(f"b{i}")
    idf = F.log(1.0 + (F.lit(float(facts["n"])) - facts[f"d{i}"] + 0.5) / (F.lit(float(facts[f"d{i}"])) + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(facts["mean"] or 1.0)))


def _wtf(i: int):
    parts = [F.lit(w) * F.col(f"{f}{i}") / (F.col(f"{f}{i}") + 1.0) for f, w in (("a", WEIGHTS["A"]), ("b", WEIGHTS["B"]))]
    return parts[0] + parts[1]


def score_all(chunks: DataFrame, queries: dict[int, list[str]], ranking: str = "bm25", key: str = "chunk_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) of every chunk that holds all lexemes of a query; none, no match.

    All queries share one pass that finds their words and one that counts, so take them in blocks
    of some dozens. Statistics are over all ``chunks``.
    """
    terms = sorted({t for q in queries.values() for t in q})
    asked = {q: sorted({terms.index(t) for t in own}) for q, own in queries.items() if own}
    if not asked:
        return chunks.select(F.lit(None).cast("bigint").alias("query_id"), key, F.lit(0.0).alias("score")).limit(0)
    counted = _form_counts(chunks, terms, key)
    facts = None
    if ranking == "bm25":
        # Narrow counts are kept, so the statistics and the scores share one pass over the texts.
        path = scratch(chunks.sparkSession)
        counted.write.parquet(path)
        counted = chunks.sparkSession.read.schema(counted.schema).parquet(path)
        held = [F.count_if(F.col(f"a{i}") + F.col(f"b{i}") > 0).alias(f"d{i}") for i in range(len(terms))]
        facts = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *held).first()
    hits = []
    for q, places in sorted(asked.items()):
        found, score = F.lit(True), F.lit(0.0)
        for i in places:
            found = found & (F.col(f"a{i}") + F.col(f"b{i}") > 0)
            score = score + (_bm25(facts, i, k1, b) if ranking == "bm25" else _wtf(i))
        hits.append(F.when(found, F.struct(F.lit(q).cast("bigint").alias("query_id"), F.round(score, PLACES).alias("score"))))
    dealt = counted.select(key, F.explode_outer(F.array(*hits)).alias("hit"))
    return dealt.where(F.col("hit").isNotNull()).select("hit.query_id", key, "hit.score")


def match_all(chunks: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, wtf) of the chunks that hold every term in either field."""
    return score_all(chunks, {0: terms}, "wtf", key).select(key, F.col("score").alias("wtf"))


def bm25(chunks: DataFrame, terms: list[str], key: str = "chunk_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, bm25) of the chunks that hold every term."""
    return score_all(chunks, {0: terms}, "bm25", key, k1, b).select(key, F.col("score").alias("bm25"))
