"""Phrase collocation mining: runs of two to five words that stand together more often than their parts.

Everything is counted within a language. A first pass over the texts fills a count-min sketch of all
runs: a row of 2^36 counters, say, of which only those that are hit are kept, by segments. A counter
bounds the occurrences of the runs that fall on it from above, so runs that occur ``min_count`` times are
all among those on counters that reach it. A second pass writes these candidates out. They, and
their single words, are compiled into Aho-Corasick automata, each word between two spaces and pieces
between line breaks, so that a pattern matches whole words only; a third pass runs the automata over the
texts and counts overlapping matches. Sums of these exact counts decide, the sketch doesn't.

Candidates beyond ``GROUP_BYTES`` take several automata and as many scans, heavy counters beyond ``SLICE``
several passes that pick candidates, so what tasks hold and what is broadcast is bounded. Nothing
is gathered by language: the first phrases of each are numbered by a sort over all of them.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each
time; very long texts are taken whole; ties in score go to the more frequent, then to the phrase that
sorts first by its bytes; an empty table gives an empty result; further columns are ignored. Scores are
whole numbers of any size up to 38 digits in between.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import broadcast_if_small, cut
from gneiss.llm.ngram_lm import decode, encode, mix

LONGEST = 5
MIN_COUNT = 100
FIRST = 2000
#: Bytes of text that are hashed at once, runs that are sorted at once, and runs in a segment, about.
CHUNK_BYTES, SORT_RUNS, SEGMENT_RUNS = 4_000_000, 4_000_000, 1_500_000
#: Heavy counters in one pass that picks candidates, and bytes of patterns in one automaton.
SLICE, GROUP_BYTES = 8_000_000, 8_000_000
#: Patterns that are packed together, and phrases that a task holds before it packs them.
PART, HELD = 4096, 400_000
#: Lower case for A to Z alone; ends of pieces become a byte that no text has, tabs become spaces.
FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_built: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` and its inverse, modulo 2^64, to the powers 0 to n - 1 at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        _powers[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, b, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def chunks(batches, size: int = CHUNK_BYTES):
    """(languages, folded texts, where each begins) of some rows at a time; a text ends with the end of a piece."""
    langs, texts, held = [], [], 0

    def chunk():
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return langs, (b"\xff".join(texts) + b"\xff").translate(FOLD), at[:-1]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            langs.append(lang)
            texts.append(text)
            held += len(text) + 1
            if held >= size:
                yield chunk()
                langs, texts, held = [], [], 0
    if texts:
        yield chunk()


class Words:
    """The words of a chunk: where they begin and end, their places in pieces, hashes, and texts."""

    def __init__(self, langs: list[str], data: bytes, at: np.ndarray):
        import xxhash

        a = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(((a != 0x20) & (a != 0xFF)).astype(np.int8), prepend=0, append=0))
        self.data, self.starts, self.ends = data, edges[::2], edges[1::2]
        up, down = powers(len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + 1) * up[: len(a)], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = mix(raw, raw >> np.uint64(32))
        piece = np.searchsorted(np.flatnonzero(a == 0xFF), self.starts)
        index = np.arange(len(piece))
        self.place = index - np.maximum.accumulate(np.where(np.diff(piece, prepend=-1) != 0, index, 0)) if len(piece) else index
        self.text = np.searchsorted(at, self.starts, "right") - 1
        self.lang = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogateescape"), 11) for x in langs], np.uint64)[self.text]

    def runs(self, kept=lambda n, last, keys: last):
        """(n, last words, keys of the runs of n words up to them), from two words on.

        ``kept(n, last, keys)`` gives those that may be part of a longer run.
        """
        grams, alive = self.hashes, np.ones(len(self.hashes), bool)
        for n in range(2, LONGEST + 1):
            last = np.flatnonzero(alive[1:] & alive[:-1] & (self.place[1:] >= n - 1)) + 1
            longer = np.zeros_like(grams)
            longer[last] = mix(grams[last - 1], self.hashes[last]) + np.uint64(n)
            keys = mix(longer[last], self.lang[last])
            yield n, last, keys
            grams, alive = longer, np.zeros(len(grams), bool)
            alive[kept(n, last, keys)] = True

    def phrase(self, n: int, last: int) -> bytes:
        return b" ".join(self.data[self.starts[last - n + 1] : self.ends[last]].split())


def sketched(rows: DataFrame, bits: int, segment_bits: int) -> DataFrame:
    """(segment, cells, counts): what each part of the texts adds to the sketch of 2^bits counters."""

    def run(batches):
        import pyarrow as pa

        shift, inner = np.uint64(64 - bits), np.uint64(bits - segment_bits)

        def part(held):
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            at = np.append(np.searchsorted(cells, np.arange(1 << segment_bits, dtype=np.uint64) << inner), len(cells))
            some = [(s, i, j) for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            columns = [pa.array([s for s, _, _ in some], pa.int64()), *(pa.array([encode(f(i, j)) for _, i, j in some], pa.binary()) for f in (lambda i, j: np.diff(cells[i:j], prepend=np.uint64(0)), lambda i, j: counts[i:j]))]
            return pa.RecordBatch.from_arrays(columns, ["segment", "cells", "counts"])

        held, size = [], 0
        for chunk in chunks(batches):
            for _, _, keys in Words(*chunk).runs():
                held.append(keys >> shift)
                size += len(keys)
            if size >= SORT_RUNS:
                yield part(held)
                held, size = [], 0
        if size:
            yield part(held)

    return rows.mapInArrow(run, "segment bigint, cells binary, counts binary")


def heavy_cells(parts: DataFrame, min_count: int) -> DataFrame:
    """(cell) of the counters that reach ``min_count``."""

    def run(frame):
        import pandas as pd

        cells = np.concatenate([np.cumsum(decode(x), dtype=np.uint64) for x in frame["cells"]])
        counts = np.concatenate([decode(x).astype(np.int64) for x in frame["counts"]])
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        return pd.DataFrame({"cell": cells[first][np.add.reduceat(counts, first) >= min_count].astype(np.int64)})

    return parts.groupBy("segment").applyInPandas(run, "cell bigint")


def picked(rows: DataFrame, cells: np.ndarray, bits: int, whole: bool, totals: bool) -> DataFrame:
    """(part, lang, words, phrases): the runs on the given counters, packed by parts of their keys; with ``totals``
    also the number of words of each language in a task, as part -1.

    If the counters are the ``whole`` heavy set, runs of which a part isn't on them are passed by, as
    none is more frequent than its parts; otherwise every run is looked up.
    """
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    part_bits = max(0, ceil(log2(max(1, len(cells) / PART))))

    def run(batches):
        import pyarrow as pa
        import zstandard

        cells, shift = shared.value, np.uint64(64 - bits)
        width = np.uint64(max(0, bits - 22))
        near = np.zeros(1 << min(bits, 22), bool)
        near[cells >> width] = True

        def known(keys):
            cell = keys >> shift
            some = np.flatnonzero(near[cell >> width])
            at = np.minimum(np.searchsorted(cells, cell[some]), max(0, len(cells) - 1))
            return some[cells[at] == cell[some]] if len(cells) else some[:0]

        def packed(found):
            by: dict = {}
            for key in sorted(found):
                lang, phrase = found[key]
                by.setdefault((key >> (64 - part_bits) if part_bits else 0, lang), []).append(phrase)
            press = zstandard.ZstdCompressor()
            columns = ([p for p, _ in by], [x for _, x in by], [0] * len(by), [press.compress(b"\xff".join(own)) for own in by.values()])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "lang", "words", "phrases"])

        types = (pa.int64(), pa.string(), pa.int64(), pa.binary())
        met, words = {}, {}
        for chunk in chunks(batches):
            found, names = Words(*chunk), chunk[0]
            for n, last, keys in found.runs((lambda n, last, keys: last[known(keys)]) if whole else lambda n, last, keys: last):
                here = known(keys)
                own, first = np.unique(keys[here], return_index=True)
                for key, i in zip(own.tolist(), last[here[first]].tolist(), strict=True):
                    if key not in met:
                        met[key] = names[found.text[i]], found.phrase(n, i)
            for lang, k in zip(names, np.bincount(found.text, minlength=len(names)).tolist(), strict=True):
                words[lang] = words.get(lang, 0) + k
            if len(met) > HELD:
                yield packed(met)
                met = {}
        yield packed(met)
        if totals:
            columns = ([-1] * len(words), list(words), list(words.values()), [None] * len(words))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "lang", "words", "phrases"])

    return rows.mapInArrow(run, "part bigint, lang string, words bigint, phrases binary")


def distinct_phrases(found: DataFrame) -> DataFrame:
    """(lang, phrase) of what tasks have ``picked``."""

    def run(frame):
        import pandas as pd
        import zstandard

        press = zstandard.ZstdDecompressor()
        own = {x for blob in frame["phrases"] for x in press.decompress(blob).split(b"\xff")}
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "phrase": sorted(own)})

    return found.where("part >= 0").select("part", "lang", "phrases").groupBy("part", "lang").applyInPandas(run, "lang string, phrase binary")


def automata(patterns: list[tuple[str, bytes]]) -> dict:
    """An automaton for each language, whose values are places in ``patterns``."""
    import ahocorasick

    made: dict = {}
    for i, (lang, phrase) in enumerate(patterns):
        made.setdefault(lang, ahocorasick.Automaton()).add_word(f" {phrase.decode('utf-8', 'surrogateescape')} ", i)
    for one in made.values():
        one.make_automaton()
    return made


def counted(rows: DataFrame, patterns: list[tuple[str, bytes]]) -> DataFrame:
    """(lang, phrase, f): occurrences of the patterns in all texts, overlaps included."""
    shared = rows.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        from operator import itemgetter

        import pyarrow as pa

        patterns = shared.value
        if shared._path not in _built:  # a worker's tasks share the automata
            _built.clear()
            _built[shared._path] = automata(patterns)
        made, counts = _built[shared._path], np.zeros(len(patterns), np.int64)
        for langs, data, at in chunks(batches):
            by_lang: dict = {}
            for lang, i, j in zip(langs, at, np.append(at[1:], len(data)), strict=True):
                by_lang.setdefault(lang, []).append(data[i:j])
            for lang, texts in by_lang.items():
                if lang not in made:
                    continue
                guarded = b" " + b"".join(texts).replace(b"\xff", b" \n ")
                while b"  " in guarded:
                    guarded = guarded.replace(b"  ", b" ")
                hits = np.fromiter(map(itemgetter(1), made[lang].iter(guarded.decode("utf-8", "surrogateescape"))), np.int64)
                counts += np.bincount(hits, minlength=len(patterns))
        some = np.flatnonzero(counts)
        parts = [(int(p[0]) // PART, p) for p in np.split(some, np.flatnonzero(np.diff(some // PART)) + 1) if len(p)]
        packed = ([k for k, _ in parts], [encode(np.diff(p, prepend=0)) for _, p in parts], [encode(counts[p]) for _, p in parts])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(packed, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "places", "counts"])

    def summed(frame):
        import pandas as pd

        sums = np.zeros(len(shared.value), np.int64)
        for places, counts in zip(frame["places"], frame["counts"], strict=True):
            sums[np.cumsum(decode(places).astype(np.int64))] += decode(counts).astype(np.int64)
        some = np.flatnonzero(sums).tolist()
        return pd.DataFrame({"lang": [shared.value[i][0] for i in some], "phrase": [shared.value[i][1] for i in some], "f": sums[some]})

    # A task's counts are a few packed columns, not a row for each pattern that it has met.
    packed = rows.mapInArrow(run, "part bigint, places binary, counts binary")
    return packed.groupBy("part").applyInPandas(summed, "lang string, phrase binary, f bigint")


def _united(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _array(df: DataFrame, name: str) -> np.ndarray:
    return df.select(name).toPandas()[name].to_numpy()


def candidates(rows: DataFrame, min_count: int, slice_: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase) of the runs whose counters reach ``min_count``, (lang, n) words of each language)."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("utf8")), F.lit(0))).first()[0]
    segment_bits = max(0, ceil(log2(max(1, total * 0.35 / SEGMENT_RUNS))))
    bits = min(60, max(24, ceil(log2(max(1, total))) + 6))
    heavy = cut(heavy_cells(sketched(rows, bits, segment_bits), min_count))
    slices = max(1, -(-heavy.count() // slice_))
    found = []
    for k in range(slices):
        here = heavy if slices == 1 else heavy.where(F.pmod(F.xxhash64("cell"), F.lit(slices)) == k)
        cells = np.sort(_array(here, "cell").astype(np.uint64))
        found.append(cut(picked(rows, cells, bits, slices == 1, k == 0)))
    whole = _united(found)
    return _united([distinct_phrases(x) for x in found]), whole.where("part < 0 and words > 0").groupBy("lang").agg(F.sum("words").alias("n"))


def counts_of(rows: DataFrame, phrases: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(lang, phrase, f): exact occurrences of ``phrases`` and of their single words."""
    one = phrases.select("lang", F.explode(F.transform(F.split(F.col("phrase").cast("string"), " "), lambda w: w.cast("binary"))).alias("phrase"))
    patterns = cut(phrases.union(one).distinct())
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("phrase") + 2), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))
    found = []
    for k in range(groups):
        here = patterns.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(groups)) == k).toPandas()
        group = sorted(zip(here["lang"].tolist(), map(bytes, here["phrase"].tolist()), strict=True))
        found.append(cut(counted(rows, group)))
    return cut(_united(found))


def scored(counts: DataFrame, totals: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one of the same frequency holds."""
    texts = counts.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")
    chosen = texts.where(F.col("f") >= min_count).withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    small = broadcast_if_small(texts)
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    k = F.explode(F.sequence(F.lit(1), F.size("w") - 1))
    cuts = chosen.select("lang", "phrase", F.col("f").alias("a"), "w", k.alias("k")).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for name, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(small.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)), ["lang", name])
    cuts = cuts.join(broadcast_if_small(totals), "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast((cast(1000 as decimal(4, 0)) * cast({wide('a')} * {wide('n')} as decimal(34, 0))) div ({wide('l')} * {wide('r')}) as bigint)")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # A run inside a longer one is inside one that is a word longer, which is as frequent as the longer one at least.
    long = chosen.where(F.size("w") > 2)
    inner = long.select("lang", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"), "f")
    over = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = least.join(broadcast_if_small(cut(over)), ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    return kept.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def numbered(found: DataFrame, first: int) -> DataFrame:
    """The ``first`` rows of each language in order, with their ``rank``; no language meets in one task."""
    ordered = cut(found.orderBy("lang", F.desc("score"), F.desc("a"), "phrase").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = ordered.groupBy("lang", part.alias("part")).agg(F.min("at").alias("begin"), F.count("*").alias("size"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("lang", "part", "begin", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    joined = ordered.withColumn("part", part).join(broadcast_if_small(base), ["lang", "part"])
    return joined.withColumn("rank", F.col("at") - F.col("begin") + F.col("before") + 1).where(F.col("rank") <= first).drop("at", "part", "begin", "before")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, first: int = FIRST, slice_: int = SLICE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases of ``docs`` (lang, text)."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("utf8"))
    phrases, totals = candidates(rows, min_count, slice_)
    found = scored(counts_of(rows, phrases, group_bytes), totals, min_count)
    return numbered(found, first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same phrases with one row for each run of words.
ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) r(k))
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c
), s AS (
  SELECT cuts.lang, cuts.phrase, size, a, cuts.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[:cuts.k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cuts.k + 1:], ' ') JOIN t ON t.lang = cuts.lang
), least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM c, range(2, 5) q(m) WHERE m < size) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM least LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
