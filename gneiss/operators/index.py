"""A stored index for ranked keyword search: blocks of postings with the largest score in each.

Chunks are dealt into ranges of some hundreds, those of like length together, since length decides how
much a word can count. A block holds one lexeme's postings in one range, and the most that they can add
to a score. Blocks are written by buckets of lexemes, in a bucket by lexeme, largest first, so a query
reads only the files of its lexemes and no text.

A query for the ``k`` best adds up, range by range, what its lexemes can reach at most; ranges that
lack one are out at once. The most promising ranges are scored first. Their ``k``-th score is a bar, and of
the rest only ranges that can reach it are opened (block-max pruning, with a conjunction). Results
are those of scoring every chunk.

Building tokenises each text once, in its own row, and a task makes ranges of its own chunks, so neither words nor
postings are shuffled: a posting is written once, as a place in its range and two counts. Row, key and length of a
range's chunks are kept once for all its lexemes. How much a lexeme can add by ``bm25`` depends on the mean length,
which is known in the end; a block keeps the counts and lengths that can be its best. Lexemes that stand in every chunk
have many ranges, so no block and no task grows with them.

Defined results: null and empty texts are chunks without lexemes, which count in the statistics; repeated keys are
rows of their own; queries without lexemes, or with one that no chunk has, match nothing; an index of no
chunks matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.functions.frames import broadcast_if_small, scratch
from gneiss.functions.vectors import PLACES
from gneiss.operators.lexical import WordCounts, slices

WEIGHTS = {"A": 1.0, "B": 0.4}
K1, B = 1.2, 0.75
BLOCK = 256
BUCKETS = 64
#: The bucket of what is kept for each range.
RANGES = -1
#: Postings that wait in a task for their range to fill, at most.
WAITING = 2_000_000
#: The lower half of a number that holds two.
LOW = (1 << 32) - 1
#: Scores are rounded; a range that comes this near to the bar is opened.
SLACK = 1e-8


@dataclass(frozen=True)
class Index:
    """Where an index is stored, and the statistics that its scores rest on."""

    path: str
    n: int
    mean: float
    kind: str
    buckets: int

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_schema(self.kind) + ", bucket int").parquet(f"{self.path}/blocks")

    def blocks(self, spark: SparkSession) -> DataFrame:
        """(term, range, n, max_bm25, max_wtf, packed, bucket); ``places`` has what is packed."""
        best = F.array_max(F.transform("peaks", lambda p: _bm25_tf(self.mean, F.shiftright(p, 32), p.bitwiseAND(LOW))))
        return self._rows(spark).where(F.col("bucket") != RANGES).select("term", "range", "n", best.alias("max_bm25"), "max_wtf", "packed", "bucket")

    def ranges(self, spark: SparkSession) -> DataFrame:
        """(range, rows, keys, lengths): the chunks of each range by their place in it."""
        return self._rows(spark).where(F.col("bucket") == RANGES).select("range", "rows", "keys", "lengths")


def places(packed, wanted) -> F.Column:
    """An array of what ``wanted`` makes of (slot, ta, tb) for each posting: a place, and a number of two counts."""
    return F.transform(F.sequence(F.lit(0), F.size(packed) - 1, F.lit(2)), lambda i: wanted(F.get(packed, i), F.shiftright(F.get(packed, i + 1), 32), F.get(packed, i + 1).bitwiseAND(LOW)))


def _schema(kind: str) -> str:
    """Blocks and ranges. Most blocks have a single posting, so columns are few: two numbers stand in the halves of one."""
    block = "term string, range bigint, n bigint, max_wtf double, peaks array<bigint>, packed array<bigint>"
    return f"{block}, rows array<bigint>, keys array<{kind}>, lengths array<bigint>"


class _Waiting:
    """Chunks of like length, with their postings, that are no range yet."""

    def __init__(self):
        self.rows, self.keys, self.lengths, self.postings = [], [], [], []
        self.n = self.held = 0

    def add(self, rows, keys, lengths, owner, names, ta, tb):
        self.postings.append((owner + self.n, names, ta, tb))
        for held, new in ((self.rows, rows), (self.keys, keys), (self.lengths, lengths)):
            held.append(new)
        self.n, self.held = self.n + len(rows), self.held + len(owner)

    def blocks(self, schema: pa.Schema) -> pa.RecordBatch:
        """The range's blocks, and before them its chunks."""
        lengths = np.concatenate(self.lengths)
        slots, ta, tb = (np.concatenate([p[i] for p in self.postings]) for i in (0, 2, 3))
        words = pa.concat_arrays([p[1] for p in self.postings]).dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        by = np.argsort(code, kind="stable")
        code, slots, ta, tb = code[by], slots[by], ta[by], tb[by]
        n = np.bincount(code, minlength=len(words.dictionary))
        ends = np.concatenate([[0], np.cumsum(n)])
        wtf = sum(w * f / (f + 1.0) for f, w in ((ta, WEIGHTS["A"]), (tb, WEIGHTS["B"])))
        # Of a block's (count, length) pairs only those stay that no other beats in both.
        tf, own = ta + tb, lengths[slots]
        by = np.lexsort((own, -tf, code))
        c, f, size = code[by], tf[by], own[by]
        shifted = size - c * (int(lengths.max()) + 1)
        best = np.concatenate([[True], shifted[1:] < np.minimum.accumulate(shifted)[:-1]]) if len(c) else np.zeros(0, bool)
        peaks = np.concatenate([[0], np.cumsum(np.bincount(c[best], minlength=len(n)))])
        rows, keys = pa.concat_arrays(self.rows), pa.concat_arrays(self.keys)

        def lists(offsets, values):
            # The first row is the range's own.
            return pa.ListArray.from_arrays(pa.array([None, *offsets.tolist()], pa.int32()), pa.array(values, pa.int64()))

        def alone(values):
            return pa.ListArray.from_arrays(pa.array([0, *[len(values)] * (len(n) + 1)], pa.int32()), values)

        none = pa.nulls(1, pa.string())
        columns = [
            pa.concat_arrays([none, words.dictionary.cast(pa.string())]), pa.array(np.full(len(n) + 1, rows[0].as_py())), pa.array(np.concatenate([[self.n], n])),
            pa.array(np.concatenate([[0.0], np.maximum.reduceat(wtf, ends[:-1]) if len(n) else []])), lists(peaks, f[best].astype(np.int64) << 32 | size[best]),
            lists(2 * ends, np.stack([slots, ta.astype(np.int64) << 32 | tb], axis=1).ravel()), alone(rows), alone(keys), alone(pa.array(lengths, pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema)


def _blocks(chunks: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of ``_schema``: for each range one with its chunks, whose term is null, and its blocks."""
    kind = chunks.schema[key].dataType.simpleString()
    names = [part.split()[0] for part in _schema(kind).split(", ")]

    def run(batches):
        counts, waiting = WordCounts(), {}
        for batch in slices(batches):
            length, owner, terms, ta, tb = counts.of(batch.column(2), batch.column(3))
            size = np.floor(np.log2(length + 1) * 4).astype(np.int64)
            for c in np.unique(size).tolist():
                todo = np.flatnonzero(size == c)
                while len(todo):
                    into = waiting.setdefault(c, _Waiting())
                    now, todo = np.split(todo, [block - into.n])
                    place = np.full(len(length), -1)
                    place[now] = np.arange(len(now))
                    own = np.flatnonzero(place[owner] >= 0)
                    at = pa.array(now)
                    into.add(batch.column(0).take(at), batch.column(1).take(at), length[now], place[owner[own]], terms.take(pa.array(own)), ta[own], tb[own])
                    if into.n == block:
                        yield waiting.pop(c).blocks(names)
            while sum(w.held for w in waiting.values()) > WAITING:
                yield waiting.pop(max(waiting, key=lambda c: waiting[c].held)).blocks(names)
        # What is left over is put together with the next lengths.
        last = None
        for c in sorted(waiting):
            one = waiting.pop(c)
            if last and last.n + one.n > block:
                yield last.blocks(names)
                last = None
            if last:
                last.postings += [(p[0] + last.n, *p[1:]) for p in one.postings]
                last.rows, last.keys, last.lengths, last.n = last.rows + one.rows, last.keys + one.keys, last.lengths + one.lengths, last.n + one.n
            else:
                last = one
        if last:
            yield last.blocks(names)

    fields = chunks.select(F.monotonically_increasing_id().alias("row"), F.col(key), text.tokens(F.col("chapter_path")).alias("a"), text.tokens(F.col("content")).alias("b"))
    return fields.mapInArrow(run, _schema(kind))


def _bm25_tf(mean: float, tf, length):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


def _wtf():
    return sum(F.lit(w) * F.col(f) / (F.col(f) + 1.0) for f, w in (("ta", WEIGHTS["A"]), ("tb", WEIGHTS["B"])))


def build(chunks: DataFrame, path: str | None = None, key: str = "chunk_id", block: int = BLOCK, buckets: int = BUCKETS) -> Index:
    """Index ``chunks`` (key, chapter_path, content) under ``path``, by default a new scratch folder."""
    spark = chunks.sparkSession
    path = path or scratch(spark)
    kind = chunks.schema[key].dataType.simpleString()
    order = ["bucket", "term", F.desc("n")]
    bucket = F.when(F.col("term").isNull(), F.lit(RANGES)).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    placed = _blocks(chunks, key, block).withColumn("bucket", bucket)
    placed.sortWithinPartitions(*order).write.partitionBy("bucket").option("maxRecordsPerFile", 200_000).parquet(f"{path}/blocks")
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda n, x: n + x)
    facts = Index(path, 0, 0.0, kind, buckets).ranges(spark).agg(F.sum(F.size("rows")).alias("n"), F.sum(total).alias("words")).first()
    n = facts["n"] or 0
    index = Index(path, n, facts["words"] / n if n else 0.0, kind, buckets)
    spark.createDataFrame([(index.n, index.mean, index.kind, buckets)], "n bigint, mean double, kind string, buckets int").coalesce(1).write.parquet(f"{path}/stats")
    return index


def stored(spark: SparkSession, path: str) -> Index:
    """The index that ``build`` has left under ``path``."""
    facts = spark.read.parquet(f"{path}/stats").first()
    return Index(path, facts["n"], facts["mean"], facts["kind"], facts["buckets"])


def own_blocks(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """The blocks of some lexemes; only their buckets' files are read."""
    wanted = sorted(set(terms))
    asked = spark.createDataFrame([(t,) for t in wanted], "term string").select(F.pmod(F.xxhash64("term"), F.lit(index.buckets)).cast("int").alias("b")).distinct()
    buckets = [r["b"] for r in asked.collect()]
    return index.blocks(spark).where((F.col("bucket").isin(buckets) & F.col("term").isin(wanted)) if wanted else F.lit(False))


def _asked(spark: SparkSession, index: Index, blocks: DataFrame, queries: dict[int, list[str]], ranking: str) -> DataFrame | None:
    """(query_id, term, weight, need) of the queries whose lexemes all occur; as small as the queries are."""
    df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weight = {t: log(1.0 + (index.n - d + 0.5) / (d + 0.5)) if ranking == "bm25" else 1.0 for t, d in df.items()}
    rows = [(q, t, weight[t], len(set(own))) for q, own in queries.items() if own and set(own) <= df.keys() for t in sorted(set(own))]
    return F.broadcast(spark.createDataFrame(rows, "query_id bigint, term string, weight double, need int").coalesce(1)) if rows else None


def bounds(blocks: DataFrame, asked: DataFrame, ranking: str = "bm25") -> DataFrame:
    """(query_id, range, bound, least): ranges with all of a query's lexemes, and what a chunk there can reach."""
    reach = F.sum(F.col("weight") * F.col(f"max_{ranking}")).alias("bound")
    met = blocks.select("term", "range", "n", f"max_{ranking}").join(asked, "term")
    return met.groupBy("query_id", "range", "need").agg(reach, F.min("n").alias("least"), F.count("*").alias("have")).where("have = need").drop("have", "need")


def scored(index: Index, blocks: DataFrame, asked: DataFrame, ranges: DataFrame, ranking: str = "bm25") -> DataFrame:
    """(query_id, row, key, score) of the chunks in ``ranges`` (query_id, range) that have all lexemes."""
    wanted = ranges.select("query_id", "range").join(asked, "query_id")
    opened = blocks.select("term", "range", "packed").join(wanted, ["term", "range"]).join(index.ranges(blocks.sparkSession), "range")

    def posting(slot, ta, tb):
        return F.struct(F.get("rows", slot).alias("row"), F.get("keys", slot).alias("key"), F.get("lengths", slot).alias("length"), ta.alias("ta"), tb.alias("tb"))

    dealt = opened.select("query_id", "weight", "need", F.explode(places(F.col("packed"), posting)).alias("p")).select("query_id", "weight", "need", "p.*")
    value = F.col("weight") * (_bm25_tf(index.mean, F.col("ta") + F.col("tb"), F.col("length")) if ranking == "bm25" else _wtf())
    found = dealt.groupBy("query_id", "row", "need").agg(F.first("key").alias("key"), F.count("*").alias("have"), F.round(F.sum(value), PLACES).alias("score"))
    return found.where("have = need").select("query_id", "row", "key", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key", "row")
    return found.withColumn("rank_kw", F.row_number().over(order).cast("bigint")).where(F.col("rank_kw") <= k)


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top(spark: SparkSession, index: Index, queries: dict[int, list[str]], k: int, ranking: str = "bm25", key: str = "chunk_id", first: int | None = None, opened: dict | None = None) -> DataFrame:
    """(query_id, key, score, rank_kw) of the ``k`` best chunks for each query's lexemes.

    ``queries`` is held by every task: take large sets in blocks. ``first`` ranges of each query are
    scored before the bar is known. ``opened``, if given, gets the numbers of ranges and of opened ones.
    """
    blocks = own_blocks(spark, index, sorted({t for own in queries.values() for t in own}))
    asked = _asked(spark, index, blocks, queries, ranking)
    if asked is None:
        return spark.createDataFrame([], f"query_id bigint, `{key}` {index.kind}, score double, rank_kw bigint")
    first = first or 4 + k // 8
    every = _kept(bounds(blocks, asked, ranking))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    seeds = _kept(every.withColumn("at", F.row_number().over(order)).where(F.col("at") <= first))
    some = _kept(_best(scored(index, blocks, asked, seeds, ranking), k))
    bar = some.where(F.col("rank_kw") == k).select("query_id", F.col("score").alias("bar"))
    rest = every.join(seeds.select("query_id", "range"), ["query_id", "range"], "left_anti").join(broadcast_if_small(bar), "query_id", "left")
    rest = _kept(rest.where(F.col("bar").isNull() | (F.col("bound") + SLACK >= F.col("bar"))))
    if opened is not None:
        opened["ranges"], opened["opened"] = every.count(), seeds.count() + rest.count()
    more = scored(index, blocks, asked, rest, ranking)
    return _best(some.drop("rank_kw").unionByName(more), k).select("query_id", F.col("key").alias(key), "score", "rank_kw")


def matches(spark: SparkSession, index: Index, queries: dict[int, list[str]], ranking: str = "wtf", key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score) of every chunk that has all lexemes of a query."""
    blocks = own_blocks(spark, index, sorted({t for own in queries.values() for t in own}))
    asked = _asked(spark, index, blocks, queries, ranking)
    if asked is None:
        return top(spark, index, queries, 1, ranking, key).drop("rank_kw")
    return scored(index, blocks, asked, bounds(blocks, asked, ranking), ranking).select("query_id", F.col("key").alias(key), "score")
