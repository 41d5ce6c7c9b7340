"""Stupid-backoff language-model scores from count tables over the whole corpus.

The relations are the exploded n-grams (document block, n-gram) and one count table
(n-gram, count), both partitioned by the n-gram's 64-bit hash. To take few bytes a row they are
held in packed columns: one record for each block and bucket has the sorted distinct hashes of a
block's n-grams in that bucket, with their counts. A bucket sums the counts of equal hashes over
all blocks (the count table), joins them to the records by merging, and each block gets its counts
back and sums its documents' scores. Counts cover every document.

A block is what a task reads, up to a number of bytes (one text at least), so rows that repeat
fall into as many blocks as they need; its texts travel compressed. Buckets have a bounded number
of hashes. Every record has a hash, so there are never more records than rows in the plain form of
these relations, however many blocks and buckets there are.

Tokens are runs of characters other than ASCII white space, in ASCII lower case. The score of a
token given the two before it is count(abc) / count(ab) if abc was seen at least ``MIN_COUNT``
times, else 0.4 times that of a shorter context, down to count(c) / all tokens. A document's
score is the sum of natural logarithms; tokens at its start have the contexts that there are.

Defined results: null and empty texts have no token, score 0 and a null mean; repeated rows are
scored each; equal texts have equal scores; a very long text is a block of its own; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import WordHashes, cut

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
#: Bytes of text in a block, and distinct hashes of all blocks in a bucket, about.
BLOCK_BYTES = 8_000_000
BUCKET_KEYS = 2_000_000


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two columns of hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and the number of words of each text."""
    known, parts = WordHashes(), []
    for text in texts:
        words = text.lower().split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        known.trim()
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def ngrams(words: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order its hashes (that of the n-gram ending at a token), and every token's place
    in its text. Places below order - 1 have no n-gram of that order."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = [words]
    for n in range(1, ORDER):
        longer = np.zeros_like(words)
        longer[1:] = mix(grams[-1][:-1], words[1:]) + np.uint64(n)
        grams.append(longer)
    return grams, place


def encode(values: np.ndarray) -> bytes:
    """Compact form of an int64 or uint64 column: byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def decode(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _all_keys(grams: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    return np.concatenate([g[place >= n] for n, g in enumerate(grams)])


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins and the last ends in sorted keys; buckets are the upper bits."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, ids, sizes, texts): documents as they are read, up to ``block_bytes`` of text each.

    A block's number holds its task's in the upper bits; a task that is run again reads the same
    rows and makes the same blocks.
    """

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0

        def block():
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.string())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([press.compress(b"".join(texts))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "texts"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= block_bytes:
                    yield block()
                    ids, texts, held, number = [], [], 0, number + 1
        if texts:
            yield block()

    utf8 = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("utf8"))
    return utf8.mapInArrow(run, "block bigint, ids array<string>, sizes array<bigint>, texts binary")


def _texts(sizes, blob) -> list[bytes]:
    import zstandard

    whole, ends = zstandard.ZstdDecompressor().decompress(blob), np.cumsum(sizes)
    return [whole[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every row."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, ceil(log2(max(1, total * 0.35 / bucket_keys))))
    blocked = blocks(docs, block_bytes).repartition("block")

    def exploded(batches):
        import pyarrow as pa

        for batch in batches:
            for block, sizes, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                keys, counts = np.unique(_all_keys(*ngrams(*hashed_words(_texts(sizes, blob)))), return_counts=True)
                at = _bounds(keys, bits)
                some = [(b, i, j) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(some), pa.int64()),
                        pa.array([b for b, _, _ in some], pa.int64()),
                        pa.array([encode(np.diff(keys[i:j], prepend=np.uint64(0))) for _, i, j in some], pa.binary()),
                        pa.array([encode(counts[i:j]) for _, i, j in some], pa.binary()),
                    ],
                    ["block", "bucket", "keys", "counts"],
                )

    def counted(frame):
        import pandas as pd

        keys = [np.cumsum(decode(k), dtype=np.uint64) for k in frame["keys"]]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, back, np.concatenate([decode(c).astype(np.int64) for c in frame["counts"]]))
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "sums": [encode(x) for x in np.split(sums[back], ends[:-1])]})

    def scored(frame, tables):
        import pandas as pd

        row = frame.iloc[0]
        words, sizes = hashed_words(_texts(row["sizes"], row["texts"]))
        grams, place = ngrams(words, sizes)
        out = pd.DataFrame({"id": list(row["ids"]), "n_tokens": sizes, "raw": 0.0, "unigrams": 0})
        if not len(words):
            return out
        _, back = np.unique(_all_keys(grams, place), return_inverse=True)
        found = np.concatenate([decode(s) for s in tables.sort_values("bucket")["sums"]]).astype(np.int64)[back]
        value, open_, at = np.zeros(len(words)), np.ones(len(words), bool), len(found)
        count = []
        for n in range(ORDER - 1, -1, -1):
            has = place >= n
            c = np.zeros(len(words), np.int64)
            c[has] = found[at - has.sum() : at]
            at -= int(has.sum())
            count.insert(0, c)
        penalty = np.zeros(len(words))
        for n in range(ORDER - 1, 0, -1):
            has = open_ & (place >= n)
            seen = np.flatnonzero(has & (count[n] >= min_count))
            value[seen] = penalty[seen] + np.log(count[n][seen]) - np.log(count[n - 1][seen - 1])
            open_[seen] = False
            penalty[has & open_] += log(backoff)
        value[open_] = penalty[open_] + np.log(count[0][open_])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out["raw"] = np.bincount(owner, value, len(sizes))
        out["unigrams"] = np.bincount(owner, open_, len(sizes)).astype(np.int64)
        return out

    packed = blocked.mapInArrow(exploded, "block bigint, bucket bigint, keys binary, counts binary")
    tables = packed.groupBy("bucket").applyInPandas(counted, "block bigint, bucket bigint, sums binary")
    made = blocked.groupBy("block").cogroup(tables.groupBy("block")).applyInPandas(scored, "id string, n_tokens bigint, raw double, unigrams bigint")
    parts = cut(made.withColumn("doc_id", F.col("id").cast(docs.schema["doc_id"].dataType)))
    tokens = parts.agg(F.sum("n_tokens")).first()[0] or 1
    log_score = F.col("raw") - F.col("unigrams") * F.lit(log(tokens))
    return parts.select("doc_id", "n_tokens", log_score.alias("log_score"), (log_score / F.when(F.col("n_tokens") > 0, F.col("n_tokens"))).alias("mean_log_score"))


#: The same scores with one row for each n-gram, in SQL.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS p FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents)
), g AS (
  SELECT doc_id, p, t AS c, lag(t) OVER d AS b, lag(t, 2) OVER d AS a FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), c1 AS (SELECT c, count(*) AS n FROM g GROUP BY ALL
), c2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL
), c3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY ALL
), total AS (SELECT count(*) AS n FROM g
), s AS (
  SELECT g.doc_id, CASE
    WHEN c3.n >= 2 THEN ln(c3.n) - ln(ab.n)
    WHEN bc.n >= 2 THEN (CASE WHEN g.a IS NOT NULL THEN ln(0.4) ELSE 0 END) + ln(bc.n) - ln(b1.n)
    ELSE (CASE WHEN g.a IS NOT NULL THEN ln(0.4) ELSE 0 END) + (CASE WHEN g.b IS NOT NULL THEN ln(0.4) ELSE 0 END) + ln(u.n) - ln(total.n) END AS v
  FROM g CROSS JOIN total JOIN c1 u ON u.c = g.c
  LEFT JOIN c1 b1 ON b1.c = g.b
  LEFT JOIN c2 bc ON bc.b = g.b AND bc.c = g.c
  LEFT JOIN c2 ab ON ab.b = g.a AND ab.c = g.b
  LEFT JOIN c3 ON c3.a = g.a AND c3.b = g.b AND c3.c = g.c
), d AS (SELECT doc_id, count(*) AS k, sum(v) AS v FROM s GROUP BY doc_id)
SELECT x.doc_id, coalesce(d.k, 0)::bigint AS n_tokens, round(coalesce(d.v, 0), 4) AS log_score, round(d.v / d.k, 6) AS mean_log_score
FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id
"""
