"""Approximate nearest neighbours: product quantisation on inverted lists, with exact re-scoring.

A vector of length one is cut into parts; each part is replaced by the number of the nearest of at most 256
centroids, so a vector becomes as many bytes. Vectors are dealt into inverted lists by their nearest list
centroid. A query looks into the lists nearest to it; there it adds up, for each row's bytes, entries of a
table of its own products with all part centroids. The best rows by that sum, at most a set number
for each query, are scored exactly; their vectors alone are looked at.

Centroids are fitted on a bounded sample; every row gets a list and a code. Stored by list, the first step
reads keys and codes, the second vectors of the lists that survivors stand in.

Defined results: null vectors, such of another length and all-zero ones are never hits; repeated keys are rows of
their own; ties go to the smaller key; no queries and an empty table give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions.frames import broadcast_if_small, scratch
from gneiss.functions.vectors import PLACES, cosine, in_turn

CODES = 256
#: Lists of 64 that a query looks into.
PROBES = 48


@dataclass(frozen=True)
class Quantizer:
    """List centroids (lists, width) and part centroids (parts, codes, width / parts)."""

    lists: np.ndarray
    parts: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A byte for each part of each row."""
        cut = x.reshape(len(x), len(self.parts), -1)
        out = np.empty(cut.shape[:2], np.uint8)
        for p, centroids in enumerate(self.parts):
            out[:, p] = (cut[:, p] @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): each query's products with the part centroids."""
        return np.einsum("qpw,pcw->qpc", queries.reshape(len(queries), len(self.parts), -1), self.parts)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(rows: DataFrame, parts: int = 16, lists: int = 64, sample: int = 10_000, rounds: int = 10, key: str = "chunk_id", vector: str = "embedding") -> Quantizer | None:
    """A quantizer fitted on at most ``sample`` vectors, those with the smallest hashes of their keys; none if there are none."""
    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    widths = [len(r[0]) for r in some]
    if not widths or not max(widths):
        return None
    width = max(set(widths), key=widths.count)
    x = unit(np.array([r[0] for r in some if len(r[0]) == width], float))
    x = x[x.any(axis=1)]
    if not len(x):
        return None
    own = next(p for p in range(min(parts, width), 0, -1) if width % p == 0)
    cut = x.reshape(len(x), own, -1)
    return Quantizer(unit(k_means(x, lists, rounds, 11)), np.stack([k_means(np.ascontiguousarray(cut[:, p]), CODES, rounds, p) for p in range(own)]))


def store(rows: DataFrame, quantizer: Quantizer | None, path: str | None = None, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(key, vector, code, list) of the rows that can be hits, written by list."""
    spark, path = rows.sparkSession, path or scratch(rows.sparkSession)
    kept = rows.select(key, vector)
    schema = T.StructType([*kept.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("list", T.IntegerType())])
    if quantizer is None:
        return spark.createDataFrame([], schema)
    width = quantizer.lists.shape[1]

    def run(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            fit_ = [i for i, v in enumerate(values) if v is not None and len(v) == width and any(v)]
            x = unit(np.array([values[i] for i in fit_], float).reshape(-1, width))
            codes, near = quantizer.codes(x), (x @ quantizer.lists.T).argmax(axis=1).astype(np.int32)
            own = batch.take(pa.array(fit_, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(near)], schema.names)

    kept.mapInArrow(run, schema).write.partitionBy("list").parquet(path)
    return spark.read.schema(schema).parquet(path)


def survivors(stored: DataFrame, quantizer: Quantizer, queries: dict, keep: int, probes: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, list, approximate) of the ``keep`` best rows of each query by the sums of table entries."""
    ids = sorted(queries)
    matrix = unit(np.array([queries[i] for i in ids], float))
    tables, number = quantizer.tables(matrix), np.array(ids, np.int64)
    probed = np.argsort(-(matrix @ quantizer.lists.T), axis=1, kind="stable")[:, :probes]
    asks = {int(n): np.flatnonzero((probed == n).any(axis=1)) for n in np.unique(probed)}
    parts = len(quantizer.parts)

    def run(batches):
        for batch in batches:
            lists = batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for n in np.unique(lists).tolist():
                at = np.flatnonzero(lists == n)
                for part in in_turn(len(asks[n]), len(at)):
                    who = asks[n][part]
                    score = sum(tables[who, p][:, codes[at, p]] for p in range(parts))
                    least = np.partition(score, -keep, axis=1)[:, -keep] if len(at) > keep else np.full(len(who), -np.inf)
                    q, r = np.nonzero(score >= least[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(number[who[q]]), batch.column(0).take(pa.array(at[r])), pa.array(np.full(len(r), n, np.int32)), pa.array(score[q, r])], ["query_id", key, "list", "approximate"])

    kind = stored.schema[key].dataType.simpleString()
    found = stored.where(F.col("list").isin(sorted(asks))).select(key, "code", "list").mapInArrow(run, f"query_id bigint, `{key}` {kind}, list int, approximate double")
    order = Window.partitionBy("query_id").orderBy(F.desc("approximate"), key)
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep).drop("at")


def nearest(stored: DataFrame, quantizer: Quantizer | None, queries: dict, k: int, keep: int = 100, probes: int = PROBES, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, cosine_similarity, rank_vec): about the ``k`` nearest rows of each query.

    ``queries`` maps an integer id to a vector and is held by every task, so it must be small; larger sets
    are run in blocks. At most ``keep`` rows of each query are scored exactly.
    """
    spark = stored.sparkSession
    kind = stored.schema[key].dataType.simpleString()
    fitting = {q: v for q, v in queries.items() if quantizer is not None and len(v) == quantizer.lists.shape[1]}
    if not fitting:
        return spark.createDataFrame([], f"query_id bigint, `{key}` {kind}, cosine_similarity double, rank_vec int")
    path = scratch(spark)
    survivors(stored, quantizer, fitting, keep, probes, key).select("query_id", key, "list").write.parquet(path)
    chosen = spark.read.schema(f"query_id bigint, `{key}` {kind}, list int").parquet(path).distinct()
    asked = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in sorted(fitting.items())], "query_id bigint, q array<double>")
    met = stored.select(key, vector, "list").join(broadcast_if_small(chosen), [key, "list"]).join(F.broadcast(asked), "query_id")
    scored = met.select("query_id", key, F.round(cosine(F.col(vector), F.col("q")), PLACES).alias("cosine_similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine_similarity"), key)
    return scored.withColumn("rank_vec", F.row_number().over(order)).where(F.col("rank_vec") <= k)
