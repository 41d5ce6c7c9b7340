"""Vector expressions and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimal places to which a score is rounded before it orders anything.
PLACES = 9
#: Scores that a task holds at once, about.
CELLS = 1_000_000


def in_turn(queries: int, rows: int) -> list[slice]:
    """Slices of queries that together meet ``rows`` rows in about ``CELLS`` scores, or one query at a time."""
    step = max(1, CELLS // max(1, rows))
    return [slice(lo, lo + step) for lo in range(0, queries, step)]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in doubles; null where one is all zeros."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def neighbour_cosines(vectors):
    """``cosine`` of each row of a matrix of doubles and the one before it, summed in the same order; zero where one is all zeros."""
    import numpy as np

    def dot(x, y):
        return np.cumsum(x * y, axis=1)[:, -1]

    square = dot(vectors, vectors)
    size = np.sqrt(square[1:] * square[:-1])
    return np.divide(dot(vectors[1:], vectors[:-1]), size, out=np.zeros(len(size)), where=size != 0)


def dims(vector: Column) -> Column:
    return F.size(vector)


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), which runs to 0 and 1 without overflow."""
    return 1.0 / (1.0 + F.exp(-x))


def nearest(rows: DataFrame, queries: dict, k: int, key: str = "chunk_id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """(query_id, key, cosine_similarity, rank_vec): the exact ``k`` nearest rows of each query.

    ``queries`` maps an integer id to a vector and is held by every task, so it must be small;
    larger sets are run in blocks. Each Arrow batch is scored by one matrix product and gives at
    most its own ``k`` best rows (ties included) for each query, so what is shuffled doesn't depend
    on the table's width. Rows of another dimension and null vectors are never hits.
    """
    import numpy as np

    ids = sorted(queries)
    if not ids:
        return rows.select(F.lit(None).cast("bigint").alias("query_id"), key, F.lit(0.0).alias("cosine_similarity"), F.lit(0).alias("rank_vec")).limit(0)
    matrix = np.array([queries[i] for i in ids], float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        width = matrix.shape[1]
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            valid = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(lists), width).fill_null(False)))
            if not len(valid):
                continue
            some = lists.take(pa.array(valid))
            flat = some.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
            norm = np.sqrt((flat * flat).sum(axis=1))
            for part in in_turn(len(ids), len(flat)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.round((matrix[part] @ flat.T) / norm, PLACES)
                score[~np.isfinite(score)] = -2
                least = np.full(len(score), -1.5) if score.shape[1] <= k else np.partition(score, -k, axis=1)[:, -k]
                if floor is not None:
                    least = np.maximum(least, floor)
                q, r = np.nonzero(score >= np.maximum(least, -1.5)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids[part], np.int64)[q]), keys.take(pa.array(valid[r])), pa.array(score[q, r])], ["query_id", key, "cosine_similarity"])

    near = rows.select(key, vector).mapInArrow(run, f"query_id bigint, `{key}` {key_type}, cosine_similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine_similarity"), key)
    return near.withColumn("rank_vec", F.row_number().over(order)).where(F.col("rank_vec") <= k)


def approximate_nearest(rows: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding", tables: int = 8, width: float = 0.6) -> DataFrame:
    """Approximate mode: random projections (an index by buckets) instead of the whole scan."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    frame = rows.where(F.size(vector) == len(query)).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=7).fit(frame)
    found = model.approxNearestNeighbors(frame, Vectors.dense(query), k, distCol="distance")
    return found.select(key, (1 - F.col("distance") ** 2 / 2).alias("cosine_similarity"))


def centroids(rows: DataFrame, lists: int = 64, sample: int = 20_000, rounds: int = 15, key: str = "chunk_id", vector: str = "embedding"):
    """Unit centroids of an inverted-list index, fitted on at most ``sample`` vectors, those with the
    smallest hashes of their keys."""
    import numpy as np

    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    if not some:
        return np.zeros((0, 0))
    width = max(len(r[0]) for r in some)
    x = np.array([r[0] for r in some if len(r[0]) == width], float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
    c = x[np.random.default_rng(11).permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].sum(axis=0)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def with_list(rows: DataFrame, index, vector: str = "embedding", name: str = "list") -> DataFrame:
    """Every row with the number of its nearest centroid; null where its vector doesn't fit. Store
    it partitioned by that number, so that a search reads the lists it probes."""
    from pyspark.sql import types as T

    kept = rows.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.IntegerType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [None] * batch.num_rows
            values = batch.column(batch.schema.get_field_index(vector)).to_pylist()
            fit = [i for i, v in enumerate(values) if v is not None and index.size and len(v) == index.shape[1]]
            if fit:
                for i, n in zip(fit, (np.array([values[i] for i in fit], float) @ index.T).argmax(axis=1).tolist(), strict=True):
                    out[i] = n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], schema.names)

    return kept.mapInArrow(run, schema)


def nearest_in_lists(listed: DataFrame, index, queries: dict, k: int, probes: int = 32, key: str = "chunk_id", vector: str = "embedding", name: str = "list") -> DataFrame:
    """Approximate ``nearest``: each query looks only into the ``probes`` lists nearest to it.

    Rows meet the queries of their list alone; each Arrow batch of a list is scored at once.
    """
    import numpy as np

    ids = sorted(queries)
    if not ids or not index.size:
        return nearest(listed, {}, k, key, vector)
    matrix = np.array([queries[i] for i in ids], float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    probed = np.argsort(-(matrix @ index.T), axis=1, kind="stable")[:, :probes]
    asks = {int(n): np.flatnonzero((probed == n).any(axis=1)) for n in np.unique(probed)}
    key_type = listed.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, vectors, lists = (batch.column(i).to_pylist() for i in range(3))
            by: dict[int, list[int]] = {}
            for i, n in enumerate(lists):
                by.setdefault(n, []).append(i)
            rows = []
            for n, places in by.items():
                x = np.array([vectors[i] for i in places], float)
                norm = np.linalg.norm(x, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.round((matrix[asks[n]] @ x.T) / norm, PLACES)
                score[~np.isfinite(score)] = -2
                for q, own in zip(asks[n], score, strict=True):
                    best = np.argsort(-own, kind="stable")[:k] if len(own) <= k else np.flatnonzero(own >= np.partition(own, -k)[-k])
                    rows += [(ids[q], keys[places[j]], float(own[j])) for j in best if own[j] > -1.5]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.schema.field(0).type), pa.array(cols[2], pa.float64())], ["query_id", key, "cosine_similarity"])

    wanted = listed.where(F.col(name).isin(sorted(asks))).select(key, vector, name)
    near = wanted.mapInArrow(run, f"query_id bigint, `{key}` {key_type}, cosine_similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine_similarity"), key)
    return near.withColumn("rank_vec", F.row_number().over(order)).where(F.col("rank_vec") <= k)
