"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_MOD = 5
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the whole cluster shares.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset on one machine,
    as in tests, a temporary one is taken. What is written there goes when the driver ends.
    """
    jvm = spark.sparkContext._jvm
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='gneiss-shared-')}")
    path = f"{root.rstrip('/')}/gneiss-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the folder that the whole cluster shares, and read them."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``max_rows`` rows, else as it is.

    For narrow tables (ids and a few numbers): the bound is then some tens of MB. Beyond it
    the join shuffles.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_facts(rows: DataFrame, facts: DataFrame, key: str, max_rows: int = 500_000, busy: int = 100_000) -> DataFrame:
    """``rows`` joined to ``facts``, which has one row for each key and in ``n`` how many rows of
    ``rows`` have that key, or more.

    Facts of at most ``max_rows`` rows are broadcast. Of larger ones only those of keys with more
    than ``busy`` rows are, so that no task gets a busy key's rows; the others are shuffled.
    """
    facts = cut(facts)
    if facts.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(facts.drop("n")), key)
    hot = broadcast_if_small(facts.where(F.col("n") > busy).drop("n"), max_rows)
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("n") <= busy).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def held_out(doc_id: Column) -> Column:
    """True for the rows from which nothing is learnt: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled rows that aren't held out.

    The rows with the smallest hashes of their ids are taken, so the sample is the same on
    every run. The ids of the sample are bounded by ``max_rows`` and so may be broadcast.
    A document with several labels takes the largest; null labels and null ids teach nothing.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id")


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it no column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_utf8(df: DataFrame) -> DataFrame:
    """``df`` with the bytes of its text (of an empty one for null) as one more, last column."""
    return df.withColumn(unused(df, "utf8"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def append_score(df: DataFrame, text_col: str, make, name: str) -> DataFrame:
    """``df`` with one more double column: ``make()`` gives a function from texts to scores.

    Batches stream through, so memory is bounded by one Arrow batch. A column that already
    has the name is replaced. Null texts are scored as empty ones.
    """
    from pyspark.sql import types as T

    kept = df.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        score = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            values = score([t or "" for t in texts]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def byte_counts(text: str):
    """How often each byte value occurs in the UTF-8 form of a text."""
    import numpy as np

    return np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)


class WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def trim(self, most: int = 2_000_000) -> None:
        if len(self) > most:
            self.clear()
