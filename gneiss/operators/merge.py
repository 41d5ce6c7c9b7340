"""Upsert of chunks by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a repeated ingest overwrites; everything else keeps its first value.
MUTABLE = ("chapter_path", "content", "embedding")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", mutable=MUTABLE, by: str | None = None) -> DataFrame:
    """The snapshot after an ingest: rows of both, new values only in the mutable columns.

    Where the new rows repeat a key, the last by ``chunk_index`` or content wins. Rows that the new
    ingest lacks stay. Null keys meet nothing.

    Each row is shuffled once: by the key, or by ``by``, a column of both that follows from the key. The result is dealt
    by it then, and has it.
    """
    theirs, ours = ([c for c in df.columns if c != by] for df in (new, old))
    old_type, new_type = (df.select(*own).schema for df, own in ((old, ours), (new, theirs)))
    dealt = [by] if by else []
    o = old.select(*dealt, F.col(key).alias("__key"), F.lit(0).alias("__new"), F.struct(*ours).alias("o"), F.lit(None).cast(new_type).alias("n"))
    n = new.select(*dealt, F.col(key).alias("__key"), F.lit(1).alias("__new"), F.lit(None).cast(old_type).alias("o"), F.struct(*theirs).alias("n"))
    both = o.unionAll(n).withColumn("__apart", F.when(F.col("__key").isNull(), F.col("__new")))
    own = Window.partitionBy(*dealt, "__key", "__apart").orderBy(F.desc("__new"), F.desc(F.struct(*[F.col(f"n.{c}") for c in ("chunk_index", "content") if c in theirs])))
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = both.repartition(*dealt or ["__key"]).withColumns({"place": F.row_number().over(own), "olds": F.count("o").over(every), "n": F.first("n").over(every)})
    met = placed.where(F.col("o").isNotNull() | (F.col("olds") == 0) & (F.col("place") == 1))
    picked = []
    for c in ours:
        first, second = (f"n.{c}", f"o.{c}") if c in mutable else (f"o.{c}", f"n.{c}")
        if c not in theirs:
            picked.append(F.col(f"o.{c}"))
        elif c in mutable:
            picked.append(F.when(F.col(f"n.{key}").isNotNull(), F.col(first)).otherwise(F.col(second)).alias(c))
        else:
            picked.append(F.coalesce(first, second).alias(c))
    return met.select(*dealt, *picked)


def write_snapshot(merged: DataFrame, path: str, files: int = 64, key: str = "chunk_id") -> None:
    """Store a snapshot for scans by type; give every snapshot a path of its own.

    Each type is written by up to ``files`` tasks, dealt by the key, so no type ends up in one.
    """
    part = F.pmod(F.xxhash64(key), F.lit(files))
    merged.repartition("chunk_type", part).write.partitionBy("chunk_type").parquet(path)


def latest(parts: DataFrame, order: str, key: str = "chunk_id", mutable=MUTABLE) -> DataFrame:
    """The state after many ingests kept side by side: for every key the mutable columns of its last
    row by ``order`` and all others of its first, as if upserted one after the other."""
    columns = [c for c in parts.columns if c not in (order, key)]
    whole = F.struct(*[F.col(c) for c in columns])
    ends = parts.groupBy(key).agg(F.min_by(whole, order).alias("first"), F.max_by(whole, order).alias("last"))
    # What was null at first is filled by the last, as a missing value is by a merge.
    return ends.select(key, *[F.col(f"last.{c}").alias(c) if c in mutable else F.coalesce(f"first.{c}", f"last.{c}").alias(c) for c in columns])
