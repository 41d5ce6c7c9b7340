"""Audit and session streams with Structured Streaming.

Both run what has arrived and stop (``availableNow``), so the same code serves a schedule or, with
another trigger, a service.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss import schemas
from gneiss.config import Chunking
from gneiss.functions import models, text
from gneiss.functions.frames import scratch
from gneiss.operators import ingest, merge, sessions


def append_audit(events: DataFrame, path: str, checkpoint: str, ts: str = "timestamp", days: int = sessions.TTL_DAYS) -> StreamingQuery:
    """Valid audit events to Parquet by day; a repeated key within the retention is left out."""
    day = events.where(sessions.audit_is_valid()).withWatermark(ts, f"{days} days").withColumn("day", F.to_date(ts))
    if "event_id" in events.columns:
        day = day.dropDuplicatesWithinWatermark(["event_id"])
    writer = day.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def append_events(events: DataFrame, path: str, ts: str = "timestamp") -> dict:
    """Valid audit events of a batch to Parquet by day, off the path of whoever asks: a failure is
    told by the status, never raised."""
    try:
        events.where(sessions.audit_is_valid()).withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)
        return {"status": "success"}
    except Exception as e:
        return {"status": "error", "error": str(e)}


def _parts(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished parts ``prefix=N`` under a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [n for n in names if n.startswith(f"{prefix}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def _drop_parts(spark: SparkSession, path: str, names: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for n in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _live(spark: SparkSession, path: str, upto: int | None = None) -> tuple[int | None, list[int]]:
    """The newest base, and the batches after it."""
    base = max((b for b in _parts(spark, path, "base") if upto is None or b <= upto), default=None)
    return base, [b for b in _parts(spark, path, "batch") if (base is None or b > base) and (upto is None or b <= upto)]


def _read(spark: SparkSession, path: str, base: int | None, batches: list[int]) -> DataFrame | None:
    """The base and batches side by side, with their numbers as ``part``."""
    named = ([(base, f"{path}/base={base}")] if base is not None else []) + [(b, f"{path}/batch={b}") for b in batches]
    out = None
    for number, at in named:
        one = spark.read.parquet(at).withColumn("part", F.lit(number).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


def _keep(batch: DataFrame, number: int, path: str, merged, every: int) -> None:
    """Write a batch's own part; after ``every`` parts merge them into a new base and drop them.

    A batch that runs again replaces its own part. What is written is in proportion to the batch;
    the whole state is rewritten only by a merge.
    """
    spark = batch.sparkSession
    base, _ = _live(spark, path)
    if base is not None and number <= base:
        return  # merged already
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    base, batches = _live(spark, path, number)
    if len(batches) >= every:
        merged(_read(spark, path, base, batches)).write.mode("overwrite").parquet(f"{path}/base={number}")
        _drop_parts(spark, path, [f"batch={b}" for b in batches] + ([f"base={base}"] if base is not None else []))


def merged_sessions(parts: DataFrame, cap: int = sessions.CAP) -> DataFrame:
    """Session states kept side by side, summed up by session: counters add, the first user and time
    of creation stay, the newest turns are kept."""
    facts = F.struct("part", "user_id", "turn_count", "turns", "created_at", "updated_at")
    ordered = parts.groupBy("session_id").agg(F.array_sort(F.collect_list(facts)).alias("p"))
    turns = F.flatten(F.transform("p", lambda x: x["turns"]))
    first = F.get("p", F.lit(0))
    return ordered.select(
        "session_id",
        first["user_id"].alias("user_id"),
        F.aggregate("p", F.lit(0), lambda n, x: n + x["turn_count"]).alias("turn_count"),
        F.slice(turns, F.greatest(F.size(turns) - cap + 1, F.lit(1)), F.lit(cap)).alias("turns"),
        first["created_at"].alias("created_at"),
        F.element_at("p", -1)["updated_at"].alias("updated_at"),
    )


def stored_sessions(spark: SparkSession, path: str, cap: int = sessions.CAP) -> DataFrame:
    """All session states that ``upsert_sessions`` has kept under ``path``; none where nothing has been kept yet."""
    parts = _read(spark, path, *_live(spark, path))
    return spark.createDataFrame([], schemas.CHAT_SESSIONS) if parts is None else merged_sessions(parts, cap)


def upsert_sessions(turns: DataFrame, path: str, checkpoint: str, cap: int = sessions.CAP, every: int = 16) -> StreamingQuery:
    """Session states by batches: each writes the state of its own turns, keyed by session, and the
    parts are merged when they are read and after every ``every`` batches."""

    def merge(batch: DataFrame, number: int) -> None:
        _keep(sessions.session_state(batch, cap), number, path, lambda p: merged_sessions(p, cap), every)

    return turns.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks that ``ingest_files`` has kept under ``path``; none where nothing has been kept yet."""
    parts = _read(spark, f"{path}/chunks", *_live(spark, f"{path}/chunks"))
    if parts is None:
        return spark.createDataFrame([], schemas.MANUAL_CHUNKS).drop("created_at")
    return merge.latest(parts, "part")


def _newest_files(parts: DataFrame) -> DataFrame:
    return parts.groupBy("manual", "source_file").agg(F.max_by("text", "part").alias("text"))


def _newest_states(parts: DataFrame) -> DataFrame:
    return parts.groupBy("manual", "source_file").agg(F.max_by("heads", "part").alias("heads"), F.max_by("tail", "part").alias("tail"))


def _key(name: str = "source_file"):
    return F.struct(text.natural_key(F.col(name)).alias("natural"), F.col(name).alias("name"))


def _states_before(states: DataFrame | None, lows: DataFrame, target: int) -> DataFrame | None:
    """(manual, heads, tail): what the files before ``lows`` (manual, low) have left."""
    if states is None:
        return None
    earlier = states.join(F.broadcast(lows), "manual").where(_key() < F.col("low"))
    back = Window.partitionBy("manual").orderBy(F.desc(_key()))
    near = earlier.withColumn("back", F.row_number().over(back))
    # Files whose tail isn't empty have a character each; only so many can matter.
    spoken = near.where(F.size("tail") > 0).withColumn("spoken", F.row_number().over(back)).where(F.col("spoken") <= target)
    tails = spoken.groupBy("manual").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("spoken")).alias("at"), "tail"))), lambda x: x["tail"])).alias("tail"))
    numbered = F.transform("tail", lambda x, i: x.withField("ord", i.cast("bigint")))
    return near.where("back = 1").select("manual", "heads").join(tails, "manual", "left").select("manual", "heads", F.coalesce(ingest.trimmed(numbered, target), F.array()).alias("tail"))


def absorb_files(batch: DataFrame, number: int, path: str, every: int = 16, settings: Chunking | None = None, kind: str = "recursive", backend=None) -> None:
    """Chunk the files (manual, source_file, text) of a batch and keep chunks, files and states under ``path``.

    Of every file the headings at its end and its last texts are kept. New files that come after all others of
    their manual start from these; only they are chunked and embedded. A file that comes between others, or
    again, makes those after it run again too, but chunks that stay the same are neither embedded nor written.
    """
    settings = settings or Chunking()
    spark = batch.sparkSession
    base, _ = _live(spark, f"{path}/states")
    if base is not None and number <= base or batch.isEmpty():
        return  # states are written last, so all of it is done
    _keep(batch, number, f"{path}/files", _newest_files, every)
    # What this batch itself left in a failed attempt doesn't count.
    before = _read(spark, f"{path}/states", *_live(spark, f"{path}/states", number - 1))
    states = None if before is None else _newest_states(before)
    lows = batch.groupBy("manual").agg(F.min(_key()).alias("low"))
    known = _newest_files(_read(spark, f"{path}/files", *_live(spark, f"{path}/files")))
    redone = known.join(F.broadcast(lows), "manual").where(_key() >= F.col("low")).drop("low")
    initial = _states_before(states, lows, settings.prefix)
    if initial is not None:
        at = scratch(spark)
        initial.write.parquet(at)
        initial = spark.read.schema(initial.schema).parquet(at)
    plain = ingest.plain_chunks(redone, settings, kind, backend, initial)
    made = ingest.finished(plain, settings, initial)
    held = _read(spark, f"{path}/chunks", *_live(spark, f"{path}/chunks", number - 1))
    again = redone.join(batch.select("manual", "source_file"), ["manual", "source_file"], "left_anti")
    if held is not None and (states is not None and not states.join(redone.select("manual", "source_file"), ["manual", "source_file"], "left_semi").isEmpty() or not again.isEmpty()):
        at = scratch(spark)
        old = merge.latest(held, "part").select("chunk_id", F.col("content").alias("old"), F.col("chapter_path").alias("old_path"), "embedding")
        made.join(old, "chunk_id", "left").write.parquet(at)
        met = spark.read.parquet(at)
        same = F.col("old").eqNullSafe(F.col("content"))
        moved = met.where(same & ~F.col("old_path").eqNullSafe(F.col("chapter_path"))).drop("old", "old_path")
        fresh = models.with_embedding(met.where(~same).drop("old", "old_path", "embedding"), backend, batch=settings.batch)
        done = fresh.unionByName(moved)
    else:
        done = models.with_embedding(made, backend, batch=settings.batch)
    _keep(done, number, f"{path}/chunks", lambda parts: merge.latest(parts, "part"), every)
    ends = ingest.heads_after(redone, initial).join(ingest.file_tails(plain, settings.prefix), ["manual", "source_file"], "left")
    empty = F.array().cast(ends.schema["tail"].dataType)
    _keep(ends.select("manual", "source_file", "heads", F.coalesce("tail", empty).alias("tail")), number, f"{path}/states", _newest_states, every)


def ingest_files(spark, folder: str, path: str, checkpoint: str, manual: str = "manual", every: int = 16, **how) -> StreamingQuery:
    """Markdown files that arrive in a folder, chunked, embedded and kept as parts under ``path``.

    Headings and overlaps carry on from one batch to the next as within one (``absorb_files``). Chunks' keys
    depend only on their file, so a batch that runs again changes nothing.
    """
    files = spark.readStream.schema("value string").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    named = files.select(F.lit(manual).alias("manual"), text.file_name().alias("source_file"), F.col("value").alias("text")).where(text.stripped(F.col("value")) != "")
    return named.writeStream.foreachBatch(lambda batch, number: absorb_files(batch, number, path, every, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
