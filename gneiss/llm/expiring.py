"""Expiring deduplication of clicks as they arrive: a stream with state that comes and goes.

The first row of a click opens a window of ``SPAN`` hours; rows of the same click up to its end are
repeats, a later one closes it and opens the next. Windows also close when the watermark (the largest
hour of earlier micro-batches less ``DELAY``) has passed their end; rows older than the watermark are
dropped. The rows of one micro-batch are taken in the order of hour, then hash.

State is kept by shard, a hash of the click, in packed values: Arrow record batches in serial form with a
column each for ids (sorted), start hours, counts and hashes, of ``PART_WINDOWS`` windows each. A micro-batch's rows of a shard are
sorted, met with the ids by a merge join, folded in rounds over whole columns, and the batch is
written anew without what has expired. One timer for each shard stands at its earliest deadline and
closes windows where no rows arrive; ``closed_batch`` is the batch after which, or in which, a window
closed, whichever micro-batch brings it out. Where a click is repeated very often, equal rows of a task are
counted together before the exchange, so that it stays narrow; the number of shards has to grow with the
clicks that are open at once (``shards_for``).

Each micro-batch opens a state store in every partition, and Spark keeps some native memory of each (the
statistics of RocksDB, half a MB on 8 processors) as long as an executor lives. So there is one micro-batch for each
start of the query, none without rows: every batch has a row that brings out what is due, the last one
a row for each shard that brings out the rest.

Defined results: rows without a click id or a time of arrival have no window and are left out; nulls in
other columns count as empty text; repeated rows are repeats; texts of any length only enter by their
hash; an empty table gives an empty result; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from gneiss.llm.common import scratch

SPAN, DELAY = 72, 48
BATCHES = 12
#: Rows of a micro-batch that share a shard, about.
SHARD_ROWS = 50_000
#: Windows of a packed value, of 72 bytes each: what passes between Python, JVM and store at once is under 0.5 MB.
PART_WINDOWS = 4_000
#: Bytes of a file's row groups in a batch's folder; a task has one open for each batch.
GROUP_BYTES = 8 << 20
#: Rows of one click beyond which equal rows are counted together before the exchange.
BUSY_ROWS = 10_000
HOUR_MS = 3_600_000
#: An hour after every other (in the year 2198), of the rows that end a stream.
END_HOUR = 2_000_000
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # A start of the query opens each store once; left open, its local files would stay with the executors.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
OUT = "click_id bigint, start_hour bigint, closed_batch bigint, n_repeats bigint, n_conflicts bigint, conflict_crc bigint, hash binary"


class Windows:
    """Open windows, a column each; ids are sorted and distinct."""

    NUMBERS = ("click_id", "start_hour", "n_repeats", "n_conflicts", "conflict_crc")

    def __init__(self, numbers: np.ndarray, hashes: np.ndarray):
        self.numbers, self.hashes = numbers, hashes  # (5, n) int64 and (n, 4) uint64, big end first

    @classmethod
    def none(cls) -> Windows:
        return cls(np.zeros((5, 0), np.int64), np.zeros((0, 4), np.uint64))

    @classmethod
    def unpack(cls, blob: bytes) -> Windows:
        import pyarrow as pa

        with pa.ipc.open_stream(blob) as stream:
            batch = stream.read_next_batch()
        raw = np.frombuffer(batch.column(5).buffers()[1], np.uint8, 32 * batch.num_rows)
        return cls(np.array([batch.column(i).to_numpy() for i in range(5)]), raw.view(">u8").astype(np.uint64).reshape(-1, 4))

    def pack(self) -> bytes:
        import pyarrow as pa

        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(self), [None, pa.py_buffer(self.hashes.astype(">u8").tobytes())])
        batch = pa.RecordBatch.from_arrays([*(pa.array(x) for x in self.numbers), raw], [*self.NUMBERS, "hash"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def __len__(self) -> int:
        return self.numbers.shape[1]

    def where(self, mask: np.ndarray | slice) -> Windows:
        return Windows(self.numbers[:, mask], self.hashes[mask])

    def and_(self, other: Windows) -> Windows:
        """Both, in the order of ids."""
        numbers = np.concatenate([self.numbers, other.numbers], axis=1)
        order = np.argsort(numbers[0], kind="stable")
        return Windows(numbers[:, order], np.concatenate([self.hashes, other.hashes])[order])

    def closed(self, batch: int) -> pd.DataFrame:
        raw = self.hashes.astype(">u8").tobytes()
        click, start, *counts = self.numbers
        columns = [click, start, np.full(len(self), batch, np.int64), *counts, [raw[i : i + 32] for i in range(0, len(raw), 32)]]
        return pd.DataFrame(dict(zip(("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"), columns, strict=True)))


def fold(open_: Windows, ids: np.ndarray, hours: np.ndarray, hashes: np.ndarray, crcs: np.ndarray, counts: np.ndarray, span: int = SPAN) -> tuple[Windows, list[Windows]]:
    """(windows open after the rows, windows that rows closed). Rows come in any order, each ``counts`` times."""
    if not len(ids):
        return open_, []
    order = np.lexsort((hashes[:, 3], hashes[:, 2], hashes[:, 1], hashes[:, 0], hours, ids))
    ids, hours, hashes, crcs, counts = ids[order], hours[order], hashes[order], crcs[order], counts[order]
    clicks, first = np.unique(ids, return_index=True)
    end = np.append(first[1:], len(ids))
    at = np.searchsorted(open_.numbers[0], clicks)
    at[at == len(open_)] = 0
    known = open_.numbers[0, at] == clicks if len(open_) else np.zeros(len(clicks), bool)
    now = Windows(np.zeros((5, len(clicks)), np.int64), np.zeros((len(clicks), 4), np.uint64))
    now.numbers[:, known], now.hashes[known] = open_.numbers[:, at[known]], open_.hashes[at[known]]
    now.numbers[0] = clicks
    idle = np.ones(len(open_), bool)
    idle[at[known]] = False
    low, reach = hours.min(), int(hours.max() - hours.min()) + 2
    keys = np.repeat(np.arange(len(clicks)), end - first) * reach + (hours - low) + 1
    next_, open_now, shut = first.copy(), known.copy(), []
    while (todo := next_ < end).any():
        new = np.flatnonzero(todo & ~open_now)
        row = next_[new]
        now.numbers[1:, new] = np.array([hours[row], counts[row] - 1, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)])
        now.hashes[new], open_now[new] = hashes[row], True
        next_[new] += 1
        until = np.clip(now.numbers[1] + span - low + 1, 0, reach - 1) + np.arange(len(clicks)) * reach
        upto = np.where(todo, np.maximum(np.searchsorted(keys, until, "right"), next_), next_)
        owner = np.repeat(np.arange(len(clicks)), upto - next_)
        rows = np.arange(len(owner)) + np.repeat(next_ - (np.cumsum(upto - next_) - (upto - next_)), upto - next_)
        odd = (hashes[rows] != now.hashes[owner]).any(axis=1) * counts[rows]
        for column, values in ((2, counts[rows]), (3, odd), (4, odd * crcs[rows])):
            np.add.at(now.numbers[column], owner, values)
        next_ = upto
        done = np.flatnonzero(next_ < end)
        if len(done):
            shut.append(now.where(done))
            open_now[done] = False
    return open_.where(idle).and_(now), shut


class Shard(StatefulProcessor):
    """The windows of one shard's clicks. ``batch`` is the number of this start of the query, which has
    one micro-batch; ``last``: nothing stays open after it."""

    def __init__(self, batch: int, last: bool, span: int):
        self.batch, self.last, self.span = batch, last, span

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("windows", "part int", "packed binary")

    def _deadline(self, hours):
        """The watermark stands on whole hours less a second; so half an hour past the last one is reached
        by it where the next hour is."""
        return (hours + self.span) * HOUR_MS + HOUR_MS // 2

    def _load(self, watermark: int) -> tuple[Windows, pd.DataFrame]:
        """What is still open, and the rows of what has expired."""
        parts = [Windows.none()]
        while (packed := self.parts.getValue((len(parts) - 1,))) is not None:
            parts.append(Windows.unpack(packed[0]))
        kept = Windows(np.concatenate([p.numbers for p in parts], axis=1), np.concatenate([p.hashes for p in parts]))
        gone = self._deadline(kept.numbers[1]) <= watermark
        return kept.where(~gone), kept.where(gone).closed(self.batch - 1)

    def _store(self, kept: Windows) -> None:
        due = int(self._deadline(kept.numbers[1].min())) if len(kept) else None
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)
        used = -(-len(kept) // PART_WINDOWS)
        for i in range(used):
            self.parts.updateValue((i,), (kept.where(slice(i * PART_WINDOWS, (i + 1) * PART_WINDOWS)).pack(),))
        while self.parts.containsKey((used,)):
            self.parts.removeKey((used,))
            used += 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        kept, expired = self._load(watermark)
        yield expired
        # Spark itself drops late rows by the watermark of the micro-batch before.
        parts = [x[(x["crc"] >= 0) & (x["hour"] * HOUR_MS > watermark)] for x in rows]
        table, shut = pd.concat(parts) if parts else None, []
        if table is not None and len(table):
            hashes = np.frombuffer(b"".join(table["hash"]), ">u8").astype(np.uint64).reshape(-1, 4)
            columns = (table[c].to_numpy(np.int64) for c in ("click_id", "hour", "crc", "n"))
            ids, hours, crcs, counts = columns
            kept, shut = fold(kept, ids, hours, hashes, crcs, counts, self.span)
        if self.last:
            kept, shut = Windows.none(), [*shut, kept]
        self._store(kept)
        for windows in shut:
            yield windows.closed(self.batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, expired = self._load(timerValues.getCurrentWatermarkInMs())
        self._store(kept)
        yield expired

    def close(self) -> None:
        pass


def combined(rows: DataFrame) -> DataFrame:
    """(shard, click_id, hour, hash, crc, n): equal rows of a task counted together, a part at a time."""

    def run(batches):
        import pyarrow as pa

        def counted(held):
            keys = ["shard", "click_id", "hour", "hash", "crc"]
            yield from pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([([], "count_all")]).rename_columns([*keys, "n"]).to_batches()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 200_000:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    return rows.select("shard", "click_id", "hour", "hash", "crc").mapInArrow(run, "shard int, click_id bigint, hour bigint, hash binary, crc bigint, n bigint")


def windows(rows: DataFrame, shards: int, batch: int = 0, last: bool = False, busy: bool = True, span: int = SPAN, delay: int = DELAY) -> DataFrame:
    """Closed windows of a stream of ``rows`` (click_id, hour, digest: lowercase hex sha256, shard), as ``OUT``.

    A row without a click id only moves the watermark and wakes its shard, where what is due comes out,
    all of it if the batch is the ``last``. The shard of other rows is null. ``busy``: some clicks have very many rows.
    """
    keyed = rows.select(
        F.coalesce("shard", F.pmod(F.xxhash64("click_id"), F.lit(shards)).cast("int")).alias("shard"), F.coalesce("click_id", F.lit(0).cast("long")).alias("click_id"), "hour",
        F.unhex("digest").alias("hash"), F.when(F.col("click_id").isNull(), -1).otherwise(F.crc32(F.col("digest").cast("binary"))).alias("crc"),
    )
    # A second more than the delay: rows at the watermark are late to Spark, and one at M - delay isn't to us.
    counted = combined(keyed) if busy else keyed.withColumn("n", F.lit(1).cast("long"))
    timed = counted.withColumn("seen_at", F.timestamp_seconds(F.col("hour") * 3600)).withWatermark("seen_at", f"{delay * 3600 + 1} seconds")
    return timed.groupBy("shard").transformWithStateInPandas(Shard(batch, last, span), OUT, "Append", "EventTime")


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column; times without a zone are taken for UTC."""
    at = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        at = F.from_utc_timestamp(at.cast("timestamp"), F.current_timezone())
    return F.unix_micros(at)


def digest(df: DataFrame, variant: Column) -> Column:
    """sha256 of a click's contents, joined by bars; nulls are empty."""
    parts = [F.col("client_id"), F.col("kind"), F.floor(100 * F.col("value") + 0.5), utc_micros(df, "ts"), F.col("props"), variant]
    texts = [x for p in parts for x in (F.lit("|"), F.coalesce(p.cast("string"), F.lit("")))][1:]
    return F.sha2(F.concat(*texts), 256)


def copies(clicks: DataFrame) -> DataFrame:
    """(click_id, client_id, kind, value, ts, props, variant, hour, order): every row's copies j from 0 to click_id % 3."""
    hour = F.floor(utc_micros(clicks, "arrived_at") / (HOUR_MS * 1000))
    found = clicks.where("click_id is not null and arrived_at is not null")
    found = found.select("click_id", "client_id", "kind", "value", "ts", "props", hour.alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("click_id", F.lit(3)))).alias("j"))
    code = F.crc32(F.concat("click_id", F.lit(":"), "j").cast("binary"))
    found = found.withColumn("code", code).withColumn("hour", F.col("base") + 6 * F.col("j") * (F.col("code") % 10))
    order = F.col("hour") + F.floor(F.col("code") / 10) % 200
    return found.select("click_id", "client_id", "kind", "value", "ts", "props", (F.col("code") % 3).alias("variant"), "hour", order.alias("order"))


def shards_for(rows: int, each: int = SHARD_ROWS) -> int:
    """Shards for micro-batches of ``rows`` rows: some for every task, and more as rows grow."""
    return max(64, -(-rows // each))


def in_batches(spark: SparkSession, clicks: DataFrame, batches: int = BATCHES, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """The windows of ``copies`` of ``clicks`` that arrive in ``batches`` files' folders, one start of the
    streaming query for each, all on one checkpoint. Last rows after all hours close what is open."""
    made = copies(clicks)
    low, high, rows = made.agg(F.min("order"), F.max("order"), F.count("*")).first()
    final = F.lower(F.hex("hash")).alias("hash")
    columns = ["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", final]
    if not rows:
        return spark.createDataFrame([], OUT).select(*columns)
    # Counts by a hash that some thousand rows share at least bound those of single clicks.
    bucket = F.pmod(F.xxhash64("click_id"), F.lit(max(64, rows // 1000)))
    busy = clicks.where("click_id is not null").groupBy(bucket.alias("bucket")).count().agg(F.max("count")).first()[0] > busy_rows
    home = scratch(spark)
    shards = shards_for(rows // batches)
    number = F.floor((F.col("order") - low) * batches / F.lit(high - low + 1))
    split = made.withColumn("batch", number.cast("int")).drop("order")
    # Each batch gets a row, so that it runs if no other arrives; the last one gets one for each shard.
    woken = [(b, 0, 0) for b in range(batches - 1)]
    wake = spark.createDataFrame(woken, "batch int, shard int, hour long")
    ends = spark.range(shards).select(F.lit(batches - 1).alias("batch"), F.col("id").cast("int").alias("shard"), F.lit(END_HOUR).cast("long").alias("hour"))
    split = split.unionByName(wake.unionByName(ends), allowMissingColumns=True)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{home}/in"))
    # With a file open for each batch, a task needs no sort by batch.
    settings = SETTINGS | {IDLE_BATCHES: "false", OPEN_FILES: str(batches)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        split.write.partitionBy("batch").option("parquet.block.size", GROUP_BYTES).parquet(f"{home}/cut")
        for batch in range(batches):
            # What a batch's watermark closes comes out with the next one's rows.
            fs.rename(path(f"{home}/cut/batch={batch}"), path(f"{home}/in/batch={batch}"))
            arriving = spark.readStream.schema(split.schema).parquet(f"{home}/in")
            found = windows(arriving.withColumn("digest", digest(arriving, F.col("variant"))), shards, batch, batch == batches - 1, busy)
            query = found.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUT).parquet(f"{home}/out").select(*columns)


#: The same windows by a recursion over each click's rows; crc32 is worked out bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE j AS (
  SELECT *, unnest(range(click_id % 3 + 1)) AS j FROM clicks WHERE click_id IS NOT NULL AND arrived_at IS NOT NULL
), j2 AS (
  SELECT *, click_id || ':' || j AS name FROM j
), c AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(name) + 1), lambda i: list_concat([ascii(name[i])::BIGINT], [-1::BIGINT FOR k IN range(8)])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS c FROM j2
), h AS (
  SELECT click_id, epoch_us(arrived_at) // 3600000000 + 6 * j * (c % 10) AS hour, c,
    sha256(coalesce(client_id::VARCHAR, '') || '|' || coalesce(kind, '') || '|' || coalesce(floor(100 * value + 0.5)::BIGINT::VARCHAR, '') || '|' || coalesce(epoch_us(ts)::VARCHAR, '') || '|' || coalesce(props, '') || '|' || (c % 3)) AS hash
  FROM c
), l AS (SELECT *, hour + (c // 10) % 200 AS l FROM h
), b AS (
  SELECT click_id, hour, hash, ((l - (SELECT min(l) FROM l)) * 12 // (SELECT max(l) - min(l) + 1 FROM l)) AS batch FROM l
), tops AS (
  SELECT n.batch, max(b.hour) AS top FROM range(12) n(batch) JOIN b ON b.batch <= n.batch GROUP BY n.batch
), live AS (
  SELECT b.*, t.top AS m FROM b LEFT JOIN tops t ON t.batch = b.batch - 1 WHERE t.top IS NULL OR b.hour >= t.top - 48
), o AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY batch, hour, hash) AS n FROM live
), r AS (
  SELECT click_id, n, batch, hash, hour AS start, hash AS opener, 1 AS win FROM o WHERE n = 1
  UNION ALL
  SELECT o.click_id, o.n, o.batch, o.hash, CASE WHEN same THEN r.start ELSE o.hour END, CASE WHEN same THEN r.opener ELSE o.hash END, r.win + (NOT same)::INT
  FROM r JOIN o ON o.click_id = r.click_id AND o.n = r.n + 1, LATERAL (SELECT (o.m IS NULL OR r.start + 72 >= o.m - 48) AND o.hour <= r.start + 72 AS same)
), odd AS (
  SELECT hash AS name, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, 65), lambda i: list_concat([ascii(hash[i])::BIGINT], [-1::BIGINT FOR k IN range(8)])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS c FROM (SELECT DISTINCT hash FROM r WHERE hash <> opener)
), w AS (
  SELECT click_id, win, start, opener, min(batch) AS first, count(*) - 1 AS n_repeats, sum((hash <> opener)::BIGINT) AS n_conflicts, sum(CASE WHEN hash <> opener THEN odd.c ELSE 0 END) AS conflict_crc
  FROM r LEFT JOIN odd ON odd.name = r.hash GROUP BY ALL
)
SELECT click_id, start AS start_hour, least(lead(first) OVER (PARTITION BY click_id ORDER BY win), coalesce((SELECT min(t.batch) FROM tops t WHERE t.top - 48 > w.start + 72), 11), 11)::BIGINT AS closed_batch,
  n_repeats::BIGINT AS n_repeats, n_conflicts::BIGINT AS n_conflicts, conflict_crc::BIGINT AS conflict_crc, opener AS hash
FROM w
"""
