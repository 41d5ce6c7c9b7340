"""Stored tables that change by whole parts: upserts that rewrite touched buckets only, and days that expire.

A table is a folder of written parts and of versions. A version is a small file that names the folders of
every part; it comes into being at once or not at all, and a number is given once. Readers take the newest
version when they begin and see nothing of later ones. A writer that fails leaves folders that no version names.
``vacuum`` removes what the newest versions don't name any more.

Parts are few: buckets of keys, or days. Rows are dealt to tasks by key inside a part, and never pass the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import merge, sessions

BUCKETS = 64


class Outdated(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    return sorted(int(n[:-5]) for s in fs.listStatus(at) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """A version, by default the newest: its number, and the folders of each part."""
    known = versions(spark, path)
    if not known:
        return {"number": -1, "parts": {}}
    fs, at = _fs(spark, f"{path}/versions/{known[-1] if number is None else number:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, made: dict) -> dict:
    """Make ``made`` the newest version, unless its number is taken."""
    fs, aside = _fs(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    _, at = _fs(spark, f"{path}/versions/{made['number']:012d}.json")
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        raise Outdated(f"{path}: version {made['number']} is there")
    return made


def read(spark: SparkSession, path: str, schema, at: dict | None = None, parts: list[str] | None = None) -> DataFrame:
    """The rows of a version, by default the newest, or of some of its parts."""
    at = at or version(spark, path)
    folders = [f"{path}/{f}" for name, own in at["parts"].items() if parts is None or name in parts for f in own]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, part: Column, deal: list) -> dict[str, str]:
    """Write rows by part; the folder of each part. Empty parts have none."""
    folder = f"data/{uuid.uuid4().hex}"
    placed = rows.withColumn("__part", part)
    (placed.repartition(*deal) if deal else placed).write.partitionBy("__part").parquet(f"{path}/{folder}")
    fs, at = _fs(rows.sparkSession, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names if n.startswith("__part=")}


def upsert(new: DataFrame, path: str, schema, key: str = "chunk_id", buckets: int = BUCKETS, mutable=merge.MUTABLE) -> dict:
    """Merge ``new`` into the table by key (``merge.upsert``), and give the new version.

    Only buckets that a new key falls into are read and written. Rows are shuffled once, by bucket.
    """
    spark = new.sparkSession
    before = version(spark, path)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")
    touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most `buckets`
    old = read(spark, path, schema, before, touched)
    merged = merge.upsert(old.withColumn("__part", bucket), new.withColumn("__part", bucket), key, mutable, "__part")
    written = _write(merged, path, F.col("__part"), [])
    parts = before["parts"] | {k: [v] for k, v in written.items()}
    return commit(spark, path, {"number": before["number"] + 1, "parts": parts})


def append(new: DataFrame, path: str, ts: str = "timestamp", days: int = sessions.TTL_DAYS, batch: int | None = None) -> dict:
    """Append events by day and drop the days that have expired, in one version.

    The newest time of all batches less ``days`` is the watermark: days before its own are dropped whole, and rows
    of them aren't taken any more. A ``batch`` that runs again changes nothing. Rows without a time are left out.
    """
    spark = new.sparkSession
    before = version(spark, path)
    if batch is not None and batch <= before.get("batch", -1):
        return before
    newest = new.agg(F.date_format(F.max(ts), "yyyy-MM-dd")).first()[0]
    top = max(filter(None, (newest, before.get("newest"))), default=None)
    made = {"number": before["number"] + 1, "parts": dict(before["parts"]), "newest": top, "batch": before.get("batch", -1) if batch is None else batch}
    if top is not None:
        least = spark.range(1).select(F.date_format(F.date_sub(F.lit(top).cast("date"), days), "yyyy-MM-dd")).first()[0]
        day = F.date_format(ts, "yyyy-MM-dd")
        for name, folder in _write(new.where(F.col(ts).isNotNull() & (day >= least)), path, day, []).items():
            made["parts"][name] = [*made["parts"].get(name, []), folder]
        made["parts"] = {k: v for k, v in made["parts"].items() if k >= least}
    return commit(spark, path, made)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove the folders that none of the ``keep`` newest versions names, and older versions; give what has gone.

    Readers of the versions that stay lose nothing. Not to be run beside a writer, whose folders have no version yet.
    """
    known = versions(spark, path)
    named = {f for n in known[-keep:] for own in version(spark, path, n)["parts"].values() for f in own}
    for n in known[:-keep]:
        fs, at = _fs(spark, f"{path}/versions/{n:012d}.json")
        fs.delete(at, False)
    fs, data = _fs(spark, f"{path}/data")
    gone = []
    for written in fs.listStatus(data) if fs.exists(data) else []:
        top = written.getPath().getName()
        own = [f"data/{top}/{s.getPath().getName()}" for s in fs.listStatus(written.getPath()) if s.isDirectory()]
        dead = [f for f in own if f not in named]
        for f in [f"data/{top}"] if len(dead) == len(own) else dead:
            fs.delete(_fs(spark, f"{path}/{f}")[1], True)
        gone += dead
    return sorted(gone)
