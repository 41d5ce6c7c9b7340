"""Helpers on DataFrames: checked broadcasts, and tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``max_rows`` rows, else as it is: the
    join then shuffles. For narrow tables."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``.

    Without that setting only a session on one machine, as in tests, has such a folder: a temporary
    one. On a cluster an error is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='gneiss-scratch-')}")
    path = f"{root.rstrip('/')}/gneiss-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as it is read back from a table of its own: for narrow results that several passes read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(spark: SparkSession, parts) -> DataFrame:
    """The union of DataFrames that are made one after the other.

    A single one is given as it is. Of several each is written before the next is made, so neither
    the plan nor the driver grows with their number.
    """
    path, first = None, None
    for df in parts:
        if first is None:
            first = df
            continue
        if path is None:
            path = scratch(spark)
            first.write.parquet(path)
        df.write.mode("append").parquet(path)
    return first if path is None else spark.read.schema(first.schema).parquet(path)
