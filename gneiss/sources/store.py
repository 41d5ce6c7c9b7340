"""Where collections are kept: a layout for each, made once, with a status instead of an error."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss import schemas
from gneiss.operators.sessions import TTL_DAYS

#: What each collection is looked up by, how it is dealt out, and after how many days a row expires.
LAYOUTS = {
    "chat_sessions": {"schema": schemas.CHAT_SESSIONS, "unique": ["session_id"], "sorted": ["user_id", "updated_at"], "partitioned": [], "days": None},
    "search_audit_logs": {"schema": schemas.AUDIT_LOGS, "unique": [], "sorted": ["query_type", "timestamp"], "partitioned": ["day"], "days": TTL_DAYS},
}


def resolved(folder: str, root: str | None = None) -> str:
    """A folder as it is given, or below the project's root where a relative one isn't there."""
    if "://" in folder or Path(folder).is_absolute() or Path(folder).exists():
        return folder
    below = Path(root or Path(__file__).resolve().parents[2]) / folder
    return str(below if below.exists() else folder)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def bootstrap(spark: SparkSession, root: str | None) -> dict:
    """Make the folder of every collection, with an empty table of its schema.

    The status is skipped without a root, success with each collection's layout, or error with what
    went wrong; collections that are there already stay as they are.
    """
    if not root:
        return {"status": "skipped", "reason": "no store is set"}
    try:
        made = {}
        for name, layout in LAYOUTS.items():
            fs, at = _folder(spark, f"{root.rstrip('/')}/{name}")
            if not fs.exists(at):
                empty = spark.createDataFrame([], layout["schema"])
                if "day" in layout["partitioned"]:
                    empty = empty.withColumn("day", F.to_date("timestamp"))
                empty.write.partitionBy(*layout["partitioned"]).parquet(at.toString()) if layout["partitioned"] else empty.write.parquet(at.toString())
            made[name] = {k: layout[k] for k in ("unique", "sorted", "partitioned", "days")}
        return {"status": "success", "indexes": made}
    except Exception as e:
        return {"status": "error", "error": str(e)}


def with_columns_of(df: DataFrame, schema) -> DataFrame:
    """``df`` in the shape of a newer schema: columns that it lacks are null, others keep."""
    have = {c.lower() for c in df.columns}
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name.lower() not in have]
    return df.select("*", *missing)


def evolving(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stored table whose files were written with fewer columns at first."""
    read = spark.read.option("mergeSchema", True).parquet(path)
    return read if schema is None else with_columns_of(read, schema)
