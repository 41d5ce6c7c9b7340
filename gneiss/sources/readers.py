"""Sources: Markdown folders, tables, collections and benchmark files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss import schemas
from gneiss.functions.text import file_name, stripped
from gneiss.sources.store import resolved


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, text) of the ``*.md`` files right in a folder; blank files are left out.

    A relative folder that isn't there is looked for below the project's root; a missing one
    raises, as any reader of a missing path does.
    """
    files = spark.read.option("pathGlobFilter", "*.md").text(resolved(folder), wholetext=True)
    return files.select(file_name().alias("source_file"), F.col("value").alias("text")).where(stripped(F.col("text")) != "")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks; a filter on chunk_type prunes partitions."""
    return spark.read.schema(schemas.MANUAL_CHUNKS).parquet(path)


def collection(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A document collection kept as JSON lines, with a fixed schema."""
    return spark.read.schema(schema).json(path)


def collection_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The collection, or an empty one if its store can't be reached: analytics degrade, not fail."""
    from pyspark.errors import AnalysisException

    try:
        return collection(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval benchmark cases from a JSON array."""
    return spark.read.schema(schemas.BENCHMARK_CASE).option("multiLine", True).json(path)


def pdf_pages(spark: SparkSession, folder: str, recognise) -> DataFrame:
    """(source_file, text) of PDF files by a pluggable ``recognise(bytes) -> str`` on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)

    def run(frames):
        for frame in frames:
            yield frame.assign(text=[recognise(c) for c in frame.pop("content")])[["source_file", "text"]]

    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content").mapInPandas(run, "source_file string, text string")
