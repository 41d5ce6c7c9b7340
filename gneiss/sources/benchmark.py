"""The built-in retrieval benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss import schemas

# The seven cases (id, query, expected files, required keywords, expected type).
CASES = [
    ("TC-01", "感測器如何安裝在樹幹上？", ["PiCUSQ72Manual_13.md", "PiCUSQ72Manual_51.md"], ["sensor", "mount", "tree"], "text"),
    ("TC-02", "MP used Transmitter Receiver Histogram", ["PiCUSQ72Manual_13.md"], ["transmitter", "receiver", "histogram"], "table"),
    ("TC-03", "No connection to Modules 模組通訊異常排除", ["PiCUSQ72Manual_59.md"], ["connection", "module", "cable"], "text"),
    ("TC-04", "如何使用皮尺測量樹木幾何形狀與幾何圓周？", ["PiCUSQ72Manual_14.md", "PiCUSQ72Manual_15.md", "PiCUSQ72Manual_16.md"], ["geometry", "tree", "measur"], "text"),
    ("TC-05", "PiCUS 儀器電池充電與電源維護規範", ["PiCUSQ72Manual_56.md", "PiCUSQ72Manual_61.md"], ["battery", "charge", "power"], "text"),
    ("TC-06", "音波斷層掃描的物理原理與聲速測量", ["PiCUSQ72Manual_4.md", "PiCUSQ72Manual_17.md"], ["velocity", "sound", "tomograph"], "text"),
    ("TC-07", "如何設定與校準感測器模組地址？", ["PiCUSQ72Manual_58.md"], ["module", "address", "program"], "text"),
]


def builtin_cases(spark: SparkSession) -> DataFrame:
    """The built-in cases, in the shape of a benchmark file."""
    rows = [(i, q, files, words, kind, None, None) for i, q, files, words, kind in CASES]
    return spark.createDataFrame(rows, schemas.BENCHMARK_CASE)
