"""Log and event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.runs import log_text
from ..streaming.events import parse_events


def read_ndjson_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream chunks of files as typed rows; the batch face of the streaming reader."""
    return parse_events(spark.read.text(path))


def export_log_text(log: DataFrame, path: str) -> None:
    """Write log rows as text lines, oldest first."""
    log_text(log).orderBy("ts", "event_id").select("line").write.mode("overwrite").text(path)
