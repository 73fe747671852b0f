"""Scans of rendered event documents, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostwarden.functions.windows_xml import EVENT_XML_OPTIONS, EVENT_XML_SCHEMA

# Folders named channel=<name> give the channel; without them it is null.
_FILE_SCHEMA = EVENT_XML_SCHEMA + ", channel STRING"
# Without multiLine a file is cut at the row tags: big files split over tasks, and a
# file may be a plain sequence of events without a root element.
_FILE_OPTIONS = {**EVENT_XML_OPTIONS, "multiLine": "false"}
_PARSED = ("System", "EventData", "UserData", "_corrupt_record")


def read_event_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files with one document per line -> ``xml``."""
    return spark.read.text(path).withColumnRenamed("value", "xml")


def read_event_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML files, one row per ``Event`` element, already in the parsed shape."""
    return _with_parsed(
        spark.read.format("xml").options(**_FILE_OPTIONS).schema(_FILE_SCHEMA).load(path)
    )


def stream_event_xml(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same scan as a stream; ``files_per_batch`` bounds one micro-batch."""
    reader = (
        spark.readStream.format("xml").options(**_FILE_OPTIONS).schema(_FILE_SCHEMA)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _with_parsed(reader.load(path))


def _with_parsed(rows: DataFrame) -> DataFrame:
    others = [F.col(name) for name in rows.columns if name not in _PARSED]
    return rows.select(*others, F.struct(*_PARSED).alias("parsed"))
