"""Shared helpers: byte-level words, Arrow passes over texts, written intermediate tables.

Texts are handled as UTF-8 bytes. ``bytes.split()`` cuts at exactly the six characters
0x20 and 0x09-0x0D and ``bytes.lower()`` touches exactly A-Z, which is what the word
definitions of the operators ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hostwarden.session import scratch_path

#: Python's own batches are cut to about this many bytes of text, so that a task's memory does not follow its input.
BATCH_BYTES = 4 << 20
#: Batches that Spark sends to Python, if the session allows larger ones.
ARROW_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def byte_lists(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, nulls kept."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose column number ``text`` holds about BATCH_BYTES at most (one row at least)."""
    for batch in batches:
        rows, size = batch.num_rows, batch.column(text).nbytes
        step = max(1, rows * BATCH_BYTES // max(size, 1)) if size > BATCH_BYTES else rows
        for start in range(0, rows, max(step, 1)):
            yield batch.slice(start, step)


def arrow_pass(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most ARROW_BYTES, so that a worker's memory does not follow the texts' lengths.

    The session's ``spark.sql.execution.arrow.maxBytesPerBatch`` is lowered if it is larger.
    """
    settings = rows.sparkSession.conf
    if int(settings.get(_BATCH_SETTING).rstrip("bB")) > ARROW_BYTES:
        settings.set(_BATCH_SETTING, str(ARROW_BYTES))
    return rows.mapInArrow(run, schema)


def map_texts(rows: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """One Arrow pass; ``make`` turns a slice of the rows into a batch of ``schema``."""
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, place):
            yield make(batch)

    return arrow_pass(rows, run, schema)


def record(**columns: object) -> pa.RecordBatch:
    """A record batch from named arrays."""
    return pa.RecordBatch.from_pydict(dict(columns))


def text_key(*columns: str) -> Column:
    """64-bit content hash of columns; used together with ``doc_id``, so that only rows of one id could collide."""
    return F.xxhash64(*[F.col(c) for c in columns])


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id has remainder -1, so it is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts the lineage with files that survive a lost executor, and the planner then
    knows the real size, so it broadcasts the table only when it is small.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove_written(frame: DataFrame) -> None:
    """Delete the files behind a table of ``written`` that nothing reads any more."""
    spark: SparkSession = frame.sparkSession
    for file in {f.rpartition("/")[0] for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
