"""Packing by power-of-two decomposition.

A document's ids are cut into full sequences of ``limit`` and then into the binary
digits of the rest, longest first. Every piece is a sequence of its own, its length is
a power of two, and pieces of equal length form a bucket. So nothing is padded and no
sequence crosses two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.texts import arrow_pass, byte_lists, small_batches
from hostwarden.llm.tokenizer import checked, default_path, id_cache

LIMIT = 2048
PIECES = "doc_id BIGINT, start BIGINT, length BIGINT, doc_tokens BIGINT, bucket INT, ids BINARY"


def piece_lengths(tokens: int, limit: int = LIMIT) -> list[int]:
    """Full sequences, then the binary digits of the rest from high to low."""
    full, rest = divmod(tokens, limit)
    digits = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    return [limit] * full + digits


def pack(documents: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (log2 of length), ids, sequence_id, offset.

    ``ids`` holds the token ids as little-endian unsigned 32-bit numbers
    (``numpy.frombuffer(ids, "<u4")``); each document ends with ``end_id``. ``limit``
    is a power of two. A sequence is one piece, so ``offset`` is 0, and ``sequence_id``
    is unique among all pieces: the task's number and the piece's place in it. It is
    stable for inputs that are read from files.

    A null or empty text gives one piece that holds only ``end_id``. A null doc_id stays
    null. Repeated rows are packed each on their own. Other columns are not read.
    No shuffle; a task holds one slice of texts at a time.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    path = checked(tokenizer_path or default_path())
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = id_cache(path)
        for batch in small_batches(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_lists(batch.column(1)), strict=True):
                ids, start = cache.text_ids(text) + end, 0
                tokens = len(ids) // 4
                for length in piece_lengths(tokens, limit):
                    rows.append((doc_id, start, length, tokens, length.bit_length() - 1, ids[4 * start : 4 * (start + length)]))
                    start += length
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "bucket", "ids"])

    pieces = arrow_pass(documents.select("doc_id", "text"), run, PIECES)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences with one folder per length, so that a reader takes batches of equal shape."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
