"""Quality rules with cross-document line frequency.

Lines are normalised and hashed, distinct documents with a line are counted per host,
lines above the limits are removed, and documents that lose too much are rejected.
Documents of equal text are one document in these counts, so exact copies alone
make no line frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from hostwarden.llm.texts import arrow_pass, byte_lists, small_batches, written

#: A line is frequent in a host when more distinct documents than both limits have it.
MIN_DOCUMENTS = 30
MAX_SHARE = 0.05
#: A document is depleted when more than this share of its words is in removed lines.
MAX_REMOVED = 0.5
MIN_WORDS = 50
#: Documents without a source share one host of their own.
NO_HOST = "\x00"

_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_FOLLOWERS = (np.arange(256) & 0xC0) == 0x80
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

PROFILE = (
    "doc_id BIGINT, host STRING, text_hash BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT,"
    " n_dup_lines BIGINT, n_repeat_words BIGINT, lines ARRAY<STRUCT<hash: BIGINT, words: BIGINT>>"
)


def line_hash(line: bytes) -> int:
    """Hash of a line in lower case (A-Z) with single spaces, as a signed number."""
    value = xxh3_64_intdigest(b" ".join(line.lower().split()))
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    numbers = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(numbers) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, place, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= again
    return int(covered.sum())


def base_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(words), int(counts[~_SPACES & ~_FOLLOWERS].sum()), int(counts[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words)


def profiles(documents: DataFrame) -> DataFrame:
    """Statistics and line hashes of every document, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            statistics, lines = [], []
            for text in byte_lists(batch.column(1)):
                statistics.append(base_statistics(text or b""))
                found = [line for line in (text or b"").split(b"\n") if line and not line.isspace()]
                lines.append([{"hash": line_hash(x), "words": len(x.split())} for x in found])
            numbers = np.array(statistics, dtype=np.int64).reshape(-1, 5)
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))
            columns = [batch.column(0), batch.column(2), batch.column(3), *(pa.array(numbers[:, i]) for i in range(5)), pa.array(lines, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    rows = documents.select("doc_id", "text", F.coalesce("source", F.lit(NO_HOST)).alias("host"), F.xxhash64("text").alias("text_hash"))
    return arrow_pass(rows, run, PROFILE)


def frequent_lines(profiled: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """host and hash of the lines that more than ``min_documents`` distinct documents of the host
    and more than ``max_share`` of them have."""
    lines = profiled.select("host", "text_hash", F.explode(F.array_distinct("lines.hash")).alias("hash"))
    counts = lines.groupBy("host", "hash").agg(F.count_distinct("text_hash").alias("n")).filter(F.col("n") > min_documents)
    hosts = profiled.groupBy("host").agg(F.count_distinct("text_hash").alias("size"))
    return counts.join(hosts, "host").filter(F.col("n") > max_share * F.col("size")).select("host", "hash")


def assess(
    documents: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    max_removed: float = MAX_REMOVED,
    min_words: int = MIN_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """The verdict on every document, and the removed lines (host, hash).

    Verdict columns: doc_id, host, text_hash, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_removed (words in removed lines), base_failed,
    depleted, kept, and ``removed``, the hashes of the document's removed lines (null: none).

    A null or empty text has no words and fails the base rule. A null source is a host
    of its own; a null doc_id stays null. Repeated rows get equal verdicts and count as
    one document. An empty table gives an empty result. Needs doc_id, text and source
    and reads no other column.
    """
    profiled = written(profiles(documents).withColumn("row", F.monotonically_increasing_id()), "profiles")
    frequent = written(frequent_lines(profiled, min_documents, max_share), "frequent-lines")
    lines = profiled.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.hash", "line.words")
    hit = lines.join(frequent, ["host", "hash"], "left_semi")
    removed = hit.groupBy("row").agg(F.sum("words").alias("lost"), F.sort_array(F.collect_set("hash")).alias("removed"))
    joined = profiled.drop("lines").join(removed, "row", "left").drop("row")
    lost = F.coalesce("lost", F.lit(0))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdicts = joined.select(
        *[c for c in joined.columns if c not in ("lost", "removed")],
        lost.cast("bigint").alias("n_removed"),
        base.alias("base_failed"),
        (lost > max_removed * F.col("n_words")).alias("depleted"),
        "removed",
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return verdicts, frequent


def clean(documents: DataFrame, **limits: float) -> DataFrame:
    """The kept documents without their frequent lines; all columns stay, a column ``n_chars`` follows the text.

    Documents that lose no line keep their text as it is. A null or empty text fails the base
    rules and goes, a null source is a host of its own, a null doc_id stays null, repeated rows
    stay repeated, texts count whole, and an empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def without_lines(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([_without(text, gone) for text, gone in zip(texts, removed, strict=True)], dtype=object)

    verdicts, _ = assess(documents, **limits)
    kept = verdicts.filter("kept").groupBy("doc_id", "host", "text_hash").agg(F.first("removed").alias("removed"))
    rows = documents.select(F.struct("*").alias("row"), F.coalesce("source", F.lit(NO_HOST)).alias("row_host"), F.xxhash64("text").alias("row_hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("row_host") == F.col("host")) & (F.col("row_hash") == F.col("text_hash"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(without_lines("row.text", "removed"))
    new = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in documents.columns else {})
    return rows.join(kept, same).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])


def _without(text: str | None, removed: np.ndarray | None) -> str | None:
    if text is None or removed is None:
        return text
    gone = set(removed)
    lines = text.encode().split(b"\n")
    return b"\n".join(x for x in lines if not x or x.isspace() or line_hash(x) not in gone).decode()
