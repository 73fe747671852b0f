"""Token counts without ids: pieces are counted once per distinct pre-token.

The distinct pre-tokens of the corpus are counted and tokenized once each. A
document's count is the sum over its pre-token frequencies, joined to that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.frequent_words import sums_by_document, word_counts
from hostwarden.llm.texts import arrow_pass, written
from hostwarden.llm.tokenizer import checked, default_path, id_cache, pre_tokens

LIMIT = 2048
#: Pre-tokens that are encoded at once.
_ENCODED = 4_000


def piece_counts(vocabulary: DataFrame, tokenizer_path: str) -> DataFrame:
    """``vocabulary`` (word, freq) with ``n_tokens`` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = id_cache(tokenizer_path)
        for batch in batches:
            for start in range(0, batch.num_rows, _ENCODED):
                part = batch.slice(start, _ENCODED)
                pieces = part.column(0).to_pylist()
                sizes = {piece: len(ids) // 4 for piece, ids in cache.encode(pieces)}
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sizes[p] for p in pieces], pa.int64())], names=["word", "freq", "n_tokens"])

    return arrow_pass(vocabulary.select("word", "freq"), run, "word BINARY, freq BIGINT, n_tokens BIGINT")


def count_tokens(documents: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No begin, end or added special tokens; special strings inside a text are handled
    as the tokenizer does by default. A null or empty text has 0 bytes and 0 tokens. A
    null doc_id stays null, repeated rows give repeated results, other columns are not
    read. A word of any length is one pre-token and is never cut.
    """
    path = checked(tokenizer_path or default_path())
    texts = documents.select("doc_id", "text")
    vocabulary = written(piece_counts(word_counts(texts, pre_tokens), path), "pre-tokens")
    sums = sums_by_document(texts, vocabulary, pre_tokens, ["n_tokens"])
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
