"""Token counts and packing against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from edge_documents import frame, make, plain_words
from hostwarden.llm import frequent_words, packing, token_counts
from hostwarden.llm.tokenizer import IdCache, default_path, load, pre_tokens


@pytest.fixture(scope="module")
def encode():
    tokenizer = load(default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pre_tokens_are_independent(encode):
    cache = IdCache(default_path())
    odd = ["", "a,.b", "word., word", "é, É. ×, ÷.", "don't 'S 'x", "a b İx é,", "<|endoftext|>a <|ENDOFTEXT|>", "1,2 3. 4.\n5"]
    for text in [*odd, *(r[1] for r in make() if r[1])]:
        assert np.frombuffer(cache.text_ids(text.encode()), "<u4").tolist() == encode(text)


def test_token_counts(spark, encode):
    rows = make()
    found = Counter(map(tuple, token_counts.count_tokens(frame(spark), limit=100).collect()))
    expected = Counter((r[0], len((r[1] or "").encode()), n := len(encode(r[1])), n > 100) for r in rows)
    assert found == expected


def test_rare_words_go_through_the_join(spark, encode, monkeypatch):
    monkeypatch.setattr(frequent_words, "FREQUENT", 20)
    monkeypatch.setattr(frequent_words, "LOCAL_WORDS", 10)
    rows = [r for r in make() if r[0] is not None and r[0] < 40]
    found = {(r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(frame(spark, rows)).collect()}
    assert found == {(r[0], len(encode(r[1]))) for r in rows}


def test_word_counts(spark):
    table = frequent_words.word_counts(frame(spark), pre_tokens)
    expected = Counter(w.encode() for r in make() for w in plain_words(r[1]))
    assert {bytes(r["word"]): r["freq"] for r in table.collect()} == expected


def test_piece_lengths():
    assert packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(2048) == [2048]
    for n in range(1, 300):
        pieces = packing.piece_lengths(n, 64)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 64 for p in pieces)
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(None, limit=100)


def test_packing_round_trip(spark, encode):
    pieces = packing.digest(packing.pack(frame(spark), limit=64)).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and all(p["offset"] == 0 for p in pieces)
    expected = Counter()
    for row in make():
        ids, start = [*encode(row[1]), 1], 0
        for length in packing.piece_lengths(len(ids), 64):
            part = np.array(ids[start : start + length], dtype="<u4").tobytes()
            expected[(row[0], start, length, zlib.crc32(part), len(ids))] += 1
            start += length
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == expected


def test_buckets_hold_equal_lengths(spark, tmp_path):
    packing.write_buckets(packing.pack(frame(spark)), str(tmp_path / "packed"))
    lengths = defaultdict(set)
    for row in spark.read.parquet(str(tmp_path / "packed")).select("bucket", "length").distinct().collect():
        lengths[row["bucket"]].add(row["length"])
    assert all(found == {1 << bucket} for bucket, found in lengths.items())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert token_counts.count_tokens(none).count() == 0
    assert packing.pack(none).count() == 0


def test_other_vocabularies_are_refused(spark, tmp_path):
    """Their ids are not those of the pre-tokens: "Hello big world" would come out in lower case, without its spaces."""
    (tmp_path / "no.json").write_text("{}")
    for path in (default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"), str(tmp_path / "no.json")):
        with pytest.raises(ValueError):
            token_counts.count_tokens(frame(spark), path)
        with pytest.raises(ValueError):
            packing.pack(frame(spark), path)
