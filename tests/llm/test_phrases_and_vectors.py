"""Collocations, radix-sorted suffixes and whitening against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from compare import database, differences
from edge_documents import frame, lowered, make
from hostwarden.llm import collocations, suffix_radix, whitening
from hostwarden.llm.registry import LLM_ORACLES, LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_suffix_radix"])
def test_query_equals_sql(spark, name):
    problem = differences(name, LLM_QUERIES[name](spark, FOLDER), LLM_ORACLES[name], database(FOLDER))
    assert problem is None, problem


# Collocations.


def brute_collocations(rows, top, longest, minimum):
    counts, totals = {}, Counter()
    for row in rows:
        lang = "und" if row[2] is None else row[2]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(row[1])):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    key = (lang, tuple(words[i : i + size]))
                    counts[key] = counts.get(key, 0) + 1
    out = []
    for lang, n in totals.items():
        candidates = {p: a for (own, p), a in counts.items() if own == lang and len(p) > 1 and a >= minimum}
        absorbed = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                absorbed |= {p[i : i + size] for i in range(len(p) - size + 1) if a >= candidates[p[i : i + size]]}
        scored = []
        for p, a in candidates.items():
            if p not in absorbed:
                cuts = [(1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows(spark_rows):
    return sorted(map(tuple, spark_rows.collect()))


@pytest.mark.parametrize(("shards", "block_phrases", "top"), [(1, 10**6, 2000), (3, 10**6, 7), (4, 30, 2000)])
def test_collocations(spark, shards, block_phrases, top):
    rng = random.Random(5)
    rows = make()
    for number in range(120):
        text = " ".join(rng.choice(["one", "two", "three", "four. five", "Six,", "\tseven", "eight\n", "\xa0", "nine;"]) for _ in range(rng.randint(0, 60)))
        rows.append((300 + number, text, rng.choice(["aa", "und", None]), *rows[0][3:]))
    expected = brute_collocations(rows, top, 5, 6)
    assert len({row[0] for row in expected}) == 3
    found = collocations.collocations(frame(spark, rows), top, minimum=6, shards=shards, block_phrases=block_phrases)
    assert phrase_rows(found) == expected


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []), minimum=1).count() == 0
    nulls = frame(spark, [(1, None, None, *[None] * 10), (None, "", "aa", *[None] * 10), (None, "., ;\t", "aa", *[None] * 10)])
    assert collocations.collocations(nulls, minimum=1).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    rows = [(1, "a b", "aa", *[None] * 10)]
    assert phrase_rows(collocations.collocations(frame(spark, rows), minimum=1)) == [("aa", 1, "a b", 1, 1, 1, 2, 2000)]
    a, n, product = 9 * 10**13, 9 * 10**13, 10**18
    exact = spark.sql(f"SELECT (CAST({a}L AS decimal(19,0)) * 1000 * CAST({n}L AS decimal(14,0))) div (CAST({product}L AS decimal(19,0)) * CAST(7L AS decimal(18,0)))")
    assert exact.head()[0] == 1000 * a * n // (product * 7)


# Suffixes.


def brute_suffixes(rows, depth):
    texts = [(suffix_radix.NO_ID if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for owner, text in texts:
        for i in range(len(text) - depth + 1):
            key = text[i : i + depth]
            least[key] = min(owner, least.get(key, owner))
    out = []
    for (owner, text), row in zip(texts, rows, strict=True):
        gone = np.zeros(len(text) + 1, dtype=bool)
        for i in range(len(text) - depth + 1):
            if least[text[i : i + depth]] < owner:
                gone[i : i + depth] = True
        kept = bytes(b for b, g in zip(text, gone, strict=False) if not g)
        out.append((row[0], len(text), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffixes_of_edge_documents(spark):
    rows = make()
    assert Counter(map(tuple, suffix_radix.deduplicate(frame(spark)).collect())) == brute_suffixes(rows, 50)


@pytest.mark.parametrize("depth", [2, 7, 8, 13])
def test_suffixes_of_texts_alike(spark, depth):
    rng = random.Random(depth)
    rows = []
    for number in range(150):
        text = "".join(rng.choice("aab é") for _ in range(rng.randint(0, 40 * (depth > 2) + 6)))
        if number % 3 == 0:
            text = text[:10] + "a common line\n" + text[10:]
        rows.append((rng.choice([None, number, number % 20]), text, *[None] * 11))
    found = suffix_radix.deduplicate(frame(spark, rows).repartition(5), depth)
    assert Counter(map(tuple, found.collect())) == brute_suffixes(rows, depth)


def test_kept_bytes_keep_all_columns(spark):
    docs = frame(spark)
    found = suffix_radix.without_repeats(docs)
    assert found.columns == [*docs.columns, "kept_bytes"]
    digests = Counter((r["doc_id"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in found.select("doc_id", "kept_bytes").collect())
    assert digests == Counter((r[0], r[4]) for r in suffix_radix.deduplicate(docs).collect())


def test_suffixes_of_nothing(spark):
    assert suffix_radix.deduplicate(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_radix.repeated_spans(frame(spark, []), 1)


def test_runs_hold_every_window_once(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 3, 12, 13, 90]))) for _ in range(40)]
    data, lengths = suffix_radix._joined(texts)
    wanted = Counter((t, i) for t, text in enumerate(texts) for i in range(len(text) - 11))
    for segment in (1 << 20, 17):
        monkeypatch.setattr(suffix_radix, "SEGMENT", segment)
        grams = {}
        found = Counter()
        for gram, text, start, size in zip(*suffix_radix._runs(data, lengths, 12), strict=True):
            for i in range(start, start + size):
                found[text, i] += 1
                grams.setdefault(texts[text][i : i + 12], set()).add(gram)
        assert found == wanted
        assert all(len(own) == 1 for own in grams.values())


def test_heavy_grams_and_cut_orders(monkeypatch):
    """The kernels with tiny limits: the suffixes that come out are those that a smaller owner has."""
    monkeypatch.setattr(suffix_radix, "ORDERED", 5)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"ab"), 40).astype(np.uint8)) for _ in range(30)]
    data, lengths = suffix_radix._joined(texts)
    gram, text, start, size = suffix_radix._runs(data, lengths, 10)
    order = np.argsort(gram, kind="stable")
    fields = np.zeros(len(gram), dtype=suffix_radix._ENTRY)
    fields["gram"], fields["owner"], fields["start"], fields["size"] = gram[order], text[order], start[order], size[order]
    blocks = suffix_radix._stretches(data, (np.cumsum(lengths) - lengths)[text[order]] + start[order], size[order] + 9)
    entries = suffix_radix._Entries(fields, blocks, 10)
    least = {}
    for owner, own in enumerate(texts):
        for i in range(31):
            least.setdefault(own[i : i + 10], owner)
    late = {(owner, p) for owner, own in enumerate(texts) for i in range(31) if least[own[i : i + 10]] < owner for p in range(i, i + 10)}

    def covered(rows):
        pairs = [(r[2], np.frombuffer(r[4], "<i8").reshape(-1, 2)) for r in rows]
        return {(owner, p) for owner, spans in pairs for begin, end in spans.tolist() for p in range(begin, end)}

    settled = list(suffix_radix._ordered_suffixes(entries, np.zeros(len(fields), bool), 7))
    assert covered(settled) == late
    travelling = list(suffix_radix._ordered_suffixes(entries, np.ones(len(fields), bool), 7))
    assert covered(r for r in travelling if r[1] == suffix_radix._SPANS) <= late
    assert any(r[1] == suffix_radix._SUFFIXES for r in travelling)


def test_radix_groups():
    rng = np.random.default_rng(2)
    for width in (1, 8, 9, 20):
        matrix = rng.integers(0, 2, (300, width)).astype(np.uint8) * np.uint8(255)
        owner = rng.integers(0, 9, 300)
        least = {}
        for row, own in zip(map(bytes, matrix), owner, strict=True):
            least[row] = min(own, least.get(row, own))
        assert suffix_radix.radix_groups(matrix, owner).tolist() == [own > least[row] for row, own in zip(map(bytes, matrix), owner, strict=True)]


# Whitening.

VECTORS = "vec_id BIGINT, embedding ARRAY<DOUBLE>, x STRING, n STRING, component STRING"


def check_whitening(spark, vectors, components=16):
    """Rows of the operator against an eigendecomposition of the exact covariance."""
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", "n", "c") for i, v in vectors]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS), components=components).collect()
    usable = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in usable], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors_of = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_of = values[::-1], vectors_of[:, ::-1]
    kept = int((values > values[0] * 1e-20 + 1e-9).sum())
    kept = min(kept, components)
    white = ((x - sums / n) @ vectors_of[:, :kept]) / np.sqrt(values[:kept])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert len(found) == len(usable) * kept
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in found) == Counter(
        (i, k + 1, n, int(d)) for (i, _), d in zip(usable, deviation, strict=True) for k in range(kept)
    )
    for r in found:
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-6
        assert r["identity_error"] < 1e-6
    order = {i: place for place, (i, _) in enumerate(usable)}
    got = np.zeros_like(white)
    for r in found:
        got[order[r["vec_id"]], r["component"] - 1] = r["whitened"]
    sign = np.sign((got * white).sum(axis=0))
    assert np.allclose(got * sign, white, atol=1e-5)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, v) for i, v in enumerate(rng.normal(0, np.linspace(0.3, 3, 20), (300, 20)))]
    vectors += [(1000, vectors[0][1]), (1001, vectors[0][1]), (1002, None), (1003, [*vectors[1][1][:-1], None]), (1004, [*vectors[1][1][:-1], math.nan]), (1005, [*vectors[1][1][:-1], math.inf])]
    check_whitening(spark, vectors)
    check_whitening(spark, vectors, components=3)


def test_whitening_of_dependent_and_uneven_columns(spark):
    rng = np.random.default_rng(5)
    base = np.floor(rng.normal(0, 1, (200, 4)) * 64) / 64
    scaled = np.column_stack([base[:, 0] * 1e3, base[:, 1], base[:, 2], base[:, 2], np.full(200, 7.0), base[:, 3] * 100])
    check_whitening(spark, list(enumerate(scaled)))


def test_fewer_vectors_than_dimensions(spark):
    rng = np.random.default_rng(6)
    check_whitening(spark, list(enumerate(rng.normal(0, 2, (5, 12)))))


def test_whitening_without_variance(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]):
        rows = spark.createDataFrame([(i, v, "x", "n", "c") for i, v in vectors], VECTORS)
        assert whitening.whiten(rows).count() == 0


def test_whitening_keeps_null_keys_and_drops_other_lengths(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0])]
    found = whitening.whiten(spark.createDataFrame([(i, v, "x", "n", "c") for i, v in rows], VECTORS)).collect()
    assert Counter(r["vec_id"] for r in found) == {None: 2, 1: 4, 2: 2}
    assert {r["n"] for r in found} == {3}


def test_counted_phrases_keep_their_first_step():
    """A phrase counts from the step after both of its parts were known, and is spelled from its prefix."""
    reached = collocations._Reached([b"a", b"b", b"c", b"a b", b"b c"], [0, 1, 0, 2, 3], 5)
    values = pa.array([b"\xff", b"a", b"b", b"c"], pa.binary())
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 0, 3, 1, 2, 3, 0])
    found = {}
    for phrases, length, first, times in collocations._counted(ids, values, reached, 4, 4, 5, False, True):
        found |= {p: (length, f, n) for p, f, n in zip(phrases.to_pylist(), first.tolist(), times.tolist(), strict=True)}
    assert found == {b"a b": (2, 2, 3), b"b c": (2, 2, 2), b"c a": (2, 1, 1), b"a b c": (3, 4, 2)}
