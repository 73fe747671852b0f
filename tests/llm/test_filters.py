"""Quality rules, language identification and toxicity."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from edge_documents import frame, lowered, make, plain_words
from pyspark.sql import functions as F

from hostwarden.llm import language_id, quality_rules, toxicity


def base(text):
    words = plain_words(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if plain_words(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed


def brute_rules(rows, min_documents, max_share):
    lines = lambda t: [" ".join(plain_words(lowered(x))) for x in (t or "").split("\n") if plain_words(x)]
    texts, having = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r[3]].add(r[1])
        for line in lines(r[1]):
            having[r[3], line].add(r[1])
    bad = {k for k, v in having.items() if len(v) > min_documents and len(v) > max_share * len(texts[k[0]])}
    out = []
    for r in rows:
        statistics = base(r[1])
        removed = sum(len(line.split(" ")) for line in lines(r[1]) if (r[3], line) in bad)
        out.append((r[0], *statistics[:5], removed, statistics[5], not statistics[5] and removed <= 0.5 * statistics[0]))
    return out, bad


def test_quality_rules(spark):
    rows = make()
    expected, bad = brute_rules(rows, 3, 0.1)
    verdicts, frequent = quality_rules.assess(frame(spark), min_documents=3, max_share=0.1)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept"]
    assert Counter(map(tuple, verdicts.select(*columns).collect())) == Counter(expected)
    assert bad and frequent.count() == len(bad)


def test_clean_removes_lines_and_keeps_columns(spark):
    rows = make()
    documents = frame(spark)
    cleaned = quality_rules.clean(documents, min_documents=3, max_share=0.1)
    assert cleaned.columns == documents.columns
    expected, bad = brute_rules(rows, 3, 0.1)
    keep = []
    for row, verdict in zip(rows, expected, strict=True):
        if verdict[-1]:
            lines = [x for x in row[1].split("\n") if (row[3], " ".join(plain_words(lowered(x)))) not in bad]
            keep.append((row[0], "\n".join(lines), len("\n".join(lines)), row[3]))
    found = [(r["doc_id"], r["text"], r["n_chars"], r["source"]) for r in cleaned.collect()]
    assert Counter(found) == Counter(keep)


def test_repeated_words_of_long_and_short_texts():
    assert quality_rules.repeated_words([b"a"] * 4) == 4
    assert quality_rules.repeated_words([b"a"] * 3) == 0
    assert quality_rules.repeated_words([]) == 0


SYLLABLES = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "tz", "pf", "ung"], "cc": ["eau", "oi", "qu", "elle"]}


def labelled_texts(count=90, words=40, seed=3):
    rng = random.Random(seed)
    out = []
    for n in range(count):
        lang = sorted(SYLLABLES)[n % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, words)))
        out.append((n, text, lang))
    return out


def test_language_of_held_out_documents(spark):
    rows = labelled_texts()
    extra = [(500, None, "aa"), (501, "", "aa"), (502, "123 !? 45", "bb"), (None, rows[0][1], "aa"), (503, rows[0][1], None), rows[0]]
    documents = spark.createDataFrame(rows + extra, "doc_id BIGINT, text STRING, lang STRING")
    found = language_id.identify_with_folds(documents).collect()
    assert len(found) == len(rows) + len(extra)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in found if r["doc_id"] is not None)
    # A text of two syllables compresses alike with every dictionary; such ties are rejected, not guessed.
    sure = [r for r in held if r["doc_id"] in truth and r["accepted"]]
    assert len(sure) >= 0.9 * sum(r["doc_id"] in truth for r in held)
    assert all(truth[r["doc_id"]] == r["lang_pred"] for r in sure)
    by_id = {r["doc_id"]: r for r in found}
    for odd in (500, 501, 502):
        assert by_id[odd]["lang_pred"] == "und" and by_id[odd]["score"] == 0 and not by_id[odd]["accepted"]
    assert not by_id[None]["held_out"] and all(0 <= r["score"] <= 1 for r in found)


def test_narrow_margins_are_rejected(spark):
    model = language_id.fit_dictionaries(spark.createDataFrame(labelled_texts(), "doc_id BIGINT, text STRING, lang STRING"))
    both = " ".join(model[k].decode()[:1500] for k in ("aa", "bb"))
    documents = spark.createDataFrame([(1, both), (2, model["aa"].decode()[:900])], "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: r for r in language_id.identify(documents, model, min_margin=0.5).collect()}
    assert not found[1]["accepted"] and found[2]["accepted"]


def test_dictionaries_are_bounded_and_may_be_missing(spark):
    documents = spark.createDataFrame(labelled_texts(), "doc_id BIGINT, text STRING, lang STRING")
    assert all(len(d) <= 500 for d in language_id.fit_dictionaries(documents, sample=3, size=500).values())
    assert language_id.fit_dictionaries(documents.limit(0)) == {}
    assert language_id.identify(documents, {}).filter("lang_pred <> 'und'").count() == 0


BAD = ["zorp", "blick"]


def toxic_rows(count=600, seed=11):
    rng = random.Random(seed)
    rows = []
    for n in range(count):
        words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(30)]
        junk, toxic = n % 5 == 0, n % 3 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(BAD) + rng.choice(["", "keit"])
        rows.append((n, " ".join(w + "###" if junk else w for w in words), int(junk), int(toxic)))
    return rows


def test_toxic_documents_of_unseen_rows(spark):
    rows = toxic_rows()
    kind = "doc_id BIGINT, text STRING, junk INT, toxic INT"
    train = spark.createDataFrame([r for r in rows if r[0] % 4], kind)
    chain = toxicity.fit_chain(train, train, ["junk", "toxic"])
    odd = [(900, None), (901, ""), (None, "zorp " * 9), (902, "zorp " + "abc " * 50_000)]
    documents = spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] % 4 == 0] + odd, "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: r for r in toxicity.predict(documents, chain).collect()}
    assert found[900]["toxic"] is False and found[901]["toxic"] is False and found[None]["toxic"] and found[902]["toxic"]
    held = [r for r in rows if r[0] % 4 == 0]
    assert np.mean([found[r[0]]["toxic"] == bool(r[3]) for r in held]) > 0.97
    assert np.mean([(found[r[0]]["junk_score"] > 0.5) == bool(r[2]) for r in held]) > 0.97
    # The second model has one weight more: that of the first category's probability.
    assert len(chain.models[1]) == len(chain.models[0]) + 1


def test_chain_without_rows(spark):
    none = spark.createDataFrame([(1, "a", None, 1)], "doc_id BIGINT, text STRING, junk INT, toxic INT")
    chain = toxicity.fit_chain(none, none, ["junk", "toxic"])
    assert toxicity.predict(none, chain).head()["toxic"] is False
    assert toxicity.predict(none.limit(0), chain).count() == 0


def test_sample_is_bounded_and_counts_an_id_once(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic").unionByName(
        spark.createDataFrame([(None, 1), (7, None), (8, 5), (2, 0), (2, 0)], "doc_id BIGINT, toxic INT")
    )
    documents = spark.range(4000).selectExpr("id AS doc_id", "CONCAT('t', id) AS text", "1 AS toxic", "2 AS weight")
    documents = documents.union(documents.filter("doc_id < 1000")).union(documents.filter("doc_id = 3").withColumn("text", F.lit(None)))
    few = toxicity.sample_labelled(documents, labels, ["toxic"], 200).collect()
    assert 300 < len(few) < 500 and len({r["text"] for r in few}) == len(few)
    assert all(r["weight"] == 10 for r in few)
    whole = toxicity.sample_labelled(documents, labels, ["toxic"], 5000).collect()
    assert len(whole) == 4000 and all(r["weight"] == 1 for r in whole)


def test_logistic_fit_matches_its_optimum():
    rng = np.random.default_rng(5)
    present = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(400)]
    dense = np.column_stack([np.ones(400), rng.normal(size=400)])
    target = (rng.random(400) < 0.5).astype(float)
    rows = toxicity.Rows(present, dense, 6)
    weights = toxicity.fit_logistic(rows, target, np.ones(400))
    slope = rows.gradient(1 / (1 + np.exp(-rows.scores(weights))) - target)
    slope[:6] += weights[:6]
    slope[7] += weights[7]
    assert np.abs(slope).max() < 1e-2
    assert rows.take(np.arange(400) < 9).scores(weights).tolist() == pytest.approx(rows.scores(weights)[:9].tolist())


def test_a_score_of_one_half_counts_like_any_other(spark):
    plain = toxicity.Chain(("junk",), [], [np.zeros(1 + len(toxicity.SHARES))])
    rows = frame(spark, [(1, "some words", *[None] * 11), (2, "", *[None] * 11)])
    for chain, threshold, expected in ((plain, 0.3, {1: True, 2: False}), (plain, 0.6, {1: False, 2: False})):
        found = toxicity.predict(rows, chain, threshold).collect()
        assert {r["doc_id"]: r["junk"] for r in found} == expected and {r["junk_score"] for r in found} == {0.5}
    unfitted = toxicity.Chain(("junk",), [], plain.models, fitted=False)
    assert not any(r["junk"] for r in toxicity.predict(rows, unfitted, 0.3).collect())
