"""Near-duplicates, repeated passages and benchmark windows against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from edge_documents import frame, lowered, make, plain_words
from hostwarden.llm import decontamination, simhash, substring_dedup
from hostwarden.llm.components import components


def brute_fingerprint(text, size=4):
    words = plain_words(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def brute_components(prints, radius):
    """Least id reachable, by id-carrying rows of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [least.get(root(i)) for i in range(len(prints))]


def test_near_duplicates(spark):
    rows = make()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    expected = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints, 4), strict=True))
    found = simhash.near_duplicates(frame(spark)).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, found)) == expected


def random_prints(seed, clusters=6, members=40):
    """Distinct fingerprints in chains: each next one differs in 1 to 5 bits."""
    rng = random.Random(seed)
    out = set()
    for _ in range(clusters):
        now = rng.getrandbits(64)
        for _ in range(members):
            out.add(now)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                now ^= 1 << bit
    return sorted(out)


@pytest.mark.parametrize(("most", "step"), [(6_000_000, 4), (3_000, 4), (50, 24)])
def test_links_with_hot_prefixes(spark, monkeypatch, most, step):
    monkeypatch.setattr(simhash, "MAX_VARIANTS", most)
    monkeypatch.setattr(simhash, "STEP_BITS", step)
    fps = random_prints(most)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in fps]
    prints = spark.createDataFrame(signed * 2, "fp BIGINT")
    pairs = simhash.links(prints).collect()
    # Links are true, and their components are those of all pairs.
    assert all(bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= 4 for r in pairs)
    wanted = brute_components([(i, p) for i, p in enumerate(fps)], 4)
    place = {s[0]: i for i, s in enumerate(signed)}
    groups = {i: {i} for i in range(len(fps))}
    for r in pairs:
        a, b = groups[place[r["u"]]], groups[place[r["v"]]]
        a |= b
        for member in a:
            groups[member] = a
    assert [min(groups[i]) for i in range(len(fps))] == wanted


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "u BIGINT, v BIGINT")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows, documents = make(), frame(spark)
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    groups = defaultdict(list)
    for (doc, _), component in zip(prints, brute_components(prints, 4), strict=True):
        groups[component].append(doc)
    kept = simhash.one_per_group(documents)
    assert kept.columns == documents.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(list(groups))


def brute_removed(rows, window):
    first = {}
    order = lambda i: 2**63 - 1 if i is None else i
    for r in rows:
        words = plain_words(r[1])
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, order(r[0])), order(r[0]))
    out = []
    for r in rows:
        words, covered = plain_words(r[1]), set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < order(r[0]):
                covered |= set(range(k, k + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in covered)
        out.append((r[0], len(words), len(covered), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [50, 10, 100, 104])
def test_repeated_passages(spark, window):
    rows = make() + [(300 + k, " ".join(f"w{(i * 7) % 501}" for i in range(260 + k)), None, None, None, 0, *[None] * 7) for k in range(3)]
    found = substring_dedup.deduplicate(frame(spark, rows), window).drop("text_key").collect()
    expected = brute_removed(rows, window)
    assert Counter(map(tuple, found)) == Counter(e[:4] for e in expected)
    assert sum(e[2] for e in expected) > 100


def test_text_without_repeats(spark):
    rows, documents = make(), frame(spark)
    cleaned = substring_dedup.without_repeats(documents)
    assert cleaned.columns == documents.columns
    expected = Counter()
    for row, (doc, words, removed, _, kept) in zip(rows, brute_removed(rows, 50), strict=True):
        if not removed or removed < words:
            expected[doc, kept if removed else row[1]] += 1
    assert Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == expected
    assert cleaned.filter("n_chars <> length(text)").count() == 0


def test_no_candidates_and_no_rows(spark):
    lonely = frame(spark, [(n, " ".join(f"a{n}b{i}" for i in range(80)), *[None] * 11) for n in range(4)])
    assert substring_dedup.deduplicate(lonely).filter("n_removed > 0").count() == 0
    none = frame(spark, [])
    assert substring_dedup.deduplicate(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError, match="even"):
        substring_dedup.deduplicate(none, 25)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        for k in range(max(1, len(words) - 12) if words else 0):
            windows[tuple(words[k : k + 13])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        words, covered, hit = bench_words(r[1]), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (key := tuple(words[k : k + size])) in windows:
                    covered |= set(range(k, k + size))
                    hit |= windows[key]
        out.append((r[0], len(words), len(covered), len(hit), ",".join(sorted(hit)), len(covered) > 0 and 20 * len(covered) >= len(words)))
    return out


@pytest.mark.parametrize("block", [100_000, 40])
def test_contamination(spark, block):
    rows = make()
    long = plain_words(rows[0][1])
    items = [(n, " ".join(plain_words(rows[k][1])[5 : 5 + size])) for n, (k, size) in enumerate([(0, 60), (3, 13), (4, 20), (5, 12), (6, 4), (7, 1), (8, 3)])]
    items += [(50, " ".join(long[10:90])), (51, None), (52, "  ,. "), (None, items[0][1]), (1, items[1][1]), (53, "ZZ-top unseen words only here"), (54, "same same same same same")]
    benchmark = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id BIGINT, text STRING, win STRING, ids STRING")
    found = decontamination.contamination(frame(spark), benchmark, block_windows=block)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in found.collect()]
    expected = brute_contamination(rows, items)
    assert Counter(got) == Counter(expected)
    assert sum(e[5] for e in expected) > 3
    clean = decontamination.without_contaminated(frame(spark), benchmark)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(e[0] for e in expected if not e[5])
    assert clean.columns == frame(spark).columns


def test_contamination_without_rows(spark):
    nothing = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontamination.contamination(frame(spark), nothing).filter("n_hit > 0 OR contaminated").count() == 0
    assert decontamination.contamination(frame(spark, []), nothing).count() == 0


@pytest.mark.parametrize("window", [13, 60, 69, 70, 130])
def test_contamination_by_long_windows(spark, window):
    passage = [f"word{i}" for i in range(200)]
    rows = [
        (1, " ".join(["before", *passage, "after"]), *[None] * 11),
        (2, " ".join(["before", *passage[: window - 1], "after"]), *[None] * 11),
        (3, " ".join([*passage[20 : 20 + window], "x", *passage[20 : 20 + window]]), *[None] * 11),
    ]
    item = spark.createDataFrame([("a", " ".join(passage))], "item_id string, text string")
    found = decontamination.contamination(frame(spark, rows), item, window=window)
    assert {r["doc_id"]: r["n_hit"] for r in found.collect()} == {1: 200, 2: 0, 3: 2 * window}
