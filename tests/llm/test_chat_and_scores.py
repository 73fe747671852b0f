"""Chat windows and context-tree scores."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_documents import frame, lowered, make, plain_words
from hostwarden.llm import chat_windows, context_tree, frequent_words

KIND = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, window STRING, a STRING, block INT"


def conversations():
    rng = random.Random(2)
    signs = ["<s>", "</s>", "[INST]", "[/INST]", "<<", ">>", "<", ">", "\\", "[\\INST]", "\\\\", "é中", "\n", " word", "s>", "INST]", "\U0001f600"]
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "tool <<x>>", "a>", "user\nx"])
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) + " w" * rng.choice([0, 3, 60, 400])
            rows.append((conv, turn, role, text))
    rows += [(20, n, "assistant" if n % 2 else "user", f"turn {n} " * 3) for n in range(700)]
    rows += [(21, None, "user", "late"), (21, 5, None, None), (21, 5, "assistant", ""), (21, 5, "assistant", ""), (None, 1, "user", "no id"), (None, 0, "assistant", "x")]
    rows += [(22, 0, "system", "rule " * 900), (22, 1, "user", "hi"), (22, 2, "assistant", "ho")]
    rng.shuffle(rows)
    return rows


def ordered(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((2**63 - 1 if turn is None else turn, role or "", text or ""))
    return {k: sorted(v) for k, v in groups.items()}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "w", None, 3) for r in conversations()], KIND)


@pytest.mark.parametrize(("budget", "history"), [(2048, 512), (100, 30), (16, 0)])
def test_conversations_are_read_back(table, budget, history):
    found = {r["conv_id"]: r for r in chat_windows.digest(chat_windows.windows(table, budget, history)).collect()}
    expected = ordered(conversations())
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        row = found[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_windows_keep_to_the_budget(table):
    budget, history = 200, 50
    windows = chat_windows.windows(table, budget, history).collect()
    turns = ordered(conversations())
    tokens = {r["text"]: r["n"] for r in table.select(F.coalesce("text", F.lit("")).alias("text"), (chat_windows.token_count(F.coalesce("text", F.lit(""))) + 4).alias("n")).collect()}
    by_conv = defaultdict(list)
    for w in windows:
        by_conv[w["conv_id"]].append(w)
    for conv, own in by_conv.items():
        own.sort(key=lambda w: w["window"])
        system = tokens[turns[conv][0][2]] if turns[conv][0][1] == "system" else 0
        targets = iter(turns[conv])
        sizes = []
        for w in own:
            spans = [tokens[next(targets)[2]] for _ in range(w["n_targets"])]
            sizes.append(sum(spans))
            kept = system if sizes[:-1] and system else 0
            assert w["tokens"] - sum(spans) - kept <= history
            assert w["tokens"] <= budget or w["n_targets"] == 1 or system > budget // 4
        if conv == 20:
            assert all(w["n_repeated"] > 0 for w in own[1:]) and own[0]["n_repeated"] == 0
            assert own[1]["formatted"].count("<s>") == own[1]["n_repeated"] + own[1]["n_targets"]


def test_plan_is_native(table):
    plan = chat_windows.digest(chat_windows.windows(table))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert chat_windows.digest(chat_windows.windows(table.limit(0))).count() == 0


def test_escape_is_reversible(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("<>s/[]INST\\ ") for _ in range(30)) for _ in range(300)] + ["", "<<<>>>", "[INST]", "</s>", "<s>", "\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", chat_windows.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", chat_windows.unescape(F.col("e")).alias("b")).collect():
        assert r["b"] == r["t"]
        assert not any(sign in r["e"] for sign in ("<s>", "</s>", "[INST]", "[/INST]", "<<", ">>"))


def brute_tree(counts, ends, depth):
    """Code lengths by the recursive definition over all contexts, without any numpy."""
    nodes = defaultdict(lambda: [0, 0])

    def symbols(word):
        data = b" " + word + b" "
        return [(data[max(0, i - depth) : i], data[i]) for i in range(1, len(data))]

    for word, n in counts.items():
        for context, byte in symbols(word):
            for d in range(len(context) + 1):
                for bit in range(8):
                    nodes[context[len(context) - d :], (1 << bit) | byte >> (8 - bit)][byte >> (7 - bit) & 1] += n
    for d in range(2):
        for bit in range(8):
            nodes[b" "[:d], (1 << bit) | 10 >> (8 - bit)][10 >> (7 - bit) & 1] += ends
    estimate = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = defaultdict(set)
    for context, prefix in nodes:
        if context:
            children[context[1:], prefix].add(context)

    def leaf(context):
        return len(context) == depth or context[:1] == b" "

    memory = {}

    def weighted(context, prefix):
        if (context, prefix) not in memory:
            own = estimate(*nodes[context, prefix])
            below = sum(weighted(c, prefix) for c in children[context, prefix])
            memory[context, prefix] = (own, own if leaf(context) else np.logaddexp(own, below) - math.log(2), below)
        return memory[context, prefix][1]

    def one(context, prefix, d=0):
        now = context[len(context) - d :]
        if (now, prefix) not in nodes:
            return 0.5
        zeros, ones = nodes[now, prefix]
        single = (ones + 0.5) / (zeros + ones + 1)
        if leaf(now):
            return single
        weighted(now, prefix)
        own, _, below = memory[now, prefix]
        stop = 1 / (1 + math.exp(min(700, below - own)))
        return stop * single + (1 - stop) * one(context, prefix, d + 1)

    def log10(context, byte):
        total = 0.0
        for bit in range(8):
            p = one(context, (1 << bit) | byte >> (8 - bit))
            total += math.log10(p if byte >> (7 - bit) & 1 else 1 - p)
        return total

    return lambda word: sum(log10(c, b) for c, b in symbols(word)), log10(b" ", 10)


def test_tree_against_the_definition(spark):
    rng = random.Random(4)
    counts = Counter("".join(rng.choice(["ka", "lo", "m", "ü"]) for _ in range(rng.randint(1, 4))).encode() for _ in range(150))
    ends, depth = 9, 3
    table = spark.createDataFrame([(bytearray(w), n, n) for w, n in counts.items()], "word BINARY, freq BIGINT, counted BIGINT")
    tree = context_tree.train(table, ends, depth, contexts=1 << 40)
    score, end = brute_tree(counts, ends, depth)
    words = [*counts, b"kaka", b"xyz", "üüüü".encode(), b"q", b"lom" * 30]
    assert tree.score(words) == pytest.approx([score(w) for w in words], rel=1e-9)
    assert tree.end_score() == pytest.approx(end, rel=1e-9)


def test_rare_contexts_are_exact(spark):
    """Contexts below the share are in subtrees; words score as in the tree of all contexts."""
    rng = random.Random(8)
    counts = Counter("".join(rng.choice(["ka", "lo", "m", "ü", "\x00", "o"]) for _ in range(rng.randint(1, 5))).encode() for _ in range(300))
    unseen = [b"kaka", b"xyz", "üüüü".encode(), b"q", b"lom" * 30, b"kalox", b"zlo"]
    rows = [(bytearray(w), n, n, i * 1000) for i, (w, n) in enumerate(counts.items())]
    rows += [(bytearray(w), 1, 0, 10**9 + i) for i, w in enumerate(unseen) if w not in counts]
    table = spark.createDataFrame(rows, "word BINARY, freq BIGINT, counted BIGINT, place BIGINT")
    for depth in (3, 6):
        score, end = brute_tree(counts, 9, depth)
        for contexts in (1 << 40, 300, 20, 2):
            tree, subtrees = context_tree.fit(table, 9, depth, contexts)
            found = {bytes(r["word"]): r["score"] for r in context_tree.score_words(table, tree, subtrees).collect()}
            assert found == pytest.approx({bytes(r[0]): score(bytes(r[0])) for r in rows}, rel=1e-9)
            assert tree.end_score() == pytest.approx(end, rel=1e-9)


def test_score_does_not_depend_on_the_share(spark):
    documents = frame(spark).withColumn("t", F.col("doc_id") % 3 > 0)
    rows = [
        sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in context_tree.score_texts(documents, "t", contexts=c).collect())
        for c in (1 << 40, 40)
    ]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("contexts", [1 << 40, 30, 3])
def test_probabilities_sum_to_one(spark, contexts):
    counts = Counter(w.encode() for w in ("kalo", "kalo", "kam", "lo", "molo", "a", "ab"))
    table = spark.createDataFrame([(bytearray(w), n, n) for w, n in counts.items()], "word BINARY, freq BIGINT, counted BIGINT")
    tree = context_tree.train(table, 3, 4, contexts)
    for before in (b"", b"ka", b"mol", b"zz"):
        context = np.array([int.from_bytes((b" " + before)[-4:], "big")] * 256, dtype=np.uint64)
        known = np.full(256, min(4, len(before) + 1))
        total = 10 ** tree.log10(context, known, np.arange(256).astype(np.uint64))
        assert total.sum() == pytest.approx(1)


def test_scores_of_documents(spark):
    rows = make()
    found = context_tree.score_with_folds(frame(spark)).collect()
    tokens = lambda t: [*plain_words(lowered(t)), "\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    key = lambda i, n, known, base: (i, n, known, round(base, 6))
    expected = Counter()
    for r in rows:
        words = tokens(r[1])
        expected[key(r[0], len(words), sum(counts[w] > 0 for w in words), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))] += 1
    assert Counter(key(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in found) == expected
    assert all(r["train_tokens"] == total and r["held_out"] == held(r["doc_id"]) and r["score"] < 0 for r in found)


def test_seen_texts_are_cheaper(spark):
    rng = random.Random(1)
    text = lambda signs: " ".join("".join(rng.choice(signs) for _ in range(5)) for _ in range(80))
    rows = [(i, text("abcd"), True) for i in range(30)] + [(50, text("abcd"), False), (51, text("wxyz"), False)]
    found = {r["doc_id"]: r for r in context_tree.score_texts(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, t BOOLEAN"), "t").collect()}
    assert found[50]["bits_per_byte"] < 2.2 < found[51]["bits_per_byte"]


def test_without_training_rows(spark):
    rows = spark.createDataFrame([(1, "ab", False), (2, None, None)], "doc_id BIGINT, text STRING, t BOOLEAN")
    found = {r["doc_id"]: r for r in context_tree.score_texts(rows, "t").collect()}
    assert found[1]["score"] == pytest.approx(-32 * math.log10(2)) and found[2]["n_tokens"] == 1
    assert found[1]["n_known"] == 0 and found[1]["train_tokens"] == 0 and found[1]["base_score"] == 0
    assert context_tree.score_texts(rows.limit(0), "t").count() == 0


def brute_stream(rows, depth):
    """Log10 probability of each text by the recursive definition over its whole byte stream; None stands before a text."""
    nodes = defaultdict(lambda: [0, 0])

    def symbols(text):
        words = (text or "").encode().lower().split()
        data = (None, 32, *b"".join(w + b" " for w in words), 10)
        return [(data[max(0, i - depth) : i], data[i]) for i in range(2, len(data))]

    def decisions(byte):
        return [((1 << bit) | byte >> (8 - bit), byte >> (7 - bit) & 1) for bit in range(8)]

    for text, trains in rows:
        for context, byte in symbols(text) if trains else ():
            for d in range(len(context) + 1):
                for prefix, bit in decisions(byte):
                    nodes[context[len(context) - d :], prefix][bit] += 1
    children = defaultdict(set)
    for context, prefix in nodes:
        if context:
            children[context[1:], prefix].add(context)
    memory = {}

    def leaf(context):
        return len(context) == depth or (context and context[0] is None)

    def weights(context, prefix):
        if (context, prefix) not in memory:
            zeros, ones = nodes[context, prefix]
            own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
            below = sum(weights(c, prefix)[1] for c in children[context, prefix])
            memory[context, prefix] = (own, own if leaf(context) else np.logaddexp(own, below) - math.log(2), below)
        return memory[context, prefix]

    def one(context, prefix, d=0):
        now = context[len(context) - d :]
        if (now, prefix) not in nodes:
            return 0.5
        zeros, ones = nodes[now, prefix]
        single = (ones + 0.5) / (zeros + ones + 1)
        if leaf(now):
            return single
        own, _, below = weights(now, prefix)
        stop = 1 / (1 + math.exp(min(700, below - own)))
        return stop * single + (1 - stop) * one(context, prefix, d + 1)

    def score(text):
        ones = [(one(context, prefix), bit) for context, byte in symbols(text) for prefix, bit in decisions(byte)]
        return sum(math.log10(p if bit else 1 - p) for p, bit in ones)

    return [score(text) for text, _ in rows]


@pytest.mark.parametrize(("depth", "contexts"), [(6, 1 << 17), (6, 40), (3, 5), (1, 2)])
def test_documents_against_the_definition(spark, monkeypatch, depth, contexts):
    """Contexts reach over the spaces, whatever is grown and however the work is cut."""
    monkeypatch.setattr(context_tree, "_HELD", 300)
    monkeypatch.setattr(context_tree, "BUCKET", 400)
    monkeypatch.setattr(context_tree, "GROUP", 100)
    monkeypatch.setattr(context_tree, "_GRAMS", 20)
    monkeypatch.setattr(frequent_words, "FREQUENT_CODES", 60)
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["ka", "lo", "Kalo", "m", "ü", "\x00", "o,"]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts += [None, "", " \n\t", "kalo", "  kalo \n", texts[0], "lo ka", "ka lo", "unseen words", "ka ka ka ka ka ka"]
    rows = [(number, text, number % 4 > 0) for number, text in enumerate(texts)]
    found = context_tree.score_texts(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, t BOOLEAN"), "t", depth, contexts).collect()
    expected = dict(enumerate(brute_stream([r[1:] for r in rows], depth)))
    assert {r["doc_id"]: r["score"] for r in found} == pytest.approx(expected, rel=1e-9)


def test_word_order_counts(spark):
    """Texts of the same words: the order that training has is the likelier one."""
    rows = [(i, "ka lo " * 5, True) for i in range(20)] + [(50, "ka lo ka lo", False), (51, "ka ka lo lo", False)]
    found = {r["doc_id"]: r for r in context_tree.score_texts(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, t BOOLEAN"), "t").collect()}
    assert found[50]["base_score"] == pytest.approx(found[51]["base_score"])
    assert found[50]["score"] > found[51]["score"] + 1


def test_grams_of_a_stream_that_is_cut(monkeypatch):
    streams = [b"kalo m \n", b"\n", b"l \n", bytes(range(33, 90)) + b" \n"]
    past = b"\n\n\n\n\n "
    expected = [(k, int.from_bytes((past + s)[i : i + 7], "big")) for k, s in enumerate(streams) for i in range(len(s))]
    for size in (1 << 22, 8, 5, 1):
        monkeypatch.setattr(context_tree, "_CUT", size)
        found = list(context_tree._grams(streams, 6))
        assert [(k, c) for numbers, codes in found for k, c in zip(numbers.tolist(), codes.tolist(), strict=True)] == expected
