"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a logistic model over the
presence of words and word beginnings, a few shares of the text, and the probabilities of the categories before it.
For training, those earlier probabilities are out of fold: each row's come from models
that have not seen it, so a later model learns from predictions as good as it will get.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hostwarden.llm.decontamination import words
from hostwarden.llm.texts import arrow_pass, byte_lists, small_batches, written

#: Bounds of the fit: about this many labelled documents of each combination of categories, features with weights, characters of a feature's word.
SAMPLE_ROWS = 3_000
MAX_WORDS = 1_000
WORD_CHARACTERS = 32
#: Lengths of the word beginnings that are features beside whole words; they meet compounds and endings.
BEGINNINGS = range(3, 8)
#: A word is a feature from this chi-square statistic (one degree of freedom) and this many rows on.
MIN_CHI_SQUARE = 20.0
MIN_ROWS = 5
FOLDS = 3
PENALTY = 1.0
NEWTON_STEPS = 10
INNER_STEPS = 25
THRESHOLD = 0.5
SHARES = ("symbols", "capitals", "digits", "distinct", "word_length", "size")

_CAPITALS = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_DIGITS = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_SMALL = np.isin(np.arange(256), np.arange(0x61, 0x7B))


def shares(text: bytes, found: list[bytes]) -> list[float]:
    """Shares of a text, all between 0 and about 1."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    signs = max(1, int(counts[~_SPACES].sum()))
    letters = int(counts[:128][(_CAPITALS | _SMALL)[:128]].sum())
    other = signs - letters - int(counts[_DIGITS].sum()) - int(counts[128:].sum())
    number = max(1, len(found))
    return [other / signs, int(counts[_CAPITALS].sum()) / max(1, letters), int(counts[_DIGITS].sum()) / signs, len(set(found)) / number, min(2.0, signs / number / 10), np.log1p(len(found)) / 10]


def signs_of(found: list[bytes]) -> set[str]:
    """Features of a text: its words, and the beginnings of longer words with a star."""
    distinct = b" ".join(set(found)).decode("utf-8", "replace").split()
    out = {w for w in distinct if len(w) <= WORD_CHARACTERS}
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in distinct if len(w) > k])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Rows:
    """Word presence in compressed rows, and dense columns."""

    def __init__(self, present: Sequence[np.ndarray], dense: np.ndarray, n_words: int) -> None:
        self.row = np.repeat(np.arange(len(present)), [len(p) for p in present])
        self.word = np.concatenate([*present, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.dense, self.n_words = dense, n_words

    def scores(self, weights: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.row, weights=weights[: self.n_words][self.word], minlength=len(self.dense))
        return by_word + self.dense @ weights[self.n_words :]

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.word, weights=errors[self.row], minlength=self.n_words)
        return np.concatenate([by_word, self.dense.T @ errors])

    def with_column(self, column: np.ndarray) -> Rows:
        other = Rows([], np.column_stack([self.dense, column]), self.n_words)
        other.row, other.word = self.row, self.word
        return other

    def take(self, chosen: np.ndarray) -> Rows:
        """The rows where ``chosen`` is true."""
        other = Rows([], self.dense[chosen], self.n_words)
        inside = chosen[self.row]
        other.row, other.word = (np.cumsum(chosen) - 1)[self.row[inside]], self.word[inside]
        return other


def fit_logistic(rows: Rows, target: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton steps, each solved with conjugate gradients.

    The first dense column is the constant, which is not penalised.
    """
    free = np.full(rows.n_words + rows.dense.shape[1], penalty)
    free[rows.n_words] = 1e-6

    def loss(w: np.ndarray) -> float:
        score = rows.scores(w)
        return float((weight * (np.logaddexp(0, score) - target * score)).sum() + 0.5 * (free * w**2).sum())

    now = np.zeros(len(free))
    reached = loss(now)
    for _ in range(NEWTON_STEPS):
        p = _sigmoid(rows.scores(now))
        slope = rows.gradient(weight * (p - target)) + free * now
        bend = weight * p * (1 - p)
        step, left = np.zeros(len(free)), -slope
        way, size = left.copy(), float(left @ left)
        stop = 1e-4 * size
        for _ in range(INNER_STEPS):
            if size <= stop or size == 0:
                break
            curved = rows.gradient(bend * rows.scores(way)) + free * way
            far = size / float(way @ curved)
            step += far * way
            left -= far * curved
            size, before = float(left @ left), size
            way = left + size / before * way
        share = 1.0
        while (tried := loss(now + share * step)) > reached and share > 1e-6:
            share /= 2
        if tried > reached:
            break
        now, gained, reached = now + share * step, reached - tried, tried
        if gained < 1e-6 * (1 + abs(reached)):
            break
    return now


@dataclass
class Chain:
    """Fitted chain: words with weights, and per category its model's weights."""

    categories: tuple[str, ...]
    words: list[str]
    models: list[np.ndarray]
    #: Whether there was any row to fit.
    fitted: bool = True

    def probabilities(self, rows: Rows) -> np.ndarray:
        out = []
        for model in self.models:
            out.append(_sigmoid(rows.scores(model)))
            rows = rows.with_column(out[-1])
        return np.column_stack(out) if out else np.zeros((len(rows.dense), 0))


def _features(labelled: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Features and shares of every row's text, with the columns ``carried``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            texts = [t or b"" for t in byte_lists(batch.column(0))]
            found = [words(t) for t in texts]
            signs = [sorted(signs_of(f)) for f in found]
            dense = [shares(t, f) for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(signs, pa.list_(pa.string())), pa.array(dense, pa.list_(pa.float64()))], names=[*carried, "words", "shares"])

    kinds = dict(labelled.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "words ARRAY<STRING>", "shares ARRAY<DOUBLE>"])
    return arrow_pass(labelled.select("text", *carried), run, schema)


def sample_labelled(documents: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int) -> DataFrame:
    """About ``sample`` labelled documents of each combination of categories, with a ``weight`` for the rest.

    The ids are chosen first, from the labels alone: of a larger combination those in a share of
    the hash range. So only the bounded list of ids meets the documents, and no text is
    shuffled but the sample's. An id counts once, with the least of its texts, however often
    it is repeated. Labels with a null id or other values than 0 and 1, and ids without text,
    are left out.
    """
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories])
    valid = F.col("doc_id").isNotNull()
    for category in categories:
        valid &= F.col(category).isin(0, 1)
    known = known.filter(valid).distinct().withColumn("place", F.xxhash64("doc_id"))
    counts = known.groupBy(*categories).agg(F.count("*").alias("of"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("of"))
    taken = known.join(F.broadcast(counts), list(categories)).withColumn("weight", 1 / share)
    taken = taken.filter(F.pmod("place", F.lit(1 << 40)) < share * (1 << 40))
    texts = documents.filter("text IS NOT NULL").select("doc_id", "text")
    kept = [*categories, "place", "weight"]
    # At most 2**len(categories) times about ``sample`` ids are broadcast.
    return texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", *kept).agg(F.min("text").alias("text")).select("text", *kept)


def fit_chain(
    documents: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE_ROWS, max_words: int = MAX_WORDS, folds: int = FOLDS
) -> Chain:
    """Fit the chain on the ``documents`` (doc_id, text) with ``labels`` (doc_id and a 0/1 column per category, in the order of prediction).

    The sample is bounded: about ``sample`` documents for each of the at most 2**len(categories)
    combinations. Words are chosen by chi-square over the sample, in Spark; only the chosen ones
    and the sample's rows over them come to the driver.
    """
    chosen = sample_labelled(documents, labels, categories, sample)
    kept = [*categories, "place", "weight"]
    features = written(_features(chosen, kept), "chain-sample")
    total = features.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in categories]).head()
    counted = features.select(F.explode("words").alias("word"), *categories).groupBy("word")
    counted = counted.agg(F.count("*").alias("rows"), *[F.sum(F.col(c).cast("double")).alias(c) for c in categories])
    statistic = F.greatest(*[_chi_square(F.col("rows"), F.col(c), total["n"], total[c]) for c in categories], F.lit(0.0))
    strong = counted.filter((F.col("rows") >= MIN_ROWS) & (statistic >= MIN_CHI_SQUARE)).orderBy(statistic.desc(), "word").limit(max_words)
    found = [r["word"] for r in strong.select("word").collect()]
    look = F.array(*[F.lit(w) for w in found]) if found else F.array().cast("array<string>")
    rows = features.select(F.array_intersect("words", look).alias("words"), "shares", *kept).toPandas()
    number = {w: i for i, w in enumerate(found)}
    present = [np.array([number[w] for w in ws], dtype=np.int64) for ws in rows["words"]]
    dense = np.array([[1.0, *s] for s in rows["shares"]]).reshape(-1, 1 + len(SHARES))
    base, weight = Rows(present, dense, len(found)), rows["weight"].to_numpy(dtype=np.float64)
    weight = weight / weight.mean() if len(weight) else weight
    fold = (rows["place"].to_numpy(dtype=np.int64) % folds).astype(np.int64)
    models, current = [], base
    for category in categories:
        target = rows[category].to_numpy(dtype=np.float64)
        models.append(fit_logistic(current, target, weight))
        outside = np.zeros(len(target))
        for k in range(folds):
            rest, own = fold != k, fold == k
            model = fit_logistic(current.take(rest), target[rest], weight[rest])
            outside[own] = _sigmoid(current.take(own).scores(model))
        current = current.with_column(outside)
    return Chain(tuple(categories), found, models, len(rows) > 0)


def _chi_square(rows: Column, positive: Column, n: int, all_positive: float) -> Column:
    """Chi-square of a word's presence against a category."""
    a, b = positive, rows - positive
    c, d = F.lit(all_positive) - positive, F.lit(n - all_positive) - b
    below = rows * (F.lit(n) - rows) * F.lit(all_positive) * F.lit(n - all_positive)
    return F.when(below > 0, F.lit(n) * (a * d - b * c) ** 2 / below).otherwise(0.0)


def predict(documents: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, ``<category>_score`` for each category, and ``<last category>``, its score at least ``threshold``.

    A null or empty text has no words and shares of 0, is scored like any other and is
    never in the category. A null doc_id stays null, repeated rows give repeated results,
    whole texts count at any length. Needs doc_id and text and reads no other column.
    A chain fitted without any row gives 0.5 and puts no document into the category.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    names = [f"{c}_score" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        look = {w: i for i, w in enumerate(fitted.words)}
        known = look.keys()
        for batch in small_batches(batches, 1):
            present, dense, empty = [], [], []
            for text in byte_lists(batch.column(1)):
                found = words(text)
                present.append(np.array([look[w] for w in known & signs_of(found)], dtype=np.int64))
                dense.append([1.0, *shares(text or b"", found)])
                empty.append(not found)
            rows = Rows(present, np.array(dense).reshape(-1, 1 + len(SHARES)), len(look))
            out = fitted.probabilities(rows)
            flagged = (out[:, -1] >= threshold) & fitted.fitted & ~np.array(empty, dtype=bool)
            columns = [batch.column(0), *(pa.array(out[:, i]) for i in range(len(names))), pa.array(flagged)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, fitted.categories[-1]])

    schema = ", ".join(["doc_id BIGINT", *(f"`{n}` DOUBLE" for n in names), f"`{chain.categories[-1]}` BOOLEAN"])
    return arrow_pass(documents.select("doc_id", "text"), run, schema)
