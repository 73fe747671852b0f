"""Substring deduplication by level-wise doubling.

Windows of ``first`` words that occur in two texts are extended to twice their length,
those that repeat again are extended once more, until windows have the asked length or
no candidate survives. Only survivors of one length are looked at in the next.

The first level takes, of every long window, the one short window inside with the
least hash. Equal long windows choose equal short ones, so nothing is lost and about
one place in thirteen is shuffled. Texts that are equal as a whole are one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from hostwarden.llm.texts import arrow_pass, byte_lists, remove_written, small_batches, written

WINDOW = 50
#: A semi-join side is broadcast up to so many keys (32 MB) and shuffled beyond.
BROADCAST_KEYS = 2_000_000
#: Order of rows without an id: after all others.
NO_ID = 2**63 - 1
EMPTY = sha256(b"").hexdigest()

#: Odd multipliers of two rolling hashes, and the seeds of the words' hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Word hashes that a worker remembers.
_REMEMBERED = 300_000
#: Windows whose least hash is chosen at once.
_CHOSEN = 100_000

PROFILE = "doc_id BIGINT, text_key BIGINT, n_words BIGINT, kept_sha256 STRING, hashes ARRAY<BIGINT>, places ARRAY<BIGINT>"
ROWS = "text_key BIGINT, owner BIGINT, place BIGINT, ha BIGINT, hb BIGINT"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_WORDS = _Hashes()


def _powers(factor: int, count: int) -> np.ndarray:
    out = np.full(count, factor, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a polynomial hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of all windows of a text, for any length."""

    def __init__(self, words: list[bytes], which: int = 0) -> None:
        base = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
        if which:
            base = _mixed(base + np.uint64(which))
        factor = _FACTORS[which]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(base * _powers(factor, len(words)), dtype=np.uint64)])
        self.back = _powers(pow(factor, -1, 1 << 64), len(words))

    def windows(self, length: int, places: np.ndarray | None = None) -> np.ndarray:
        if places is None:
            places = np.arange(len(self.sums) - length)
        return _mixed((self.sums[places + length] - self.sums[places]) * self.back[places])


def _choices(short: np.ndarray, spread: int) -> np.ndarray:
    """For each long window, the place of the least of the ``spread`` short windows inside (the first at ties)."""
    count = len(short) - spread + 1
    out = np.empty(count, dtype=np.int64)
    for start in range(0, count, _CHOSEN):
        stop = min(count, start + _CHOSEN)
        view = np.lib.stride_tricks.sliding_window_view(short[start : stop + spread - 1], spread)
        out[start:stop] = view.argmin(axis=1) + np.arange(start, stop)
    return out


def _profiles(documents: DataFrame, window: int, first: int) -> DataFrame:
    """Per document: its words' number and digest, and the chosen short windows."""
    spread = window - first + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            counts, digests, hashes, places = [], [], [], []
            for text in byte_lists(batch.column(2)):
                words = text.split() if text else []
                counts.append(len(words))
                digests.append(sha256(b" ".join(words)).hexdigest())
                if len(words) >= window:
                    short = Rolling(words).windows(first)
                    chosen = np.unique(_choices(short, spread))
                    hashes.append(short[chosen].view(np.int64))
                    places.append(chosen)
                else:
                    hashes.append(np.zeros(0, np.int64))
                    places.append(np.zeros(0, np.int64))
            kind = pa.list_(pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(hashes, kind), pa.array(places, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_words", "kept_sha256", "hashes", "places"])

    return arrow_pass(documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run, PROFILE)


def _extended(texts: DataFrame, window: int, first: int) -> DataFrame:
    """Windows of twice ``first`` words around surviving short ones; ``texts``: text_key, owner, text, alive."""
    spread, length = window - first + 1, 2 * first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            out = [[], [], []]
            owners = []
            for row, (text, alive) in enumerate(zip(byte_lists(batch.column(2)), batch.column(3), strict=True)):
                words = text.split()
                one = Rolling(words)
                chosen = _choices(one.windows(first), spread)
                flags = np.zeros(len(words), dtype=bool)
                flags[alive.values.to_numpy()] = True
                # A long window can repeat only where its chosen short one does; its parts of twice ``first`` words are tried.
                long = np.flatnonzero(flags[chosen])
                places = np.unique((long[:, None] + np.arange(window - length + 1)[None, :]).ravel())
                out[0].append(places)
                out[1].append(one.windows(length, places).view(np.int64))
                out[2].append(Rolling(words, 1).windows(length, places).view(np.int64))
                owners.append(np.full(len(places), row))
            order = pa.array(np.concatenate(owners))
            arrays = [pa.array(np.concatenate(x)) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(order), batch.column(1).take(order), *arrays], names=["text_key", "owner", "place", "ha", "hb"])

    return arrow_pass(texts, run, ROWS)


def _repeated(rows: DataFrame) -> DataFrame:
    """Hashes that rows of two owners have, with the least owner."""
    return rows.groupBy("ha", "hb").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least < most").select("ha", "hb", "least")


def _doubled(rows: DataFrame, length: int) -> DataFrame:
    """Surviving windows (text_key, owner, place, ha, hb) joined with the ones that follow them directly."""
    ahead = rows.select(F.col("text_key").alias("k"), F.col("owner").alias("o"), (F.col("place") - length).alias("p"), F.col("ha").alias("a2"), F.col("hb").alias("b2"))
    met = rows.join(ahead, (F.col("text_key") == F.col("k")) & (F.col("owner") == F.col("o")) & (F.col("place") == F.col("p")))
    return met.select("text_key", "owner", "place", F.xxhash64("ha", "a2").alias("ha"), F.xxhash64("b2", "hb").alias("hb")).distinct()


def _few(keys: DataFrame) -> DataFrame:
    """A key table for a join: broadcast if its counted size allows, shuffled otherwise."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _texts_of(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``documents`` that own a text of ``texts`` (text_key, owner, more), with the columns of both."""
    rows = documents.select(F.xxhash64("text").alias("text_key"), F.coalesce("doc_id", F.lit(NO_ID)).alias("owner"), "text")
    keys = texts.select("text_key", "owner")
    return rows.join(_few(keys), ["text_key", "owner"], "left_semi").join(texts, ["text_key", "owner"])


def _levels(window: int) -> list[int]:
    """Lengths of the levels; the first is half the window, halved again down to 25 words at most."""
    levels = [window]
    while levels[0] % 2 == 0 and (len(levels) < 2 or levels[0] > 25):
        levels.insert(0, levels[0] // 2)
    if len(levels) < 2:
        raise ValueError("the window must be an even number of words")
    return levels


def repeated_places(documents: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Profiles of all documents, and the starts of windows to be removed by text: text_key, owner, starts.

    ``owner`` is the least doc_id with the text. A start counts when its window also
    starts in a text with a smaller owner.
    """
    levels = _levels(window)
    first = levels[0]
    profile = written(_profiles(documents, window, first), "substring-profiles")
    owners = profile.groupBy("text_key").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("owner"))
    short = profile.select("text_key", F.explode(F.arrays_zip("hashes", "places")).alias("w")).select("text_key", "w.hashes", "w.places")
    twice = short.groupBy("hashes").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).filter("a < b").select("hashes")
    survivors = short.join(written(twice, "substring-level"), "hashes", "left_semi")
    alive = survivors.groupBy("text_key").agg(F.collect_set("places").alias("alive")).join(owners, "text_key")
    candidates = written(alive.select("text_key", "owner", "alive"), "substring-candidates")
    texts = _texts_of(documents, candidates).select("text_key", "owner", "text", "alive")
    rows = written(_extended(texts, window, first), "substring-level")
    for length in levels[1:]:
        repeated = written(_repeated(rows), "substring-repeated")
        last = length == window
        left = rows.join(repeated, ["ha", "hb"])
        if last or left.isEmpty():
            found = left.filter("owner > least") if last else left.limit(0)
            break
        grown = written(_doubled(left.select("text_key", "owner", "place", "ha", "hb").distinct(), length), "substring-level")
        remove_written(rows)
        rows = grown
    starts = written(found.groupBy("text_key", "owner").agg(F.collect_set("place").alias("starts")), "substring-starts")
    remove_written(rows)
    return profile, starts


def _cut(documents: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """What is left of the texts of ``starts``: text_key, owner, lost (words), kept (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            lost, kept = [], []
            for text, begin in zip(byte_lists(batch.column(2)), batch.column(3), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                places = begin.values.to_numpy()
                np.add.at(edge, places, 1)
                np.add.at(edge, places + window, -1)
                stays = np.cumsum(edge)[:-1] == 0
                lost.append(int(len(words) - stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays).tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["text_key", "owner", "lost", "kept"])

    texts = _texts_of(documents, starts).select("text_key", "owner", "text", "starts")
    return arrow_pass(texts, run, "text_key BIGINT, owner BIGINT, lost BIGINT, kept STRING").dropDuplicates(["text_key", "owner"])


def deduplicate(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word is removed when a window of ``window`` words around it also starts in a
    document with a smaller doc_id; windows are judged on the input texts.

    A null text has no words. Documents shorter than a window keep all words. Rows of
    one doc_id never remove each other's words, so repeated rows stay alike; a null
    doc_id counts as larger than all others. Needs doc_id and text and reads no other column.
    """
    profile, starts = repeated_places(documents, window)
    cut = _cut(documents, starts, window).select("text_key", "owner", "lost", F.sha2(F.col("kept").cast("binary"), 256).alias("left_sha256"))
    rows = profile.select("doc_id", "text_key", "n_words", "kept_sha256")
    owners = rows.groupBy("text_key").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("owner"))
    joined = rows.join(owners.join(written(cut, "substring-cut"), ["text_key", "owner"], "left"), "text_key")
    # A later copy of a whole text starts every window that its first document starts.
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("owner")) & (F.col("n_words") >= window)
    return joined.select(
        "doc_id",
        "text_key",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("left_sha256", "kept_sha256")).alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words removed; all columns stay, a column ``n_chars`` follows the text.

    A text that loses words is its kept words joined by one space, the others stay as
    they are. A document that had words and lost all of them goes. Null and empty texts stay, a
    null doc_id comes after all others, rows of one id never cut each other, and an empty table
    gives an empty one.
    """
    profile, starts = repeated_places(documents, window)
    cut = written(_cut(documents, starts, window), "substring-cut")
    owners = profile.groupBy("text_key").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"), F.max("n_words").alias("words"))
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key"), F.coalesce("doc_id", F.lit(NO_ID)).alias("own"))
    known = owners.join(cut, (owners["text_key"] == cut["text_key"]) & (F.col("least") == F.col("owner")), "left").select(owners["text_key"], "least", "words", "lost", "kept")
    joined = rows.join(known, F.col("key") == F.col("text_key"))
    copy = (F.col("own") > F.col("least")) & (F.col("words") >= window)
    stays = ~copy & (F.col("lost").isNull() | (F.col("lost") < F.col("words")))
    text = F.coalesce("kept", "row.text")
    new = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in documents.columns else {})
    return joined.filter(stays).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
