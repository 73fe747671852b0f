"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window (13 consecutive words of an item) is a list of word shingles. A
document can contain it only if it contains every one of its shingles, so the rarest
in the corpus, its necessary prefix token, is enough to find candidates. Length and
position bounds place the window around that shingle, and the exact check compares
all shingles of the window with the document's at that place.

Documents are turned once into segments: stretches whose words all lie in shingles
that some window has. Everything after that is joins of segments with windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from hostwarden.llm.texts import arrow_pass, byte_lists, map_texts, record, small_batches, written

WINDOW = 13
SHINGLE = 5
#: A document is contaminated when hit words are at least one in so many.
SHARE = 20
#: Bounds of a broadcast: windows of the benchmark that are looked for in one pass, and their bytes.
BLOCK_WINDOWS = 100_000
BLOCK_BYTES = 16 << 20
#: Shingles of a segment; longer stretches are cut with an overlap, so that rows stay small.
SEGMENT = 64

#: Lower case for A-Z; separators 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F become spaces.
_FOLD = bytes(ord(chr(c).lower()) if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def shingle_id(part: list[bytes]) -> int:
    """Number of a shingle of the benchmark: a 63-bit hash of its words."""
    return xxh3_64_intdigest(b" ".join(part)) >> 1


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """A row per item and distinct window of it: item_id (text), win (words, space-joined), size (words), ids (shingles).

    An item of fewer words than a window is one window; an item without words has none.
    A window of fewer words than a shingle is one shingle.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, found, sizes, ids = [], [], [], []
        for item, text in zip(batch.column(0).to_pylist(), byte_lists(batch.column(1)), strict=True):
            own = words(text)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                part = own[i : i + window]
                n = min(shingle, len(part))
                items.append(item)
                found.append(b" ".join(part))
                sizes.append(len(part))
                ids.append([shingle_id(part[k : k + n]) for k in range(len(part) - n + 1)])
        return record(item_id=pa.array(items, pa.string()), win=pa.array(found, pa.binary()), size=pa.array(sizes, pa.int32()), ids=pa.array(ids, pa.list_(pa.int64())))

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return map_texts(rows, make, "item_id STRING, win BINARY, size INT, ids ARRAY<BIGINT>").distinct()


class Vocabulary:
    """The shingles of a block of windows, and where a text has them."""

    def __init__(self, windows: list[bytes], shingle: int) -> None:
        texts = [w.split() for w in windows]
        self.number: dict[bytes, int] = {}
        for text in texts:
            for word in text:
                self.number.setdefault(word, len(self.number) + 1)
        # By length of the shingle: that of a short item is the whole item. Keys are word numbers, so equal keys are equal words.
        self.known: dict[int, dict[bytes, int]] = {}
        for text in texts:
            size = min(shingle, len(text))
            for i in range(len(text) - size + 1):
                part = text[i : i + size]
                key = np.array([self.number[w] for w in part], dtype=np.uint32).tobytes()
                self.known.setdefault(size, {})[key] = shingle_id(part)
        # Shingles begin with one of these pairs of words; most places of a text end here.
        self.pairs = {size: np.unique([int.from_bytes(k[:8], "little") for k in keys]).astype(np.uint64) for size, keys in self.known.items()}

    def segments(self, own: list[bytes], segment: int, step: int) -> list[dict[str, object]]:
        """Stretches of places where known shingles start: first place and shingle numbers.

        Longer stretches are cut into pieces of ``segment`` shingles that overlap in all but ``step``.
        """
        ids = np.fromiter(map(self.number.get, own, repeat(0)), np.uint32, len(own))
        raw, out = ids.tobytes(), []
        for size, keys in self.known.items():
            places = len(ids) - size + 1
            if places < 1:
                continue
            key = ids[:places].astype(np.uint64)
            if size > 1:
                key |= ids[1 : places + 1].astype(np.uint64) << np.uint64(32)
            pairs = self.pairs[size]
            maybe = np.flatnonzero(ids[:places])
            key = key[maybe]
            maybe = maybe[pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key]
            run: list[int] = []
            last = -2
            for i in maybe.tolist():
                found = keys.get(raw[4 * i : 4 * (i + size)])
                if found is None:
                    continue
                if i != last + 1 and run:
                    out += self._cut(last - len(run) + 1, run, segment, step)
                    run = []
                run.append(found)
                last = i
            if run:
                out += self._cut(last - len(run) + 1, run, segment, step)
        return out

    @staticmethod
    def _cut(start: int, run: list[int], segment: int, step: int) -> list[dict[str, object]]:
        last = max(1, len(run) - segment + step)
        return [{"start": start + i, "ids": run[i : i + segment]} for i in range(0, last, step)]


def _profiles(documents: DataFrame, block: list[bytes], shingle: int, segment: int, step: int) -> DataFrame:
    """Per document: content keys, doc_id, n_words, and its segments for one block of windows."""
    shared = documents.sparkSession.sparkContext.broadcast(block)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value, shingle)
        for batch in small_batches(batches, 3):
            texts = [words(t) for t in byte_lists(batch.column(3))]
            found = [vocabulary.segments(own, segment, step) for own in texts]
            columns = [*batch.columns[:3], pa.array([len(own) for own in texts], pa.int64()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "doc_id", "n_words", "segments"])

    rows = documents.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "doc_id", "text")
    schema = "k1 BIGINT, k2 BIGINT, doc_id BIGINT, n_words BIGINT, segments ARRAY<STRUCT<start: BIGINT, ids: ARRAY<BIGINT>>>"
    return arrow_pass(rows, run, schema)


def _hits(profile: DataFrame, windows: DataFrame) -> DataFrame:
    """Where windows occur: k1, k2, start, size, win."""
    segments = profile.select("k1", "k2", F.explode("segments").alias("s")).select("k1", "k2", "s.start", "s.ids")
    tokens = segments.select("k1", "k2", "start", F.col("ids").alias("has"), F.posexplode("ids").alias("at", "id"))
    rarity = tokens.groupBy("id").agg(F.count("*").alias("freq"))
    each = windows.select("win", "size", "ids", F.posexplode("ids").alias("offset", "id"))
    ranked = each.join(rarity, "id", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    # Containment is complete, so one token is a necessary prefix: the rarest. With none in the corpus there is no occurrence.
    order = F.struct("freq", "id", "offset")
    rarest = ranked.groupBy("win").agg(F.min(order).alias("rarest"), F.first("size").alias("size"), F.first("ids").alias("ids"))
    prefix = rarest.filter("rarest.freq > 0").select("win", "size", "ids", F.col("rarest.id").alias("id"), F.col("rarest.offset").alias("offset"))
    prefix = written(prefix, "prefix-tokens")
    placed = tokens.join(prefix, "id").withColumn("from", F.col("at") - F.col("offset"))
    fits = (F.col("from") >= 0) & (F.col("from") + F.size("ids") <= F.size("has"))
    exact = placed.filter(fits).filter(F.slice("has", F.col("from") + 1, F.size("ids")) == F.col("ids"))
    return exact.select("k1", "k2", (F.col("start") + F.col("from")).alias("start"), "size", "win").distinct()


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, size) spans."""

    def step(sofar: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        fresh = end - F.greatest(span["start"], sofar["end"])
        return F.struct((sofar["n"] + F.greatest(fresh, F.lit(0))).alias("n"), F.greatest(sofar["end"], end).alias("end"))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), step)["n"]


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """Per document: k1, k2 (content keys), doc_id, n_words, n_hit, n_items, items (sorted item ids), contaminated.

    A word is hit when an occurrence of a benchmark window covers it; a document is
    contaminated when at least one word in ``share`` is hit. The benchmark is read in
    blocks of about ``block_windows`` windows or BLOCK_BYTES, each looked for in one pass
    over the documents, so any size of benchmark keeps the broadcast bounded.

    A null text has no words; so has one of separators only. Such documents have no hit.
    A null doc_id stays null, an item without id counts as the item ``null``, repeated
    rows give repeated results, repeated items count once. An empty benchmark hits
    nothing. Needs doc_id and text, item_id and text, and reads no other column.
    """
    items = written(item_windows(benchmark, window, shingle).withColumn("item_id", F.coalesce("item_id", F.lit("null"))), "item-windows")
    windows = items.groupBy("win").agg(F.first("size").alias("size"), F.first("ids").alias("ids"))
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("win")), F.lit(0)).alias("bytes")).head()
    blocks = max(1, ceil(size["n"] / block_windows), ceil(size["bytes"] / BLOCK_BYTES))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("win"), F.lit(blocks)))
    # A segment holds any window whole, and two that follow each other share all but the last shingle of one.
    overlap = max(1, window - shingle)
    segment = max(SEGMENT, 2 * overlap + 2)
    step = segment - overlap
    first = hits = None
    for number in range(blocks):
        part = windows.filter(F.col("block") == number).drop("block")
        block = [bytes(r["win"]) for r in part.select("win").collect()]  # bounded by the block's size
        profile = written(_profiles(documents, block, shingle, segment, step), "segments")
        found = _hits(profile, part)
        first = first if first is not None else profile
        hits = found if hits is None else hits.unionByName(found)
    hits = written(hits, "window-hits")
    spans = F.array_sort(F.collect_set(F.struct("start", F.col("size").cast("bigint").alias("size"))))
    words_hit = hits.groupBy("k1", "k2").agg(_covered(spans).alias("n_hit"))
    pairs = hits.select("k1", "k2", "win").distinct().join(items.select("win", "item_id"), "win").select("k1", "k2", "item_id").distinct()
    with_items = pairs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    found = words_hit.join(with_items, ["k1", "k2"])
    joined = first.select("k1", "k2", "doc_id", "n_words").join(found, ["k1", "k2"], "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)), F.array().cast("array<string>")
    return joined.select(
        "k1", "k2", "doc_id", "n_words",
        n_hit.cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, **limits: int) -> DataFrame:
    """The documents that are not contaminated, all columns as they are.

    Null and empty texts have no hit and stay, a null doc_id stays null, repeated rows go or stay
    together. Empty tables are taken: without documents nothing comes out, without items all.
    """
    bad = written(contamination(documents, benchmark, **limits).filter("contaminated").select("k1", "k2").distinct(), "contaminated")
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"))
    return rows.join(bad, ["k1", "k2"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
