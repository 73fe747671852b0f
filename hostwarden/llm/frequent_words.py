"""Corpus-wide word tables, and per-document sums of what such a table says about the words.

The table has a row per distinct word of the corpus, so it grows with the input and is
never broadcast. Its most frequent words are: at most ``FREQUENT`` words of at most
``WORD_BYTES`` bytes, which cover most occurrences. A document's other words go through a
shuffle join with the whole table, so every word gets its value. Codes, numbers of up to
seven bytes that stand for short byte strings, are looked up in the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.texts import arrow_pass, byte_lists, small_batches

#: Bound of the broadcast: entries and bytes of an entry's word (16 MB at most, with values).
FREQUENT = 200_000
WORD_BYTES = 64
#: The same for codes (32 MB with one value).
FREQUENT_CODES = 1 << 21
#: A task's counter is handed on when it has so many words.
LOCAL_WORDS = 100_000

Words = Callable[[bytes], list[bytes]]
#: From the words of some texts to (number of the text, code), at most a few million at a time.
Windows = Callable[[list[list[bytes]]], Iterator[tuple[np.ndarray, np.ndarray]]]

#: The first byte of a code's key, which no word that is counted beside codes may have.
_CODE = np.uint64(0x0A << 56)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_counts(documents: DataFrame, words: Words, counted: str | None = None) -> DataFrame:
    """``word``, ``freq`` (occurrences) and ``counted`` (occurrences in rows whose column ``counted`` is true).

    ``documents`` has a column text; each task adds up its words before the shuffle.
    """
    flag = F.col(counted) if counted else F.lit(True)

    def flush(totals: Counter, part: Counter) -> pa.RecordBatch:
        keys = list(totals)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(list(totals.values()), pa.int64()), pa.array([part[k] for k in keys], pa.int64())],
            names=["word", "freq", "counted"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, part = Counter(), Counter()
        for batch in small_batches(batches, 0):
            for text, flagged in zip(byte_lists(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = words(text) if text else ()
                totals.update(found)
                if flagged:
                    part.update(found)
            if len(totals) > LOCAL_WORDS:
                yield flush(totals, part)
                totals, part = Counter(), Counter()
        yield flush(totals, part)

    rows = documents.select("text", F.coalesce(flag, F.lit(False)).alias("flag"))
    counts = arrow_pass(rows, run, "word BINARY, freq BIGINT, counted BIGINT")
    return counts.groupBy("word").agg(F.sum("freq").alias("freq"), F.sum("counted").alias("counted"))


def code_keys(codes: np.ndarray) -> pa.Array:
    """Codes as the keys under which a table has them: a line feed and seven bytes."""
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * 8
    data = (codes.astype(np.uint64) | _CODE).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class CodeTable:
    """Codes in the order of their hash, then one that is none, and their values by place; zeros for the last place."""

    def __init__(self, codes: np.ndarray, values: Sequence[np.ndarray]) -> None:
        self._bits = len(codes).bit_length() + 1
        order = np.argsort(self._home(codes), kind="stable")
        self.codes = np.append(codes[order], _CODE)
        self.values = [np.append(v[order], 0) for v in values]
        self._starts: np.ndarray | None = None

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> np.uint64(64 - self._bits)).astype(np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code, the last one for a code that is not there."""
        if self._starts is None:
            sizes = np.bincount(self._home(self.codes[:-1]), minlength=1 << self._bits).astype(np.int32)
            self._starts = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
        home = self._home(codes)
        at = self._starts[home]
        open_ = np.flatnonzero(self.codes[at] != codes)
        ends = self._starts[home[open_] + 1]
        while len(open_):
            at[open_] += 1
            over = at[open_] >= ends
            at[open_[over]] = len(self.codes) - 1
            left = ~over & (self.codes[at[open_]] != codes[open_])
            open_, ends = open_[left], ends[left]
        return at


def _frequent_rows(table: DataFrame, values: Sequence[str], most: int) -> pa.Table | None:
    """At most ``most`` of the most frequent rows of ``table``: word and values.

    The least frequency comes from a histogram over powers of 2**(1/8), a few hundred rows.
    """
    level = F.floor(F.log2("freq") * 8).cast("int")
    histogram = sorted(((r[0], r[1]) for r in table.groupBy(level.alias("level")).count().collect()), reverse=True)
    covered = np.cumsum([n for _, n in histogram])
    levels = [k for (k, _), n in zip(histogram, covered, strict=True) if n <= most]
    return table.filter(level >= min(levels)).select("word", *values).toArrow() if levels else None


def _frequent_codes(table: DataFrame, values: Sequence[str]) -> CodeTable:
    """At most FREQUENT_CODES of the most frequent codes with their values."""
    rows = _frequent_rows(table, values, FREQUENT_CODES)
    if rows is None:
        return CodeTable(np.zeros(0, np.uint64), [np.zeros(0) for _ in values])
    blobs = [np.frombuffer(c.buffers()[2], ">u8")[c.offset : c.offset + len(c)] for c in rows.column(0).chunks if len(c)]
    return CodeTable(np.concatenate(blobs).astype(np.uint64) ^ _CODE, [rows.column(1 + i).to_numpy() for i in range(len(values))])


def frequent_part(table: DataFrame, values: Sequence[str]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """At most FREQUENT of the most frequent words of ``table``: word to place, and the values by place.

    The last place holds zeros, for words that are not there.
    """
    rows = _frequent_rows(table.filter(F.length("word") <= WORD_BYTES), values, FREQUENT)
    if rows is None:
        return {}, [np.zeros(1) for _ in values]
    columns = [rows.column(1 + i).to_numpy() for i in range(len(values))]
    return dict(zip(rows.column(0).to_pylist(), range(rows.num_rows), strict=True)), [np.append(c, c.dtype.type(0)) for c in columns]


def sums_by_document(
    documents: DataFrame, table: DataFrame, words: Words, values: Sequence[str], windows: Windows | None = None, coded: DataFrame | None = None
) -> DataFrame:
    """``documents`` (columns text and others) without text, plus n_bytes, n_words and, per name in ``values``, the sum over the text's words.

    ``table`` has word, freq and double or long columns ``values``. A word that the
    table lacks counts as 0. ``windows`` finds codes in the text's words, and ``coded`` has
    word (the code's key), freq and further double ``values`` that ``table`` lacks; codes
    count as words do, each with its number of occurrences. Rows are told apart by their place in the input, so
    repeated rows and null ids stay what they are.
    """
    spark = documents.sparkSession
    carried = [c for c in documents.columns if c != "text"]
    of_codes = [v for v in values if coded is not None and v in coded.columns]
    of_words = [v for v in values if v not in of_codes]
    known = spark.sparkContext.broadcast(frequent_part(table, of_words))
    known_codes = spark.sparkContext.broadcast(_frequent_codes(coded, of_codes)) if of_codes else None
    values = [*of_words, *of_codes]
    kinds = [*(dict(table.dtypes)[v] for v in of_words), *("double" for _ in of_codes)]

    def code_sums(texts: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Sums by text over the frequent codes, and of the others text, code and occurrences."""
        look = known_codes.value
        sums = [np.zeros(len(texts)) for _ in look.values]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for number, code in windows(texts):
            place = look.find(code)
            for i, v in enumerate(look.values):
                sums[i] += np.bincount(number, weights=v[place], minlength=len(texts))
            tail = place == len(look.codes) - 1
            found.append((number[tail], code[tail]))
        number, code = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((code, number))
        number, code = number[order], code[order]
        starts = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(code, prepend=np.uint64(0)) != 0))
        return sums, number[starts], code[starts], np.diff(starts, append=len(code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, worth = known.value
        for batch in small_batches(batches, 1):
            sizes, lengths, sums, tails, freqs, texts = [], [], [], [], [], []
            for text in byte_lists(batch.column(1)):
                found = words(text) if text else []
                times = Counter(found)
                places = np.fromiter((look.get(w, -1) for w in times), np.int64, len(times))
                weight = np.fromiter(times.values(), np.int64, len(times))
                tail = [w for w, place in zip(times, places.tolist(), strict=True) if place < 0]
                sizes.append(len(text) if text else 0)
                lengths.append(len(found))
                sums.append([(v[places] * weight).sum().item() for v in worth])
                if of_codes:
                    texts.append(found)
                tails.append(tail)
                freqs.append([times[w] for w in tail])
            rows = batch.num_rows
            # The document's own row has a key that is no word, unlike null, which would meet in one task.
            own = [b" %d" % k for k in batch.column(0).to_pylist()]
            places = np.repeat(np.arange(rows), [len(t) for t in tails])
            more = [w for t in tails for w in t]
            keys, times = pa.array(own + more, pa.binary()), np.array([0] * rows + [n for f in freqs for n in f], dtype=np.int64)
            mine = [np.array([s[i] for s in sums], dtype=np.int64 if kinds[i] == "bigint" else np.float64) for i in range(len(of_words))]
            if of_codes:
                coded_sums, number, code, often = code_sums(texts)
                mine += coded_sums
                places = np.concatenate([places, number])
                keys, times = pa.concat_arrays([keys, code_keys(code)]), np.concatenate([times, often])
            order = pa.array(np.concatenate([np.arange(rows), places]))
            out = [c.take(order) for i, c in enumerate(batch.columns) if i != 1]
            blank = np.zeros(len(places), dtype=np.int64)
            out += [keys, pa.array(times)]
            out += [pa.array(np.concatenate([np.array(v, dtype=np.int64), blank])) for v in (sizes, lengths)]
            out += [pa.array(np.concatenate([v, blank.astype(v.dtype)])) for v in mine]
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = documents.select(F.monotonically_increasing_id().alias("_row"), "text", *carried)
    fixed = [(f"_c{i}", dict(documents.dtypes)[c]) for i, c in enumerate(carried)]
    shape = [("_row", "bigint"), *fixed, ("_word", "binary"), ("_times", "bigint"), ("n_bytes", "bigint"), ("n_words", "bigint")]
    shape += [(f"_v{i}", k) for i, k in enumerate(kinds)]
    names = [n for n, _ in shape]
    pieces = arrow_pass(rows, run, ", ".join(f"`{n}` {k}" for n, k in shape))
    wanted = table.select(F.col("word").alias("_word"), *[(F.col(v) if v in of_words else F.lit(0.0)).alias(f"_t{i}") for i, v in enumerate(values)])
    if of_codes:
        wanted = wanted.unionByName(coded.select(F.col("word").alias("_word"), *[(F.col(v) if v in of_codes else F.lit(0).cast(k)).alias(f"_t{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))]))
    joined = pieces.join(wanted, "_word", "left")
    sums = [F.sum(F.col(f"_v{i}") + F.coalesce(F.col("_times") * F.col(f"_t{i}"), F.lit(0))).alias(v) for i, v in enumerate(values)]
    kept = [F.max(f"_c{i}").alias(c) for i, c in enumerate(carried)]
    return joined.groupBy("_row").agg(*kept, F.max("n_bytes").alias("n_bytes"), F.max("n_words").alias("n_words"), *sums).drop("_row")
