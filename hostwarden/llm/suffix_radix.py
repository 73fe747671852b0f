"""Substring deduplication by a depth-limited radix sort of all suffixes.

Suffixes are ordered by their first ``depth`` bytes only, most significant digits first:
every pass splits the groups of equal suffixes by the next digit, and a group that holds
suffixes of one document alone is dropped at once. After the last digit the groups left are
exactly the windows of ``depth`` bytes that documents share.

Two things keep the sort from moving every byte of the corpus fifty times over. First, of
each suffix's first ``depth`` bytes one gram of half that length counts, the one with the least hash.
Equal suffixes have equal grams, so the gram is the digit that deals suffixes to tasks,
and suffixes whose gram no other document has are dropped before the sort. Second, the
neighbouring suffixes that share their gram travel as one row, a run; runs with equal bytes
are equal in all of their suffixes, so only one of them is ordered suffix by suffix.

Runs, grams and suffixes travel packed, one row for each chunk of input and bucket. What a chunk
can settle by itself it settles, so a passage in any number of documents sends a few
entries a chunk to its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from hostwarden.llm.texts import arrow_pass, byte_lists, ragged, small_batches, written

DEPTH = 50
#: Order of rows without an id: after all others.
NO_ID = 2**63 - 1
#: Bytes of text whose grams, and whose runs, a chunk settles together, and that one bucket takes.
GRAM_CHUNK, RUN_CHUNK, BUCKET_BYTES = 16 << 20, 8 << 20, 16 << 20
#: Different runs of one gram that a chunk sends to the gram's bucket; of a gram with more, suffixes are dealt by their own bytes.
RUNS_OF_GRAM = 4
#: Of zstandard.
LEVEL = 3
#: Bytes of a gram's hash that travel in the first pass. Equal ones of different grams only let runs through that the second pass drops.
GRAM_BYTES = 5
#: Places hashed at once, suffixes ordered at once in a bucket, and runs copied at once.
SEGMENT, ORDERED, COPIED = 1 << 18, 200_000, 50_000

#: Whether Spark removes the shuffle files of a query when it ends; otherwise when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FACTOR = 0x9E3779B97F4A7C15
_SPANS, _RUNS, _SUFFIXES = 0, 1, 2
_PLAIN, _DEALT, _WITNESS = 0, 1, 2
_ENTRY = [("gram", "u8"), ("owner", "i8"), ("key", "i8"), ("start", "i8"), ("size", "i4"), ("flag", "i4")]
_ROWS = "bucket INT, kind INT, owner BIGINT, text_key BIGINT, fields BINARY, blocks BINARY"


def _table(seed: int) -> np.ndarray:
    """An odd number of 64 bits for each byte value."""
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR) + np.uint64(seed)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(factor: int, count: int) -> np.ndarray:
    out = np.full(count, factor, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_GRAM_TABLE, _RUN_TABLE = _table(1), _table(2)
_POWERS: dict[int, np.ndarray] = {}


def _power(factor: int, count: int) -> np.ndarray:
    if factor not in _POWERS or len(_POWERS[factor]) < count:
        _POWERS[factor] = _powers(factor, max(count, SEGMENT + 4096))
    return _POWERS[factor][:count]


def _hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes; equal bytes have equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * _power(_FACTOR, len(data)), out=sums[1:])
    return _mixed((sums[ends] - sums[begins]) * _power(pow(_FACTOR, -1, 1 << 64), len(data) + 1)[begins])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from windows of doubling width."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(data: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one gram, of texts laid end to end: gram, text, start in the text, suffixes."""
    width = depth // 2
    ends = np.cumsum(lengths)
    begins = ends - lengths
    found = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for offset in range(0, len(data) - depth + 1, SEGMENT):
        piece = data[offset : offset + SEGMENT + depth - 1]
        count = len(piece) - depth + 1
        places = np.arange(len(piece) - width + 1)
        gram = _least(_hashes(piece, places, places + width, _GRAM_TABLE), depth - width + 1)
        change = np.ones(count, dtype=bool)
        change[1:] = gram[1:] != gram[:-1]
        # A text's last places begin no window; they are runs of their own and left out.
        for marks in (begins, np.maximum(begins, ends - depth + 1)):
            inside = marks[(marks >= offset) & (marks < offset + count)]
            change[inside - offset] = True
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, count))
        text = np.searchsorted(ends, start + offset, side="right")
        full = start + offset + depth <= ends[np.minimum(text, len(ends) - 1)]
        start, size, text = start[full], size[full], text[full]
        found.append((gram[start], text, start + offset - begins[text], size))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    texts = [text or b"" for text in texts]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(text) for text in texts], dtype=np.int64)


def _planes(values: np.ndarray, size: int = 8) -> bytes:
    """The low bytes of whole numbers, all first bytes, then all second ones: neighbours alike compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :size].T).tobytes()


def _from_planes(data: bytes, kind: str = "<u8", size: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
    out[:, :size] = planes.T
    return out.view(kind).ravel()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(_starts(bucket[order]))
    for place, rows in zip(edges, np.split(order, edges[1:]), strict=True):
        yield int(bucket[order[place]]), rows


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([column[1:] != column[:-1] for column in columns])
    return new


def _compressed(rows: DataFrame, text: str) -> DataFrame:
    """The rows with a text column as compressed bytes: texts are shuffled twice, to their grams and to their spans."""
    names = rows.columns
    place = names.index(text)
    schema = StructType([StructField(text, BinaryType()) if field.name == text else field for field in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in small_batches(batches, place):
            packed = [None if value is None else packer.compress(value) for value in byte_lists(batch.column(place))]
            columns = [pa.array(packed, pa.binary()) if n == place else batch.column(n) for n in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_pass(rows, run, schema)


def _texts(column: pa.Array) -> list[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return [b"" if value is None else unpacker.decompress(value) for value in column.to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], text: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of compressed texts in slices of about ``size`` compressed bytes."""
    for batch in batches:
        lengths = np.array([len(value or b"") for value in batch.column(text).to_pylist()], dtype=np.int64)
        part = np.cumsum(lengths) // size
        edges = np.flatnonzero(_starts(part))
        for here, stop in zip(edges, np.append(edges, batch.num_rows)[1:], strict=True):
            yield batch.slice(here, stop - here)


# First pass: which grams two documents have.

_GRAM_ROWS = "bucket INT, alive BOOLEAN, owners BINARY, salts BINARY, grams BINARY"


def _gram_row(bucket: int, alive: bool, owner: np.ndarray, salt: np.ndarray, gram: np.ndarray) -> tuple:
    order = np.argsort(owner, kind="stable")
    return bucket, alive, _planes(np.diff(owner[order], prepend=0)), _planes(salt[order], 1), _planes(gram[order], GRAM_BYTES)


def _settled_grams(owner: np.ndarray, salt: np.ndarray, gram: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of a chunk: grams of one document go to the gram's bucket, shared ones are alive and send two witnesses."""
    order = np.lexsort((salt, owner, gram))
    owner, salt, gram = owner[order], salt[order], gram[order]
    once = _starts(gram, owner, salt)
    owner, salt, gram = owner[once], salt[once], gram[once]
    begin = np.flatnonzero(_starts(gram))
    size = np.diff(np.append(begin, len(gram)))
    shared = np.repeat(owner[begin] != owner[begin + size - 1], size) if len(begin) else np.zeros(0, bool)
    sent = ~shared
    sent[begin] = True
    sent[begin + size - 1] = True
    rows = []
    for bucket, own in _by_bucket((gram[sent] % np.uint64(buckets)).astype(np.int64)):
        rows.append(_gram_row(bucket, False, owner[sent][own], salt[sent][own], gram[sent][own]))
    for bucket, own in _by_bucket(_home(owner[shared], salt[shared], buckets)):
        rows.append(_gram_row(bucket, True, owner[shared][own], salt[shared][own], gram[shared][own]))
    return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)], schema=schema)


_GRAM_SCHEMA = pa.schema([("bucket", pa.int32()), ("alive", pa.bool_()), ("owners", pa.binary()), ("salts", pa.binary()), ("grams", pa.binary())])
_ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("owner", pa.int64()), ("text_key", pa.int64()), ("fields", pa.binary()), ("blocks", pa.binary())])


def _salt(key: np.ndarray) -> np.ndarray:
    return key.view(np.uint64) & np.uint64(0xFF)


def _home(owner: np.ndarray, salt: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document's own rows."""
    return (_mixed((owner + salt.astype(np.int64)).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _grams(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Owners, salts and grams of packed rows, and whether they are known to be alive."""
    owners, salts, grams, alive = [], [], [], []
    for known, owner, salt, gram in zip(*[table.column(c).to_pylist() for c in ("alive", "owners", "salts", "grams")], strict=True):
        owners.append(np.cumsum(_from_planes(owner, "<i8")))
        salts.append(_from_planes(salt, "<i8", 1))
        grams.append(_from_planes(gram, "<i8", GRAM_BYTES))
        alive.append(np.full(len(owners[-1]), known))
    return tuple(map(np.concatenate, (owners, salts, grams, alive)))


def _alive_grams(texts: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Grams that two documents have, by document: owner, salt, grams (packed)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in small_batches(batches, 2):
            data, lengths = _joined(byte_lists(batch.column(2)))
            gram, text, _, _ = _runs(data, lengths, depth)
            owner, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            kept.append((owner[text], _salt(key)[text], _mixed(gram)))
            size += len(data)
            if size >= GRAM_CHUNK:
                yield _batch(_settled_grams(*map(np.concatenate, zip(*kept, strict=True)), buckets), _GRAM_SCHEMA)
                kept, size = [], 0
        if kept:
            yield _batch(_settled_grams(*map(np.concatenate, zip(*kept, strict=True)), buckets), _GRAM_SCHEMA)

    def settle(table: pa.Table) -> pa.Table:
        owner, salt, gram, known = _grams(table)
        order = np.lexsort((owner, gram))
        order = order[~known[order]]
        begin = np.flatnonzero(_starts(gram[order]))
        if len(begin):
            size = np.diff(np.append(begin, len(order)))
            shared = np.repeat(owner[order][begin] != owner[order][begin + size - 1], size)
            known[order[shared]] = True
        owner, salt, gram = owner[known], salt[known], gram[known]
        rows = [_gram_row(bucket, True, owner[own], salt[own], gram[own]) for bucket, own in _by_bucket(_home(owner, salt, buckets))]
        return pa.Table.from_batches([_batch(rows, _GRAM_SCHEMA)])

    def gather(table: pa.Table) -> pa.Table:
        owner, salt, gram, _ = _grams(table)
        order = np.lexsort((gram, salt, owner))
        order = order[_starts(owner[order], salt[order], gram[order])]
        owner, salt, gram = owner[order], salt[order], gram[order]
        edges = np.flatnonzero(_starts(owner, salt))
        packed = [_planes(part, GRAM_BYTES) for part in np.split(gram, edges[1:])] if len(edges) else []
        return pa.table({"owner": owner[edges], "salt": salt[edges], "grams": pa.array(packed, pa.binary())})

    rows = arrow_pass(texts.select("owner", "text_key", "text"), scan, _GRAM_ROWS)
    found = rows.groupBy("bucket").applyInArrow(settle, _GRAM_ROWS)
    return found.groupBy("bucket").applyInArrow(gather, "owner BIGINT, salt BIGINT, grams BINARY")


# Second pass: runs of those grams, equal as a whole or ordered suffix by suffix.


def _span_rows(owner: np.ndarray, key: np.ndarray, begin: np.ndarray, end: np.ndarray, buckets: int) -> list[tuple]:
    """A row per document with its covered stretches, joined where they touch."""
    order = np.lexsort((begin, key, owner))
    owner, key, begin, end = owner[order], key[order], begin[order], end[order]
    first = np.flatnonzero(_starts(owner, key))
    rows = []
    for here, stop in zip(first, np.append(first, len(owner))[1:], strict=True):
        reach = np.maximum.accumulate(end[here:stop])
        fresh = np.r_[True, begin[here + 1 : stop] > reach[:-1]]
        last = np.append(np.flatnonzero(fresh)[1:] - 1, stop - here - 1)
        spans = np.stack([begin[here:stop][fresh], reach[last]], axis=1)
        rows.append(((int(owner[here]) * 31 + int(key[here])) % buckets, _SPANS, int(owner[here]), int(key[here]), spans.astype("<i8").tobytes(), None))
    return rows


def _stretches(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, dtype=np.uint8)
    parts = [(begin[here : here + COPIED], size[here : here + COPIED]) for here in range(0, len(begin), COPIED)]
    return np.concatenate([data[np.repeat(b, n) + ragged(n)] for b, n in parts])


def _run_hashes(blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each block of bytes, the blocks laid end to end."""
    out, ends = np.zeros(len(sizes), dtype=np.uint64), np.cumsum(sizes)
    begins, here = ends - sizes, 0
    while here < len(sizes):
        stop = max(here + 1, int(np.searchsorted(ends, begins[here] + SEGMENT, side="right")))
        part = blocks[begins[here] : ends[stop - 1]]
        out[here:stop] = _hashes(part, begins[here:stop] - begins[here], ends[here:stop] - begins[here], _RUN_TABLE)
        here = stop
    return out


class _Entries:
    """Runs with their bytes."""

    def __init__(self, fields: np.ndarray, blocks: np.ndarray, depth: int) -> None:
        self.fields, self.blocks, self.depth = fields, blocks, depth
        self.sizes = np.where(fields["flag"] == _WITNESS, 0, fields["size"] + depth - 1).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def take(self, rows: np.ndarray) -> _Entries:
        return _Entries(self.fields[rows], _stretches(self.blocks, self.begins[rows], self.sizes[rows]), self.depth)

    def packed(self, bucket: int) -> tuple:
        """As a row, in order of the documents: alike neighbours compress."""
        order = np.lexsort((self.fields["start"], self.fields["owner"]))
        return self.take(order)._packed(bucket)

    def _packed(self, bucket: int) -> tuple:
        planes = b"".join(_planes(self.fields[name], np.dtype(kind).itemsize) for name, kind in _ENTRY)
        return bucket, _RUNS, None, None, planes, zstandard.ZstdCompressor(level=LEVEL).compress(self.blocks.tobytes())

    @staticmethod
    def unpacked(rows: list[tuple[bytes, bytes]], depth: int) -> _Entries:
        parts = []
        for planes, _ in rows:
            width = sum(np.dtype(kind).itemsize for _, kind in _ENTRY)
            fields, place, count = np.zeros(len(planes) // width, dtype=_ENTRY), 0, len(planes) // width
            for name, kind in _ENTRY:
                size = np.dtype(kind).itemsize
                fields[name] = _from_planes(planes[place : place + size * count], kind, size)
                place += size * count
            parts.append(fields)
        fields = np.concatenate(parts) if parts else np.zeros(0, dtype=_ENTRY)
        unpacker = zstandard.ZstdDecompressor()
        return _Entries(fields, np.frombuffer(b"".join(unpacker.decompress(blocks) for _, blocks in rows), dtype=np.uint8), depth)

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order of gram, bytes and owner, without repetitions; the class number of each, and whether a smaller owner has the same run."""
        f, run = self.fields, _run_hashes(self.blocks, self.sizes)
        order = np.lexsort((f["start"], f["key"], f["owner"], run, f["gram"]))
        f, run = f[order], run[order]
        once = _starts(f["gram"], run, f["owner"], f["key"], f["start"])
        order, f, run = order[once], f[once], run[once]
        new = _starts(f["gram"], run)
        number = np.cumsum(new) - 1
        return order, number, f["owner"] > f["owner"][np.flatnonzero(new)][number] if len(order) else np.zeros(0, bool)

    def covered(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        f = self.fields[rows]
        return f["owner"], f["key"], f["start"], f["start"] + f["size"] + self.depth - 1

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All suffixes of the runs: their first bytes as a matrix, the run of each, its place in the text."""
        run = np.repeat(np.arange(len(self.fields)), self.fields["size"])
        step = ragged(self.fields["size"].astype(np.int64))
        if not len(run):
            return np.zeros((0, self.depth), dtype=np.uint8), run, step
        matrix = np.lib.stride_tricks.sliding_window_view(self.blocks, self.depth)[self.begins[run] + step]
        return matrix, run, self.fields["start"][run] + step


def radix_groups(matrix: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a row of bytes also occurs with a smaller owner: a most-significant-digit radix sort, eight bytes a pass."""
    digits = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), dtype=np.uint8)
    digits[:, : matrix.shape[1]] = matrix
    digits = digits.view(">u8")
    rows, group = np.arange(len(matrix)), np.zeros(len(matrix), dtype=np.int64)
    least = owner[:0]
    for place in range(digits.shape[1]):
        digit = digits[rows, place].astype(np.uint64)
        order = np.lexsort((digit, group))
        rows, group, digit = rows[order], group[order], digit[order]
        new = _starts(group, digit)
        if not len(new):
            break
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(owner[rows], begin)
        # A group of one owner alone is ordered far enough.
        alive = (least < np.maximum.reduceat(owner[rows], begin))[group]
        rows, group = rows[alive], group[alive]
    out = np.zeros(len(matrix), dtype=bool)
    out[rows] = owner[rows] > least[group] if len(rows) else False
    return out


def _settled_runs(entries: _Entries, buckets: int) -> list[tuple]:
    """Rows of a chunk: spans that a smaller owner covers, and the least owner's runs for the buckets."""
    order, number, late = entries.classes()
    rows = _span_rows(*entries.covered(order[late]), buckets)
    order, number = order[~late], number[~late]
    f = entries.fields[order]
    begin = np.flatnonzero(_starts(f["gram"]))
    classes = np.add.reduceat(_starts(number).astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    heavy = np.repeat(classes > RUNS_OF_GRAM, np.diff(np.append(begin, len(order))))
    bucket = (f["gram"] % np.uint64(buckets)).astype(np.int64)
    entries.fields["flag"][order[heavy]] = _DEALT
    bucket[heavy] = (_mixed(f["owner"][heavy].view(np.uint64) + f["start"][heavy].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    rows += [entries.take(order[own]).packed(which) for which, own in _by_bucket(bucket)]
    marks = np.zeros(int((classes > RUNS_OF_GRAM).sum()), dtype=_ENTRY)
    marks["gram"], marks["flag"] = f["gram"][begin[classes > RUNS_OF_GRAM]], _WITNESS
    for which, own in _by_bucket((marks["gram"] % np.uint64(buckets)).astype(np.int64)):
        rows.append(_Entries(marks[own], np.zeros(0, np.uint8), entries.depth).packed(which))
    return rows


def _ordered_suffixes(entries: _Entries, travels: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Suffixes of runs, which are in order of their grams: spans of those that a smaller owner has, and rows for the ones that travel on."""
    f = entries.fields
    gram_ends = np.append(np.flatnonzero(_starts(f["gram"]))[1:], len(f)) if len(f) else np.zeros(0, np.int64)
    total = np.cumsum(f["size"].astype(np.int64))
    here = 0
    while here < len(f):
        # Whole grams up to ORDERED suffixes. Only a gram whose suffixes travel may be larger and is cut.
        limit = (total[here - 1] if here else 0) + ORDERED
        fits = gram_ends[(gram_ends > here) & (total[gram_ends - 1] <= limit)]
        stop = int(fits[-1]) if len(fits) else int(gram_ends[np.searchsorted(gram_ends, here, side="right")])
        if not len(fits) and travels[here]:
            stop = min(stop, max(here + 1, int(np.searchsorted(total, limit, side="right"))))
        part = entries.take(np.arange(here, stop))
        matrix, run, place = part.suffixes()
        own = part.fields[run]
        late = radix_groups(matrix, own["owner"])
        yield from _span_rows(own["owner"][late], own["key"][late], place[late], place[late] + entries.depth, buckets)
        on = travels[here:stop][run] & ~late
        if on.any():
            yield from _suffix_rows(matrix[on], own["owner"][on], own["key"][on], place[on], buckets)
        here = stop


def _suffix_rows(matrix: np.ndarray, owner: np.ndarray, key: np.ndarray, place: np.ndarray, buckets: int) -> list[tuple]:
    data = matrix.ravel()
    begins = np.arange(0, len(data), matrix.shape[1])
    dealt = _run_hashes(data, np.full(len(begins), matrix.shape[1], dtype=np.int64)) % np.uint64(buckets)
    rows = []
    for bucket, own in _by_bucket(dealt.astype(np.int64)):
        fields = _planes(owner[own]) + _planes(key[own]) + _planes(place[own])
        rows.append((bucket, _SUFFIXES, None, None, fields, matrix[own].tobytes()))
    return rows


def _table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, _ROW_SCHEMA)])


def repeated_spans(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Stretches that a document with a smaller doc_id has, too: owner, text_key, spans (packed pairs of begin and end, in several pieces).

    ``owner`` is the doc_id (NO_ID for null) and ``text_key`` tells texts of one id apart.
    """
    if depth < 2:
        raise ValueError("the depth must be at least two bytes")
    spark = documents.sparkSession
    texts = documents.select(_owner().alias("owner"), _key().alias("text_key"), F.col("text"))
    size = documents.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # An odd number, so that the low bits of a gram say nothing about its bucket.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1) | 1
    alive = _alive_grams(texts.filter(F.octet_length("text") >= depth), depth, buckets)
    salted = texts.withColumn("salt", F.col("text_key").bitwiseAND(F.lit(0xFF)))
    packed = _compressed(salted.filter(F.octet_length("text") >= depth).select("owner", "salt", "text_key", "text"), "text")
    chosen = packed.join(alive, ["owner", "salt"]).select("owner", "text_key", "text", "grams")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, read = [], 0
        for batch in _slices(batches, 2):
            data, lengths = _joined(_texts(batch.column(2)))
            gram, text, start, count = _runs(data, lengths, depth)
            known = [_from_planes(own, "<u8", GRAM_BYTES) for own in batch.column(3).to_pylist()]
            bits = np.uint64(8 * GRAM_BYTES)
            place = np.repeat(np.arange(len(known), dtype=np.uint64), [len(x) for x in known]) << bits
            low = (np.uint64(1) << bits) - np.uint64(1)
            wanted = (_mixed(gram) & low) | (text.astype(np.uint64) << bits)
            left = np.isin(wanted, np.concatenate(known) | place if known else place)
            gram, text, start, count = gram[left], text[left], start[left], count[left]
            fields = np.zeros(len(gram), dtype=_ENTRY)
            owner, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fields["gram"], fields["owner"], fields["key"], fields["start"], fields["size"] = _mixed(gram), owner[text], key[text], start, count
            blocks = _stretches(data, (np.cumsum(lengths) - lengths)[text] + start, count + depth - 1)
            kept.append((fields, blocks))
            read += len(data)
            if read >= RUN_CHUNK:
                yield _batch(_settled_runs(_Entries(*map(np.concatenate, zip(*kept, strict=True)), depth), buckets), _ROW_SCHEMA)
                kept, read = [], 0
        if kept:
            yield _batch(_settled_runs(_Entries(*map(np.concatenate, zip(*kept, strict=True)), depth), buckets), _ROW_SCHEMA)

    def settle(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [tuple(row.values()) for row in rows if row["kind"] == _SPANS]
        entries = _Entries.unpacked([(row["fields"], row["blocks"]) for row in rows if row["kind"] == _RUNS], depth)
        flag = entries.fields["flag"]
        marked = np.unique(entries.fields["gram"][flag == _WITNESS])
        dealt = np.flatnonzero(flag == _DEALT)
        own = entries.take(np.flatnonzero(flag == _PLAIN))
        order, number, late = own.classes()
        out += _span_rows(*own.covered(order[late]), buckets)
        order, number = order[~late], number[~late]
        gram = own.fields["gram"][order]
        begin = np.flatnonzero(_starts(gram))
        if len(begin):
            classes = np.add.reduceat(_starts(number).astype(np.int64), begin)
            travels = np.isin(gram, marked)
            mixed = np.repeat(classes > 1, np.diff(np.append(begin, len(gram)))) | travels
            out += _ordered_suffixes(own.take(order[mixed]), travels[mixed], buckets)
        if len(dealt):
            spread = entries.take(dealt[np.argsort(entries.fields["gram"][dealt], kind="stable")])
            out += _ordered_suffixes(spread, np.ones(len(dealt), dtype=bool), buckets)
        return _table_of(out)

    def last(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [np.frombuffer(row["fields"], dtype=np.uint8).reshape(3, 8, -1) for row in rows]
        owner, key, place = (np.concatenate([np.ascontiguousarray(part[k].T).view("<i8").ravel() for part in parts]) for k in range(3))
        matrix = np.frombuffer(b"".join(row["blocks"] for row in rows), dtype=np.uint8).reshape(-1, depth)
        late = radix_groups(matrix, owner)
        return _table_of(_span_rows(owner[late], key[late], place[late], place[late] + depth, buckets))

    settled = _written(arrow_pass(chosen, scan, _ROWS).groupBy("bucket").applyInArrow(settle, _ROWS), "suffix-settled")
    ordered = settled.filter(F.col("kind") == _SUFFIXES).groupBy("bucket").applyInArrow(last, _ROWS)
    spans = settled.filter(F.col("kind") == _SPANS).unionByName(ordered).select("owner", "text_key", "fields")
    return spans.groupBy("owner", "text_key").agg(F.collect_list("fields").alias("spans"))


def _written(frame: DataFrame, name: str) -> DataFrame:
    """``written``, and the shuffles behind it are deleted at once: they hold more than the result."""
    settings = frame.sparkSession.conf
    before = settings.get(_CLEANUP, "false")
    settings.set(_CLEANUP, "true")
    try:
        return written(frame, name)
    finally:
        settings.set(_CLEANUP, before)


def _owner() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID))


def _key() -> Column:
    return F.xxhash64("text")


def _cut(documents: DataFrame, depth: int, kept_text: bool) -> DataFrame:
    """All rows with what is left of them: the row as a struct, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    spans = repeated_spans(documents, depth)
    carried = F.struct("*") if kept_text else F.struct("doc_id")
    rows = documents.select(carried.alias("row"), _owner().alias("owner"), _key().alias("text_key"), F.col("text").alias("whole"))
    joined = _compressed(rows, "whole").join(spans, ["owner", "text_key"], "left").select("row", "whole", "spans")
    schema = StructType([joined.schema["row"], *StructType.fromDDL("n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING, kept BINARY").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            sizes, lost, runs, digests, left = [], [], [], [], []
            for text, pieces in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, gaps, begin = [], 0, 0
                if pieces:
                    pairs = np.frombuffer(b"".join(pieces), dtype="<i8").reshape(-1, 2)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    fresh = np.r_[True, pairs[1:, 0] > reach[:-1]]
                    ends = reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(pairs) - 1)]
                    for first, end in zip(pairs[fresh, 0].tolist(), ends.tolist(), strict=True):
                        kept.append(text[begin:first])
                        gaps, begin = gaps + 1, end
                kept.append(text[begin:])
                rest = b"".join(kept)
                sizes.append(len(text))
                lost.append(len(text) - len(rest))
                runs.append(gaps)
                digests.append(sha256(rest).hexdigest())
                left.append(rest if kept_text else None)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, lost, runs)], pa.array(digests, pa.string()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return arrow_pass(joined, run, schema)


def deduplicate(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256 (of the bytes left, joined).

    A byte is removed when a window of ``depth`` bytes around it also starts in a document with a
    smaller doc_id. Windows are judged on the input and never leave their document.

    A null text is empty; texts shorter than a window stay whole, texts of any length are taken
    whole. Rows of one doc_id never remove each other's bytes, so repeated rows stay alike; a
    null doc_id counts as larger than all others. An empty table gives no rows. Only doc_id
    and text are read, so other columns may have any name.
    """
    return _cut(documents.select("doc_id", "text"), depth, False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """All documents with their columns and ``kept_bytes``, the bytes left of the text.

    They are bytes, since a cut may fall inside a character. Cases as in ``deduplicate``.
    """
    return _cut(documents, depth, True).select("row.*", F.col("kept").alias("kept_bytes"))
