"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words and one end. As bytes, a word is followed by a space
and the end is a line feed. The context of a byte are the ``depth`` bytes before it, in
its own word and in those before; before a text stand line feeds and one space. Every byte
is eight binary decisions; at each of them the Krichevsky-Trofimov estimates of the contexts
of all depths are mixed with the weights of the context tree.

A byte and its ``depth`` bytes of context are a gram. All texts are cut into grams once to
count them and once to score them: every distinct gram is scored once, and a document's
score is the sum over its grams.

The tree is that of all contexts. It is kept in two parts. A context that holds at least
one in ``contexts`` of all bytes is grown: there are at most ``contexts`` of them at each
depth, whatever the corpus, and they are the only part of the tree that is broadcast. Every other
context is in the subtree of its shallowest context that is not grown, which holds less
than that share. Subtrees are weighted and scored by key in Spark: what they say about
their roots goes into the grown tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.frequent_words import code_keys, sums_by_document, word_counts
from hostwarden.llm.texts import arrow_pass, byte_lists, id_remainder, remove_written, small_batches, written

DEPTH = 6
CONTEXTS = 1 << 17
END = 0x0A
#: Bytes that are cut into grams at once, and distinct grams that a task holds before it hands them on.
_CUT, _HELD = 1 << 20, 1 << 20
#: The same for bytes whose grams are looked up.
_LOOK = 1 << 18
#: Groups whose grams are handed on together.
_PIECES = 16
#: Bytes of text whose grams are counted in one group, distinct grams in one group of subtrees, grams weighted at once.
BUCKET, GROUP, _GRAMS = 1 << 23, 1 << 18, 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def stream(found: list[bytes]) -> bytes:
    """The bytes of a text with these words, its end included."""
    return b" ".join(found) + b" \n" if found else b"\n"


def _past(depth: int) -> bytes:
    """The context of a text's first byte."""
    return (b"\n" * depth + b" ")[1:] if depth else b""


def _grams(streams: list[bytes], depth: int, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of all bytes of the streams, some of them at a time: number of the stream, context and byte as one number."""
    ends = np.cumsum(np.fromiter(map(len, streams), np.int64, len(streams)) + depth)
    starts = np.append(0, ends)[:-1]
    past = _past(depth)
    data = b"".join(past + s for s in streams)
    keep = np.ones(len(data), dtype=bool)
    keep[(ends[:, None] - 1 - np.arange(depth)).ravel()] = False
    padded = data + bytes(8)
    size = size or _CUT
    for lo in range(0, len(data), size):
        hi = min(lo + size, len(data))
        code = np.ndarray((hi - lo,), dtype=">u8", buffer=padded, offset=lo, strides=(1,))[keep[lo:hi]].astype(np.uint64)
        code >>= np.uint64(8 * (7 - depth))
        yield np.repeat(np.arange(len(streams)), np.clip(ends - depth, lo, hi) - np.clip(starts, lo, hi)), code


def _key(context: np.ndarray, depth: int) -> np.ndarray:
    """Number of a context: a one before its bytes, so that keys rise with the depth."""
    one = np.uint64(1 << (8 * depth))
    return (context & (one - np.uint64(1))) | one


def _path(context: np.ndarray, depth: int) -> np.ndarray:
    """The context's bytes in reverse, so that a subtree's contexts share their first bytes."""
    path = np.zeros_like(context)
    for back in range(depth):
        path = (path << np.uint64(8)) | ((context >> np.uint64(8 * back)) & np.uint64(255))
    return path


def _deepest(keys: np.ndarray, context: np.ndarray, known: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``keys`` and depth of the deepest context among them, -1 without any."""
    found, level = np.full(len(context), -1, dtype=np.int64), np.full(len(context), -1, dtype=np.int64)
    for d in range(depth if len(keys) else -1, -1, -1):
        open_ = np.flatnonzero((found < 0) & (known >= d))
        key = _key(context[open_], d)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        found[open_[hit]], level[open_[hit]] = at[hit], d
    return found, level


def _starts(keys: np.ndarray) -> np.ndarray:
    """First places of equal neighbours; no key is -1."""
    return np.flatnonzero(np.diff(keys, prepend=-1))


def _summed(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes, ascending, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = _starts(codes)
    return codes[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c for c in counts)


def _packed(numbers: np.ndarray) -> bytes:
    """An array of 64-bit numbers as bytes: the length and the compressed numbers."""
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(numbers), asbytes=True)


def _unpacked(blob: bytes, kind: type = np.int64) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(pa.py_buffer(blob)[8:], 8 * size), kind)


def _arrays(*columns: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of arrays of 64-bit integers."""
    for row in zip(*(c.to_pylist() for c in columns), strict=True):
        yield tuple(map(_unpacked, row))


def gram_counts(streams: DataFrame, depth: int, size: int, found: Callable[[bytes | None], bytes] | None = None) -> DataFrame:
    """Distinct grams of byte strings that each begin a text, in rows of packed arrays: ``codes`` (context, then byte), ``n`` (in training) and ``everywhere``.

    ``streams`` has a byte string, or what ``found`` makes one of, how often it occurs in
    training and how often everywhere; ``size`` is about the sum of their lengths. Contexts
    that differ in their oldest byte only are in one row.
    """
    buckets = max(1, -(-size // BUCKET))

    def pieces(codes: np.ndarray, n: np.ndarray, everywhere: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = (codes.astype(np.uint64) >> np.uint64(8)) & np.uint64((1 << (8 * max(depth - 1, 0))) - 1)
        bucket = (((near * _MIX) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ranges = list(_slices(bucket[order]))
        for here in range(0, len(ranges), _PIECES):
            part = ranges[here : here + _PIECES]
            blobs = [pa.array([_packed(c[order[a:b]]) for a, b in part], pa.binary()) for c in (codes, n, everywhere)]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[order[a]]) for a, _ in part], pa.int64()), *blobs], names=["bucket", "codes", "n", "everywhere"])

    def counted(texts: list[bytes], n: np.ndarray, everywhere: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        once = bool((everywhere == 1).all())
        for number, code in _grams(texts, depth):
            if once:
                # A sort of numbers alone is many times faster than one that keeps track of places.
                both, times = np.unique((code << np.uint64(1)) | n[number].astype(np.uint64), return_counts=True)
                yield (both >> np.uint64(1)).astype(np.int64), times * (both & np.uint64(1)).astype(np.int64), times
            else:
                yield _summed(code.astype(np.int64), n[number], everywhere[number])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in small_batches(batches, 0):
            texts = byte_lists(batch.column(0))
            for part in counted([found(t) for t in texts] if found else texts, *(batch.column(i).to_numpy() for i in (1, 2))):
                held.append(part)
                if sum(len(p[0]) for p in held) > _HELD:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > _HELD // 2:
                        yield from pieces(*held.pop())
        if held:
            yield from pieces(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    def add(rows: pa.Table) -> pa.Table:
        columns = (np.concatenate([_unpacked(b) for b in rows.column(c).to_pylist()]) for c in ("codes", "n", "everywhere"))
        return pa.table({name: pa.array([_packed(c)], pa.binary()) for name, c in zip(("codes", "n", "everywhere"), _summed(*columns), strict=True)})

    parts = arrow_pass(streams, run, "bucket BIGINT, codes BINARY, n BINARY, everywhere BINARY")
    return written(parts.groupBy("bucket").applyInArrow(add, "codes BINARY, n BINARY, everywhere BINARY"), "byte-grams")


def word_grams(vocabulary: DataFrame, ends: int, depth: int) -> DataFrame:
    """``gram_counts`` of a word table (word, freq, counted) where each word begins a text, and of so many empty texts."""
    size = vocabulary.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).head()[0]
    rows = vocabulary.select(F.concat("word", F.lit(b" ")).alias("word"), "counted", "freq").filter("freq > 0")
    empty = vocabulary.sparkSession.createDataFrame([(bytearray(stream([])), ends, ends)] if ends else [], "word BINARY, counted BIGINT, freq BIGINT")
    return gram_counts(rows.unionByName(empty), depth, size)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5 by Stirling's series, shifted by 8."""
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to so many zeros and ones."""
    out = np.empty(len(zeros))
    for at in range(0, len(out), _CUT // 8):
        a, b = zeros[at : at + _CUT // 8], ones[at : at + _CUT // 8]
        out[at : at + len(a)] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)
    return out


@dataclass
class Tree:
    """The grown contexts, and what the tree says at each of their binary nodes.

    ``nodes`` are numbered context place * 256 + bits so far (with a leading one). The
    probability of a one is ``decided`` plus ``share`` times what the deeper contexts
    say, which is one half where none has met these bits.
    """

    depth: int
    keys: np.ndarray
    parents: np.ndarray
    nodes: np.ndarray
    decided: np.ndarray
    share: np.ndarray

    @classmethod
    def grow(cls, contexts: np.ndarray, bytes_: np.ndarray, counts: np.ndarray, depth: int, roots: np.ndarray, weights: np.ndarray) -> Tree:
        """From the counts of the grown contexts (keys, bytes, how often) and the log weights of the subtrees below them.

        ``roots`` are a grown context's key * 256 + bits so far.
        """
        keys, place = np.unique(contexts, return_inverse=True)
        level = np.zeros(len(keys), dtype=np.int64)
        for d in range(1, depth + 1):
            level += keys >= np.uint64(1 << (8 * d))
        shift = (8 * np.maximum(level - 1, 0)).astype(np.uint64)
        parent_keys = (keys & ((np.uint64(1) << shift) - np.uint64(1))) | (np.uint64(1) << shift)
        parents = np.searchsorted(keys, parent_keys)
        final = level == depth

        node_parts, one_parts, zero_parts = [], [], []
        for bit in range(8):
            prefix = (1 << bit) | (bytes_.astype(np.int64) >> (8 - bit))
            value = (bytes_.astype(np.int64) >> (7 - bit)) & 1
            node, back = np.unique(place * 256 + prefix, return_inverse=True)
            node_parts.append(node)
            one_parts.append(np.bincount(back, weights=counts * value, minlength=len(node)))
            zero_parts.append(np.bincount(back, weights=counts * (1 - value), minlength=len(node)))
        nodes, ones, zeros = np.concatenate(node_parts), np.concatenate(one_parts), np.concatenate(zero_parts)
        del node_parts, one_parts, zero_parts, place, node, back, prefix, value
        order = np.argsort(nodes)
        nodes, ones, zeros = nodes[order], ones[order], zeros[order]
        own = (nodes >> 8).astype(np.int32)
        depth_of = level.astype(np.int8)[own]
        up = np.searchsorted(nodes, parents[own] * 256 + (nodes & 255)).astype(np.int32)
        del order

        # From the leaves to the root: weighted probabilities, those of the subtrees included.
        estimate = _log_estimate(zeros, ones)
        weighted, split = estimate.copy(), np.zeros(len(nodes))
        below = np.searchsorted(keys, (roots >> 8).astype(np.uint64)) * 256 + (roots & 255)
        np.add.at(split, np.searchsorted(nodes, below), weights)
        for d in range(depth, -1, -1):
            at = np.flatnonzero(depth_of == d)
            inner = at[~final[own[at]]]
            weighted[inner] = np.logaddexp(estimate[inner], split[inner]) - np.log(2)
            if d:
                np.add.at(split, up[at], weighted[at])

        # From the root to the leaves: what the contexts so far have decided, and the share that is left.
        stop = 1 / (1 + np.exp(np.clip(split - estimate, -700, 700)))
        stop[final[own]] = 1.0
        del estimate, weighted, split
        decided, share = stop * (ones + 0.5) / (zeros + ones + 1), 1 - stop
        for d in range(1, depth + 1):
            at = np.flatnonzero(depth_of == d)
            decided[at] = decided[up[at]] + share[up[at]] * decided[at]
            share[at] *= share[up[at]]
        return cls(depth, keys, parents, nodes, decided, share)

    def decisions(self, places: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the eight bits of ``symbols``: the bit, and ``decided`` and ``share`` at the contexts ``places`` (-1: none)."""
        for bit in range(8):
            at, prefix = places.copy(), (1 << bit) | (symbols >> (8 - bit))
            decided, share = np.zeros(len(at)), np.ones(len(at))
            open_, first = np.flatnonzero(at >= 0), True
            while len(open_):
                node = at[open_] * 256 + prefix[open_]
                place = np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
                hit = self.nodes[place] == node
                found, place = open_[hit], place[hit]
                # Bits that the deepest context has not met are one half below any context above it.
                decided[found] = self.decided[place] + (0 if first else 0.5 * self.share[place])
                share[found] = self.share[place] if first else 0
                # The root's parent is the root, so what it has not met ends there.
                open_, first = open_[~hit & (at[open_] > 0)], False
                at[open_] = self.parents[at[open_]]
            yield (symbols >> (7 - bit)) & 1, decided, share

    def _log10(self, places: np.ndarray, byte: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(places * 256 + byte.astype(np.int64), return_inverse=True)
        total = np.zeros(len(pairs))
        for bit, decided, share in self.decisions(pairs >> 8, pairs & 255):
            one = decided + 0.5 * share
            total += np.log10(np.where(bit, one, 1 - one))
        return total[back]

    def log10(self, context: np.ndarray, known: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Log10 probability of bytes after contexts, as far as the grown contexts tell."""
        return self._log10(_deepest(self.keys, context, known, self.depth)[0], byte)

    def score(self, found: list[bytes]) -> np.ndarray:
        """Log10 probability of each word with its space at a text's beginning, as far as the grown contexts tell."""
        total = np.zeros(len(found))
        for number, code in _grams([w + b" " for w in found], self.depth):
            known = np.full(len(code), self.depth)
            total += np.bincount(number, weights=self.log10(code >> np.uint64(8), known, code & np.uint64(255)), minlength=len(found))
        return total

    def end_score(self) -> float:
        """Log10 probability of the end of a text without words."""
        context = np.array([int.from_bytes(_past(self.depth), "big")], dtype=np.uint64)
        return float(self.log10(context, np.array([self.depth]), np.array([END], dtype=np.uint64))[0])


class Subtrees:
    """Subtrees of contexts that are not grown.

    ``codes`` are their grams: depth of the subtree's root, reversed context and byte, in
    ascending order; a subtree is there as a whole. ``counts`` are the grams' training
    counts. A gram that training lacks has count 0, which changes no weight.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int) -> None:
        self.depth, self.codes = depth, codes
        # By depth: grams of that depth, counts, and of the deeper grams, those that are no root's first, the place in them.
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {depth: (codes, counts)}
        self.up: dict[int, np.ndarray] = {}
        most = 0
        for d in range(depth, 0, -1):
            keys, n = self.levels[d]
            most = max(most, int(np.add.reduceat(n, _starts(keys >> 8)).max(initial=0))) if len(keys) else most
            inner = keys[: np.searchsorted(keys, d << 56)]
            above = (inner >> 56 << 56) | ((inner & ((1 << 56) - 1)) >> 16 << 8) | (inner & 255)
            keys, self.up[d] = np.unique(above, return_inverse=True)
            self.levels[d - 1] = keys, np.bincount(self.up[d], weights=n[: len(inner)], minlength=len(keys)).astype(np.int64)
        steps = np.arange(most + 1, dtype=np.float64)
        self._half, self._whole = _log_gamma(steps + 0.5) - 0.5 * np.log(np.pi), _log_gamma(steps + 1)

    def weigh(self, bit: int) -> dict[int, tuple[np.ndarray, ...]]:
        """By depth, of its nodes after so many bits: first gram, parent (all but the roots), log weight, stop share, estimate of a one."""
        found: dict[int, tuple[np.ndarray, ...]] = {}
        split = np.zeros(0)
        for d in range(self.depth, 0, -1):
            keys, n = self.levels[d]
            if not len(keys):
                break
            starts = _starts(keys >> (8 - bit))
            ones = np.add.reduceat(n * ((keys >> (7 - bit)) & 1), starts)
            both = np.add.reduceat(n, starts)
            estimate = self._half[ones] + self._half[both - ones] - self._whole[both]
            if d == self.depth:
                weighted, stop = estimate, np.ones(len(starts))
            else:
                weighted, stop = np.logaddexp(estimate, split) - np.log(2), 1 / (1 + np.exp(np.clip(split - estimate, -700, 700)))
            shallower = self.levels[d - 1][0]
            number = np.cumsum(np.diff(shallower >> (8 - bit), prepend=-1) != 0) - 1
            parent = number[self.up[d][starts[: np.searchsorted(starts, len(self.up[d]))]]]
            split = np.bincount(parent, weights=weighted[: len(parent)], minlength=number[-1] + 1 if len(number) else 0)
            found[d] = starts, parent, weighted, stop, (ones + 0.5) / (both + 1)
        return found

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """Log weights of the roots: key of the grown context above * 256 + bits so far, sum."""
        nodes, weights = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for bit in range(8):
            for d, (starts, parent, weighted, _, _) in self.weigh(bit).items():
                code = self.levels[d][0][starts[len(parent) :]]
                nodes.append((self._above(code, d) << 8) | (1 << bit) | ((code & 255) >> (8 - bit)))
                weights.append(weighted[len(parent) :])
        nodes, back = np.unique(np.concatenate(nodes), return_inverse=True)
        return nodes, np.bincount(back, weights=np.concatenate(weights), minlength=len(nodes))

    @staticmethod
    def _above(codes: np.ndarray, depth: int) -> np.ndarray:
        """Key of the grown context above the roots of ``depth`` with these grams of that depth."""
        context = _path(((codes & ((1 << 56) - 1)) >> 16).astype(np.uint64), depth - 1)
        return _key(context, depth - 1).astype(np.int64)

    def log10(self, tree: Tree) -> np.ndarray:
        """Log10 probability of each gram's byte after its context, ``tree`` being the grown one."""
        root = self.codes >> 56
        above = np.zeros(len(root), dtype=np.int64)
        for d in range(1, self.depth + 1):
            at = slice(*np.searchsorted(root, (d, d + 1)))
            inside = self.codes[at] & ((1 << 56) - 1)
            above[at] = self._above((inside >> (8 + 8 * (self.depth - d)) << 8), d)
        pairs, back = np.unique(np.searchsorted(tree.keys, above.astype(np.uint64)) * 256 + (self.codes & 255), return_inverse=True)
        total = np.zeros(len(root))
        for bit, (value, sure, left) in enumerate(tree.decisions(pairs >> 8, pairs & 255)):
            decided, share = np.zeros(0), np.zeros(0)
            nodes = self.weigh(bit)
            for d in sorted(nodes):
                starts, parent, _, stop, single = nodes[d]
                so_far, open_ = np.zeros(len(starts)), np.ones(len(starts))
                so_far[: len(parent)], open_[: len(parent)] = decided[parent], share[parent]
                decided, share = so_far + open_ * stop * single, open_ * (1 - stop)
            sizes = np.diff(nodes[self.depth][0], append=len(root))
            one = sure[back] + left[back] * np.repeat(decided, sizes)
            total += np.log10(np.where(value[back], one, 1 - one))
        return total


def _slices(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are equal in all ``keys``, which are in order."""
    if len(keys[0]):
        borders = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        yield from zip([0, *borders.tolist()], [*borders.tolist(), len(keys[0])], strict=True)


def grown_contexts(grams: DataFrame, depth: int, contexts: int) -> np.ndarray:
    """Keys of the contexts with at least one in ``contexts`` of all bytes, and of those of a text's first byte, ascending."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for (c,) in _arrays(batch.column(0))], pa.int64())], names=["total"])

    least = -(-(arrow_pass(grams.select("everywhere"), total, "total BIGINT").agg(F.coalesce(F.sum("total"), F.lit(0))).head()[0]) // contexts)
    first = np.array([int.from_bytes(_past(depth), "big")], dtype=np.uint64)
    always = np.array([int(_key(first, d)[0]) for d in range(depth + 1)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in _arrays(*batch.columns):
                keys, sums = codes >> 8, counts
                for d in range(depth, -1, -1):
                    keys, sums = _summed(_key(keys.astype(np.uint64), d).astype(np.int64), sums)
                    # The deepest contexts are whole here.
                    chosen = (sums >= least) | np.isin(keys, always) if d >= depth - 1 else slice(None)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[chosen]), pa.array(sums[chosen])], names=["context", "times"])

    sizes = arrow_pass(grams.select("codes", "everywhere"), run, "context BIGINT, times BIGINT").groupBy("context").agg(F.sum("times").alias("times"))
    grown = sizes.filter((F.col("times") >= least) | F.col("context").isin(always.tolist())).select("context").toArrow()
    return np.sort(grown.column(0).to_numpy()).astype(np.uint64)


def grown_counts(grams: DataFrame, shared: Broadcast, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (key of a grown context, then byte) and training counts of all grown contexts (a broadcast of their keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in _arrays(*batch.columns):
                context = (codes >> 8).astype(np.uint64)
                place, _ = _deepest(shared.value, context, np.full(len(codes), depth), depth)
                codes, counts = _summed((shared.value[place].astype(np.int64) << 8) | (codes & 255), counts)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    deepest = arrow_pass(grams.select("codes", "n"), run, "code BIGINT, n BIGINT").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, counts = _summed(*(deepest.column(i).to_numpy() for i in range(2)))
    # A gram is counted at its deepest grown context; those above have it, too.
    found = []
    for d in range(depth, -1, -1):
        split = np.searchsorted(codes, 1 << (8 * d + 8))
        own, n = codes[split:], counts[split:]
        found.append((own, n))
        if d:
            above = (_key((own >> 8).astype(np.uint64), d - 1).astype(np.int64) << 8) | (own & 255)
            codes, counts = _summed(np.append(codes[:split], above), np.append(counts[:split], n))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def subtree_grams(grams: DataFrame, shared: Broadcast, depth: int) -> DataFrame:
    """All grams, those of contexts that are not grown in rows that hold whole subtrees.

    Columns are packed arrays: ``codes`` and ``counts`` as in Subtrees, ``everywhere``, and
    ``roots`` and ``weights`` (the subtrees' log weights). Grams of grown contexts have depth + 1
    for the depth of the root and are in rows of their own.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(c) for (c,) in _arrays(batch.column(0))], pa.int64())], names=["size"])

    size = arrow_pass(grams.select("codes"), lengths, "size BIGINT").agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    groups = max(1, -(-size // GROUP))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, *counts in _arrays(*batch.columns):
                context = (codes >> 8).astype(np.uint64)
                level = _deepest(shared.value, context, np.full(len(codes), depth), depth)[1]
                root, path = (level + 1).astype(np.uint64), _path(context, depth)
                top = path >> (np.uint64(8) * (np.uint64(depth) - np.minimum(root, np.uint64(depth))))
                group = ((((top << np.uint64(3)) | root) * _MIX) >> np.uint64(32)) % np.uint64(groups)
                code = ((root << np.uint64(56)) | (path << np.uint64(8))).astype(np.int64) | (codes & 255)
                order = np.argsort(group, kind="stable")
                group, columns = group[order].astype(np.int64), [c[order] for c in (code, *counts)]
                ranges = list(_slices(group))
                blobs = [pa.array([_packed(c[a:b]) for a, b in ranges], pa.binary()) for c in columns]
                numbers = pa.array([int(group[a]) for a, _ in ranges], pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, *blobs], names=["part", "codes", "counts", "everywhere"])

    def weigh(rows: pa.Table) -> pa.Table:
        codes, *counts = (np.concatenate([_unpacked(b) for b in rows.column(c).to_pylist()]) for c in ("codes", "counts", "everywhere"))
        order = np.argsort(codes, kind="stable")
        codes, (n, everywhere) = codes[order], (c[order] for c in counts)
        # Chunks end where a subtree ends, and where the grams of grown contexts begin.
        root = codes >> 56
        inside = np.searchsorted(codes, (depth + 1) << 56)
        first = _starts(((root << 56) | ((codes & ((1 << 56) - 1)) >> (8 + 8 * (depth - np.minimum(root, depth)))))[:inside])
        ends = np.append(first[1:], inside)[: len(first)]
        ends = ends[np.flatnonzero(np.diff(ends // _GRAMS, append=-1))]
        ends = np.unique(np.append(ends, len(codes)))
        out = {name: [] for name in ("codes", "counts", "everywhere", "roots", "weights")}
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            roots, weights = Subtrees(codes[a:b], n[a:b], depth).roots() if a < inside else (np.zeros(0, dtype=np.int64), np.zeros(0))
            for name, column in zip(out, (codes[a:b], n[a:b], everywhere[a:b], roots, weights), strict=True):
                out[name].append(_packed(column))
        return pa.table({name: pa.array(blobs, pa.binary()) for name, blobs in out.items()})

    pieces = arrow_pass(grams.select("codes", "n", "everywhere"), cut, "part BIGINT, codes BINARY, counts BINARY, everywhere BINARY")
    shape = "codes BINARY, counts BINARY, everywhere BINARY, roots BINARY, weights BINARY"
    return written(pieces.groupBy("part").applyInArrow(weigh, shape), "context-subtrees")


def root_weights(subtrees: DataFrame) -> DataFrame:
    """``node`` (grown context's key * 256 + bits so far) and ``weight``, the sum of the log weights of the subtrees below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for roots, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arrays = [pa.array(_unpacked(roots)), pa.array(_unpacked(weights, np.float64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "weight"])

    return arrow_pass(subtrees.select("roots", "weights"), run, "node BIGINT, weight DOUBLE").groupBy("node").agg(F.sum("weight").alias("weight"))


def fit_grams(grams: DataFrame, depth: int = DEPTH, contexts: int = CONTEXTS) -> tuple[Tree, DataFrame]:
    """The grown tree and all subtrees below it, of the grams of ``gram_counts``."""
    shared = grams.sparkSession.sparkContext.broadcast(grown_contexts(grams, depth, contexts))
    codes, counts = grown_counts(grams, shared, depth)
    subtrees = subtree_grams(grams, shared, depth)
    roots = root_weights(subtrees).toArrow()
    keys, bytes_ = (codes >> 8).astype(np.uint64), codes & 255
    return Tree.grow(keys, bytes_, counts.astype(np.float64), depth, roots.column(0).to_numpy(), roots.column(1).to_numpy()), subtrees


def fit(vocabulary: DataFrame, ends: int, depth: int = DEPTH, contexts: int = CONTEXTS) -> tuple[Tree, DataFrame]:
    """The grown tree and all subtrees below it, of a word table (word, freq, counted) where each word begins a text, and of so many empty texts."""
    return fit_grams(word_grams(vocabulary, ends, depth), depth, contexts)


def train(vocabulary: DataFrame, ends: int, depth: int = DEPTH, contexts: int = CONTEXTS) -> Tree:
    """The grown part of ``fit``."""
    return fit(vocabulary, ends, depth, contexts)[0]


def score_grams(tree: Tree, subtrees: DataFrame) -> DataFrame:
    """``word`` (key of a gram's code), ``freq`` (everywhere) and ``score`` of every gram."""
    shared = subtrees.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts, everywhere in _arrays(*batch.columns):
                depth = shared.value.depth
                context = _path(((codes & ((1 << 56) - 1)) >> 8).astype(np.uint64), depth)
                if codes[0] >> 56 > depth:
                    scores = shared.value.log10(context, np.full(len(codes), depth), codes & 255)
                else:
                    scores = Subtrees(codes, counts, depth).log10(shared.value)
                keys = code_keys((context << np.uint64(8)) | (codes & 255).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([keys, pa.array(everywhere), pa.array(scores)], names=["word", "freq", "score"])

    return arrow_pass(subtrees.select("codes", "counts", "everywhere"), run, "word BINARY, freq BIGINT, score DOUBLE")


def score_words(vocabulary: DataFrame, tree: Tree, subtrees: DataFrame) -> DataFrame:
    """``vocabulary`` (word, freq, counted) with ``score`` of every word at a text's beginning."""
    depth = tree.depth
    rows = vocabulary.select(F.col("word").alias("text"), "word", "freq", "counted")
    nothing = vocabulary.select("word", "freq").limit(0)
    grams = score_grams(tree, subtrees)
    sums = sums_by_document(rows, nothing, lambda text: [text], ["score"], lambda texts: _grams([t[0] + b" " if t else b" " for t in texts], depth), grams)
    return sums.select("word", "freq", "counted", "score")


def score_texts(documents: DataFrame, training: str, depth: int = DEPTH, contexts: int = CONTEXTS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``training`` is an SQL condition on the documents' columns; rows where it is not
    true are only scored. ``base_score`` is the add-one unigram log10 probability,
    ``score`` the context tree's, both of all words and the end.

    A null text is empty: one token, the end. Its bits_per_byte count the end as one
    byte. A null doc_id stays null, repeated rows count as often as they come. With
    no training row N, V and all counts are 0 and every bit has probability 1/2. Needs
    doc_id, text and what ``training`` names.
    """
    rows = documents.select("doc_id", "text", F.coalesce(F.expr(training), F.lit(False)).alias("trains"))
    vocabulary = written(word_counts(rows, words, "trains"), "words")
    trains = F.col("trains")
    ends = rows.filter(trains).count()
    sums = vocabulary.filter("counted > 0").agg(F.coalesce(F.sum("counted"), F.lit(0)), F.count("*")).head()
    tokens, distinct = sums[0] + ends, sums[1] + (ends > 0)
    size = vocabulary.agg(F.coalesce(F.sum(F.col("freq") * (F.length("word") + 1)), F.lit(0))).head()[0]
    grams = gram_counts(rows.select("text", trains.cast("bigint"), F.lit(1).cast("bigint").alias("once")), depth, size, lambda text: stream(words(text or b"")))
    tree, subtrees = fit_grams(grams, depth, contexts)
    remove_written(grams)

    def base(count: object) -> object:
        return F.log10((count + 1) / F.lit(float(tokens + distinct + 1)))

    valued = vocabulary.select("word", "freq", (F.col("counted") > 0).cast("bigint").alias("n_known"), base(F.col("counted")).alias("base_score"))
    scores = written(score_grams(tree, subtrees), "gram-scores")
    found = sums_by_document(
        rows.select("doc_id", "text"), valued, words, ["n_known", "base_score", "score"], lambda texts: _grams([stream(t) for t in texts], depth, _LOOK), scores
    )
    score = F.col("score")
    # Bytes of the scored sequence: words, a space each, and the end.
    size = F.greatest(F.col("n_bytes"), F.lit(1))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + base(F.lit(ends))).alias("base_score"),
        score.alias("score"),
        (-score * np.log2(10) / size).alias("bits_per_byte"),
    )


def score_with_folds(documents: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Learn outside fold ``held`` of crc32(doc_id) mod ``modulus``, score all documents."""
    fold = id_remainder("doc_id", modulus)
    rows = documents.select("doc_id", "text", (fold != held).alias("in_training"))
    return score_texts(rows, "in_training").withColumn("held_out", fold == held)
