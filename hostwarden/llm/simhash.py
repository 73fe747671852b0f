"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within half the radius of
both. Every distinct fingerprint emits all its variants within that half radius,
variants are brought together, and fingerprints of one variant are linked.

The variants of a fingerprint that agree in their leading bits travel as one row
(prefix, fingerprint, bits left to flip) and are written out where they meet. A
prefix that would hold too many variants is split by more leading bits, at most down
to a single variant.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from hostwarden.llm.components import components
from hostwarden.llm.texts import arrow_pass, byte_lists, small_batches, written

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Fingerprints that share a prefix on average.
MEAN_BUCKET = 800
#: Variants that one task writes out at once, and leading bits added where there are more.
MAX_VARIANTS = 6_000_000
STEP_BITS = 4
#: Shingles whose bits are counted at once.
_COUNTED = 16_384

ROUTED = "prefix BIGINT, fp BIGINT, left INT"


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased (A-Z) word shingles of a text, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - shingle + 1)
    pairs = zip(starts[:count].tolist(), ends[-count:].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, count, _COUNTED):
        octets = hashes[i : i + _COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (the fingerprint as a signed number) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = np.array([fingerprint(t, shingle) for t in byte_lists(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return arrow_pass(rows, run, "doc_id BIGINT, text_hash BIGINT, fp BIGINT")


def flips(places: range, most: int) -> np.ndarray:
    """All masks with at most ``most`` of the bits ``places`` set, the empty one first."""
    masks = [sum(1 << p for p in chosen) for n in range(most + 1) for chosen in combinations(places, n)]
    return np.array(masks, dtype=np.uint64)


def _routes(done: int, more: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks over the ``more`` leading bits after the first ``done``, and how many bits each sets."""
    masks = flips(range(BITS - done - more, BITS - done), most)
    return masks, np.bitwise_count(masks).astype(np.int32)


def _route(rows: DataFrame, done: int, more: int, radius: int) -> DataFrame:
    """Send every row (prefix, fp, left) on to the prefixes that ``more`` further bits can lead to."""
    shift = np.uint64(BITS - done - more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, used = _routes(done, more, radius)
        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                part = batch.slice(start, 10_000)
                prefix = part.column(0).to_numpy().view(np.uint64)
                fp, left = part.column(1).to_numpy().view(np.uint64), part.column(2).to_numpy()
                own = (prefix << np.uint64(more)) | ((fp >> shift) & np.uint64((1 << more) - 1))
                for mask, bits in zip(masks, used, strict=True):
                    can = left >= bits
                    columns = (own[can] ^ (mask >> shift)).view(np.int64), fp[can].view(np.int64), (left[can] - bits).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "fp", "left"])

    return arrow_pass(rows, run, ROUTED)


def _linked(fps: np.ndarray, left: np.ndarray, free: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that share a variant; ``free`` is the number of trailing bits that may differ."""
    order = np.argsort(fps)
    fps, left = fps[order], left[order]
    tails = fps & np.uint64((1 << free) - 1)
    keys, owners = [], []
    for most in np.unique(left).tolist():
        rows = np.flatnonzero(left == most)
        masks = flips(range(free), min(most, free))
        keys.append((tails[rows][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(rows, len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    place = np.argsort(key)
    key, owner = key[place], owner[place]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(key))))
    meets = owner != least
    pairs = np.unique(owner[meets] * len(fps) + least[meets])
    a, b = fps[pairs // len(fps)], fps[pairs % len(fps)]
    near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
    return a[near], b[near]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints ``fp`` that connect everything within ``radius`` bits.

    Fingerprints of one variant are all within ``radius`` of each other, so each is linked
    to the least of them instead of to all; connected components lose nothing by that.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("radius must be even")
    distinct = prints.select("fp").distinct()
    number = max(1, distinct.count())
    done = min(BITS - 1, max(1, round(log2(number / MEAN_BUCKET)) if number > MEAN_BUCKET else 1))
    start = distinct.select(F.lit(0).cast("bigint").alias("prefix"), "fp", F.lit(half).alias("left"))
    rows = written(_route(start, 0, done, half), "simhash-routes")
    found = None
    while True:
        # What each prefix would write out; a hot one is split by further bits.
        free = BITS - done
        sizes = [sum(comb(free, i) for i in range(n + 1)) for n in range(half + 1)]
        weight = F.element_at(F.array(*map(F.lit, sizes)), F.col("left") + 1).cast("double")
        hot = rows.groupBy("prefix").agg(F.sum(weight).alias("size")).filter((F.col("size") > MAX_VARIANTS) & F.lit(free > 0))
        hot = written(hot.select("prefix"), "simhash-hot")
        cold = rows.join(hot, "prefix", "left_anti")
        pairs = _pairs(cold, free, radius)
        found = pairs if found is None else found.unionByName(pairs)
        if hot.isEmpty():
            return found.distinct()
        more = min(STEP_BITS, free)
        rows = written(_route(rows.join(hot, "prefix", "left_semi"), done, more, half), "simhash-routes")
        done += more


def _pairs(rows: DataFrame, free: int, radius: int) -> DataFrame:
    if not free:
        # A prefix is one variant now: its members need no group, only their least.
        least = rows.groupBy("prefix").agg(F.min("fp").alias("v"))
        return rows.join(least, "prefix").filter("fp <> v").select(F.col("fp").alias("u"), "v")

    def run(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        a, b = _linked(fps, group.column("left").to_numpy(), free, radius)
        return pa.table({"u": a.view(np.int64), "v": b.view(np.int64)})

    return rows.groupBy("prefix").applyInArrow(run, "u BIGINT, v BIGINT")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, text_hash, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest doc_id that links lead to.

    A null or empty text, or one without words, has fingerprint zero, which is linked
    like any other. Fewer words than a shingle are one shingle. A null doc_id is in a
    component but never its id, unless all ids there are null. Repeated rows are in one
    component. Needs doc_id and text and reads no other column.
    """
    prints = written(fingerprints(documents, shingle), "fingerprints")
    roots = components(links(prints, radius))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = written(rooted.join(ids, "root").select("fp", "component_id"), "simhash-components")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(by_print, "fp").select("doc_id", "text_hash", digits.alias("fingerprint"), "component_id")


def one_per_group(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest doc_id.

    Of rows with equal id, the one with the least text hash stays, once. All columns stay.
    Null and empty texts share the fingerprint zero and are one component. A component whose
    ids are all null keeps one of its rows. An empty table gives an empty one.
    """
    found = near_duplicates(documents, shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    group = F.coalesce("component_id", F.xxhash64("fingerprint"))
    # A component without any id is told from the others by its missing id.
    chosen = found.groupBy(F.col("component_id").isNull().alias("alone"), group.alias("group")).agg(F.min(order).alias("best"))
    best = chosen.select("alone", "group", F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"))
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64("text").alias("row_hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("best_id")) & (F.col("row_hash") == F.col("best_hash"))
    kept = rows.join(best, same).dropDuplicates(["alone", "group"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
