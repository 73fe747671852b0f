"""Embedding whitening by shifted CholeskyQR.

The centred rows A of the fit list are orthogonalised by passes over the whole table: a
pass applies the triangular solves found so far to each block of rows, Q = A R1^-1 R2^-1 ...,
and sums the Gram matrix Q'Q; its Cholesky factor is the next R. The first Gram matrix may be
too ill-conditioned for that, so it is shifted by a multiple of the unit matrix, and the next
passes take away what the shift left. The factors compose to R = ... R2 R1 with A = Q R, and
the singular values and right vectors of R are those of A: deviations and components.

Between the passes only a Gram matrix of ``dimension`` squared numbers comes to the driver,
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostwarden.llm.texts import arrow_pass, remove_written, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this are no vector entries: their x could not be summed exactly.
LARGEST = float(2**40)
#: Rows whose products are summed at once.
BLOCK = 4096
#: Gram passes at most; three settle a matrix of full rank, dependent columns take two more.
PASSES = 8
#: Q counts as orthonormal when the eigenvalues of its Gram matrix are this near to 1 (or to 0 for dependent columns).
SETTLED = 1e-10
_EPS = float(np.finfo(np.float64).eps)
_LOW_BITS = 20


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: number and sums of the fitted vectors, components as columns, their variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total_variance: float
    identity_error: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and a remainder in units of 1 / n, so that differences are exact."""
        whole = [total // max(self.n, 1) for total in self.sums]
        rest = [total - mean * self.n for total, mean in zip(self.sums, whole, strict=True)]
        return np.array(whole, dtype=np.int64), np.array(rest, dtype=np.int64)


def quantised(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The usable rows with ``x``: whole numbers floor(scale * entry) + offset.

    A row goes when its vector is null or has an entry that is null, not finite or beyond LARGEST.
    """
    usable = F.forall(vector, lambda c: F.abs(c.cast("double")) <= F.lit(LARGEST))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(offset).cast("bigint"))
    return embeddings.filter(F.col(vector).isNotNull() & F.coalesce(usable, F.lit(False))).withColumn("x", x)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _totals(fit: DataFrame, dimension: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sum over all blocks of rows of ``part(block)``, a vector of the same length for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = _matrix(batch.column(0), dimension)
            for start in range(0, len(rows), BLOCK):
                own = part(rows[start : start + BLOCK])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    wide = "decimal(38,0)" if kind == "BIGINT" else "double"
    cells = arrow_pass(fit.select("x"), run, f"cell INT, value {kind}").groupBy("cell").agg(F.sum(F.col("value").cast(wide)).alias("value"))
    return [row["value"] for row in cells.orderBy("cell").collect()]


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums; high and low bits are summed apart, so neither overflows."""

    def part(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(rows)], (rows >> _LOW_BITS).sum(axis=0), (rows & ((1 << _LOW_BITS) - 1)).sum(axis=0)])

    totals = [int(value) for value in _totals(fit, dimension, part, "BIGINT")]
    high, low = totals[1 : dimension + 1], totals[dimension + 1 :]
    return totals[0], [(h << _LOW_BITS) + lo for h, lo in zip(high, low, strict=True)]


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular factor, by substitution."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _gram(fit: DataFrame, model: Whitening, factors: list[np.ndarray]) -> np.ndarray:
    """Q'Q over all rows, for Q = centred rows behind the solves with all factors."""
    whole, rest = model.centre()
    shares = rest / model.n
    upper = np.triu_indices(model.dimension)

    def part(rows: np.ndarray) -> np.ndarray:
        q = (rows - whole) - shares
        for factor in factors:
            q = _solved(q, factor)
        return (q.T @ q)[upper]

    gram = np.zeros((model.dimension, model.dimension))
    gram[upper] = _totals(fit, model.dimension, part, "DOUBLE")
    return gram + np.triu(gram, 1).T


def _settled(values: np.ndarray) -> bool:
    return bool(np.all((np.abs(values - 1) < SETTLED) | (np.abs(values) < SETTLED)))


def _factorised(fit: DataFrame, model: Whitening) -> tuple[np.ndarray, float]:
    """A matrix M with M'M = A'A to full precision, and the trace of A'A."""
    size = model.dimension
    factors, composed, trace = [], np.eye(size), 0.0
    for number in range(PASSES):
        gram = _gram(fit, model, factors)
        values, vectors = np.linalg.eigh(gram)
        if number == 0:
            trace = float(np.trace(gram))
        if trace == 0 or (number and _settled(values)):
            break
        # Shift of the published method, for sums of BLOCK rows; none where Q is nearly orthonormal.
        needed = number == 0 or values[0] < 0.5
        shift = 11 * (size * BLOCK + size * (size + 1)) * _EPS * float(values[-1]) if needed else 0.0
        factor = np.linalg.cholesky(gram + shift * np.eye(size)).T
        factors.append(factor)
        composed = factor @ composed
    else:
        gram = _gram(fit, model, factors)
        values, vectors = np.linalg.eigh(gram)
    # What the last pass measured goes in as well: A'A = R' (Q'Q) R.
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    return root @ composed, trace


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``vectors``; None if there is no vector.

    Vectors of another length than the most frequent one (the longer at ties) belong to no
    common space and are left out. Directions without variance give no component.
    """
    distinct = written(vectors.select("x").distinct(), "whitening-fit")
    sizes = distinct.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).filter("size > 0")
    most = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not most:
        return None
    dimension = int(most[0]["size"])
    rows = distinct.filter(F.size("x") == dimension)
    n, sums = _sums(rows, dimension)
    start = Whitening(n, tuple(sums), np.zeros((dimension, 0)), np.zeros(0), 0.0, 0.0)
    matrix, trace = _factorised(rows, start)
    _, deviations, right = np.linalg.svd(matrix)
    kept = [k for k in range(min(components, dimension)) if deviations[k] > 4 * dimension * _EPS * deviations[0]]
    model = Whitening(n, tuple(sums), right[kept].T.copy(), deviations[kept] ** 2 / n, trace / n, 0.0)
    error = _identity_error(rows, model)
    remove_written(distinct)
    return Whitening(model.n, model.sums, model.components, model.variances, model.total_variance, error)


def _projected(rows: np.ndarray, model: Whitening, whole: np.ndarray, shares: np.ndarray) -> np.ndarray:
    return (((rows - whole) - shares) @ model.components) / np.sqrt(model.variances)


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the unit matrix, over the fit list."""
    count = len(model.variances)
    if not count:
        return 0.0
    whole, rest = model.centre()
    shares = rest / model.n
    upper = np.triu_indices(count)

    def part(block: np.ndarray) -> np.ndarray:
        white = _projected(block, model, whole, shares)
        return np.concatenate([white.sum(axis=0), (white.T @ white)[upper]])

    totals = np.array(_totals(rows, model.dimension, part, "DOUBLE"))
    mean = totals[:count] / model.n
    covariance = np.zeros((count, count))
    covariance[upper] = totals[count:] / model.n
    covariance -= np.triu(np.outer(mean, mean))
    return float(np.abs(covariance - np.eye(count))[upper].max())


def _deviation(rows: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """Sum over dimensions of (n * x - S) squared; null where that is no long."""
    apart = (rows - whole).astype(np.float64) * n - rest
    fits = (apart * apart).sum(axis=1) < 2.0**62
    safe = np.where(fits[:, None], rows - whole, 0) * n - np.where(fits[:, None], rest, 0)
    return pa.array((safe * safe).sum(axis=1), pa.int64(), mask=~fits)


def transform(vectors: DataFrame, model: Whitening, key: str) -> DataFrame:
    """A row per vector and component: the key, component (from 1), n, deviation, whitened, explained, identity_error."""
    whole, rest = model.centre()
    shares, count = rest / model.n, len(model.variances)
    explained = model.variances / model.total_variance if count else model.variances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if count else 0, BLOCK):
                part = batch.slice(start, BLOCK)
                rows = _matrix(part.column(1), model.dimension)
                size = len(rows)
                each = pa.array(np.repeat(np.arange(size), count))
                columns = [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, model.n, dtype=np.int64)),
                    _deviation(rows, whole, rest, model.n).take(each),
                    pa.array(_projected(rows, model, whole, shares).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * count, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"
    return arrow_pass(vectors.filter(F.size("x") == model.dimension).select(key, "x"), run, schema)


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable vector on up to ``components`` components.

    Fitted on each distinct quantised vector once. A row per vector and component: key,
    component, n, deviation, whitened, explained, identity_error. Only key and vector are read,
    so other columns may have any name. Rows with a null or unusable vector go (see
    ``quantised``), a null key stays, repeated rows stay and count once in the fit, vectors of an
    uncommon length go (see ``fit``). Directions without variance have no rows, so equal
    vectors, a single one and an empty table give none. Equal variances leave the choice of
    their components open; it is one choice for all rows.
    """
    vectors = quantised(embeddings.select(key, vector), vector)
    model = fit(vectors, components)
    if model is None:
        model = Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
        vectors = vectors.limit(0)
    return transform(vectors, model, key)
