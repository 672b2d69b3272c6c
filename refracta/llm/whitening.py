"""Whitening of embeddings, with covariances by polarisation.

Entries become whole numbers x. For every dimension, and for the sum of every pair of
dimensions, the squared centred values are added up exactly; the covariance of a pair is half
of what the variance of its sum exceeds the two variances by. The matrix of these is small
(dimensions squared) and decomposed on the driver; everything per row runs in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this many, either side, count as so many; they would not fit a long.
LIMIT = float(2**62)
#: Rows of a batch whose pair sums are held at a time.
BLOCK_ROWS = 1024
#: Components with less than this share of the trace are rounding, not variance.
NO_VARIANCE = 1e-13
LIMB = 2**64


def scaled(vector: Column, scale: float) -> Column:
    """Whole numbers floor(scale * entry) of every entry, taken as doubles."""
    return F.transform(
        vector,
        lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(LIMIT)), F.lit(-LIMIT))).cast("bigint"),
    )


def is_finite(vector: Column) -> Column:
    """True for arrays without NULL, NaN or infinite entries; NULL arrays are not."""
    odd = F.exists(
        vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    )
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: as 64-bit numbers where these hold it and its sums of two, else as
    Python's own."""
    most = max([abs(int(v)) for v in (x.max(), x.min())], default=0) if x.size else 0
    if n * most + max([abs(s) for s in sums], default=0) < 2**61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of the squares of every column; at most ``BLOCK_ROWS`` rows."""
    if y.dtype == object:
        return [int(v) for v in (y * y).sum(axis=0)]
    most = int(np.abs(y).max()) if y.size else 0
    if most < 2**26:
        return np.einsum("ij,ij->j", y, y).tolist()
    if most >= 2**52:
        return square_sums(y.astype(object))
    high, low = y >> 26, y & (2**26 - 1)
    parts = [np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(hh << 52) + (hl << 27) + ll for hh, hl, ll in zip(*parts)]


def _limbs(totals: list[int]) -> pa.RecordBatch:
    """(key, high, low) rows; sums of high and low give the sum of the totals."""
    limb = pa.decimal128(38, 0)
    split = [divmod(t, LIMB) for t in totals]
    return pa.record_batch(
        [
            pa.array(range(len(totals)), pa.int32()),
            pa.array([_decimal(h) for h, _ in split], limb),
            pa.array([_decimal(low) for _, low in split], limb),
        ],
        names=["key", "high", "low"],
    )


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def _summed(rows: DataFrame, run, size: int) -> list[int]:
    """Exact totals by key of what the tasks of ``run`` found: ``size`` numbers in all."""
    found = rows.mapInArrow(run, "key int, high decimal(38,0), low decimal(38,0)")
    totals = [0] * size
    for r in found.groupBy("key").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        totals[r["key"]] = int(r["high"]) * LIMB + int(r["low"])
    return totals


def _plain_sums(dims: int):
    """Per task: the number of rows, then the sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (dims + 1)
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, dims), np.int64)
            totals[0] += batch.num_rows
            for start in range(0, len(x), BLOCK_ROWS):
                block = x[start : start + BLOCK_ROWS]
                wide = max(abs(int(block.max())), abs(int(block.min()))) >= 2**52
                for d, s in enumerate((block.astype(object) if wide else block).sum(axis=0).tolist(), 1):
                    totals[d] += int(s)
        yield _limbs(totals)

    return run


def _pair_keys(dims: int) -> list[tuple[int, int]]:
    """(i, j) of every total: i == j for a dimension, i < j for the sum of a pair."""
    return [(i, i) for i in range(dims)] + [(i, j) for i in range(dims) for j in range(i + 1, dims)]


def _square_totals(n: int, sums: list[int]):
    """Per task: sums of squared centred values of every dimension, then of every pair sum."""
    dims = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (dims * (dims + 1) // 2)
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, dims), np.int64)
            for start in range(0, len(x), BLOCK_ROWS):
                y = centred(x[start : start + BLOCK_ROWS], n, sums)
                at = 0
                for found in (square_sums(y), *(square_sums(y[:, i : i + 1] + y[:, i + 1 :]) for i in range(dims - 1))):
                    for value in found:
                        totals[at] += value
                        at += 1
        yield _limbs(totals)

    return run


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` distinct vectors, their exact sums, components by falling
    eigenvalue (rows of ``components`` are unit vectors) and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace > 0 else np.zeros(len(self.eigenvalues))

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared deviations (n * x - S, exact) and whitened values, NaN without variance."""
        y = centred(x, self.n, list(self.sums))
        deviation = np.array([square for rows in _chunks(y) for square in square_sums(rows.T)], object)
        roots = np.sqrt(np.where(self._varies(), self.eigenvalues, np.nan))
        return deviation, (y / self.n).astype(float) @ self.components.T / roots

    def _varies(self) -> np.ndarray:
        return self.eigenvalues > NO_VARIANCE * self.trace


def _chunks(y: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of ``y`` in pieces; their transposes have one column for each row."""
    for start in range(0, len(y), BLOCK_ROWS):
        yield y[start : start + BLOCK_ROWS]


def covariance(n: int, dims: int, totals: list[int]) -> np.ndarray:
    """The covariance matrix from the exact totals of dimensions and pair sums.

    Totals are of n * x - S, so n ** 3 divides them; differences are taken before rounding."""
    out = np.zeros((dims, dims))
    for (i, j), total in zip(_pair_keys(dims), totals):
        twice = 2 * total if i == j else total - totals[i] - totals[j]
        out[i, j] = out[j, i] = twice / (2 * n**3)
    return out


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` whose vector has finite entries only, with ``x`` beside it (without the shift,
    which no result depends on)."""
    return rows.filter(is_finite(F.col(vector)) & (F.size(vector) > 0)).withColumn("x", scaled(F.col(vector), SCALE))


def fit(x: DataFrame, components: int = 16) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct vectors of the column ``x``, and these vectors.

    Copies are made one before they move, so a vector that a third of the rows share costs one
    row per task. Vectors of the most frequent length (the longer on ties) count; None without
    any. The driver gets one number per dimension and pair of dimensions.
    """
    distinct = cut_lineage(x.select("x").distinct())
    length = distinct.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if length is None:
        return None
    dims = int(length["dims"])
    vectors = distinct.filter(F.size("x") == dims)
    n, *sums = _summed(vectors, _plain_sums(dims), dims + 1)
    totals = _summed(vectors, _square_totals(n, sums), dims * (dims + 1) // 2)
    values, columns = np.linalg.eigh(covariance(n, dims, totals))
    kept = np.argsort(values)[::-1][: min(components, dims)]
    trace = sum(totals[:dims]) / n**3
    return Whitening(n, tuple(sums), np.maximum(values[kept], 0.0), columns[:, kept].T.copy(), trace), vectors


def _moments(model):
    """Per task: the sums of whitened values, then of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.value.eigenvalues)
        first, second = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                w = model.value.project(_matrix(batch.column("x")))[1]
                first += w.sum(axis=0)
                second += w.T @ w
        values = [*first.tolist(), *second.ravel().tolist()]
        yield pa.record_batch([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], names=["key", "value"])

    return run


def identity_error(vectors: DataFrame, model, whitening: Whitening) -> float:
    """Largest entry of |covariance - identity| of the whitened ``vectors``, over the components
    that have variance. Whitened values are centred by construction; what rounding leaves of
    their mean is taken off."""
    size, n = len(whitening.eigenvalues), whitening.n
    rows = vectors.mapInArrow(_moments(model), "key int, value double").groupBy("key").agg(F.sum("value").alias("value"))
    flat = np.zeros(size + size * size)
    for r in rows.collect():  # components + components squared numbers
        flat[r["key"]] = r["value"]
    mean = flat[:size] / n
    error = np.abs(flat[size:].reshape(size, size) / n - np.outer(mean, mean) - np.eye(size))
    return float(np.nanmax(error)) if np.isfinite(error).any() else 0.0


def _project(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            deviation, whitened = model.value.project(_matrix(batch.column("x")))
            flat = pa.array(whitened.ravel(), pa.float64(), mask=np.isnan(whitened.ravel()))
            ends = np.arange(0, flat.__len__() + 1, whitened.shape[1], dtype=np.int32)
            yield pa.record_batch(
                [
                    batch.column("carried"),
                    pa.array([_decimal(int(d)) for d in deviation], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                ],
                names=["carried", "deviation", "whitened"],
            )

    return run


def whiten(
    rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 16
) -> DataFrame:
    """One row per row of ``rows`` with a usable vector.

    vec_id          the id, as it is
    n               distinct vectors of the fit
    deviation       sum over dimensions of (n * x - S) ** 2, exact, as decimal
    whitened        (x - S / n) on each component over the root of its eigenvalue; an entry is
                    NULL where the component has no variance
    explained       share of the trace of each component
    identity_error  largest absolute entry of whitened's covariance minus the identity

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries are left out, and so
    are those of another length than most. Repeated rows are each returned and count once in
    the fit. Entries beyond 2 ** 62 / 64 count as that. Other columns are ignored, whatever
    their names. A table without usable rows gives an empty table.
    """
    spark = rows.sparkSession
    # one struct, so that no name of the caller's table can clash with those used on the way
    carried = rows.select(F.col(id_column).alias("carried"), F.col(vector).alias("vector"))
    whole = whole_vectors(carried, "vector").select("carried", "x")
    fitted = fit(whole, components)
    kind = dict(carried.dtypes)["carried"]
    schema = f"carried {kind}, deviation decimal(38,0), whitened array<double>"
    if fitted is None:
        projected, n, explained, error = spark.createDataFrame([], schema), 0, [], 0.0
    else:
        whitening, vectors = fitted
        model = spark.sparkContext.broadcast(whitening)
        same = whole.filter(F.size("x") == len(whitening.sums))
        projected = same.mapInArrow(_project(model), schema)
        n, explained = whitening.n, whitening.explained().tolist()
        error = identity_error(vectors, model, whitening)
    return projected.select(
        F.col("carried").alias("vec_id"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.lit(explained).cast("array<double>").alias("explained") if explained else F.array().cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
