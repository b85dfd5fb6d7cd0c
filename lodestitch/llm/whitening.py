"""Whitening of embeddings from an exact covariance: digit-slice GEMM.

Every entry c becomes the integer x = floor(scale * c) + offset. The covariance of the integers
is needed exactly, while BLAS is fast only in float64. So each task centres its integers on a
common pivot, cuts them into balanced digits of ``LIMB`` bits, and multiplies digit matrices a
block of rows at a time: a product of two digits over a block stays below 2**53, so every float64
sum is an exact integer. Products of equal weight are added as 64-bit integers; Spark adds up the
entries of all tasks as decimals, and the driver recombines the weights as big integers. The
covariance that is decomposed is therefore the correctly rounded true one, whatever the number of
rows, and however far the mean is from 0. Components come from ``numpy.linalg.eigh``, with the entry of
the largest magnitude positive.

Four scans: counts and sums, digit products, the covariance of the result, the result. Each
task sends only sums: dimensions squared numbers, whatever it has read. The driver holds matrices of dimensions
squared (``MOST_DIMENSIONS`` at most), never rows.

Defined results. A row is dropped if its vector is null or holds a null, NaN or infinite entry.
The dimension is the length that most of the remaining rows have (of equally common ones the
longest); rows of other lengths, empty ones too, are dropped. A scaled entry beyond 2**60 counts as 2**60. Rows with
equal or null ids are separate rows. A component without variance (eigenvalue below ``LEAST`` of
the largest) has null ``whitened`` and takes no part in ``identity_error``; ``explained`` is null if there is no variance at all.
A ``deviation`` that no 64-bit integer holds is null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a digit; a block of BLOCK rows adds up to below 2**(2 * (LIMB - 1) + 13) < 2**53.
LIMB, BLOCK = 18, 1 << 13
#: Blocks whose products are added before they leave as 64-bit integers.
MOST_BLOCKS = 1 << 14
MOST_DIMENSIONS = 4096
#: Share of the largest eigenvalue below which a component counts as without variance.
LEAST = 1e-13
FAR = 2.0**60


def finite_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>) of the rows whose vector is whole and finite."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(v.isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def integers(vectors: pa.Array | pa.ChunkedArray, dimension: int, scale: float, offset: int) -> np.ndarray:
    """The integer matrix of a list column whose lists all have ``dimension`` entries."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    c = np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dimension)
    return np.clip(np.floor(c * scale), -FAR, FAR).astype(np.int64) + offset


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of ``LIMB`` bits, least first, as float64 matrices; at least one."""
    out, half, mask = [], 1 << (LIMB - 1), (1 << LIMB) - 1
    while True:
        low = ((y + half) & mask) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
        if not y.any():
            return out


def digit_products(y: np.ndarray) -> dict[int, np.ndarray]:
    """weight in digits -> exact int64 matrix; the sum of weight * matrix is y'y. At most BLOCK rows."""
    cut, out = digits(y), {}
    for a, left in enumerate(cut):
        for b in range(a, len(cut)):
            product = (left.T @ cut[b]).astype(np.int64)
            if a != b:
                product += product.T
            out[a + b] = out.get(a + b, 0) + product
    return out


def _blocks(batch: pa.RecordBatch, dimension: int, scale: float, offset: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        yield at, integers(batch.column("v").slice(at, BLOCK), dimension, scale, offset)


def _entries(at: np.ndarray, weight: int, matrix: np.ndarray) -> pa.RecordBatch:
    i, j = at
    weights = pa.array(np.full(len(i), weight, np.int32))
    return pa.record_batch([weights, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(matrix[i, j])], ["weight", "i", "j", "value"])


def column_sums(vectors: DataFrame, dimension: int, scale: float, offset: int) -> list[int]:
    """Exact sums of the integers per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(dimension, dtype=np.int32)
        for batch in batches:
            low, high = np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
            for _, x in _blocks(batch, dimension, scale, offset):
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
            yield pa.record_batch([pa.array(at), pa.array(low), pa.array(high)], ["i", "low", "high"])

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = vectors.mapInArrow(run, "i int, low long, high long").groupBy("i").agg(total("low"), total("high")).collect()
    sums = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return [sums[i] for i in range(dimension)]


def exact_gram(vectors: DataFrame, pivot: list[int], scale: float, offset: int) -> list[list[int]]:
    """Sum over rows of (x - pivot)(x - pivot)', as big integers."""
    d = len(pivot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, upper = np.array(pivot, dtype=np.int64), np.triu_indices(d)
        sums: dict[int, np.ndarray] = {}
        blocks = 0
        for batch in batches:
            for _, x in _blocks(batch, d, scale, offset):
                for weight, product in digit_products(x - centre).items():
                    sums[weight] = sums.get(weight, 0) + product
                blocks += 1
                if blocks == MOST_BLOCKS:
                    yield from (_entries(upper, w, m) for w, m in sums.items())
                    sums, blocks = {}, 0
        yield from (_entries(upper, w, m) for w, m in sums.items())

    parts = vectors.mapInArrow(run, "weight int, i int, j int, value long")
    out = [[0] * d for _ in range(d)]
    for r in parts.groupBy("weight", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        out[r["i"]][r["j"]] += int(r["value"]) << (LIMB * r["weight"])
    for i in range(d):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def covariance(gram: list[list[int]], rest: list[int], n: int) -> np.ndarray:
    """Centred covariance with divisor n, every entry the correctly rounded exact value.

    ``rest``: n times the mean of what ``gram`` was made from.
    """
    square = n * n
    return np.array([[(n * g - a * b) / square for g, b in zip(row, rest, strict=True)] for row, a in zip(gram, rest, strict=True)])


def principal_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest, by falling eigenvalue."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def squared_deviations(y: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """Sum over dimensions of (n*y - rest)**2 per row, exact; null where 64 bits do not hold it."""
    if not len(y):
        return pa.array([], pa.int64())
    far = n * int(np.abs(y).max()) + int(np.abs(rest).max())
    if far * far * y.shape[1] < 2**63:
        return pa.array(((n * y - rest) ** 2).sum(axis=1))
    big = ((n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
    return pa.array([x if x < 2**63 else None for x in big], pa.int64())


def whiten(
    rows: DataFrame,
    components: int = 8,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    offset: int = 100_000,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per remaining row and component."""
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = finite_vectors(rows, id_col, vector_col)
    lengths = vectors.groupBy(F.size("v").alias("length")).count().where("length > 0")
    first = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    d, n = first["length"], first["count"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the driver holds matrices of at most {MOST_DIMENSIONS}")
    vectors = vectors.where(F.size("v") == d)
    sums = column_sums(vectors, d, scale, offset)
    pivot = [s // n for s in sums]
    rest = [s - n * p for s, p in zip(sums, pivot, strict=True)]
    cov = covariance(exact_gram(vectors, pivot, scale, offset), rest, n)
    values, axes = principal_components(cov, components)
    k, trace = len(values), float(np.trace(cov))
    varies = values > max(values[0], 0.0) * LEAST
    shrunk = axes / np.sqrt(np.where(varies, values, 1.0))

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x - np.array(pivot, dtype=np.int64)
        return y, (y - np.array(rest, dtype=np.float64) / n) @ shrunk

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The mean is the exact one, so the values are centred already.
        total = np.zeros((k, k))
        for batch in batches:
            for _, x in _blocks(batch, d, scale, offset):
                z = project(x)[1]
                total += z.T @ z
        yield _entries(np.triu_indices(k), 0, total)

    found = vectors.mapInArrow(moments, "weight int, i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    error = max((abs(r["value"] / n - (r["i"] == r["j"])) for r in found if varies[r["i"]] and varies[r["j"]]), default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch, d, scale, offset):
                y, z = project(x)
                m = len(x)
                row = pa.array(np.repeat(np.arange(m), k))
                component = np.tile(np.arange(k), m)
                whitened = pa.array(z.ravel(), mask=~varies[component])
                share = pa.array((values / trace)[component] if trace > 0 else np.zeros(m * k), mask=np.full(m * k, trace <= 0))
                yield pa.record_batch(
                    [
                        batch.column("id").slice(at, BLOCK).take(row),
                        pa.array(component.astype(np.int32) + 1),
                        pa.array(np.full(m * k, n)),
                        squared_deviations(y, np.array(rest, dtype=np.int64), n).take(row),
                        whitened,
                        share,
                        pa.array(np.full(m * k, error)),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    return vectors.mapInArrow(run, schema)
