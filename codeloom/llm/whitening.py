"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The distinct rounded vectors are packed into blocks once. With X the centred rows, each step takes one pass over the
blocks: a task multiplies its rows with the new right vector (its part of u = Xv), with all earlier ones (against which
u is reorthogonalised in full) and its part of u with its rows (Xᵀu). Every u is X times a short vector, so tasks make
their part of it again and nothing as long as the table is kept. Steps run over all dimensions, so that equal
deviations are found as often as they occur; the small bidiagonal matrix gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.io import materialise, prepare

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Vectors of a block.
BLOCK_ROWS = 4096
_LONG_MAX = (1 << 63) - 1
#: Partial sums, one a partition, that the driver takes; with more, Spark adds them up first.
DIRECT_PARTS = 1000
#: A step whose vector is this small, of the largest, has come to the end of what it can reach.
_TINY = 1e-11


def _rounded(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a batch that have a finite vector, and floor(64 c) of each as 64-bit integers."""
    rows, vectors = [], []
    for i, v in enumerate(column):
        if not v.is_valid:
            continue
        values = v.values
        if values.null_count:
            continue
        c = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(c).all():
            rows.append(i)
            vectors.append(_floor(c))
    return np.array(rows, np.int64), vectors


def _floor(c: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * c), -(2.0**63), float(_LONG_MAX - SHIFT - 1023)).astype(np.int64)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """The same as one matrix, for a batch whose vectors all have one length and no nulls inside."""
    kept = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    some = column.drop_null()
    lengths = some.value_lengths().to_numpy()
    values = some.flatten()
    if values.null_count or len(np.unique(lengths)) != 1 or lengths[0] == 0:
        return None
    c = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)
    ok = np.isfinite(c).all(1)
    return kept[ok], _floor(c[ok])


def _pack(y: np.ndarray) -> bytes:
    """Vectors as bytes: 16-bit integers if all fit, else 64-bit ones; equal vectors have equal bytes."""
    small = len(y) == 0 or (y.min() >= -(1 << 15) and y.max() < 1 << 15)
    return b"h" + y.astype("<i2").tobytes() if small else b"q" + y.astype("<i8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"h" else "<i8", offset=1).astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = _matrix(batch.column(0))
        _, rows = whole if whole is not None else _rounded(batch.column(0))
        packed = [_pack(y) for y in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(packed, pa.binary()), pa.array([len(y) for y in rows], pa.int32())], ["vector", "dims"]
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            y = np.stack([_unpack(v) for v in batch.column(0).slice(at, BLOCK_ROWS).to_pylist()])
            low, high = y & 0xFFFFFFFF, y >> 32
            sums = [str(int(a) + (int(b) << 32)) for a, b in zip(low.sum(0), high.sum(0), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(y)], pa.int64()), pa.array([_pack(y)], pa.binary()), pa.array([sums], pa.list_(pa.string()))],
                ["rows", "data", "sums"],
            )


def _add_up(blocks: DataFrame, part, width: int) -> np.ndarray:
    """The sum over all blocks of `part(rows)`, an array of `width` doubles a block; each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += part(_unpack(data).reshape(n, -1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    parts = blocks.select("rows", "data").mapInArrow(run, "part array<double>")
    if blocks.rdd.getNumPartitions() <= DIRECT_PARTS:
        return np.sum([np.zeros(width), *(np.array(x[0]) for x in parts.collect())], axis=0)
    out = np.zeros(width)
    for at, value in parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


class Fit:
    """What the fit list gives: n, the sums of floor(64 c), centre, components (columns), deviations squared, trace."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, eigenvalues: np.ndarray, trace: float, identity_error: float) -> None:
        self.n, self.sums, self.components, self.eigenvalues, self.trace = n, sums, components, eigenvalues, trace
        self.identity_error, self.centre = identity_error, np.array([s / n if n else 0.0 for s in sums])


def _bidiagonalise(blocks: DataFrame, n: int, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Right vectors V (columns), the bidiagonal B with XV = UB, and the sum of squares of X."""
    d = len(centre)
    rng = np.random.default_rng(seed)
    right, short, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, w with u = Xw, and Xᵀu
    b = np.zeros((d, d))

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    def product(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Xᵀu, the products with earlier u, uᵀu of u = Xw, and the sum of squares of X."""
        k = short.shape[1]
        all_w = np.column_stack([short, w])

        def part(y: np.ndarray) -> np.ndarray:
            x = y - centre
            u = x @ all_w
            return np.concatenate([x.T @ u[:, k], u.T @ u[:, k], [np.einsum("ij,ij->", x, x)]])

        total = _add_up(blocks, part, d + k + 2)
        return total[:d], total[d : d + k], total[d + k], total[-1]

    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    beta, scale, squares = 0.0, 0.0, 0.0
    for j in range(d):
        right = np.column_stack([right, v])
        w = v - beta * short[:, j - 1] if j else v
        image, dots, size, squares = product(w)
        w, image, left = w - short @ dots, image - images @ dots, size - dots @ dots
        if left < 1e-4 * size:  # much was taken away: once more
            image, dots, size, _ = product(w)
            w, image, left = w - short @ dots, image - images @ dots, size - dots @ dots
        alpha = np.sqrt(max(left, 0.0))
        scale = max(scale, alpha, beta)
        if alpha > _TINY * max(scale, np.sqrt(squares / d)):
            w, image = w / alpha, image / alpha
            v = image - alpha * v
        else:
            alpha, w, image, v = 0.0, np.zeros(d), np.zeros(d), np.zeros(d)
        short, images, b[j, j] = np.column_stack([short, w]), np.column_stack([images, image]), alpha
        if j + 1 == d:
            break
        v = orthogonal(v)
        beta = np.linalg.norm(v)
        if beta > _TINY * scale:
            b[j, j + 1] = beta
        else:
            # nothing new is reached from here: go on from a random direction, or stop if no spread is left
            if squares - (b * b).sum() <= 1e-13 * squares:
                break
            beta, v = 0.0, orthogonal(rng.standard_normal(d))
        v /= np.linalg.norm(v)
    k = right.shape[1]
    return right, b[:k, :k], squares


def fit_whitening(embeddings: DataFrame, *, components: int = COMPONENTS, seed: int = 7) -> Fit:
    """Fits components on the distinct vectors floor(64 c) of `embeddings` (column `embedding`).

    Only finite vectors of the commonest length (the longer of equally common ones) and of one entry or more count. At most `components` components come
    back, by falling deviation, none whose deviation is zero to double precision.
    """
    prepare(embeddings.sparkSession)
    vectors = embeddings.select(F.col("embedding").cast("array<double>")).mapInArrow(_vectors, "vector binary, dims int").where("dims > 0")
    distinct = materialise(vectors.groupBy("vector").agg(F.first("dims").alias("dims"), F.count("*").alias("copies")))
    common = distinct.groupBy("dims").agg(F.sum("copies").alias("rows"), F.count("*").alias("n")).orderBy(F.desc("rows"), F.desc("dims")).first()
    if common is None:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    d, n = common["dims"], common["n"]
    blocks = materialise(distinct.where(F.col("dims") == d).select("vector").mapInArrow(_blocks, "rows long, data binary, sums array<string>"))
    exact = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(s) for _, s in sorted(exact.collect())]
    centre = np.array([s / n for s in sums])
    right, b, squares = _bidiagonalise(blocks, n, centre, seed)
    _, sigma, qt = np.linalg.svd(b)
    found = sigma**2 / n
    k = int(min(components, (sigma > 1e-9 * max(sigma[0], 1e-300)).sum())) if squares else 0
    vectors_k, found = (right @ qt.T)[:, :k], found[:k]
    if not k:
        return Fit(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    project = vectors_k / np.sqrt(found)

    def moments(y: np.ndarray) -> np.ndarray:
        z = (y - centre) @ project
        return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

    total = _add_up(blocks, moments, k * k + k)
    mean = total[k * k :] / n
    error = np.abs(total[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()
    return Fit(n, sums, vectors_k, found, squares / n, float(error))


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n y - S)² of each row; None if it is no long."""
    if not len(y):
        return []
    most = n * int(max(-int(y.min()), int(y.max()), 0)) + max(abs(s) for s in sums)
    if most < 1 << 62 and len(sums) * most * most <= _LONG_MAX:
        t = n * y - np.array(sums, np.int64)
        return (t * t).sum(1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in y]
    return [x if x <= _LONG_MAX else None for x in exact]


def whiten(embeddings: DataFrame, fit: Fit | None = None, **options) -> DataFrame:
    """Every vector in the whitened space, a row per component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows with a null vector, or one with null or non-finite entries, are dropped, and so are empty vectors and those of another length than
    most have, as they lie in no common space. Repeated rows get their rows each and count once in the fit; a
    null vec_id is carried along. A table without spread (one distinct vector) or without rows has no components and so
    gives no rows. Numbers beyond 64 bits are clipped on entry; a deviation beyond 64 bits is null. Other columns are not read.
    """
    prepare(embeddings.sparkSession)
    fit = fit_whitening(embeddings, **options) if fit is None else fit
    k, d = len(fit.eigenvalues), len(fit.sums)
    project = fit.components / np.sqrt(fit.eigenvalues) if k else fit.components
    explained = (fit.eigenvalues / fit.trace).tolist() if k else []
    n, sums, centre, error = fit.n, fit.sums, fit.centre, fit.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column(1))
            rows, vectors = whole if whole is not None else _rounded(batch.column(1))
            same = [i for i, y in enumerate(vectors) if len(y) == d]
            if not same or not k:
                continue
            rows, y = rows[same], np.stack([vectors[i] for i in same])
            z = (y - centre) @ project
            m = len(y)
            deviation = pa.array(_deviations(y, n, sums), pa.int64())
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, n)), deviation.take(pa.array(each)), pa.array(z.ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = embeddings.schema["vec_id"].dataType if isinstance(embeddings.schema["vec_id"].dataType, T.StringType) else T.LongType()
    rows = embeddings.select(F.col("vec_id").cast(kind), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(
        run, f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
