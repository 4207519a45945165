"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Entries are made whole numbers, so counts, sums and deviations are exact.  Each
distinct vector counts once.  Tasks compress their centred rows, block by block,
to a triangle R (TSQR); a tree of tasks compresses the triangles to one.  Plane
rotations make R's columns orthogonal: their lengths are the standard
deviations (times the root of n), the accumulated rotations the components.
Columns are never squared into a covariance matrix, so small deviations keep
their accuracy beside large ones.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from quillsift.llm.shared import shared_folder
from quillsift.llm.trees import tree_reduce

#: Entries are multiples of one SCALEth, rounded down.
SCALE = 256
#: Rows that are compressed at once, besides the triangle.
BLOCK = 4096
SWEEPS = 60
LONG = 2**63


def whole(vector: Column) -> Column:
    """The vector's entries as whole numbers; those outside of longs become the nearest long."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(0).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def padded(x: Column, dims: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(x)))


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The rows of a batch's column ``x`` as a matrix of longs, short ones filled up with zeros."""
    column = batch.column(batch.schema.get_field_index("x"))
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


@dataclass
class Model:
    """``n`` fitted vectors with sums ``s``; ``components`` are columns, ``e`` their eigenvalues, ``largest`` bounds |n x - s|."""

    n: int
    s: list[int]
    largest: int
    components: np.ndarray | None = None
    e: np.ndarray | None = None
    trace: float = 0.0
    error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.s)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """``x - s/n`` as doubles, and the exact sum of squares of ``n x - s`` for each row (None beyond a long)."""
        if max(1, self.dims) * self.largest**2 < LONG:
            y = x * self.n - np.array(self.s, dtype=np.int64)
            return y / self.n, (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - np.array(self.s, dtype=object)
        sums = (y * y).sum(axis=1) if self.dims else [0] * len(x)
        return y.astype(float) / self.n, [v if v < LONG else None for v in sums]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """By component; NaN where it has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.e > 0, (centred @ self.components) / np.sqrt(self.e), np.nan)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of R's columns once plane rotations made them orthogonal, and the accumulated rotations, by falling length.

    Each round of a sweep rotates disjoint pairs of columns, by the schedule
    of a round-robin tournament.
    """
    dims = r.shape[1]
    scale = np.abs(r).max(initial=0.0) or 1.0
    a, v = np.array(r / scale).T.copy(), np.eye(dims)
    seats = np.arange(dims + dims % 2)
    small = max(dims, 8) * np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            left, right = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            real = (left < dims) & (right < dims)
            p, q = left[real], right[real]
            alpha, beta, gamma = (a[p] ** 2).sum(axis=1), (a[q] ** 2).sum(axis=1), (a[p] * a[q]).sum(axis=1)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = np.abs(gamma) > small * size
            if turn.any():
                p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
                with np.errstate(over="ignore"):
                    zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                turned = turned or bool(sin.any())
                for m in (a, v):
                    mp, mq = m[p], m[q]
                    m[p], m[q] = cos[:, None] * mp - sin[:, None] * mq, sin[:, None] * mp + cos[:, None] * mq
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    lengths = np.sqrt((a**2).sum(axis=1)) * scale
    order = np.argsort(-lengths, kind="stable")
    v = v[order]
    # Of the two directions, the one whose largest entry is positive, so that reruns agree.
    if dims:
        v = v * np.where(v[np.arange(dims), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return lengths[order], v.T


def per_part(fit: DataFrame, of: Callable[[Iterable[pa.RecordBatch]], bytes | None]) -> DataFrame:
    """One value for each partition that has rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = of(b for b in batches if b.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "data": pa.array([found], pa.binary())})

    return fit.mapInArrow(run, "part bigint, data binary")


def counted(fit: DataFrame, dims: int) -> Model | None:
    """Number and sums of the fitted vectors, exactly; None if there are none."""

    def of(batches: Iterable[pa.RecordBatch]) -> bytes | None:
        n, s, most = 0, [0] * dims, 0
        for batch in batches:
            x = matrix(batch, dims)
            top = max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
            part = (x if top * len(x) < LONG else x.astype(object)).sum(axis=0)
            n, most, s = n + len(x), max(most, top), [a + int(b) for a, b in zip(s, part, strict=True)]
        return json.dumps([n, most, s]).encode() if n else None

    def merge(parts: list[bytes]) -> bytes:
        found = [json.loads(p) for p in parts]
        return json.dumps([sum(f[0] for f in found), max(f[1] for f in found), [sum(c) for c in zip(*(f[2] for f in found), strict=True)]]).encode()

    found = tree_reduce(per_part(fit, of), merge)
    if found is None:
        return None
    n, most, s = json.loads(found)
    return Model(n, s, n * most + max(map(abs, s), default=0))


def triangle(fit: DataFrame, model: Model) -> np.ndarray:
    """R of the centred fitted vectors, by TSQR."""
    dims = model.dims

    def compressed(blocks: Iterable[np.ndarray]) -> bytes | None:
        r = None
        for block in blocks:
            for at in range(0, len(block), BLOCK):
                part = block[at : at + BLOCK]
                r = np.linalg.qr(part if r is None else np.vstack([r, part]), mode="r")
        return None if r is None else pickle.dumps(r)

    parts = per_part(fit, lambda batches: compressed(model.deviations(matrix(b, dims))[0] for b in batches))
    return pickle.loads(tree_reduce(parts, lambda found: compressed(map(pickle.loads, found))))


def identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity, measured over the fitted vectors (components with variance)."""
    dims, live = model.dims, model.e > 0
    if not live.any():
        return None

    def joined(a: tuple, b: tuple) -> tuple:
        """Numbers, means and centred products of two sets of rows together."""
        n, by = a[0] + b[0], b[1] - a[1]
        return n, a[1] + by * (b[0] / n), a[2] + b[2] + np.outer(by, by) * (a[0] * b[0] / n)

    def of(batches: Iterable[pa.RecordBatch]) -> bytes | None:
        total = None
        for batch in batches:
            w = model.whitened(model.deviations(matrix(batch, dims))[0])[:, live]
            mean = w.mean(axis=0)
            one = (len(w), mean, (w - mean).T @ (w - mean))
            total = one if total is None else joined(total, one)
        return None if total is None else pickle.dumps(total)

    def merge(parts: list[bytes]) -> bytes:
        first, *rest = map(pickle.loads, parts)
        for more in rest:
            first = joined(first, more)
        return pickle.dumps(first)

    n, _, products = pickle.loads(tree_reduce(per_part(fit, of), merge))
    return float(np.abs(products / n - np.eye(int(live.sum()))).max())


def fit_whitening(vectors: DataFrame, top: int = 4) -> Model | None:
    """The model of the distinct ``x`` of ``vectors``; jobs run here, and the list of distinct vectors is deleted when they end."""
    spark = vectors.sparkSession
    folders = [shared_folder(spark, "whitening")]
    vectors.select("x").distinct().write.parquet(folders[0])
    fit = spark.read.parquet(folders[0])
    least, dims = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if dims is None:
        return None
    if least != dims:
        # Vectors that differ by zeros at their end only are one.
        folders.append(shared_folder(spark, "whitening"))
        fit.select(padded(F.col("x"), dims).alias("x")).distinct().write.parquet(folders[1])
        fit = spark.read.parquet(folders[1])
    model = counted(fit, dims)
    if dims:
        lengths, components = jacobi(triangle(fit, model))
        e = lengths**2 / model.n
        model.trace = float(e.sum())
        # Lengths that are rounding errors of the largest count as none.
        e = np.where(lengths > dims * np.finfo(float).eps * lengths.max(initial=0.0), e, 0.0)
        model.components, model.e = components[:, :top], e[:top]
        model.error = identity_error(fit, model)
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return model


def whiten(embeddings: DataFrame, top: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of each usable vector along the first ``top`` components.

    Returns a row per vector and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``.  Vectors that are null or have null
    or non-finite entries give no rows and aren't fitted.  Repeated vectors
    are fitted once, but all rows are returned, those with a null id too.
    Vectors shorter than the longest count as filled up with zeros (so an
    empty one as zeros); with fewer dimensions than ``top`` there are fewer
    components, with none no rows.  A component without variance (as all are
    for a single vector) has ``explained`` 0 and a null ``whitened``; without
    any that has variance, ``identity_error`` is null.  ``deviation`` is null
    where it exceeds a long.  An empty table gives no rows; other columns are
    ignored, whatever their names.

    The driver and each task hold a few matrices of dimension times dimension
    and a block of rows, whatever the number of vectors.  The model is fitted
    here; the rows are made when they are read.
    """
    rows = embeddings.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col)).alias("x"))
    kind = embeddings.schema[id_col]
    schema = StructType([StructField("vec_id", kind.dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    model = fit_whitening(rows, top)
    if model is None or model.components is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    count = model.components.shape[1]
    explained = model.e / model.trace if model.trace else model.e * 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            centred, deviation = model.deviations(matrix(batch, model.dims))
            whitened = model.whitened(centred)
            at = np.repeat(np.arange(rows), count)
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, count + 1), rows), pa.int32()),
                pa.array(np.full(rows * count, model.n), pa.int64()),
                pa.array(deviation, pa.int64()).take(pa.array(at)),
                pa.array(whitened.ravel(), pa.float64(), mask=np.isnan(whitened.ravel())),
                pa.array(np.tile(explained, rows), pa.float64()),
                pa.array([model.error] * (rows * count), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
