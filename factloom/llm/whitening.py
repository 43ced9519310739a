"""Whitening of embedding vectors by a covariance found in two passes.

Entries become whole numbers, floor(STEP * c) + OFFSET, so that sums are exact whatever order they are added in. The fit
is on each distinct vector once: a vector is packed into as few bytes as it needs, and equal vectors collapse before the
shuffle, so that a vector which a third of all rows hold is one row. The first pass adds the numbers exactly and gives the
mean; the second adds outer products of the centred rows, a matrix product a block, into one matrix a partition.
treeAggregate merges the partitions' sums level by level, so that the driver receives one matrix, whose size depends on the
number of dimensions alone. LAPACK's symmetric solver gives the components; they are broadcast (dimensions x components
numbers) and every row is projected where it is read. A third pass over the fit list measures how far the covariance of the
whitened vectors is from the identity.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped, as are those that differ
in length from the most frequent length (of ties, the shortest). Scaled entries beyond 2**52 either way count as 2**52.
A component whose variance is within rounding of zero has the value 0 for every row, as every row lies in the mean there; it
is left out of the identity's error. Repeated rows each get a row, null ids are kept, other columns are ignored whatever
their names, and an empty table gives no rows. Vectors without entries have no components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import cut

#: Steps in 1, and what is added so that usual entries are positive.
STEP, OFFSET = 64, 1_000_000
FARTHEST = 2.0**52
#: Rows (times dimensions, about) that are worked on at a time.
BLOCK = 1 << 20
#: Widths of the numbers of a packed vector, in bytes.
WIDTHS = (1, 2, 4, 8)
TREE_DEPTH = 3


def usable(vector: str) -> Column:
    """Whether a vector and all its entries are there and finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def numbers(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers, less OFFSET, of rows of entries."""
    return np.clip(np.floor(vectors.astype(np.float64) * STEP), -FARTHEST, FARTHEST).astype(np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as its width and its numbers in that many bytes; equal rows have equal bytes."""
    most = np.maximum(x.max(axis=1, initial=0), ~x.min(axis=1, initial=0))
    width = np.searchsorted([127, 32_767, 2**31 - 1], most)
    out = np.empty(len(x), object)
    for k in np.unique(width):
        mine = np.flatnonzero(width == k)
        body = x[mine].astype(f"<i{WIDTHS[k]}").tobytes()
        size = WIDTHS[k] * x.shape[1]
        out[mine] = [bytes([WIDTHS[k]]) + body[i * size : (i + 1) * size] for i in range(len(mine))]
    return out.tolist()


def unpack(codes: pa.Array, dims: int) -> np.ndarray:
    """The whole numbers, less OFFSET, of packed vectors."""
    raw = codes.to_pylist()
    widths = np.fromiter((c[0] for c in raw), np.int64, len(raw))
    out = np.empty((len(raw), dims), np.int64)
    for w in np.unique(widths):
        mine = np.flatnonzero(widths == w)
        out[mine] = np.frombuffer(b"".join([raw[i][1:] for i in mine]), f"<i{w}").reshape(-1, dims)
    return out


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


@dataclass(frozen=True)
class Model:
    """What the fit list says: its size, exact sums of the numbers, eigenvalues, the matrix that whitens, and its error."""

    dims: int
    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    explained: np.ndarray
    projection: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Numbers (less OFFSET) minus their mean: whole parts are subtracted exactly, then the rest of the mean."""
        whole, rest = self.mean()
        return (x - whole) - rest / self.n

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean, less OFFSET, as its whole part and the remainder in n-ths."""
        parts = [divmod(s - self.n * OFFSET, self.n) for s in self.sums]
        return np.array([q for q, _ in parts], np.int64), np.array([r for _, r in parts], np.int64)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n*x - S)**2, exactly."""
        whole, rest = self.mean()
        far = x - whole
        most = (int(np.abs(far).max(initial=0)) + 1) * self.n
        if most * most * max(self.dims, 1) < 1 << 63:
            return ((far * self.n - rest) ** 2).sum(axis=1).tolist()
        return [sum((int(f) * self.n - int(r)) ** 2 for f, r in zip(row, rest, strict=True)) for row in far]


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, and per dimension the sums of the numbers' upper and lower halves, which can't overflow."""
    n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for batch in blocks(batches, dims):
        x = unpack(batch.column(0), dims)
        n += len(x)
        high += (x >> 32).sum(axis=0)
        low += (x & 0xFFFFFFFF).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([high.tobytes() + low.tobytes()], pa.binary())], ["n", "part"])


def _products(batches: Iterator[pa.RecordBatch], model: Model, whitened: bool) -> Iterator[pa.RecordBatch]:
    """The sum of outer products of a partition's centred rows; whitened: of their projections."""
    size = model.projection.shape[1] if whitened else model.dims
    total = np.zeros((size, size))
    for batch in blocks(batches, model.dims):
        c = model.centred(unpack(batch.column(0), model.dims))
        c = c @ model.projection if whitened else c
        total += c.T @ c
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "part"])


def merged(parts: DataFrame, read: Callable[[bytes], object], zero: object) -> tuple[int, object]:
    """The sum of what partitions hold (n, part), merged in a tree."""
    rows = parts.rdd.map(lambda r: (r["n"], read(bytes(r["part"]))))
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    return rows.treeAggregate((0, zero), add, add, TREE_DEPTH)


def fit_list(vectors: DataFrame, vector: str) -> DataFrame:
    """Each distinct vector of usable rows once, packed (code)."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 64):
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            dims = int(lengths[0]) if len(lengths) else 0
            yield pa.RecordBatch.from_arrays([pa.array(pack(numbers(_vectors(batch.column(0), dims))), pa.binary())], ["code"])

    return vectors.select(F.col(vector)).mapInArrow(codes, "code binary").distinct()


def _halves(part: bytes) -> np.ndarray:
    """Both sums, as whole numbers of any size."""
    return np.frombuffer(part, np.int64).astype(object)


def _matrix(part: bytes) -> np.ndarray:
    return np.frombuffer(part, np.float64)


def fit(vectors: DataFrame, vector: str, components: int) -> Model | None:
    """The model of usable rows of one length; None where there are none."""
    lengths = vectors.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return None
    dims = lengths["dims"]
    chosen = cut(fit_list(vectors.where(F.size(vector) == dims), vector))
    n, halves = merged(chosen.mapInArrow(lambda b: _sums(b, dims), "n long, part binary"), _halves, np.zeros(2 * dims, object))
    sums = tuple(int(h) * 2**32 + int(low) + n * OFFSET for h, low in zip(halves[:dims], halves[dims:], strict=True))
    k = min(components, dims)
    model = Model(dims, n, sums, np.zeros(dims), np.zeros(k), np.zeros((dims, k)))
    if not dims:
        return model
    _, flat = merged(chosen.mapInArrow(lambda b: _products(b, model, False), "n long, part binary"), _matrix, np.zeros(dims * dims))
    v = flat.reshape(dims, dims) / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    there = values > dims * np.finfo(float).eps * max(values[0], 0.0)
    trace = float(np.trace(v))
    scale = np.where(there[:k], 1 / np.sqrt(np.where(there, values, 1.0)[:k]), 0.0)
    model = Model(dims, n, sums, values, np.where(there, values, 0.0)[:k] / trace if trace > 0 else np.zeros(k), axes[:, :k] * scale)
    _, flat = merged(chosen.mapInArrow(lambda b: _products(b, model, True), "n long, part binary"), _matrix, np.zeros(k * k))
    error = np.abs(flat.reshape(k, k) / n - np.diag(there[:k].astype(float))).max()
    return Model(dims, n, sums, values, model.explained, model.projection, float(error))


def whiten(vectors: DataFrame, components: int = 16, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, n (size of the fit list), deviation (decimal), whitened and explained (arrays by component), identity_error for each usable row."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(usable("vector"))
    model = fit(rows, "vector", components)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in blocks(batches, m.dims):
            x = numbers(_vectors(batch.column(1), m.dims))
            white, k = m.centred(x) @ m.projection, m.projection.shape[1]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            deviation = pa.array([d if d < 10**38 else None for d in m.deviation(x)], pa.decimal128(38, 0))
            lists = [pa.ListArray.from_arrays(ends, pa.array(a)) for a in (white.ravel(), np.tile(m.explained, len(x)))]
            fixed = [pa.array(np.full(len(x), m.n, np.int64)), pa.array(np.full(len(x), m.identity_error))]
            yield pa.RecordBatch.from_arrays([batch.column(0), fixed[0], deviation, *lists, fixed[1]], [key, "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("vector") == model.dims).mapInArrow(project, schema)
