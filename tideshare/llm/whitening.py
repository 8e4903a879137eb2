"""Principal components and whitened coordinates of embeddings by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import batch, released, stored, tasks

#: Entries are multiplied by this and rounded down.
SCALE = 256
#: Rows of one stored block of the fit list.
BLOCK_ROWS = 8192
#: Columns of the subspace per component asked for: the more, the fewer passes.
SPARE = 8
#: Partial sums of a pass that reach the driver.
SUMS = 16
#: Degree of the filter; passes over the data per round.
DEGREE = 10
#: Passes that estimate the lower end of the spectrum.
LANCZOS = 10
#: Residual norm, in shares of the largest eigenvalue, that certifies a component.
CERTIFIED = 2.0**-44
#: Residual that is still taken when rounding errors let it fall no further.
STALLED = 2.0**-36
#: A direction counts as one of the data if its share of the largest eigenvalue is above this.
FLAT = 2.0**-40

WIDTHS = [np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8")]


def quantised(values: np.ndarray) -> np.ndarray:
    """``floor(256 c)`` as 64-bit integers; what lies beyond them takes the nearest."""
    x = np.floor(values.astype(np.float64) * SCALE)
    top = 2.0**63
    return np.where(x >= top, np.iinfo(np.int64).max, np.where(x < -top, np.iinfo(np.int64).min, np.clip(x, -top, top - 1024).astype(np.int64)))


def vectors(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, x)``: rows whose vector is whole (of ``dim`` finite entries) and these vectors."""
    lists = column.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(column.type) else column
    size = pa.compute.list_value_length(lists).fill_null(-1).to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    good = size > 0 if dim is None else size == dim
    good[owner[~np.isfinite(flat)]] = False
    if dim is None:
        return np.flatnonzero(good), size
    return np.flatnonzero(good), quantised(flat[good[owner]].reshape(-1, dim)) if dim else np.zeros((0, 0), np.int64)


def to_bytes(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest width that holds it, after a byte that names the width: equal rows, equal bytes."""
    out = [b""] * len(x)
    need = np.zeros(len(x), np.int64)
    for k, t in enumerate(WIDTHS[:-1]):
        need[((x > np.iinfo(t).max) | (x < np.iinfo(t).min)).any(axis=1)] = k + 1
    for k, t in enumerate(WIDTHS):
        which = np.flatnonzero(need == k)
        for i, row in zip(which.tolist(), x[which].astype(t), strict=True):
            out[i] = bytes([k]) + row.tobytes()
    return out


def from_bytes(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.empty((len(rows), dim), np.int64)
    kinds = np.fromiter((r[0] for r in rows), np.int64, len(rows))
    for k, t in enumerate(WIDTHS):
        which = np.flatnonzero(kinds == k)
        if len(which):
            x[which] = np.frombuffer(b"".join(rows[i][1:] for i in which.tolist()), t).reshape(-1, dim)
    return x


def exact(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """Integers that sums and products with ``factor`` cannot overflow: 64 bits where they do, else Python's."""
    top = max(abs(int(x.max())), abs(int(x.min())), 1) if x.size else 1
    return x if top * factor < 2**62 else x.astype(object)


@dataclass
class Fit:
    """The components of a fit list, the same for all rows."""

    dim: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


class FitList:
    """The distinct integer vectors of a table, stored in blocks, and sums over them."""

    def __init__(self, rows: DataFrame, dim: int, vector_column: str):
        self.dim = dim

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("x", pa.binary())])
            for b in batches:
                yield batch(schema, to_bytes(vectors(b.column("v"), dim)[1]))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("rows", pa.int32()), ("width", pa.int32()), ("block", pa.binary())])

            def block(rows: list[bytes]) -> pa.RecordBatch:
                x = from_bytes(rows, dim)
                k = max(r[0] for r in rows)
                return batch(schema, [len(x)], [k], [x.astype(WIDTHS[k]).tobytes()])

            held: list[bytes] = []
            for b in batches:
                held += b.column("x").to_pylist()
                while len(held) >= BLOCK_ROWS:
                    yield block(held[:BLOCK_ROWS])
                    del held[:BLOCK_ROWS]
            if held:
                yield block(held)
            released()

        distinct = rows.select(F.col(vector_column).alias("v")).mapInArrow(coded, "x binary").groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
        self.blocks = stored(distinct.select("x").mapInArrow(blocks, "rows int, width int, block binary"))
        self.tasks = self.blocks.rdd.getNumPartitions()
        self.passes = 0

    def _matrices(self) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
        dim = self.dim

        def each(b: pa.RecordBatch) -> Iterator[np.ndarray]:
            for k, blob in zip(b.column("width").to_pylist(), b.column("block"), strict=True):
                yield np.frombuffer(blob.as_buffer(), WIDTHS[k]).reshape(-1, dim)

        return each

    def exact_sums(self) -> tuple[int, list[int], int]:
        """``(n, S, sum of all squares)``; sums per task, added up as 38 decimals and exact below 10^38."""
        each = self._matrices()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dim, n, sums, squares = self_dim, 0, [0] * self_dim, 0
            for b in batches:
                for x in map(lambda m: m.astype(np.int64), each(b)):
                    n += len(x)
                    own = exact(x, len(x)).sum(axis=0)
                    sums = [a + int(s) for a, s in zip(sums, own, strict=True)]
                    y = exact(x, max(1, int(np.abs(x.astype(np.float64)).max())) * x.size)
                    squares += int((y * y).sum())
            yield batch(pa.schema([("at", pa.int32()), ("s", pa.string())]), range(dim + 2), map(str, [*sums, squares, n]))

        self_dim = self.dim
        parts = self.blocks.mapInArrow(partial, "at int, s string")
        rows = parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        total = {r["at"]: int(r["s"]) for r in rows}
        return total.get(self.dim + 1, 0), [total.get(i, 0) for i in range(self.dim)], total.get(self.dim, 0)

    def sum_over(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum of ``of(block)``: added up per task, then in a fixed number of groups, then here."""
        each, spark = self._matrices(), self.blocks.sparkSession
        groups = min(SUMS, tasks(spark))
        schema = pa.schema([("part", pa.int32()), ("sum", pa.binary())])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(shape)
            for b in batches:
                for x in each(b):
                    total += of(x.astype(np.float64))
            yield batch(schema, [TaskContext.get().partitionId() % groups], [total.tobytes()])

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer()) for x in group.column("sum"))
            return pa.table([[group.column("part")[0].as_py()], [total.tobytes()]], schema=schema)

        parts = self.blocks.mapInArrow(partial, "part int, sum binary")
        if self.tasks > groups:
            parts = parts.groupBy("part").applyInArrow(add, "part int, sum binary")
        self.passes += 1
        rows = sorted(parts.collect())
        return sum((np.frombuffer(r["sum"]) for r in rows), np.zeros(math.prod(shape))).reshape(shape)

    def covariance_times(self, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
        """``V q``: one pass of centred rows, never a matrix of all dimensions by all."""

        def of(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ q)

        return self.sum_over(of, q.shape) / n


def lowest(times: Callable[[np.ndarray], np.ndarray], dim: int) -> float:
    """A bound under the spectrum of a symmetric matrix that is not negative: a few Lanczos steps and their residual."""
    v = np.random.default_rng(1).standard_normal(dim)
    basis, alpha, beta = [v / np.linalg.norm(v)], [], []
    for _ in range(min(LANCZOS, dim)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            for u in basis:
                w = w - (w @ u) * u
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            beta[-1] = 0.0
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1)
    values, vecs = np.linalg.eigh(t)
    return max(0.0, float(values[0]) - beta[-1] * abs(float(vecs[-1, 0])))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """A polynomial of the matrix times ``q``: at most 1 on [low, cut], scaled to 1 at ``top``, by its three-term recurrence."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    ratio = first = half / (top - middle)
    before, now = q, (times(q) - middle * q) * (ratio / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - ratio)
        before, now = now, (times(now) - middle * now) * (2 * following / half) - before * (ratio * following)
        ratio = following
    return now


def components(fit_list: FitList, count: int) -> Fit | None:
    """The ``count`` first components, to a residual of about 13 digits of the largest eigenvalue.

    A block of orthonormal columns goes through the Chebyshev filter, which damps all directions under
    the smallest Ritz value of the block, then through QR and Rayleigh-Ritz, until the residuals
    |V u - e u| of all components are certified, or certified as far as rounding lets them fall. The
    driver holds a few matrices of dimension x block, whatever the number of rows.
    """
    n, sums, squares = fit_list.exact_sums()
    if not n:
        return None
    dim = fit_list.dim
    mean = np.array([s / n for s in sums])
    trace = (n * squares - sum(s * s for s in sums)) / n**2
    width = min(dim, SPARE * count)
    times = lambda q: fit_list.covariance_times(mean, n, q)
    if trace <= 0:
        return Fit(dim, n, sums, trace, np.zeros(0), np.zeros((dim, 0)), fit_list.passes)
    q = np.eye(dim) if width == dim else np.linalg.qr(np.random.default_rng(0).standard_normal((dim, width)))[0]
    low = lowest(times, dim) if width < dim else 0.0
    last = math.inf
    while True:
        z = times(q)
        h = q.T @ z
        values, w = np.linalg.eigh((h + h.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        u = q @ w
        some = min(count, width)
        residual = float(np.linalg.norm(z @ w[:, :some] - u[:, :some] * values[:some], axis=0).max()) / values[0]
        if width == dim or residual <= CERTIFIED or (residual <= STALLED and residual > last / 2):
            break
        last = residual
        # below the last Ritz value lies nothing wanted; keep the interval inside the spectrum's own scale
        cut = max(float(values[-1]), low + 1e-6 * float(values[0]))
        q = np.linalg.qr(filtered(times, u, min(low, cut * 0.999), cut, float(values[0]), DEGREE))[0]
    keep = values[:some] > FLAT * values[0]
    u = u[:, :some][:, keep]
    return Fit(dim, n, sums, trace, values[:some][keep], u / np.linalg.norm(u, axis=0), fit_list.passes)


def identity_error(fit_list: FitList, fit: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity: one pass for the mean, one centred."""
    project = fit.vectors / np.sqrt(fit.values)
    mean, k = fit.mean, len(fit.values)
    if not k:
        return 0.0
    middle = fit_list.sum_over(lambda x: ((x - mean) @ project).sum(axis=0), (k,)) / fit.n

    def of(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ project - middle
        return y.T @ y

    return float(np.abs(fit_list.sum_over(of, (k, k)) / fit.n - np.eye(k)).max())


def most_frequent_size(rows: DataFrame, vector_column: str) -> int:
    """The length that most whole vectors have, of equally frequent ones the largest; 0 without any."""
    whole = F.col(vector_column).isNotNull() & F.forall(
        vector_column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    sizes = rows.filter(whole).groupBy(F.size(vector_column).alias("d")).count().filter("d > 0")
    found = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def whitening(rows: DataFrame, count: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: rows times components.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another
    length than most have. Entries become ``floor(256 c)``. The fit list holds each distinct integer
    vector once: distinct vectors are found by a grouped exchange with a partial step before it,
    so a hot vector sends one row per task. They are stored in blocks that every pass reads.
    ``components`` finds the eigenvectors by passes over these blocks; the rows are then projected in one
    scan of the table.

    ``deviation`` is exact; null where it does not fit 64 bits. Components without variance are left out, so
    a table of equal vectors, or an empty one, gives no rows. Identifiers may be null or repeated; other
    columns are not read. ``identity_error`` is one value for all rows.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    dim = most_frequent_size(own, "v")
    fit = None
    if dim:
        fit_list = FitList(own, dim, "v")
        fit = components(fit_list, count)
        fit.identity_error = identity_error(fit_list, fit)
    if fit is None or not len(fit.values):
        return rows.sparkSession.createDataFrame([], ddl)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, mean = len(fit.values), fit.mean
        onto, share = fit.vectors / np.sqrt(fit.values), fit.values / fit.trace
        sums = np.array(fit.sums, object)
        for b in batches:
            which, x = vectors(b.column("v"), dim)
            white = (x - mean) @ onto
            off = x * fit.n - np.array(fit.sums, np.int64) if _fits(x, fit) else x.astype(object) * fit.n - sums
            square = (off * off).sum(axis=1)
            deviation = [d if d < 2**63 else None for d in square.tolist()]
            ids = b.column("id").take(pa.array(which)).to_pylist()
            m = len(ids)
            yield batch(schema, [i for i in ids for _ in range(k)], np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n),
                        [d for d in deviation for _ in range(k)], white.ravel(), np.tile(share, m), np.full(m * k, fit.identity_error))

    return own.mapInArrow(project, ddl)


def _fits(x: np.ndarray, fit: Fit) -> bool:
    """Whether the deviations of these rows can be computed in 64 bits."""
    top = float(np.abs(x.astype(np.float64)).max()) * fit.n + max(map(abs, fit.sums), default=0) if x.size else 0.0
    return top * top * max(fit.dim, 1) < 2.0**62
