"""Whitening of embeddings: Welford's rank-one updates in each partition, merged in a tree, and a symmetric QR solve.

Entries are read as whole steps of 1/64. The fit sees each distinct vector once: a partition streams its vectors into
a mean and a matrix of centred products, pairs of those merge by the parallel update formula (Chan et al., 1983), and
the eigenvectors of the one that is left are found by Householder's reduction and implicit QR steps with Wilkinson's
shift. What goes to the driver is one matrix of the vectors' length squared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseplane.llm.common import cut, shared_dir

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Partial statistics that merge in one task.
FAN_IN = 16
#: Steps stop here, some 7 * 10^16 from zero, so that they fit a long whatever the entry.
MOST = 2**62
_STATS = "dims int, part long, n long, sums binary, mean binary, m2 binary"


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def steps(vector: str | Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * entry) + offset as longs."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))) + offset)


class Welford:
    """Number, exact sums, mean and centred products of the rows seen so far; the mean is that of rows less `offset`."""

    def __init__(self, dims: int, offset: int = OFFSET) -> None:
        self.n, self.sums, self.offset = 0, [0] * dims, offset
        self.mean, self.m2 = np.zeros(dims), np.zeros((dims, dims))

    def update(self, rows: np.ndarray) -> None:
        if rows.dtype.kind == "i":
            small = not len(rows) or np.abs(rows).max() < 2**40
            self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(axis=0) if small else rows.astype(object).sum(axis=0), strict=True)]
            rows = (rows - self.offset).astype(np.float64)
        for x in rows:
            self.n += 1
            d = x - self.mean
            self.mean += d / self.n
            self.m2 += np.outer(d, x - self.mean)

    def merge(self, other: Welford) -> None:
        n = self.n + other.n
        if not other.n:
            return
        d = other.mean - self.mean
        self.mean += d * (other.n / n)
        self.m2 += other.m2 + np.outer(d, d) * (self.n * other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    @staticmethod
    def read(n: int, sums: bytes, mean: bytes, m2: bytes) -> Welford:
        out = Welford(0)
        out.mean = np.frombuffer(mean).copy()
        out.n, out.m2 = n, np.frombuffer(m2).reshape(len(out.mean), -1).copy()
        out.sums = [int(s) for s in sums.decode().split(",")] if sums else []
        return out


def _batch(stats: dict[int, Welford], part: int) -> pa.RecordBatch:
    rows = sorted(stats.items())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows], pa.int32()), pa.array([part for _ in rows], pa.int64()), pa.array([s.n for _, s in rows], pa.int64()),
            *[pa.array(x, pa.binary()) for x in ([",".join(map(str, s.sums)).encode() for _, s in rows], [s.mean.tobytes() for _, s in rows], [s.m2.tobytes() for _, s in rows])],
        ],
        names=["dims", "part", "n", "sums", "mean", "m2"],
    )


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrices of the vectors of each length; empty ones are left out."""
    sizes = np.asarray(column.value_lengths())
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def statistics(vectors: DataFrame, into: dict[int, Reduced] | None = None) -> dict[int, Welford]:
    """By length, of the one column of vectors, or of their whitened form; merged in a tree of tasks."""
    shared = vectors.sparkSession.sparkContext.broadcast(into) if into else None

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats: dict[int, Welford] = {}
        for batch in batches:
            for _, rows in _by_length(batch.column(0)):
                d = rows.shape[1]
                if shared:
                    rows = shared.value[d].whitened(rows)
                stats.setdefault(d, Welford(rows.shape[1], 0 if shared else OFFSET)).update(rows)
        yield _batch(stats, TaskContext.get().partitionId())

    def merged(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["at"])  # FAN_IN of them
        whole = Welford.read(*[rows[0][c] for c in ("n", "sums", "mean", "m2")])
        for r in rows[1:]:
            whole.merge(Welford.read(*[r[c] for c in ("n", "sums", "mean", "m2")]))
        return pa.Table.from_batches([_batch({rows[0]["dims"]: whole}, rows[0]["part"])])

    got = cut(vectors.mapInArrow(streamed, _STATS))
    parts = (got.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        # the places of parts stay dense, so a group holds FAN_IN of them at most
        group = got.withColumn("at", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        got = group.groupBy("dims", "part").applyInArrow(merged, _STATS)
        parts = -(-parts // FAN_IN)
    return {r["dims"]: Welford.read(r["n"], bytes(r["sums"]), bytes(r["mean"]), bytes(r["m2"])) for r in got.collect()}  # one row for each length


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and rows q with q a q' of that form, by Householder's reflections."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not np.any(v[1:]):
            continue
        to = -np.copysign(size, v[0])
        v[0] -= to
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = to
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, whose largest entry is positive."""
    d, e, q = tridiagonal(a)
    high, eps = len(d) - 1, np.finfo(np.float64).eps
    while high > 0:
        near = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][near] = 0
        if not e[high - 1]:
            high -= 1
            continue
        zeros = np.flatnonzero(e[:high] == 0)
        low = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # chase the bulge down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    q = q[order] / np.linalg.norm(q[order], axis=1, keepdims=True)
    return d[order], q * np.sign(np.take_along_axis(q, np.abs(q).argmax(axis=1)[:, None], axis=1))


@dataclass(frozen=True)
class Reduced:
    """What is known of the vectors of one length."""

    n: int
    sums: tuple[int, ...]
    #: Unit rows, their eigenvalues, and those by the trace.
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def offsets(self, steps_: np.ndarray) -> np.ndarray:
        """n * x - sum, exactly."""
        far = max((abs(s) for s in self.sums), default=0) + (int(np.abs(steps_).max()) if steps_.size else 0) * self.n
        wide = object if far >= 2**62 else np.int64
        return steps_.astype(wide) * self.n - np.array(self.sums, wide)

    def whitened(self, steps_: np.ndarray) -> np.ndarray:
        """Unit variance along each component; 0 along those without any."""
        centred = (self.offsets(steps_) / self.n).astype(np.float64)
        along = centred @ self.components.T
        return np.divide(along, np.sqrt(self.values), out=np.zeros_like(along), where=self.values > 0)

    def deviations(self, steps_: np.ndarray) -> list[int | None]:
        """Sums of squares of the offsets, exactly; None where a long can't hold one."""
        off = self.offsets(steps_)
        if off.size and float(np.abs(off).max()) ** 2 * off.shape[1] >= 2.0**62:
            return [x if x < 2**63 else None for x in (sum(int(v) ** 2 for v in row) for row in off)]
        return (off.astype(np.int64) ** 2).sum(axis=1).tolist()


@dataclass(frozen=True)
class Model:
    by_length: dict[int, Reduced]
    identity_error: float


def reduced(stats: Welford, components: int) -> Reduced:
    values, vectors = symmetric_qr(stats.m2 / max(stats.n, 1))
    trace = float(np.trace(stats.m2)) / max(stats.n, 1)
    none = values <= max(float(values[0]), 0) * len(values) * np.finfo(np.float64).eps * 16  # as good as nothing
    values = np.where(none, 0.0, values)[:components]
    return Reduced(stats.n, tuple(stats.sums), vectors[:components], values, values / trace if trace > 0 else np.zeros_like(values))


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    """From each distinct vector of steps once; vectors of each length are whitened among themselves.

    Null vectors, and such as hold nulls or other than finite numbers, are left out; so are empty ones, which have
    no component. A vector that makes up a third of all rows is one row of each task before the shuffle. The distinct
    vectors are written to the shared folder, read twice (once to measure the whitened covariance) and deleted.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    rows.where(usable(vector)).select(steps(vector).alias("x")).distinct().write.parquet(folder)
    try:
        distinct = spark.read.parquet(folder)
        by_length = {d: reduced(s, components) for d, s in statistics(distinct).items()}
        error = 0.0
        for d, s in statistics(distinct, by_length).items() if by_length else ():
            live = by_length[d].values > 0
            if live.any():
                error = max(error, float(np.abs(s.m2 / s.n - np.eye(len(live)))[np.ix_(live, live)].max()))
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return Model(by_length, error)


_WHITENED = pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("values", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64()))])


def whiten(rows: DataFrame, model: Model, vector: str = "embedding", into: str = "whitening") -> DataFrame:
    """rows with a usable vector, with the struct `into`: n, deviation, values and explained by component.

    deviation is the exact sum of squares of n times the steps less their sum (null beyond a long). Along components
    without variance values are 0. Repeated rows stay, no rows give no rows, a column `into` is replaced; a vector
    of a length that the model has not seen, and an empty one, has no values.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model.by_length)

    @F.arrow_udf("struct<n:bigint,deviation:bigint,values:array<double>,explained:array<double>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out: list[dict] = [{"n": 0, "deviation": 0, "values": [], "explained": []}] * len(column)
            for at, x in _by_length(column):
                known = shared.value.get(x.shape[1])
                if known is not None:
                    for i, v, dev in zip(at.tolist(), known.whitened(x).tolist(), known.deviations(x), strict=True):
                        out[i] = {"n": known.n, "deviation": dev, "values": v, "explained": known.explained.tolist()}
            yield pa.array(out, _WHITENED)

    return rows.where(usable(vector)).withColumn(into, found(steps(vector)))
