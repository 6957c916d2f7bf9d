"""Whitening of embeddings: principal components by Chebyshev-filtered subspace iteration over distributed passes.

An entry c becomes the integer ``floor(1024 * c) + 100000``; sums of integers are exact, so all tasks centre
by the same mean. One pass over the vectors gives V Q for a block Q of a few more directions than are asked
for, V being the covariance: each task adds up its rows' part of ``XᵀXQ``, centred before multiplying, and the
parts are summed by dimension. What comes to the driver has dimensions times block entries, whatever the number of rows.

A round filters the block by a Chebyshev polynomial in V, one pass for each degree: it is small over the unwanted
spectrum, from the least eigenvalue to the block's least Ritz value, and grows fast above. The least eigenvalue is
bounded by a Lanczos recurrence whose vector rides along as one more column of each pass. QR makes the block orthonormal,
and Rayleigh-Ritz turns it into approximate components with one more pass, whose products also start the next round.
Rounds end when the wanted components are certified: each residual ``|Vq - eq|`` at most ``tolerance`` times the
largest eigenvalue, or as small as rounding lets it be. A last pass over the final components gives the covariance of the
whitened vectors, and so the identity error.

Defined results:
* vectors that are null or hold null or non-finite entries are dropped, as are those of another length than most
  (the longer of equally frequent lengths) and entries beyond 2**30, whose integers double arithmetic could not tell apart;
* no vectors left, or all of them equal: no rows; components whose variance is below 1e-12 of the largest are left out;
* each component's largest entry is positive;
* ``deviation`` is null where it does not fit into 64 bits;
* repeated rows and rows without an id are rows like others; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.scratch import Scratch

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 30)
#: Entries taken at a time.
SLICE = 1 << 20
#: A filter may enlarge the first component against the unwanted ones so much, else the others drown in rounding.
GROWTH = 1e8


def _integers(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors, and their integers."""
    column = column.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(column.type) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == d)
    flat = column.take(pa.array(rows, pa.int64())).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), d)  # null entries become nan
    with np.errstate(invalid="ignore"):
        good = (np.abs(values) < LARGEST).all(axis=1)
    return rows[good], np.floor(values[good] * SCALE).astype(np.int64) + SHIFT


def _vectors(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    """Slices of a batch of packed integers."""
    column = batch.column(0).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    x = np.frombuffer(column.buffers()[2], np.int64, (offsets[-1] - offsets[0]) // 8, offsets[0]).reshape(-1, d)
    step = max(1, SLICE // d)
    for k in range(0, len(x), step):
        yield x[k : k + step]


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray
    components: np.ndarray  # one column each
    variances: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)**2 of each row, exactly."""
        rough = ((self.n * x.astype(float) - self.sums) ** 2).sum(axis=1)
        if not len(x) or self.n * float(np.abs(x).max()) + float(np.abs(self.sums).max()) < 2**62 and rough.max() < 2**62:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        out = []
        for row, about in zip(x, rough, strict=True):
            exact = sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(row, self.sums, strict=True)) if about < 2**64 else 2**64
            out.append(exact if exact < 2**63 else None)
        return out


class _Lanczos:
    """Bounds the least eigenvalue from below, by products of one vector with V."""

    def __init__(self, d: int, least: int = 8, most: int = 40) -> None:
        self.vector: np.ndarray | None = np.random.default_rng(1).standard_normal(d)
        self.vector /= np.linalg.norm(self.vector)
        self.least, self.most = least, most
        self.basis: list[np.ndarray] = []
        self.diagonal: list[float] = []
        self.beside: list[float] = []

    def take(self, product: np.ndarray) -> None:
        self.basis.append(self.vector)
        self.diagonal.append(float(self.vector @ product))
        basis = np.array(self.basis)
        rest = product - basis.T @ (basis @ product)
        rest -= basis.T @ (basis @ rest)
        self.beside.append(float(np.linalg.norm(rest)))
        exact = self.beside[-1] <= 1e-10 * max(self.diagonal)
        self.vector = None if exact or len(self.basis) == self.most else rest / self.beside[-1]

    def low(self) -> float:
        """The least Ritz value less its residual; 0 while there are too few products for that to be safe."""
        if len(self.basis) < self.least:
            return 0.0
        values, vectors = np.linalg.eigh(np.diag(self.diagonal) + np.diag(self.beside[:-1], 1) + np.diag(self.beside[:-1], -1))
        return max(0.0, values[0] - 2 * self.beside[-1] * abs(vectors[-1, 0]))


class _Covariance:
    """V of the packed vectors of a table, known by its products."""

    def __init__(self, table: DataFrame, d: int) -> None:
        self.table, self.d, self.passes = table, d, 0
        self.lanczos = _Lanczos(d)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(d, np.int64), 0
            for batch in batches:
                for x in _vectors(batch, d):
                    total += x.sum(axis=0)
                    n += len(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total), pa.array(np.full(d, n))], ["dim", "total", "n"])

        found = self._by_dimension(table.mapInArrow(sums, "dim int, total bigint, n bigint"), "total", "n")
        self.n = int(found[0][1]) if found else 0
        self.sums = np.array([r[0] for r in found], np.int64)

    def _by_dimension(self, parts: DataFrame, *columns: str) -> list[tuple]:
        self.passes += 1
        rows = parts.groupBy("dim").agg(*(F.sum(c).alias(c) for c in columns)).collect()
        return [tuple(r[c] for c in columns) for r in sorted(rows, key=lambda r: r["dim"])]

    def times(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and the trace of V."""
        wanted = q.shape[1]
        q = np.column_stack([q, self.lanczos.vector]) if self.lanczos.vector is not None else q
        d, k = q.shape
        names = [f"q{j}" for j in range(k)]
        shared = self.table.sparkSession.sparkContext.broadcast((self.sums / self.n, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, block = shared.value
            out, squares = np.zeros((d, k)), np.zeros(d)
            for batch in batches:
                for x in _vectors(batch, d):
                    centred = x - mean
                    out += centred.T @ (centred @ block)
                    squares += np.einsum("ij,ij->j", centred, centred)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *(pa.array(c) for c in out.T), pa.array(squares)], ["dim", *names, "squares"])

        schema = ", ".join(["dim int", *(f"{c} double" for c in names), "squares double"])
        found = np.array(self._by_dimension(self.table.mapInArrow(run, schema), *names, "squares")) / self.n
        shared.unpersist()
        if k > wanted:
            self.lanczos.take(found[:, wanted])
        return found[:, :wanted], float(found[:, k].sum())


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values from large to small, vectors, and V times these."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def _filtered(v: _Covariance, q: np.ndarray, vq: np.ndarray, values: np.ndarray, degree: int) -> np.ndarray:
    """A scaled Chebyshev polynomial of V times q, whose unwanted interval ends at the block's least Ritz value."""
    high = max(values[-1], values[0] * 1e-12)
    low = min(v.lanczos.low(), 0.95 * high)
    centre, half = (high + low) / 2, (high - low) / 2
    first = (values[0] - centre) / half
    if first <= 1:
        return vq
    degree = max(2, min(degree, int(math.log(GROWTH) / math.acosh(first))))
    sigma = rate = 1 / first
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / rate - sigma)
        before, now = now, (v.times(now)[0] - centre * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def _orthonormal(q: np.ndarray) -> np.ndarray:
    return np.linalg.qr(q / np.maximum(np.linalg.norm(q, axis=0), 1e-300))[0]


def fit(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 8, guard: int = 16, degree: int = 10, tolerance: float = 1e-14, rounds: int = 200, seed: int = 7) -> Whitening | None:
    """The components of a table of vectors; None if no variance is left."""
    column = F.col(vector_col)
    most = vectors.where(column.isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or most["d"] < 1:
        return None
    d = most["d"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(_integers(batch.column(0), d)[1])
            offsets = np.arange(len(x) + 1, dtype=np.int64) * (8 * d)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())], ["x"])

    scratch = Scratch(vectors.sparkSession, "whitening")
    v = _Covariance(scratch.save(vectors.select(vector_col).mapInArrow(pack, "x binary"), "packed"), d)
    if not v.n:
        return None
    block = min(d, components + guard)
    q = _orthonormal(np.random.default_rng(seed).standard_normal((d, block)))
    best = math.inf
    stalled = 0
    for _ in range(rounds):
        vq, trace = v.times(q)
        if not trace > 0:
            return None
        values, q, vq = _ritz(q, vq)
        wanted = slice(0, min(components, block))
        residual = float(np.linalg.norm(vq[:, wanted] - q[:, wanted] * values[wanted], axis=0).max() / values[0])
        # Rounding keeps residuals from falling for ever: a small one that no longer halves is as good as it gets.
        stalled = stalled + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if residual <= tolerance or stalled >= 2 and residual <= 1e-11:
            break
        q = _orthonormal(_filtered(v, q, vq, values, degree))
    else:
        raise RuntimeError(f"components not certified: residual {residual:g} after {v.passes} passes")
    chosen = q[:, wanted][:, values[wanted] > 1e-12 * values[0]]
    chosen = chosen / np.linalg.norm(chosen, axis=0)
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    covariance = chosen.T @ v.times(chosen)[0]
    variances = np.diag(covariance).copy()
    whitened = covariance / np.sqrt(np.outer(variances, variances))
    scratch.drop("packed")
    return Whitening(v.n, v.sums, chosen, variances, trace, float(np.abs(whitened - np.eye(len(variances))).max()), residual, v.passes)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", model: Whitening | None = None, **options) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    model = model or fit(vectors, vector_col=vector_col, **options)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        d, k = m.components.shape
        step = max(1, SLICE // d)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            at, x = _integers(batch.column(1), d)
            rows = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, m.n)),
                    pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(m.of(x).ravel()),
                    pa.array(np.tile(m.variances / m.trace, rows)),
                    pa.array(np.full(rows * k, m.identity_error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
