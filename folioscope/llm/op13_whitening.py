"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

An entry c becomes the whole number x = floor(64 c) + 1000000. The model is fitted on the distinct x vectors, which are
written to the shared folder once, and never forms the covariance V: all it asks of the data are products of V with a
block of ``2 * components`` directions (at least 32), one Spark pass each. A task centres its rows exactly
(n x - S in whole numbers), multiplies them with the block and back, and passes on one matrix of dimensions x block; these
are summed in groups of rows of the matrix. The driver sees sums of that size, never vectors.

1. The block begins at random (fixed seed) and is made orthonormal.
2. Rayleigh-Ritz: the eigenvectors of Q'VQ turn the block; the smallest Ritz value bounds the unwanted spectrum.
3. The Chebyshev polynomial of that interval is applied by its three-term recurrence, a pass for each degree. It stays
   small on the interval and grows quickly above it. QR makes the block orthonormal again.
4. Steps 2 and 3 go on until every wanted pair is certified: |V q - e q| is at most 1e-12 of the largest value. A block
   that doesn't get there in ``patience`` rounds (a nearly flat spectrum) is doubled; a block of all dimensions is exact.

Rows whose vector is null, empty, holds nulls or non-finite entries, or an entry beyond 2**53 / 64, are dropped; so are
rows of another length than the most frequent one (the longer of two equally frequent). Components whose value is below
1e-12 of the largest have no scale; they are left out, so a fit list of one vector gives no rows. Null vec_id: kept.
Repeated rows and vectors: each row is returned, the fit counts a vector once. Equal eigenvalues: any orthonormal basis of
their space. ``deviation`` is null where it doesn't fit a long. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, DEGREE, PATIENCE, TIGHT = 16, 10, 8, 1e-12
ROWS = 4096  # vectors multiplied at once
SLICE = 32  # rows of a matrix that are summed in one group


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_dims, x): valid vectors as packed 64-bit numbers floor(64 c), without the shift."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ok = np.asarray(lists.is_valid())
            lists = lists.fill_null([]) if lists.null_count else lists
            flat = lists.flatten()
            values = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            length = np.diff(lists.offsets.to_numpy())
            ends = np.concatenate([[0], np.cumsum(length)])
            bad = np.concatenate([[0], np.cumsum(~(np.abs(values) <= 2.0**53))])
            ok &= (length > 0) & (bad[ends[1:]] == bad[ends[:-1]])
            x = np.where(np.isfinite(values), np.clip(values, -(2.0**53), 2.0**53), 0).astype("<i8")
            rows = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(length[rows].astype(np.int32)), pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in rows], pa.binary())],
                names=["vec_id", "n_dims", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, n_dims int, x binary")


def blocks(column: pa.Array, dims: int):
    """Matrices of at most ROWS vectors."""
    for k in range(0, len(column), ROWS):
        part = column.slice(k, ROWS).to_pylist()
        yield np.frombuffer(b"".join(part), dtype="<i8").reshape(len(part), dims)


class Centre:
    """n, the sums of all dimensions, and centring in whole numbers where they fit 64 bits."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums, self.dims = n, sums, len(sums)
        self.small = 2 * n * (largest + 1) < 2**62
        self.s = np.array(sums, dtype=np.int64) if self.small else None
        self.mean = np.array([float(Fraction(s, n)) for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.s) / float(self.n) if self.small else x - self.mean

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; the shift of x cancels."""
        if self.small:
            y = x * self.n - self.s
            if self.dims * float(np.abs(y).max(initial=0)) ** 2 < 2.0**62:
                return (y * y).sum(axis=1).tolist()
            rows = y.astype(object)
        else:
            rows = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        out = [int(v) for v in (rows * rows).sum(axis=1)]
        return [v if v < 2**63 else None for v in out]


def centre(fit: DataFrame, dims: int) -> Centre:
    """Count, sums and the largest entry of the fit list; sums in halves of 32 bits, added as decimals."""

    def run(batches):
        n, high, low, most = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            for x in blocks(batch.column(0), dims):
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                most = np.maximum(most, np.abs(x).max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low), pa.array(most)], names=["dim", "n", "high", "low", "most"])

    parts = fit.mapInArrow(run, "dim long, n long, high long, low long, most long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("dim").agg(total("n"), total("high"), total("low"), F.max("most").alias("most")).orderBy("dim").collect()
    return Centre(int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows], max(int(r["most"]) for r in rows)) if rows else Centre(0, [], 0)


def gathered(fit: DataFrame, at: Centre, make, shape: tuple[int, int]) -> np.ndarray:
    """Sum over the fit list of ``make(centred rows)``, a matrix of ``shape``: one Spark pass."""

    def run(batches):
        total, seen = np.zeros(shape), False
        for batch in batches:
            for x in blocks(batch.column(0), at.dims):
                total += make(at.centred(x))
                seen = True
        if seen:
            for k in range(0, shape[0], SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + SLICE].tobytes()], pa.binary())], names=["first", "part"])

    def add(key, rows):
        total = sum(np.frombuffer(p.as_py()) for p in rows.column("part"))
        return pa.table({"first": pa.array([key[0].as_py()], pa.int32()), "part": [total.tobytes()]})

    sums = fit.mapInArrow(run, "first int, part binary").groupBy("first").applyInArrow(add, "first int, part binary")
    rows = sorted((r["first"], bytes(r["part"])) for r in sums.collect())
    return np.frombuffer(b"".join(p for _, p in rows)).reshape(shape)


def filtered(times, q: np.ndarray, vq: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of V on [0, cut], applied to q; ``vq`` is V q."""
    half = cut / 2
    first = sigma = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, 2 * (following / half) * (times(now) - half * now) - sigma * following * before
        sigma = following
    return now


def components(fit: DataFrame, at: Centre, most: int, degree: int = DEGREE, patience: int = PATIENCE):
    """(eigenvectors as columns, eigenvalues, trace) of the covariance, largest first, certified."""
    dims, rng = at.dims, np.random.default_rng(13)
    want, width = min(most, dims), min(dims, max(2 * most, 32))
    times = lambda q: gathered(fit, at, lambda y: y.T @ (y @ q), q.shape) / at.n
    trace = float(gathered(fit, at, lambda y: (y * y).sum(axis=0)[:, None], (dims, 1)).sum()) / at.n
    q, rounds = np.linalg.qr(rng.standard_normal((dims, width)))[0], 0
    while True:
        vq = times(q)
        inner = q.T @ vq
        e, u = np.linalg.eigh((inner + inner.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        off = np.linalg.norm(vq - q * e, axis=0)[:want].max()
        if width == dims or off <= TIGHT * e[0] or e[0] <= 0:
            return q[:, :want], e[:want], trace
        rounds += 1
        if rounds % patience == 0:
            width = min(dims, 2 * width)
            q, _ = np.linalg.qr(np.hstack([q, rng.standard_normal((dims, width - q.shape[1]))]))
            continue
        cut = e[-1]
        if cut > TIGHT * e[0]:
            q = filtered(times, q, vq, cut, e[0], degree)
        else:  # the block holds all of the range
            q = vq
        q, _ = np.linalg.qr(q)


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row per valid row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = whole(vectors)
    usual = rows.groupBy("n_dims").count().orderBy(F.desc("count"), F.desc("n_dims")).first()
    if usual is None:
        return spark.createDataFrame([], kinds)
    dims = int(usual["n_dims"])
    rows = rows.filter(F.col("n_dims") == dims).select("vec_id", "x")
    fit = common.staged(rows.select("x").distinct(), "fit")
    at = centre(fit, dims)
    vectors_, values, trace = components(fit, at, most)
    kept = int((values > TIGHT * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], kinds)
    turn, explained = vectors_[:, :kept] / np.sqrt(values[:kept]), values[:kept] / trace
    # mean and covariance of the whitened fit list, gathered in a pass of their own
    got = gathered(fit, at, lambda y: np.vstack([(z := y @ turn).T @ z, z.sum(axis=0)]), (kept + 1, kept)) / at.n
    error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(kept)).max())

    def run(batches):
        for batch in batches:
            for k, x in enumerate(blocks(batch.column(1), dims)):
                ids, many = batch.column(0).slice(k * ROWS, ROWS), len(x)
                each = np.repeat(np.arange(many), kept)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), many)), pa.array(np.full(len(each), at.n)),
                     pa.array(at.deviation(x), pa.int64()).take(pa.array(each)), pa.array((at.centred(x) @ turn).ravel()),
                     pa.array(np.tile(explained, many)), pa.array(np.full(len(each), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kinds)
