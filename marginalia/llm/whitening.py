"""Embedding whitening by incremental eigendecomposition.

Vectors become integers, floor(64 c) + 1000000. The fit list holds each distinct integer vector once. Every task keeps the
spectrum of the vectors it has read and takes in each further one by a centred rank-one update: the eigenvalues are the
roots of a secular equation, found side by side after deflation of the entries that do not change. Spectra of tasks are
combined eight at a time, in rounds, the smaller one's eigenpairs being added by successive rank-one updates. A last
distributed Rayleigh-Ritz step projects the exactly centred vectors on that basis and turns it to the eigenvectors to
double precision; one more pass measures how far the covariance of the whitened fit list is from the identity.

A spectrum has the size of dimensions squared, whatever the number of vectors; an update costs dimensions cubed. Nothing
else passes through the driver.

Defined cases: rows whose vector is null, empty or holds a null or non-finite entry are dropped, and so are vectors of
another length than most have (of two lengths equally frequent the longer counts); repeated rows are returned each but
fitted once; null ids stay; further columns are ignored; an empty table gives an empty result. A component along which the
fit list does not vary (always so if it has one vector) has a null whitened value and explains 0. A deviation beyond a long
stops the job with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import discard, materialise, plain

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: States that are combined in one group.
FAN = 8
_EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rising poles and positive squares the roots of 1 + sum(squares / (poles - x)) = 0: (nearest pole of each root, root less that pole).

    Each root lies between two poles, the last one at most sum(squares) above the last pole. All are iterated together by a
    rational function through both neighbouring poles, and by bisection where that leaves the bracket.
    """
    n = len(poles)
    gap = np.append(np.diff(poles), squares.sum())
    with np.errstate(all="ignore"):
        # the sign halfway tells the nearer pole, from which the root is measured
        middle = 1 + (squares / ((poles[None, :] - poles[:, None]) - gap[:, None] / 2)).sum(axis=1)
        low = (middle >= 0) | (np.arange(n) == n - 1)
        base = np.arange(n) + ~low
        delta = poles[None, :] - poles[base][:, None]
        left, right = np.arange(n), np.append(np.arange(1, n), n - 1)
        lo, hi = np.where(low, 0.0, -gap / 2), np.where(low, np.where(middle >= 0, gap / 2, gap), 0.0)
        lo = np.where((np.arange(n) == n - 1) & (middle < 0), gap / 2, lo)
        x = (lo + hi) / 2
        below = np.arange(n)[None, :] <= np.arange(n)[:, None]
        last = np.arange(n) == n - 1
        for _ in range(80):
            d = delta - x[:, None]
            term = squares / d
            slope = term / d
            f = 1 + term.sum(axis=1)
            done = np.abs(f) <= 4 * n * _EPS * (1 + np.abs(term).sum(axis=1))
            lo, hi = np.where(f < 0, x, lo), np.where(f > 0, x, hi)
            if (done | (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))).all():
                break
            up = (slope * below).sum(axis=1)
            down = slope.sum(axis=1) - up
            dl, dr = d[left, left], np.where(last, gap - x, d[left, right])
            a = (dl + dr) * f - dl * dr * (up + down)
            b = dl * dr * f
            c = f - dl * up - dr * down
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
            inside = np.isfinite(new) & (new > lo) & (new < hi)
            x = np.where(done, x, np.where(inside, new, (lo + hi) / 2))
    return base, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (rising values, vectors in columns) of vectors diag(values) vectors' + rho v v', for rho >= 0."""
    z = vectors.T @ v
    size = float(np.linalg.norm(z))
    if not rho * size:
        return values, vectors
    tol = 8 * _EPS * max(float(np.abs(values).max()), rho * size * size)
    values, vectors = values.copy(), vectors.copy()
    active = np.flatnonzero(rho * np.abs(z) * size > tol)
    # of eigenvalues that are as good as equal, one takes over the whole entry: a plane rotation
    kept: list[int] = []
    for j in active:
        if kept and values[j] - values[kept[-1]] <= tol:
            i = kept.pop()
            r = np.hypot(z[i], z[j])
            cos, sin = z[j] / r, z[i] / r
            vectors[:, i], vectors[:, j] = cos * vectors[:, i] - sin * vectors[:, j], sin * vectors[:, i] + cos * vectors[:, j]
            z[i], z[j] = 0.0, r
        kept.append(j)
    at = np.array(kept, int)
    if not len(at):
        return values, vectors
    poles, own = values[at], z[at]
    base, x = secular_roots(poles, rho * own * own)
    # distances of every pole from every root, by differences that lose no digits
    away = (poles[:, None] - poles[base][None, :]) - x[None, :]
    # entries for which the roots are exact, so that the new vectors are orthogonal
    n = len(at)
    ratio = -away / np.where(np.eye(n, dtype=bool), 1.0, poles[None, :] - poles[:, None])
    ratio = np.where(np.eye(n, dtype=bool), -away, np.abs(ratio))
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(own)
    turned = exact[:, None] / away
    turned /= np.linalg.norm(turned, axis=0)
    vectors[:, at] = vectors[:, at] @ turned
    values[at] = poles[base] + x
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean and eigenpairs of the scatter of vectors."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(d), np.zeros(d), np.eye(d)

    def add(self, y: np.ndarray) -> None:
        away = y - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if self.n < other.n:
            self.__dict__, other.__dict__ = other.__dict__, self.__dict__
        if not other.n:
            return
        for value, v in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, v, max(float(value), 0.0))
        away, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / n)
        self.mean, self.n = self.mean + away * (other.n / n), n

    def pack(self) -> tuple[int, bytes]:
        return self.n, np.concatenate((self.mean, self.values, self.vectors.ravel())).tobytes()

    @classmethod
    def unpack(cls, n: int, state: bytes, d: int) -> Spectrum:
        out, all_ = cls(d), np.frombuffer(state)
        out.n, out.mean, out.values, out.vectors = n, all_[:d], all_[d : 2 * d], all_[2 * d :].reshape(d, d)
        return out


def integers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def _matrix(batch: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _states(fit: DataFrame, start: Callable, take: Callable, give: Callable) -> DataFrame:
    """One (node, n, state) a task, from its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = start(), 0
        for batch in batches:
            if batch.num_rows:
                own = take(own, batch)
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([give(own)], pa.binary())], names=["node", "n", "state"])

    return fit.mapInArrow(run, "node long, n long, state binary")


def _combined(states: DataFrame, merge: Callable[[list[tuple[int, bytes]]], bytes]) -> tuple[int, bytes] | None:
    """All states as one: FAN of them to a group, round after round."""

    def run(rows: pa.Table) -> pa.Table:
        parts = sorted(zip(rows.column("node").to_pylist(), rows.column("n").to_pylist(), rows.column("state").to_pylist()))
        return pa.table({"node": pa.array([parts[0][0] // FAN], pa.int64()), "n": pa.array([sum(n for _, n, _ in parts)], pa.int64()), "state": pa.array([merge([p[1:] for p in parts])], pa.binary())})

    now = materialise(states)
    for _ in count():
        if now.count() <= 1:
            break
        before = now
        now = materialise(now.groupBy(F.floor(F.col("node") / FAN)).applyInArrow(run, "node long, n long, state binary"))
        discard(before)
    row = now.first()
    discard(now)
    return (row.n, bytes(row.state)) if row else None


def _sum(parts: list[tuple[int, bytes]]) -> bytes:
    return np.sum([np.frombuffer(s) for _, s in parts], axis=0).tobytes()


def _products(fit: DataFrame, centred: Callable[[pa.RecordBatch], np.ndarray], basis: np.ndarray) -> np.ndarray:
    """(projections)' (projections) of all centred vectors on a basis."""
    k = basis.shape[1]

    def take(own: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        p = centred(batch) @ basis
        return own + p.T @ p

    _, state = _combined(_states(fit, lambda: np.zeros((k, k)), take, lambda own: own.tobytes()), _sum)
    return np.frombuffer(state).reshape(k, k)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component (from 1, by falling eigenvalue): id, component, n, deviation, whitened, explained, identity_error."""
    v = plain(vector_col)
    schema = rows.select(plain(id_col)).schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    good = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))
    common = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not common:
        return rows.sparkSession.createDataFrame([], schema)
    d = common.d
    good = good.where(F.size(v) == d).select(plain(id_col), integers(v).alias("__x"))
    fit = materialise(good.select("__x").distinct())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros(d, np.int64), 0
        for batch in batches:
            s += _matrix(batch, 0, d).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(s), pa.array(np.full(d, n))], names=["dim", "s", "n"])

    totals = fit.mapInArrow(add, "dim int, s long, n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    n, sums = totals[0].n, np.array([t.s for t in totals], np.int64) - SHIFT * totals[0].n

    def away(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
        """n x - S, in exact integers."""
        x = _matrix(batch, at, d) - SHIFT
        if int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max()) < 2**62:
            return n * x - sums
        return n * x.astype(object) - sums.astype(object)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return away(batch).astype(float) / n

    def take(own: Spectrum, batch: pa.RecordBatch) -> Spectrum:
        for y in centred(batch):
            own.add(y)
        return own

    def merged(parts: list[tuple[int, bytes]]) -> bytes:
        out = Spectrum(d)
        for m, state in parts:
            out.merge(Spectrum.unpack(m, state, d))
        return out.pack()[1]

    m, state = _combined(_states(fit, lambda: Spectrum(d), take, lambda own: own.pack()[1]), merged)
    basis = np.linalg.qr(Spectrum.unpack(m, state, d).vectors[:, ::-1])[0]
    # Rayleigh-Ritz: the covariance as the basis sees it, from exactly centred vectors
    ritz = _products(fit, centred, basis) / n
    values, turn = np.linalg.eigh(ritz)
    order = np.argsort(-values)[: min(components, d)]
    trace, values, vectors = float(np.trace(ritz)), values[order], (basis @ turn)[:, order]
    varies = values > 8 * d * _EPS * max(float(values.max()), 0.0)
    scaled = vectors / np.sqrt(np.where(varies, values, 1.0))
    error = 0.0
    if varies.any():
        error = float(np.abs(_products(fit, centred, scaled[:, varies]) / n - np.eye(int(varies.sum()))).max())
    discard(fit)
    share = np.where(varies, values / (trace or 1.0), 0.0)
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(s, 2000) for whole in batches for s in range(0, whole.num_rows, 2000)):
            far = away(batch, 1)
            if far.dtype != object and d * int(np.abs(far).max(initial=0)) ** 2 >= 2**63:
                far = far.astype(object)
            spread = (far * far).sum(axis=1)
            white = (far.astype(float) / n) @ scaled
            rows = batch.num_rows
            repeat = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), pa.array(spread.tolist(), pa.int64()).take(repeat),
                    pa.array(white.ravel(), mask=np.tile(~varies, rows)), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, error)),
                ],
                names=schema.names,
            )

    return good.mapInArrow(project, schema)
