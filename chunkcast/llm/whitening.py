"""Whitening of embeddings from an incrementally kept eigendecomposition.

Every task keeps the spectrum of the scatter of its vectors and takes each vector as one centred rank-one
update: the eigenvalues move to the roots of a secular equation, after deflation of components that the
update does not touch. Spectra of tasks are combined pair by pair by further rank-one updates, one for each
eigenvector of the smaller one and one for the distance of the means. A pass over all vectors then
projects the exactly centred vectors on the combined basis and solves that small problem
(Rayleigh and Ritz), which removes what rounding the updates have gathered.

A task holds a few matrices of d * d doubles for vectors of d numbers; an update takes O(d^3) steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chunkcast.session import staged

EPS = np.finfo(np.float64).eps
#: Spectra that one task combines into one.
FAN_IN = 16
#: Largest entry of a vector, so that 1,024 times it is exact and sums of an Arrow batch stay in a long.
MOST = float(1 << 37)


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) and the matrix ``d[i] - root[j]``; d ascending, rho positive.

    Root j lies between d[j] and d[j + 1]. It is kept as an offset from the nearer of the two, so that the
    differences keep their relative accuracy; steps follow a rational interpolation of the poles on
    either side and fall back to bisection.
    """
    k = len(d)
    top = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = top - d
    lower = np.arange(k)[:, None] <= np.arange(k)[None, :]
    middle = 1 / rho + (z2[:, None] / (d[:, None] - (d + gap / 2)[None, :])).sum(0)
    right = (middle < 0) & (np.arange(k) < k - 1)  # the root lies nearer to the upper pole
    origin = np.where(right, top, d)
    shift = d[:, None] - origin[None, :]
    low = np.where(right, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    high = np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    tau = (low + high) / 2
    first, second = d - origin, top - origin
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(80):
            diff = shift - tau
            w = z2[:, None] / diff
            f = 1 / rho + w.sum(0)
            slopes = w / diff
            done = np.abs(f) <= 4 * EPS * k * (1 / rho + np.abs(w).sum(0))
            narrow = high - low <= 4 * EPS * np.maximum(np.abs(low), np.abs(high))
            if (done | narrow).all():
                break
            low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
            one, two = first - tau, second - tau
            slope = slopes.sum(0)
            before = np.where(lower, slopes, 0.0).sum(0)
            a = (one + two) * f - one * two * slope
            b = one * two * f
            c = f - one * before - two * (slope - before)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = tau + step
            good = np.isfinite(new) & (new > low) & (new < high)
            tau = np.where(done, tau, np.where(good, new, (low + high) / 2))
    return origin + tau, shift - tau


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + weight x x'``."""
    z = vectors.T @ x
    size = float(z @ z)
    rho = weight * size
    if not rho > 0:
        return values, vectors
    z = z / np.sqrt(size)
    small = 8 * EPS * max(float(np.abs(values).max()), rho)
    # equal eigenvalues: turn their eigenvectors until the update touches only one of them
    jumps = np.flatnonzero(np.diff(values) > small) + 1
    if len(jumps) + 1 < len(values):
        vectors = vectors.copy()
        for at in np.split(np.arange(len(values)), jumps):
            part = z[at]
            norm = np.sqrt(part @ part)
            if len(at) > 1 and norm > 0:
                mirror = part.copy()
                sign = 1.0 if part[-1] >= 0 else -1.0
                mirror[-1] += sign * norm
                mirror /= np.sqrt(mirror @ mirror)
                vectors[:, at] -= 2 * np.outer(vectors[:, at] @ mirror, mirror)
                z[at] = 0.0
                z[at[-1]] = -sign * norm
    on = np.flatnonzero(rho * np.abs(z) > small)  # deflation: the others keep value and vector
    if not len(on):
        return values, vectors
    roots, diff = secular_roots(values[on], z[on] ** 2, rho)
    # the vector for which these roots are exact gives orthogonal eigenvectors
    d = values[on]
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(-diff / apart, axis=1)))
    turned = (np.copysign(exact, z[on]))[:, None] / diff
    turned /= np.sqrt((turned * turned).sum(0))
    values, new = values.copy(), vectors.copy()
    values[on] = roots
    new[:, on] = vectors[:, on] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], new[:, order]


@dataclass
class Spectrum:
    """Number, mean and eigendecomposition of the scatter (sum of centred squares) of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> "Spectrum":
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        delta = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, delta, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + delta / self.n

    def merge(self, other: "Spectrum") -> "Spectrum":
        """The spectrum of both sets of vectors."""
        big, few = (self, other) if self.n >= other.n else (other, self)
        if not few.n:
            return big
        values, vectors = big.values, big.vectors
        for value, vector in zip(few.values, few.vectors.T):
            if value > 0:
                values, vectors = rank_one(values, vectors, vector, value)
        delta, n = few.mean - big.mean, big.n + few.n
        values, vectors = rank_one(values, vectors, delta, big.n * few.n / n)
        return Spectrum(n, big.mean + delta * (few.n / n), values, vectors)


PARTIAL = "part long, n long, sums array<decimal(38,0)>, mean binary, scatter binary, vectors binary"


def _as_row(part: int, one: Spectrum, sums: list[int] | None) -> pa.RecordBatch:
    decimals = pa.list_(pa.decimal128(38, 0))
    values = [np.ascontiguousarray(x).tobytes() for x in (one.mean, one.values, one.vectors)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([one.n]), pa.array([sums], decimals), *(pa.array([v], pa.binary()) for v in values)],
        ["part", "n", "sums", "mean", "scatter", "vectors"],
    )


def _of_row(row: dict) -> Spectrum:
    mean, values, vectors = (np.frombuffer(row[k], np.float64) for k in ("mean", "scatter", "vectors"))
    return Spectrum(row["n"], mean, values, vectors.reshape(len(mean), len(mean)))


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x``: vectors of finite entries as longs, floor(1024 c) + 100,000.

    Null vectors, those with a null, NaN or infinite entry or one beyond 2^37, and empty ones are
    left out, and those of another length than the most frequent one (of two as frequent, the longer).
    """
    c = F.col("embedding")
    fine = F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < MOST))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c).where(c.isNotNull() & (F.size(c) > 0) & fine)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    whole = F.transform(c, lambda v: F.floor(v.cast("double") * 1024) + 100_000)
    return rows.where(F.size("embedding") == d).select("vec_id", whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs where they fit, else as Python integers."""
    reach = int(np.abs(x).max(initial=0)) * n + max(abs(s) for s in sums)
    if reach < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def partial_spectra(vectors: DataFrame) -> DataFrame:
    """One row a task: the exact sums of its vectors and the spectrum of their scatter."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            own = own or Spectrum.empty(x.shape[1])
            sums = sums + x.sum(0).astype(object)
            for row in x.astype(np.float64):
                own.add(row)
        if own:
            yield _as_row(TaskContext.get().partitionId(), own, [int(s) for s in sums])

    return vectors.mapInArrow(update, PARTIAL)


def combined_spectrum(partial: DataFrame) -> Spectrum | None:
    """The spectrum of all vectors; ``FAN_IN`` spectra at a time become one, until one is left."""

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").drop_columns(["sums", "group"])
        one = None
        for batch in rows.to_batches(max_chunksize=1):
            other = _of_row(batch.to_pylist()[0])
            one = one.merge(other) if one else other
        return pa.Table.from_batches([_as_row(key[0].as_py(), one, None)])

    number = partial.count()
    while number > 1:
        groups = partial.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("group")
        partial = staged(groups.applyInArrow(combine, PARTIAL), "spectra")
        number = partial.count()
    row = partial.first()
    return _of_row(row.asDict()) if row else None


def _summed_products(vectors: DataFrame, project, width: int) -> np.ndarray:
    """Sum over all vectors of p p' with p = project(x), added up by task and then by entry."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                p = project(_matrix(batch.column(1)))
                total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(width * width)
    for r in vectors.mapInArrow(products, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out.reshape(width, width)


@dataclass
class Whitening:
    """Exact number and sums, and the components (columns, by falling eigenvalue) of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray  # of the returned components
    components: np.ndarray
    trace: float
    identity_error: float | None

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """(x - mean) on every component over its root; ``centred`` is n * x - S, NaN where there is no variance."""
        scale = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return (centred / self.n).astype(np.float64) @ self.components / scale


def fit_whitening(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of ``vec_id, x`` rows; None without a row.

    An eigenvalue within rounding of zero counts as zero.
    """
    partial = staged(partial_spectra(vectors), "spectra")
    spectrum = combined_spectrum(partial)
    if spectrum is None:
        return None
    d, n = len(spectrum.mean), spectrum.n
    sums = [0] * d
    for r in partial.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        sums[r.pos] = int(r.s)
    basis, _ = np.linalg.qr(spectrum.vectors)

    def on_basis(x: np.ndarray) -> np.ndarray:
        return (_centred(x, n, sums) / n).astype(np.float64) @ basis

    small = _summed_products(vectors, on_basis, d) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(np.trace(small))
    values = np.where(values > trace * d * EPS, values, 0.0)[:components]
    fit = Whitening(n, sums, values, (basis @ turn)[:, :components], trace, None)
    live = int((values > 0).sum())
    if live:
        own = _summed_products(vectors, lambda x: fit.whiten(_centred(x, n, sums))[:, :live], live) / n
        fit.identity_error = float(np.abs(own - np.eye(live)).max())
    return fit


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector.

    Rows of ``vec_id, embedding`` that ``usable_vectors`` leaves out have no result; repeated rows count
    and return once each, a null id stays null, other columns are ignored. There are at most as many
    components as entries. A component without variance has a null ``whitened`` and stays out of
    ``identity_error``; without any variance ``explained`` is null too. ``deviation`` is null beyond a long.
    """
    spark = embeddings.sparkSession
    vectors = usable_vectors(embeddings)
    fit = fit_whitening(vectors, components)
    if fit is None:
        return spark.createDataFrame([], WHITE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        explained = fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.num_rows
            centred = _centred(_matrix(batch.column(1)), fit.n, fit.sums)
            far = int(np.abs(centred).max())
            exact = centred if far * far * centred.shape[1] < 2**63 else centred.astype(object)
            deviation = [None if v >= 2**63 else v for v in (exact * exact).sum(1).tolist()]
            white = fit.whiten(centred).ravel()
            share = np.tile(explained, m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fit.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(share, mask=np.isnan(share)),
                    pa.array([fit.identity_error] * (m * k), pa.float64()),
                ],
                [x.split()[0] for x in WHITE.split(", ")],
            )

    return vectors.mapInArrow(rows, WHITE)
