"""Whitening of vectors by an eigendecomposition that is updated vector by vector.

*Rank-one updates.* A task keeps count, sums, eigenvalues and eigenvectors of the scatter matrix of what it has read. A further
vector x adds n/(n+1) times the outer product of x minus the mean, a rank-one change of a diagonal matrix in the present basis. Its
eigenvalues are the roots of the secular equation ``1 + rho * sum(z_i^2 / (d_i - m)) = 0``, one between each two poles,
found by rational interpolation within brackets. Components with a weight of (nearly) zero keep their eigenpair, and of (nearly) equal
eigenvalues all weight is first turned into one (deflation). Eigenvectors come from weights recomputed from the
roots found, which keeps them orthogonal.
*Combination.* Two spectra are joined by rank-one updates, one per eigenpair of the other and one for the difference of
means, over a tree of stored tables; a task joins ``FAN`` spectra.
*Refinement.* The basis found is orthonormalised; one distributed pass gives the covariance within it, centred by the exact
mean, and its small eigenproblem turns the basis (Rayleigh-Ritz). As the basis spans the whole space, what
rounding the many updates left is gone after it.

Components are whole numbers, so that counts and sums are exact. The driver and each task hold matrices of the vectors' dimension only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.centroids import unfit, whole
from ticketlens.session import staged

OFFSET = 100_000
COMPONENTS = 8
FAN = 16
_EPS = float(np.finfo(float).eps)
# Eigenvalues below this share of the largest are rounding.
_LEAST = 1e-12


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """For each root its nearest pole's number and its distance from that pole.

    ``poles`` rise strictly, ``weights`` (squares) and ``rho`` are positive. Root i lies between poles i and i+1, the
    last within ``rho * sum(weights)`` beyond the last pole. Distances are kept instead of roots, as differences
    between a root and its pole would otherwise lose their digits.
    """
    n = len(poles)
    at = np.arange(n)
    gap = np.diff(poles, append=poles[-1] + rho * weights.sum())
    middle = (weights / (poles - poles[:, None] - gap[:, None] / 2)).sum(axis=1) + 1 / rho
    left = (middle >= 0) | (at == n - 1)
    origin = np.where(left, at, at + 1)
    apart = poles - poles[origin][:, None]
    low = np.where(left, np.where(middle >= 0, 0.0, gap / 2), -gap / 2)
    high = np.where(left, np.where(middle >= 0, gap / 2, gap), 0.0)
    below = at <= at[:, None]  # poles left of each root
    upper = np.minimum(at + 1, n - 1)
    distance = (low + high) / 2
    for _ in range(80):
        away = apart - distance[:, None]
        terms = weights / away
        value = terms.sum(axis=1) + 1 / rho
        settled = np.abs(value) <= 4 * n * _EPS * (np.abs(terms).sum(axis=1) + 1 / rho)
        if settled.all():
            break
        low, high = np.where(value < 0, distance, low), np.where(value < 0, high, distance)
        # Both sides' sums are replaced by one pole each with equal value and slope; then the quadratic's root.
        slopes = terms / away
        near, far = away[at, at], away[at, upper]
        s = np.where(below, slopes, 0).sum(axis=1) * near**2
        t = np.where(at == n - 1, 0.0, np.where(below, 0, slopes).sum(axis=1) * far**2)
        with np.errstate(all="ignore"):
            c = value - s / near - np.where(at == n - 1, 0.0, t / far)
            a, b = c * (near + far) + s + t, near * far * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            step = np.where(at == n - 1, near + s / c, step)
            guess = distance + step
        inside = (guess > low) & (guess < high)
        following = np.where(settled, distance, np.where(inside, guess, (low + high) / 2))
        if (following == distance).all():
            break
        distance = following
    return origin, distance


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) after adding ``rho`` times the outer product of ``vector``."""
    z = basis.T @ vector
    added = rho * float(z @ z)
    if not added > 0:
        return values, basis
    tolerance = 8 * _EPS * max(float(values[-1]), added)
    basis = basis.copy()
    # Runs of equal eigenvalues: a reflection leaves all weight to the last of each.
    equal = np.diff(values) <= tolerance
    runs = np.split(np.arange(len(values)), np.flatnonzero(~equal) + 1) if equal.any() else []
    for run in runs:
        length = np.linalg.norm(z[run])
        if len(run) > 1 and length > 0:
            mirror = z[run].copy()
            mirror[-1] += np.copysign(length, mirror[-1])
            basis[:, run] -= np.outer(basis[:, run] @ mirror, mirror * (2 / (mirror @ mirror)))
            last = -np.copysign(length, z[run[-1]])
            z[run] = 0.0
            z[run[-1]] = last
    live = np.flatnonzero(rho * np.abs(z) * np.linalg.norm(z) > tolerance)
    if not len(live):
        return values, basis
    poles, weights = values[live], z[live] ** 2
    origin, distance = secular_roots(poles, weights, rho)
    away = poles - poles[origin][:, None] - distance[:, None]  # pole minus root, a row per root
    between = poles - poles[:, None]
    np.fill_diagonal(between, 1.0)
    with np.errstate(divide="ignore"):
        logs = np.log(np.abs(away)).sum(axis=0) - np.log(np.abs(between)).sum(axis=0)
    turned = np.copysign(np.exp(logs / 2), z[live])[:, None] / np.where(away == 0, _EPS * tolerance, away).T
    turned /= np.linalg.norm(turned, axis=0)
    values = values.copy()
    values[live] = poles[origin] + distance
    basis[:, live] = basis[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, and eigenpairs of the scatter matrix of the vectors read."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, np.int64), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, x - self.sums / self.n, self.n / (self.n + 1))
        self.n += 1
        self.sums = self.sums + x

    def join(self, other: Spectrum) -> None:
        if self.n and other.n:
            for value, vector in zip(other.values, other.basis.T, strict=True):
                if value > 0:
                    self.values, self.basis = rank_one(self.values, self.basis, vector, float(value))
            between = other.sums / other.n - self.sums / self.n
            self.values, self.basis = rank_one(self.values, self.basis, between, self.n * other.n / (self.n + other.n))
        elif other.n:
            self.values, self.basis = other.values, other.basis
        self.n += other.n
        self.sums = self.sums + other.sums


_SPECTRUM = "n long, sums array<long>, eigenvalues array<double>, basis array<double>"


def _as_batch(found: Spectrum) -> pa.RecordBatch:
    columns = [
        pa.array([found.n], pa.int64()),
        pa.array([found.sums.tolist()], pa.list_(pa.int64())),
        pa.array([found.values.tolist()], pa.list_(pa.float64())),
        pa.array([found.basis.reshape(-1).tolist()], pa.list_(pa.float64())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["n", "sums", "eigenvalues", "basis"])


def _spectra(batch: pa.RecordBatch, size: int) -> Iterator[Spectrum]:
    for i in range(batch.num_rows):
        n, sums, values, basis = (batch.column(c)[i] for c in range(4))
        yield Spectrum(
            n.as_py(),
            sums.values.to_numpy(),
            values.values.to_numpy(),
            basis.values.to_numpy().reshape(size, size),
        )


def spectrum(vectors: DataFrame, size: int, fan: int = FAN) -> Spectrum:
    """The joined spectrum of ``vectors``, rows with ``x`` of ``size`` whole numbers: one a task, then a tree of ``fan``."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.empty(size)
        for batch in batches:
            for x in batch.column(0).flatten().to_numpy().reshape(-1, size):
                found.add(x)
        if found.n:
            yield _as_batch(found)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.empty(size)
        for batch in batches:
            for other in _spectra(batch, size):
                found.join(other)
        if found.n:
            yield _as_batch(found)

    states = staged(vectors.select("x").mapInArrow(grown, _SPECTRUM), "spectra")
    while (count := states.count()) > 1:
        states = staged(states.repartition(-(-count // fan)).mapInArrow(joined, _SPECTRUM), "spectra")
    found = Spectrum.empty(size)
    for batch in states.toArrow().to_batches():
        for other in _spectra(batch, size):
            found.join(other)
    return found


def _sums(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """``run`` gives an array per task; their sum by place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([run(batches).tolist()], pa.list_(pa.float64()))], ["part"])

    parts = frame.mapInArrow(work, "part array<double>").select(F.posexplode("part").alias("place", "value"))
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(rows, key=lambda r: r["place"])])


@dataclass
class Whitening:
    """Exact count and sums, eigenpairs of the covariance (falling, as columns), its trace, and the mean residue of the projections."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    trace: float
    residue: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times each vector minus the sums: whole numbers."""
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        return (self.centred(x) / self.n @ self.basis[:, :components]) / np.sqrt(self.values[:components])


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Eigenpairs of the covariance (divisor n) of all ``vectors``, a stored table with ``x`` of ``size`` whole numbers.

    At most ``components`` are given, and none with an eigenvalue that is zero but for rounding.
    """
    found = spectrum(vectors, size)
    n, sums = found.n, found.sums
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((size, 0)), 0.0, np.zeros(0))
    basis, _ = np.linalg.qr(found.basis[:, ::-1])

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, squares = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            y = (n * batch.column(0).flatten().to_numpy().reshape(-1, size) - sums) / n @ basis
            total += y.sum(axis=0)
            squares += y.T @ y
        return np.r_[total, squares.reshape(-1)]

    flat = _sums(vectors.select("x"), moments)
    mean, inner = flat[:size] / n, flat[size:].reshape(size, size) / n
    inner = inner - np.outer(mean, mean)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    keep = int((values[:components] > _LEAST * max(float(values[0]), 0.0)).sum())
    basis = basis @ turn
    return Whitening(n, sums, values[:keep], basis[:, :keep], float(np.trace(inner)), mean @ turn[:, :keep])


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over all vectors."""
    size, k = len(model.sums), len(model.values)
    if not k:
        return 0.0
    middle = model.residue / np.sqrt(model.values)

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k, k))
        for batch in batches:
            w = model.whitened(batch.column(0).flatten().to_numpy().reshape(-1, size), k) - middle
            out += w.T @ w
        return out.reshape(-1)

    covariance = _sums(vectors.select("x"), squares).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def _squared_lengths(whole_numbers: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; null beyond 63 bits."""
    size = whole_numbers.shape[1]
    small = np.abs(whole_numbers).max(axis=1, initial=0) < int((2**62 / max(size, 1)) ** 0.5)
    out: list[int | None] = (np.where(small[:, None], whole_numbers, 0) ** 2).sum(axis=1).tolist()
    for i in np.flatnonzero(~small):
        exact = sum(int(c) ** 2 for c in whole_numbers[i])
        out[i] = exact if exact < 2**63 else None
    return out


def whole_vectors(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Fit vectors as whole numbers, stored, and their length: the most frequent one, of equally frequent ones the longest."""
    x = F.transform(whole(F.col(vector)), lambda c: c + OFFSET)
    fit = table.filter((F.size(vector) > 0) & ~unfit(F.col(vector))).select(F.col(key).alias("key"), x.alias("x"))
    stored = staged(fit, "vectors")
    rows = stored.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = rows[0]["size"] if rows else 0
    top = stored.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    if size and rows[0]["count"] * top >= 2**61:
        raise ValueError(f"Components of up to {top} in {rows[0]['count']} vectors leave the range of exact sums")
    return stored.filter(F.size("x") == size), size


def whitened(
    table: DataFrame, *, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` for each fit vector and component.

    Null and empty vectors and those with null or non-finite entries take no part, nor do vectors whose length isn't
    the most frequent one. Keys may repeat or be null; every row counts. Directions without variance have no
    component, so equal vectors, a single one or an empty table give no rows. ``deviation`` is null beyond 63 bits.
    Further columns of any name are ignored.
    """
    vectors, size = whole_vectors(table, key, vector)
    model = fit(vectors, size, components)
    error = identity_error(vectors, model)
    k = len(model.values)
    explained = model.values / model.trace if model.trace > 0 else model.values
    schema = T.StructType(
        [
            vectors.schema["key"],
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, size)
            rows = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(rows), model.n), pa.int64()),
                pa.array(_squared_lengths(model.centred(x)), pa.int64()).take(pa.array(rows)),
                pa.array(model.whitened(x, k).reshape(-1)),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return vectors.select("key", "x").mapInArrow(run, schema)
