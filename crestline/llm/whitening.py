"""Whitening of embeddings by incremental eigendecomposition.

Each task keeps the count, the mean and the spectrum (eigenvalues and eigenvectors) of the scatter matrix of the vectors
it has seen.  A further vector is a rank-one update along its difference to the mean: the roots of the secular equation
are the new eigenvalues, after components that the update does not touch, or that share an eigenvalue, are deflated.
The spectra of two tasks are combined by the same updates, one for each eigenvector of the smaller one and one for the
difference of the means.  The combined basis is then refined by a distributed Rayleigh-Ritz step: all vectors are
projected on it, and the small matrix of their products gives the final components.

Vectors are whole numbers, floor(256 x), so counts, sums and deviations are exact.  Equal vectors count once.

Defined cases: rows whose vector is null or holds a null, a NaN or an infinity are left out; shorter vectors count as
padded with zeros to the longest one; a component without variance gives 0 for ``whitened`` and ``explained`` and is not
part of ``identity_error``; a deviation or an entry beyond 64 bits is null or the nearest 64-bit number; repeated rows
each get their rows; an empty table gives no rows.  Extra columns are not read.

What reaches the driver is the sums of d entries, the d x d basis and one d x d matrix for vectors of d entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import read
from crestline.session import stage

SCALE = 256
COMPONENTS = 4
#: Vectors that one task adds one by one, on average.
ROWS = 8192
#: States that one task combines; states are combined in rounds until one is left.
FAN = 16
_EPS = np.finfo(float).eps


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) = 0 for rising distinct ``d``, each as (nearest pole, distance to it).

    A step fits one simple fraction to the terms on either side of the root and solves the quadratic that is left; a
    step that leaves the bracket is replaced by its middle.
    """
    k = len(d)
    top = d[-1] + z2.sum()
    upper = np.append(d[1:], top)
    width = upper - d
    half = d + width / 2
    f = 1 + (z2 / (d - half[:, None])).sum(1)
    near_low = f >= 0  # then the root lies in the lower half
    near_low[-1] = True
    pole = np.where(near_low, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d - d[pole][:, None]  # poles as seen from the nearest one
    low = np.where(near_low, 0.0, -width / 2)
    high = np.where(near_low, width / 2, 0.0)
    high[-1] = width[-1] * (1 + 4 * _EPS)
    x = (low + high) / 2
    left, right = delta[np.arange(k), np.arange(k)], np.append(delta[np.arange(k - 1), np.arange(1, k)], width[-1])
    below, done = np.tri(k), np.zeros(k, bool)
    for _ in range(60):
        gap = delta - x[:, None]
        term = z2 / gap
        f = 1 + term.sum(1)
        size = 1 + np.abs(term).sum(1)
        high, low = np.where(f >= 0, x, high), np.where(f < 0, x, low)
        done |= np.abs(f) <= 4 * k * _EPS * size
        if done.all():
            break
        slope = term / gap
        psi = np.einsum("ij,ij->i", slope, below)
        phi = slope.sum(1) - psi
        a1, a2 = left - x, right - x
        c = f - a1 * psi - a2 * phi
        a = (a1 + a2) * f - a1 * a2 * (psi + phi)
        b = a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            moved = x + step
            inside = (moved >= low) & (moved <= high)
        now = np.where(done, x, np.where(inside, moved, (low + high) / 2))
        done |= now == x  # no number lies between
        x = now
    return pole, x


def rank_one(d: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``basis diag(d) basis.T + v v.T``."""
    z = basis.T @ v
    scale = max(float(np.abs(d).max()), float(z @ z))
    tiny = 8 * _EPS * scale
    if not scale or z @ z <= _EPS * tiny:
        return d, basis
    close = np.nonzero(np.diff(d) <= tiny)[0]
    if len(close):  # a shared eigenvalue: turn its vectors until one of them takes the whole update
        basis = basis.copy()
        for i in close.tolist():
            r = np.hypot(z[i], z[i + 1])
            if r:
                cos, sin = z[i + 1] / r, z[i] / r
                basis[:, [i, i + 1]] = basis[:, [i, i + 1]] @ np.array([[cos, sin], [-sin, cos]])
                z[i], z[i + 1] = 0.0, r
    # what the update moves by less than rounding is left as it is
    live = np.nonzero(np.abs(z) * np.sqrt(z @ z) > tiny)[0]
    if not len(live):
        return d, basis
    p, z2 = d[live], z[live] ** 2
    pole, x = _roots(p, z2)
    away = (p[:, None] - p[pole]) - x  # p_i - root_j, without cancellation
    # the update that has exactly these roots: its vectors are orthogonal to rounding
    other = p[None, :] - p[:, None]
    place = np.arange(len(p) - 1)
    partner = np.where(place[None, :] >= np.arange(len(p))[:, None], other[:, 1:], other[:, :-1])  # root j pairs with pole j + 1 from row j on
    exact = np.prod(-away[:, :-1] / partner, 1) * -away[:, -1]
    vectors = np.copysign(np.sqrt(np.maximum(exact, 0)), z[live])[:, None] / away
    vectors /= np.sqrt((vectors**2).sum(0))
    values, turned = d.copy(), basis.copy()
    values[live] = p[pole] + x
    turned[:, live] = basis[:, live] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], turned[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition of the scatter about the mean."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray) -> None:
        self.count += 1
        away = vector - self.mean
        self.mean = self.mean + away / self.count
        self.values, self.basis = rank_one(self.values, self.basis, away * np.sqrt((self.count - 1) / self.count))

    def join(self, other: Spectrum) -> Spectrum:
        if self.count < other.count:
            self, other = other, self
        total = self.count + other.count
        if not other.count:
            return self
        values, basis = self.values, self.basis
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                values, basis = rank_one(values, basis, vector * np.sqrt(value))
        away = other.mean - self.mean
        values, basis = rank_one(values, basis, away * np.sqrt(self.count / total * other.count))
        return Spectrum(total, self.mean + away * (other.count / total), values, basis)

    def packed(self) -> bytes:
        return np.concatenate([[float(self.count)], self.mean, self.values, self.basis.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, size: int) -> Spectrum:
        all_ = np.frombuffer(data)
        return cls(int(all_[0]), all_[1 : size + 1], all_[size + 1 : 2 * size + 1], all_[2 * size + 1 :].reshape(size, size))


def combined(states: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """All ``states`` (name, state) as one, in rounds of ``FAN`` a task, each in the order of their names."""
    states = stage(states, "states")
    left = states.count()
    while left > 1:
        left = -(-left // FAN)
        target = left

        def some(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("name")
            return pd.DataFrame({"name": [group["name"].iloc[0]], "state": [merge(list(group["state"]))]})

        dealt = states.withColumn("deal", F.pmod(F.xxhash64("name"), F.lit(target)))
        states = stage(dealt.groupBy("deal").applyInPandas(some, "name string, state binary"), "states")
        left = states.count() if target > 1 else 1
    row = states.first()
    return None if row is None else bytes(row.state)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The lists of ``column`` as rows of whole numbers, padded with zeros."""
    lists = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size), np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors as floor(256 x)."""
    entry = F.col("embedding")
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    most = float(2**63 - 1024)

    def scaled(c):
        v = F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-most)), F.lit(most)))
        return v.cast("long")

    return rows.where(entry.isNotNull() & ~bad).select("vec_id", F.transform(entry, scaled).alias("x"))


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n, exact sums, components (columns), eigenvalues, total variance, distance to the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # of Python integers: correctly rounded

    def whiten(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = np.where(self.values > 0, 1 / np.sqrt(self.values), 0.0)
        return ((x - self.mean) @ self.vectors) * factor

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S) squared per row; null beyond 64 bits."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 62:
            away = self.n * x - np.array(self.sums, np.int64)
            return (away * away).sum(1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _partial_sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, [0] * size
    for batch in batches:
        x = _matrix(batch.column("x"), size)
        n += len(x)
        halves = [(x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()]
        total = [t + (a << 32) + b for t, a, b in zip(total, *halves)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(size + 1), pa.int32()), pa.array([str(v) for v in [n, *total]], pa.string())], names=["place", "total"]
    )


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors`` (column x); None if there are none or they have no entries."""
    once = stage(vectors.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "distinct")
    size = once.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return None
    sums = once.mapInArrow(lambda batches: _partial_sums(batches, size), "place int, total string")
    totals = [int(r.total) for r in sums.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()]
    n, sums_ = totals[0], totals[1:]
    mean = np.array([s / n for s in sums_])

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name = Spectrum.empty(size), ""
        for batch in batches:
            for row in _matrix(batch.column("x"), size).astype(float):
                name = name or row.tobytes().hex()  # tasks hold different vectors, so their first ones name them
                own.add(row)
        if own.count:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([own.packed()], pa.binary())], names=["name", "state"])

    def join_all(states: list[bytes]) -> bytes:
        out = Spectrum.unpacked(states[0], size)
        for state in states[1:]:
            out = out.join(Spectrum.unpacked(state, size))
        return out.packed()

    dealt = once.repartition(-(-n // ROWS), "x")
    state = combined(dealt.mapInArrow(spectra, "name string, state binary"), join_all)
    basis, _ = np.linalg.qr(Spectrum.unpacked(state, size).basis[:, ::-1])

    def products(project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, name = None, ""
            for batch in batches:
                x = _matrix(batch.column("x"), size)
                if not len(x):
                    continue
                y = project(x)
                name = name or x[0].tobytes().hex()
                total = y.T @ y if total is None else total + y.T @ y
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tobytes()], pa.binary())], names=["name", "state"])

        found = combined(once.mapInArrow(task, "name string, state binary"), lambda states: np.sum([np.frombuffer(s) for s in states], 0).tobytes())
        total = np.frombuffer(found)
        return total.reshape(int(len(total) ** 0.5), -1) / n

    small = products(lambda x: (x - mean) @ basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    trace = float(np.trace(small))
    keep = min(components, size)
    values, turned = values[::-1][:keep], turned[:, ::-1][:, :keep]
    values = np.where(values > size * _EPS * max(trace, 0.0), values, 0.0)
    fitted = Whitening(n, sums_, basis @ turned, values, trace, 0.0)
    white = products(fitted.whiten)
    there = values > 0
    error = float(np.abs(white[np.ix_(there, there)] - np.eye(int(there.sum()))).max(initial=0.0))
    return Whitening(n, sums_, fitted.vectors, values, trace, error)


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector of ``rows`` (vec_id, embedding) and component."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    fitted = fit(vectors, components)
    if fitted is None:
        return spark.createDataFrame([], _OUT)
    keep, size = len(fitted.values), len(fitted.sums)
    explained = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(keep)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            many = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), keep))),
                    pa.array(np.tile(np.arange(1, keep + 1), many), pa.int32()),
                    pa.array(np.full(many * keep, fitted.n), pa.int64()),
                    pa.array([d for d in fitted.deviation(x) for _ in range(keep)], pa.int64()),
                    pa.array(fitted.whiten(x).ravel()),
                    pa.array(np.tile(explained, many)),
                    pa.array(np.full(many * keep, fitted.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, _OUT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLE: dict[str, str] = {}
