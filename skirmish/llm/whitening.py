"""Whitening of embeddings by incremental eigendecomposition.

Each partition holds the spectrum of its centred scatter matrix and brings vectors in by rank-one updates: with
``A = Q diag(e) Q'`` and ``z = Q'v``, the eigenvalues of ``A + vv'`` are the roots of the secular equation
``1 + sum z_i^2 / (e_i - t) = 0``, one between each pair of poles.  Components of z that vanish and eigenvalues that
coincide are deflated first.  The vectors of a block are folded by a QR decomposition into as many rows as there are
dimensions, with the same scatter, so a block takes that many updates however long it is.  Spectra of partitions are
combined pair by pair: the eigenvectors of one, scaled, are rank-one updates of the other, and so is the distance of their
means.  A Rayleigh-Ritz step over all vectors then refines the basis: the covariance is summed in the coordinates of the
basis, where it is nearly diagonal, and its small eigenproblem turns the basis.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Vectors of a block, spectra that one task combines, and the largest component as an integer.
BLOCK, FAN_IN, LARGEST = 4096, 8, 1 << 52
_EPS = np.finfo(np.float64).eps


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``basis diag(values) basis' + vector vector'``."""
    z = basis.T @ vector
    size = float(np.sqrt(z @ z))
    scale = max(float(np.abs(values).max()), size * size)
    if scale == 0:
        return values, basis
    limit = 8 * _EPS * scale
    basis = basis.copy()
    # Deflation of coinciding eigenvalues: a rotation of their eigenvectors moves the weight to the last of them.
    for i in range(len(values) - 1):
        if values[i + 1] - values[i] <= limit and z[i]:
            r = float(np.hypot(z[i], z[i + 1]))
            c, s = z[i + 1] / r, z[i] / r
            basis[:, [i, i + 1]] = basis[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
            z[i], z[i + 1] = 0.0, r
    live = np.flatnonzero(np.abs(z) * size > limit)  # deflation of components without weight
    if not len(live):
        return values, basis
    poles, weights = values[live], z[live] ** 2
    roots_from, offset = secular_roots(poles, weights)
    gap = (poles[:, None] - poles[roots_from]) - offset  # pole i less root j, without cancellation
    # The weights for which these roots are exact, so that the eigenvectors are orthogonal (Gu and Eisenstat 1994).
    with np.errstate(divide="ignore"):
        far = poles[:, None] - poles
        np.fill_diagonal(far, 1.0)
        exact = np.exp(0.5 * (np.log(np.abs(gap)).sum(1) - np.log(np.abs(far)).sum(1))) * np.sign(z[live])
    turned = exact[:, None] / gap
    turned /= np.sqrt((turned * turned).sum(0))
    values, out = values.copy(), basis
    values[live] = poles[roots_from] + offset
    out[:, live] = basis[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


def secular_roots(poles: np.ndarray, weights: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum weights / (poles - t)``, as the index of the nearer pole and the offset from it.

    Poles rise and weights are positive; root j lies between poles j and j + 1, the last behind the last pole by the
    sum of weights at most.  Bisection runs on the exponent of the offset, so small offsets keep their relative precision.
    """
    n = len(poles)
    width = np.append(np.diff(poles), weights.sum())
    middle = poles + width / 2
    with np.errstate(divide="ignore"):
        value = 1 + (weights[:, None] / (poles[:, None] - middle)).sum(0)
    ahead = value < 0  # the root is in the upper half
    ahead[-1] = False
    base = np.arange(n) + ahead
    shifted = poles[:, None] - poles[base]
    sign = np.where(ahead, -1.0, 1.0)
    high = np.log2(np.where(np.arange(n) == n - 1, width * (1 + 4 * _EPS), width / 2))
    low = high - 120.0
    for _ in range(rounds):
        at = (low + high) / 2
        if (high - low).max() < 1e-15 * np.abs(at).max():
            break
        value = 1 + (weights[:, None] / (shifted - sign * np.exp2(at))).sum(0)
        # the function rises between poles: positive means that the root is lower
        nearer = np.where(ahead, value < 0, value > 0)
        high, low = np.where(nearer, at, high), np.where(nearer, low, at)
    return base, sign * np.exp2((low + high) / 2)


@dataclass
class Spectrum:
    """Count and mean of some vectors, with eigenvalues and eigenvectors of their centred scatter matrix."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def of_nothing(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def _update(self, vector: np.ndarray) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, vector)

    def _shift(self, count: int, mean: np.ndarray) -> None:
        """The update for the distance of two means."""
        total = self.count + count
        if self.count and count:
            self._update((mean - self.mean) * np.sqrt(self.count / total * count))
        self.mean = self.mean + (mean - self.mean) * (count / total)
        self.count = total

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        mean = rows.mean(0)
        centred = rows - mean
        if len(rows) > rows.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        for vector in centred:
            self._update(vector)
        self._shift(len(rows), mean)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self._update(vector * np.sqrt(value))
        self._shift(other.count, other.mean)

    def to_bytes(self) -> bytes:
        return np.concatenate([self.mean, self.values, self.basis.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, count: int, data: bytes, size: int) -> Spectrum:
        found = np.frombuffer(data, np.float64)
        return cls(count, found[:size].copy(), found[size:2 * size].copy(), found[2 * size:].reshape(size, size).copy())


def _usable(vector: Column) -> Column:
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / 256))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fits, F.lit(False))


def _rows(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[np.ndarray]:
    """The vectors in blocks of ``BLOCK`` rows at most."""
    for batch in batches:
        for first in range(0, len(batch), BLOCK):
            yield batch.slice(first, BLOCK).column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def spectrum(vectors: DataFrame, column: str, size: int) -> Spectrum:
    """The spectrum of all rows: one per partition, combined ``FAN_IN`` at a time."""
    kind = "part long, count long, state binary"

    def one(part: int, found: Spectrum) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([found.count]), pa.array([found.to_bytes()])], ["part", "count", "state"])

    def partition(batches):
        from pyspark import TaskContext

        found = Spectrum.of_nothing(size)
        for rows in _rows(batches, column, size):
            found.add(rows.astype(np.float64))
        if found.count:
            yield one(TaskContext.get().partitionId(), found)

    def combined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        found = Spectrum.from_bytes(rows[0]["count"], rows[0]["state"], size)
        for r in rows[1:]:
            found.merge(Spectrum.from_bytes(r["count"], r["state"], size))
        return pa.Table.from_batches([one(rows[0]["part"] // FAN_IN, found)])

    spectra = materialise(vectors.select(column).mapInArrow(partition, kind), "spectra")
    while (most := spectra.agg(F.max("part")).first()[0]) is not None and most > 0:
        spectra = materialise(spectra.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(combined, kind), "spectra")
    row = spectra.first()
    return Spectrum.from_bytes(row["count"], bytes(row["state"]), size) if row else Spectrum.of_nothing(size)


def covariance(vectors: DataFrame, column: str, centre: np.ndarray, basis: np.ndarray, count: int) -> np.ndarray:
    """The covariance (divisor ``count``) of the rows, centred and in the coordinates of the columns of ``basis``."""
    size, width = basis.shape

    def partial(batches):
        total = np.zeros((width, width))
        for rows in _rows(batches, column, size):
            turned = (rows - centre) @ basis
            total += turned.T @ turned
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])

    cells = vectors.select(column).mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    found = cells.toArrow()  # as many rows as the matrix has entries
    out = np.zeros(width * width)
    out[found["cell"].to_numpy()] = found["value"].to_numpy()
    out = out.reshape(width, width) / max(count, 1)
    return (out + out.T) / 2


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``id_col``, component, n, deviation, whitened, explained, identity_error: up to ``components`` rows per vector.

    A component c becomes the integer x = floor(``scale`` * c).  The n distinct integer vectors, with sums S, are the fit
    list; eigenvectors of its covariance are numbered by falling eigenvalue e.  deviation is the exact sum of (n x - S)^2,
    whitened is x - S / n projected on the component over sqrt(e), explained is e / trace, identity_error the largest entry
    of the whitened fit list's covariance less the identity.

    Vectors that are null, empty, or hold null, non-finite or huge (2^44 and more) entries give no rows, nor do those of another
    length than the commonest (ties: the shorter).  Components whose eigenvalue is zero to working precision are left out, so a
    table of equal vectors gives none.  Repeated rows each get their rows; a null identifier stays null; other columns are not read; an
    empty table gives none.  A deviation beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    out = (f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    usable = vectors.where(_usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    length = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if length is None:
        return spark.createDataFrame([], out)
    size = length["size"]
    whole = F.transform("vector", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = usable.where(F.size("vector") == size).select("id", whole.alias("x"))
    fit = materialise(rows.select("x").distinct(), "whitening-fit")
    sums = fit.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")).toArrow().to_pylist()
    n = sums[0]["n"]
    total = [int(r["total"]) for r in sorted(sums, key=lambda r: r["at"])]
    centre = np.array([s / n for s in total])
    basis = np.linalg.qr(spectrum(fit, "x", size).basis[:, ::-1])[0]
    ritz, turn = np.linalg.eigh(covariance(fit, "x", centre, basis, n))
    values, basis = ritz[::-1], basis @ turn[:, ::-1]
    trace = float(values.sum())
    kept = [i for i in range(min(components, size)) if values[i] > 1e-13 * max(values[0], 0.0)]
    if not kept or trace <= 0:
        return spark.createDataFrame([], out)
    axes = basis[:, kept] / np.sqrt(values[kept])
    explained, k = values[kept] / trace, len(kept)
    error = float(np.abs(covariance(fit, "x", centre, axes, n) - np.eye(k)).max())
    exact = np.array(total, object)

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                some = batch.slice(first, BLOCK)
                x = some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                most = n * max(abs(int(x.max())), abs(int(x.min()))) + int(abs(exact).max()) if len(x) else 0
                if size * most * most < 1 << 63:
                    apart = n * x - np.array(total, np.int64)
                    deviation = (apart * apart).sum(1)
                else:
                    apart = x.astype(object) * n - exact
                    deviation = (apart * apart).sum(1)
                white = (x - centre) @ axes
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    some.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)), pa.array(np.repeat(deviation, k).tolist(), pa.int64()), pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    ["id", *[c.split()[0] for c in out.split(", ")[1:]]])

    return rows.mapInArrow(run, out.replace(f"{id_col} {kind}", f"id {kind}", 1)).withColumnRenamed("id", id_col)
