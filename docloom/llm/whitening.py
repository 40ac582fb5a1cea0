"""Whitening of embeddings by block subspace iteration that never forms the covariance.

A block Q of directions is multiplied by the covariance in one Spark pass, as X'(XQ) over centred rows; QR and a
Rayleigh-Ritz step on the driver (of a matrix as small as the block) give eigenpairs and their residuals. Passes follow
each other until the residuals of all components asked for are at rounding level. The block is twice as wide as the number
of components, which is what makes flat spectra converge; where a pass doesn't halve the worst residual, random directions
double it. A block as wide as the vectors spans all of space and ends in that pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .vectors import exact_sums, integers, lists, rows_of, vector_batches

#: Residual, against the largest eigenvalue, that certifies a component; passes at most; least eigenvalue, against the largest, of a component.
RESIDUAL, PASSES, RANK = 1e-13, 400, 1e-12


@dataclass
class Fit:
    """Mean (whole + rest, the whole part in integers) and components as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int

    @property
    def whole(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.whole, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the integers are subtracted exactly, so nothing of a small deviation is lost in a large mean."""
        return (x - self.whole).astype(np.float64) - self.rest


def _matrix_sum(x: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over batches of f(rows), a small matrix: each task adds its own, Spark adds those cell by cell."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            if b.num_rows:
                part = f(rows_of(b.column("x")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists(total, pa.float64())], names=["i", "y"])

    with vector_batches(x):
        cells = x.select("x").mapInArrow(batches, "i int, y array<double>").select("i", F.posexplode("y").alias("j", "y"))
        found = cells.groupBy("i", "j").agg(F.sum("y").alias("y")).collect()
    out = np.zeros((1 + max(r["i"] for r in found), 1 + max(r["j"] for r in found)))
    for r in found:
        out[r["i"], r["j"]] = r["y"]
    return out


def fit(x: DataFrame, k: int, block: int | None = None, seed: int = 7) -> Fit | None:
    """The first k components of the covariance (divisor n) of the integer rows of x; None where x has no rows.

    Directions whose eigenvalue is at most RANK of the largest aren't components, so there may be fewer than k.
    """
    found = exact_sums(x, F.lit(0))
    if not found:
        return None
    n, sums = found[0]
    d = len(sums)
    now = Fit(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    wide, k = min(d, block or 2 * k), min(d, k)
    random = np.random.default_rng([seed, d])
    q = np.linalg.qr(random.normal(size=(d, wide)))[0]
    worst = np.inf
    for turn in range(1, PASSES + 1):

        def times(rows: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            a = now.centred(rows)
            squares = np.zeros((1, q.shape[1]))
            squares[0, 0] = (a * a).sum()
            return np.vstack([a.T @ (a @ q), squares])

        got = _matrix_sum(x, times) / n
        y, trace = got[:-1], float(got[-1, 0])
        t = q.T @ y
        values, turned = np.linalg.eigh((t + t.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        u, vu = q @ turned, y @ turned
        top = max(float(values[0]), 0.0)
        real = int((values[:k] > RANK * top).sum()) if top > 0 else 0
        residuals = np.linalg.norm(vu - u * values, axis=0)
        if not real or (residuals[:real] <= RESIDUAL * top).all() or q.shape[1] == d and turn > 1:
            u = u[:, :real] / np.linalg.norm(u[:, :real], axis=0)
            return Fit(n, sums, u, values[:real], trace, turn)
        slow, worst = residuals[:real].max() > worst / 2, residuals[:real].max()
        more = min(d - vu.shape[1], vu.shape[1]) if slow else 0
        q = np.linalg.qr(np.hstack([vu, random.normal(size=(d, more)) * top]))[0]
    raise RuntimeError(f"residuals still above {RESIDUAL} after {PASSES} passes")


def whitened(vectors: DataFrame, k: int = 32, scale: int = 64, plus: int = 1_000_000, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of every sound vector.

    Entries become x = floor(scale * entry) + plus. n counts the vectors; deviation, a decimal of 38 digits, is the sum of
    (n * x - column sum)^2, exact, and null if that needs more digits. whitened and explained are arrays by component, at most k: the projection of
    x less the mean over the root of the eigenvalue, and the eigenvalue's share of the trace. identity_error is the
    largest absolute entry of whitened's covariance minus the identity, measured over all rows.
    Null vectors and those with null or non-finite entries have no row. Of vectors of several lengths those of the
    most frequent one are kept (of equally frequent, the longest); entries beyond 2^53 / scale count as that.
    Repeated rows and null ids count as others. Vectors that are all equal have no component, so their arrays are empty.
    An empty table gives an empty one.
    """
    spark = bounded(vectors.sparkSession)
    entries = F.col(vector_col).cast("array<double>")
    finite = F.forall(entries, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    common = vectors.where(F.col(vector_col).isNotNull() & finite & (F.size(vector_col) > 0)).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    x = integers(vectors, id_col, F.col(vector_col), common["d"] if common else 1, scale, plus)
    found = fit(x, k, block)
    kind = x.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, deviation decimal(38,0), whitened array<double>"
    if found is None:
        return spark.createDataFrame([], f"{schema}, explained array<double>, identity_error double").withColumnRenamed("id", id_col)
    onto = found.components / np.sqrt(found.eigenvalues)
    error = 0.0
    if onto.shape[1]:

        def products(rows: np.ndarray) -> np.ndarray:
            w = found.centred(rows) @ onto
            return np.vstack([w.T @ w, w.sum(axis=0)])

        got = _matrix_sum(x, products) / found.n
        error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(onto.shape[1])).max())
    n, whole = found.n, found.whole
    left = np.array([s - n * int(m) for s, m in zip(found.sums, whole, strict=True)], np.int64 if n < 1 << 62 else object)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            rows = rows_of(b.column("x"))
            off = rows - whole
            if len(whole) * (n * (int(np.abs(off).max()) + 1)) ** 2 >= 1 << 63:
                off = off.astype(object)
            far = ((n * off - left) ** 2).sum(axis=1).tolist()
            w = found.centred(rows) @ onto
            deviation = pa.array([Decimal(int(s)) if s < 10**38 else None for s in far], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(len(rows), n, np.int64)), deviation, lists(w, pa.float64())], names=["id", "n", "deviation", "whitened"])

    explained = F.array(*(F.lit(float(e / found.trace)) for e in found.eigenvalues)).cast("array<double>")
    out = x.mapInArrow(batches, schema)
    return out.withColumnRenamed("id", id_col).withColumns({"explained": explained, "identity_error": F.lit(error)})
