"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor.

Vectors are whole numbers x = floor(256 * c). The fit list holds each distinct x once (a partial aggregate folds copies
in every task, so a vector held by a third of all rows is a row per task). Spark sums n and the sums S exactly, then
the scatter of x - S / n, a triangle of dims * (dims + 1) / 2 numbers per task. Only these sums, whose size is set by
the dimension, reach the driver:

1. V = P' L L' P by Cholesky with diagonal pivoting, which stops where what is left is rounding: L is dims x rank.
2. Jacobi rotations of L's columns, all disjoint pairs of a round at a time, until the columns are orthogonal. V's own
   entries are never rotated, so small eigenvalues keep their digits.
3. Squared norms of the rotated columns are the eigenvalues, the normalised columns, un-pivoted, the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import load, query, stage

SCALE, COMPONENTS = 256, 4
#: Entries are left out from here on, as infinite ones are: their x would not fit a long.
LARGEST = float(1 << 54)
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list, components as columns by falling eigenvalue, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float


# --- dense algebra of the driver -----------------------------------------------------------------------


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (dims x rank) and the pivots p with v[p][:, p] = L L', largest remaining diagonal first."""
    v = v.copy()
    dims = len(v)
    pivots = np.arange(dims)
    factor = np.zeros((dims, dims))
    floor = dims * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(dims):
        best = k + int(np.argmax(v.diagonal()[k:]))
        if v[best, best] <= floor:
            return factor[:, :k], pivots
        for swapped in (v, v.T, factor):
            swapped[[k, best]] = swapped[[best, k]]
        pivots[[k, best]] = pivots[[best, k]]
        root = np.sqrt(v[k, k])
        factor[k, k] = root
        factor[k + 1 :, k] = v[k + 1 :, k] / root
        v[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, pivots


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, as rounds of disjoint pairs (n even)."""
    ring = list(range(n))
    for _ in range(n - 1):
        yield np.array(ring[: n // 2]), np.array(ring[n // 2 :][::-1])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of `factor` after rotations among them that make them orthogonal."""
    columns = factor.copy()
    rank = columns.shape[1]
    if rank % 2:
        columns = np.hstack([columns, np.zeros((len(columns), 1))])
    enough = np.finfo(float).eps * max(len(columns), 1) ** 0.5
    for _ in range(sweeps):
        still = False
        for i, j in _rounds(columns.shape[1]):
            a, b = columns[:, i], columns[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > enough * np.sqrt(aa * bb)
            if not turn.any():
                continue
            still = True
            half = np.where(turn, (bb - aa) / (2 * np.where(turn, ab, 1.0)), 0.0)
            t = np.where(turn, np.where(half < 0, -1.0, 1.0) / (np.abs(half) + np.hypot(1.0, half)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            columns[:, i], columns[:, j] = c * a - s * b, s * a + c * b
        if not still:
            break
    norms = np.linalg.norm(columns, axis=0)
    return columns[:, np.argsort(-norms, kind="stable")[:rank]]


def spectrum(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns, as many as the covariance has rank."""
    factor, pivots = pivoted_cholesky(covariance)
    columns = one_sided_jacobi(factor)
    norms = np.linalg.norm(columns, axis=0)
    components = np.zeros_like(columns)
    components[pivots] = columns / norms
    return norms**2, components


# --- tables --------------------------------------------------------------------------------------------


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, of rows whose vector is there and holds only finite entries."""
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE))
    return embeddings.filter(F.col(vector_col).isNotNull() & fine).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: 64-bit numbers where they suffice, else Python's."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if largest < _SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of every row; null where it does not fit a long."""
    largest = int(np.abs(centred).max(initial=0))
    if largest * largest * max(centred.shape[1], 1) < _SAFE:
        return (centred.astype(np.int64) ** 2).sum(1).tolist()
    exact = (centred.astype(object) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def _sums(fit: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """Count and exact sums of the fit list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            small = int(np.abs(x).max(initial=0)) * max(len(x), 1) < _SAFE
            part = x.sum(0) if small else x.astype(object).sum(0)
            n += len(x)
            total = [a + b for a, b in zip(total, part.tolist())]
        if n:
            values = pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), values], names=["at", "total"])

    rows = fit.mapInArrow(work, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()
    found = {r["at"]: int(r["total"]) for r in rows}
    return found[-1], tuple(found[i] for i in range(dims))


def _covariance(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Covariance of the fit list, centred before multiplying, divisor n."""
    dims = len(sums)
    rows, columns = np.triu_indices(dims)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((dims, dims))
        for batch in batches:
            d = (_centred(_matrix(batch.column(0), dims), n, sums) / n).astype(float)
            scatter += d.T @ d
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(scatter[rows, columns])], names=["i", "j", "v"]
        )

    v = np.zeros((dims, dims))
    for r in fit.mapInArrow(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["v"] / n
    return v


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The model of a list of distinct vectors `x` of `dims` entries; at most `components` components."""
    n, sums = _sums(fit, dims)
    v = _covariance(fit, n, sums)
    values, vectors = spectrum(v)
    return Whitening(n, sums, values[:components], vectors[:, :components], float(np.trace(v)))


def _project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the whitened coordinates of the components that vary."""
    centred = _centred(x, model.n, model.sums)
    return centred, (centred / model.n).astype(float) @ model.components / np.sqrt(model.eigenvalues)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity; null without components."""
    k, dims = len(model.eigenvalues), len(model.sums)
    if not k:
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Moments about the task's own mean, merged batch by batch.
        n, mean, moments = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, w = _project(_matrix(batch.column(0), dims), model)
            if not len(w):
                continue
            own = w.mean(0)
            gap, both = own - mean, n + len(w)
            moments += (w - own).T @ (w - own) + np.outer(gap, gap) * (n * len(w) / both)
            mean += gap * (len(w) / both)
            n = both
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([mean.tolist()]), pa.array([moments.ravel().tolist()])], names=["n", "mean", "moments"]
            )

    tasks = stage(fit.mapInArrow(work, "n bigint, mean array<double>, moments array<double>"), "whitened-moments")
    centre = tasks.agg(*[(F.sum(F.col("n") * F.col("mean")[i]) / model.n).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def gap(i: int):
        return F.col("mean")[i] - F.lit(centre[i])

    found = tasks.agg(
        *[(F.sum(F.col("moments")[i * k + j] + F.col("n") * gap(i) * gap(j)) / model.n).alias(f"c{i}_{j}") for i, j in pairs]
    ).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening, error: float | None, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, of rows (vec_id, x) of the model's dimension."""
    dims = len(model.sums)
    most, k = min(components, dims), len(model.eigenvalues)
    explained = [(float(e) / model.trace) for e in model.eigenvalues] + [0.0 if model.trace else None] * (most - k)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            centred, w = _project(_matrix(batch.column(1), dims), model)
            at = np.repeat(np.arange(rows), most)
            table = np.full((rows, most), np.nan)
            table[:, :k] = w
            whitened = pa.array(table.ravel(), mask=np.tile(np.arange(most) >= k, rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * most, model.n)),
                    pa.array(_deviation(centred), pa.int64()).take(pa.array(at)),
                    whitened,
                    pa.array(explained * rows, pa.float64()),
                    pa.array([error] * (rows * most), pa.float64()),
                ],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    return rows.mapInArrow(work, OUT)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    * Left out are rows whose vector is null, holds null, infinite or missing entries or entries of 2**54 and more, and
      rows whose length is not that of most distinct vectors (of equally many: the longer; empty vectors never count).
    * A null vec_id stays null; rows repeating a vec_id or a vector have rows each. Other columns are not read.
    * A component without variance (fewer distinct vectors than components) has null `whitened` and 0 `explained`;
      with one distinct vector `explained` and `identity_error` are null.
    * A deviation that does not fit a long is null. Tables without a remaining vector give no rows.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    fit = stage(rows.select("x").distinct(), "fit-vectors")
    lengths = fit.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).filter("dims > 0")
    common = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return _nothing(spark)
    dims = common["dims"]
    fit = fit.filter(F.size("x") == dims)
    model = fit_whitening(fit, dims, components)
    return whiten(rows.filter(F.size("x") == dims), model, identity_error(fit, model), components)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OUT)


@query("op12_embedding_whitening")
def _op12(spark, sf_dir):
    return whitened(load(spark, sf_dir, "embeddings"))
