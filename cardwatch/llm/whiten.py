"""Operator 13: whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

1. Entries become whole numbers, x = floor(scale * entry) + 0. Each distinct vector is one row of the fit list, which is written once.
2. Sums per dimension are exact. The scatter of the centred vectors is added up per partition and then per cell of the matrix; the vectors themselves
   never leave their tasks, and what reaches the driver is one matrix, whose size depends on the number of dimensions alone.
3. The covariance V is factored as P L L' P' with the largest remaining diagonal entry as pivot, so the factor ends
   where the rest is rounding: its columns are as many as the data's rank.
4. One-sided Jacobi turns pairs of columns of L against each other until all are orthogonal, without forming V's product again. L J = U S, so
   V = U S^2 U': the squared norms of the turned columns are the eigenvalues, the normalised columns the components.
   The pairs of one round are disjoint and turned together.
5. Every vector is projected on the components; a second pass over the fit list gives the covariance of what comes out.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are empty vectors, vectors with an entry beyond 64 bits
after scaling, and those of another length than the commonest one (the longer on a tie); repeated vectors count once in the fit and are all returned; rows without an id keep their null; an
empty table, or a single distinct vector, has no components and gives no rows; ``deviation`` is null where its exact value exceeds 64 bits;
columns besides the id and the vector are not read, whatever their names. Where eigenvalues tie, the components span the same space but may be turned in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.text import table
from cardwatch.session import stage

SCALE = 256
COMPONENTS = 4
ROUNDING = 1e-13  # of the largest diagonal entry: what is left below it is not told from rounding
SWEEPS = 60
ROWS = 4_096


def quantised(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """key, x (whole numbers) of the rows that take part."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: c * scale)
    fits = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < 2.0**63, F.lit(False)))  # false for what is not a number, too
    whole = rows.select(key, F.when(fits, F.transform(scaled, lambda c: F.floor(c).cast("long"))).alias("x"))
    whole = whole.filter(F.col("x").isNotNull() & (F.size("x") > 0))
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d"))
    common = lengths.first()
    return whole.filter(F.size("x") == (common["d"] if common else 0))


def _blocks(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    """Blocks of vectors as rows of 64-bit numbers."""
    column = batch.column("x")
    values = column.flatten().to_numpy().reshape(-1, d)
    for a in range(0, len(values), ROWS):
        yield values[a : a + ROWS]


def _added_up(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray, part) -> dict[tuple[int, int], float]:
    """Sums over the projections (x - mean) basis: ``part`` gives a matrix of sums for a block of them. One row per cell of that matrix is collected."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _blocks(batch, len(mean)):
                own = part((x - mean) @ basis)
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = vectors.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(i, j): v for i, j, v in cells.collect()}


def covariance(vectors: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Of the projections, which are centred anew before they are multiplied."""
    k = basis.shape[1]
    sums = _added_up(vectors, mean, basis, lambda w: w.sum(axis=0)[None, :])
    off = np.array([sums[0, j] / n for j in range(k)])
    cells = _added_up(vectors, mean, basis, lambda w: (w - off).T @ (w - off))
    found = np.array([[cells[i, j] for j in range(k)] for i in range(k)]) / n
    return (found + found.T) / 2


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L', rows in the order of v; as many columns as v has rank."""
    rest, least = np.diag(v).copy(), ROUNDING * max(np.diag(v).max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    order = np.ones(len(v), dtype=bool)  # rows that were no pivot yet
    for _ in range(len(v)):
        p = int(np.argmax(np.where(order, rest, -np.inf)))
        if not rest[p] > least:
            break
        made = np.array(columns)
        column = v[:, p] - (made.T @ made[:, p] if columns else 0.0)
        column = column / np.sqrt(rest[p])
        column[~order] = 0.0
        column[p] = np.sqrt(rest[p])
        order[p] = False
        columns.append(column)
        rest = rest - column**2
    return np.array(columns).T if columns else np.zeros((len(v), 0))


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor factor', largest first, and their eigenvectors as columns."""
    w = factor.copy()
    k = w.shape[1]
    ring = list(range(k)) + [-1] * (k % 2)  # a tournament: in every round each column meets another one, in a sweep all others
    for _ in range(SWEEPS):
        largest = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if a >= 0 and b >= 0]
            p, q = np.array([min(x) for x in pairs], dtype=int), np.array([max(x) for x in pairs], dtype=int)
            x, y = w[:, p], w[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(alpha * beta)
            angle = np.divide(np.abs(gamma), scale, out=np.zeros_like(gamma), where=scale > 0)
            largest = max(largest, angle.max(initial=0.0))
            turn = angle > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            w[:, p], w[:, q] = c * x - s * y, s * x + c * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if largest < len(w) * np.finfo(float).eps:
            break
    values = (w * w).sum(0)
    falling = np.argsort(-values, kind="stable")
    w, values = w[:, falling], values[falling]
    return values, w / np.sqrt(values)


@dataclass(frozen=True)
class Whitening:
    """Fitted on a list of n vectors; ``basis`` holds a component over the root of its eigenvalue per column."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the distinct vectors of (x); None where nothing varies."""
    fitted = stage(vectors.select("x").distinct(), "whiten-fit")
    places = fitted.select(F.posexplode("x").alias("i", "c")).groupBy("i")
    rows = places.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # one row per dimension
    if not rows:
        return None
    n, sums = rows[0]["n"], tuple(int(r["s"]) for r in rows)
    mean = np.array([s / n for s in sums])
    v = covariance(fitted, n, mean, np.eye(len(mean)))
    values, turned = one_sided_jacobi(pivoted_cholesky(v))
    k = min(components, len(values))
    if not k:
        return None
    basis = turned[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(covariance(fitted, n, mean, basis) - np.eye(k)).max())
    return Whitening(n, sums, basis, values[:k] / np.trace(v), error)


def whiten(rows: DataFrame, model: Whitening | None, key: str) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for every row of (key, x) and every component."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, basis = model.n, model.sums, model.basis
    d, k = basis.shape
    mean = np.array([s / n for s in sums])
    # n * x - S in 64 bits, and its square summed up, where that cannot overflow; else in whole numbers of any size
    total, small = np.array([s if abs(s) < 2**62 else 0 for s in sums], dtype=np.int64), all(abs(s) < 2**62 for s in sums)

    def deviation(x: np.ndarray) -> list[int | None]:
        top = np.abs(x - mean).max(axis=1) * n
        found: list[int | None] = [None] * len(x)
        fast = small & (top < np.sqrt(2.0**62 / d)) & (np.abs(x).max(axis=1).astype(float) * n < 2.0**62)
        off = n * x[fast] - total
        for i, value in zip(np.flatnonzero(fast).tolist(), (off * off).sum(axis=1).tolist(), strict=True):
            found[i] = value
        for i in np.flatnonzero(~fast).tolist():
            exact = sum((n * c - s) ** 2 for c, s in zip(x[i].tolist(), sums, strict=True))
            found[i] = exact if exact < 2**63 else None
        return found

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch, d):
                m = len(x)
                ids = batch.column(key).slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                numbers = pa.array(deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                made = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)), numbers,
                    pa.array(((x - mean) @ basis).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays([ids, *made], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += m

    return rows.select(key, "x").mapInArrow(project, schema)


def op13_whiten(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whiten(rows, fit(rows), "vec_id")
