"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers first, so that counts, sums and deviations are exact. With X the centred
rows, the bidiagonalisation keeps right vectors V (as long as a vector, on the driver) and left vectors
U (as long as the table, never stored): every left vector is X w for a short w, so a task recomputes its
part of them from its rows. A step is one pass over the table, in which each task sends the sums of
X'p, U'p and p'p for p = X v - beta u of its rows. U'p orthogonalises the new left vector against all
earlier ones, V'r the new right vector, twice. So X V = U B with a small upper bidiagonal B, whose
singular values and right vectors give the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Vectors up to this long are bidiagonalised fully, so that equal eigenvalues are all found. Beyond, the
#: steps end when the components' residuals are under ``RESIDUAL`` of the largest singular value.
FULL_STEPS, RESIDUAL = 256, 1e-14
#: Share of the largest singular value (eigenvalue) below which a direction counts as empty.
EMPTY, EMPTY_VALUE = 1e-13, 1e-12
#: Entries beyond this are no exact whole doubles.
LARGEST = float(1 << 52)

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whole_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the whole numbers floor(1024 c) + 100000, of the rows that take part, written.

    Left out: null and empty vectors, vectors with a null, non-finite or huge entry (beyond 2^52 once
    scaled), and vectors of another length than the commonest (of equally common ones, the longest).
    """
    scaled = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE <= LARGEST))
    rows = embeddings.filter(F.col(vector).isNotNull()).filter(fit & (F.size(vector) > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<long>").alias("x"))
    rows = cut_lineage(rows)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows if length is None else rows.filter(F.size("x") == length["d"])


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of whole numbers."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of part(x) over all rows; every task sends one array as long as the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = part(matrix(batch.column(0)))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["s"])

    parts = rows.select("x").mapInArrow(run, f"s array<{kind}>").select(F.posexplode("s").alias("at", "value"))
    found = parts.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    return np.array([r["value"] for r in found], np.int64 if kind == "long" else np.float64)


class Bidiagonal:
    """The state of the bidiagonalisation: everything in it is as small as d x d."""

    def __init__(self, d: int) -> None:
        self.d = d
        self.v, self.w, self.z = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # right vectors; u = X w; X'u
        self.alpha: list[float] = []
        self.beta: list[float] = []
        self.random = np.random.default_rng(12)
        self.next = self.fresh()

    def off_basis(self, r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - self.v @ (self.v.T @ r)
        return r

    def fresh(self) -> np.ndarray:
        """A unit direction orthogonal to all right vectors."""
        r = self.off_basis(self.random.standard_normal(self.d))
        return r / np.linalg.norm(r)

    def short(self) -> np.ndarray:
        """p = X times this, before it is made orthogonal to the left vectors."""
        return self.next - (self.beta[-1] * self.w[:, -1] if self.beta else 0.0)

    def step(self, w: np.ndarray, xp: np.ndarray, up: np.ndarray, pp: float) -> None:
        """Takes in the sums X'p, U'p and p'p of one pass."""
        largest = max(self.alpha + self.beta, default=0.0)
        alpha = float(np.sqrt(max(0.0, pp - up @ up)))
        if alpha <= EMPTY * max(largest, alpha):
            alpha, w, z = 0.0, np.zeros(self.d), np.zeros(self.d)
        else:
            w, z = (w - self.w @ up) / alpha, (xp - self.z @ up) / alpha
        v = self.next
        self.v, self.w, self.z = np.c_[self.v, v], np.c_[self.w, w], np.c_[self.z, z]
        self.alpha.append(alpha)
        if len(self.alpha) == self.d:
            self.beta.append(0.0)
            return
        r = self.off_basis(z - alpha * v)
        beta = float(np.linalg.norm(r))
        if beta <= EMPTY * max(largest, alpha, beta):
            self.beta.append(0.0)
            self.next = self.fresh()
        else:
            self.beta.append(beta)
            self.next = r / beta

    def solved(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, components as columns, and the residual of each."""
        b = np.diag(self.alpha) + np.diag(self.beta[:-1], 1)
        p, s, q = np.linalg.svd(b)
        return s, self.v @ q.T, self.beta[-1] * np.abs(p[-1])


def bidiagonalised(rows: DataFrame, mean: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the centred rows and their right vectors as columns."""
    state = Bidiagonal(len(mean))
    while len(state.alpha) < state.d:
        short, earlier = state.short(), state.w

        def part(x: np.ndarray, short=short, earlier=earlier) -> np.ndarray:
            centred = x - mean
            p = centred @ short
            return np.concatenate([centred.T @ p, (centred @ earlier).T @ p, [p @ p]])

        sums = summed(rows, part)
        state.step(short, sums[:state.d], sums[state.d:-1], float(sums[-1]))
        if state.d > FULL_STEPS and len(state.alpha) >= components:
            s, _, residual = state.solved()
            if (residual[:components] <= RESIDUAL * s[0]).all():
                break
    s, q, _ = state.solved()
    return s[:components], q[:, :components]


def exact_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Per row the sum of (n x - S)^2; None where it does not fit a long."""
    spread = n * (float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0)) / n)
    if spread * spread * x.shape[1] < 2.0 ** 62:
        y = n * x - sums
        return (y * y).sum(1).tolist()
    whole = [int(s) for s in sums]
    found = [sum((n * int(c) - s) ** 2 for c, s in zip(row, whole)) for row in x]
    return [v if v < 1 << 63 else None for v in found]


def whitened(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error per row and component.

    A component's largest entry is positive (of equally large ones, the first). Components with less than
    1e-12 of the largest eigenvalue cannot be whitened and are not given out, so equal or single rows give
    none. A deviation beyond a long is null. Repeated rows and null ids are rows like others, an empty
    table gives none, other columns are not read. `whole_vectors` says which rows take part.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings, vector)
    sums = summed(rows, lambda x: np.concatenate([[len(x)], x.sum(0)]), "long")
    if not len(sums):
        return spark.createDataFrame([], RESULT)
    n, sums = int(sums[0]), sums[1:]
    mean = sums / n
    trace = float(summed(rows, lambda x: np.array([np.square(x - mean).sum()]))[0]) / n
    s, axes = bidiagonalised(rows, mean, components)
    values = s * s / n
    there = values > EMPTY_VALUE * values.max(initial=0.0)
    values, axes = values[there], axes[:, there]
    if not len(values):
        return spark.createDataFrame([], RESULT)
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(values))])
    turn = axes / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ turn
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    found = summed(rows, moments) / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            m = len(x)
            deviation = pa.array(exact_deviations(x, n, sums), pa.int64())
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                deviation.take(row), pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, RESULT)
