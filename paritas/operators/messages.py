"""Message passing with one row per distinct syndrome.

A syndrome's state between legs is one row: its marginals as an array, in fault order. Within a leg the
messages of a batch of rows are a matrix, syndromes by edges, and an iteration is a few passes over it
along the graph's neighbour positions: no sort, no exchange and no join. Spark deals the rows out, joins
and filters between legs, and keeps the control flow of a relay decode in columns. The graph goes to the
tasks once, after its edges were counted; a larger one is decoded as rows of edges (see ``bp``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.plans.spec import RelaySpec

# Edges of a graph that is sent to the tasks whole, and messages that a task handles at once.
GRAPH_EDGES, BATCH_MESSAGES = 2_000_000, 1_000_000


@dataclass(frozen=True)
class Graph:
    """Edges ordered by (det, fault); positions of each fault's edges in det order, padded with the number of edges."""

    dets: np.ndarray  # detector of each row
    faults: np.ndarray  # fault of each column
    starts: np.ndarray  # first edge of each row
    row: np.ndarray  # row, column and place in its column of each edge
    column: np.ndarray
    place: np.ndarray
    of_column: np.ndarray  # columns x largest degree
    lam: np.ndarray
    asked: np.ndarray

    @property
    def edges(self) -> int:
        return len(self.row)


def read_graph(edges: DataFrame, faults: DataFrame, ar, dets: DataFrame | None) -> Graph | None:
    """The graph on the driver, or None if it has more than GRAPH_EDGES edges. Faults without edges are no columns."""
    held = edges.select(F.col("det").cast("long").alias("det"), F.col("fault").cast("long").alias("fault")).limit(GRAPH_EDGES + 1).toPandas()
    if len(held) > GRAPH_EDGES:
        return None
    known = faults.join(edges.select("fault").distinct(), "fault", "left_semi").select(
        F.col("fault").cast("long").alias("fault"), ar.start(F.col("lam")).alias("lam")).toPandas().sort_values("fault")
    held = held[held["fault"].isin(known["fault"])].sort_values(["det", "fault"])
    names, rows = np.unique(held["det"].to_numpy(), return_inverse=True)
    columns = np.searchsorted(known["fault"].to_numpy(), held["fault"].to_numpy())
    order = np.lexsort((rows, columns))
    first = np.searchsorted(columns[order], np.arange(len(known)))
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows)) - first[columns[order]]
    of_column = np.full((len(known), int(place.max(initial=0)) + 1), len(rows))
    of_column[columns, place] = np.arange(len(rows))
    asked = np.ones(len(names), bool)
    if dets is not None:
        wanted = dets.select(F.col("det").cast("long").alias("det")).join(edges.select("det").distinct(), "det", "left_semi").toPandas()
        asked = np.isin(names, wanted["det"].to_numpy())
    return Graph(names, known["fault"].to_numpy(), np.searchsorted(rows, np.arange(len(names))), rows, columns, place, of_column, known["lam"].to_numpy(), asked)


# ---- arithmetic ---------------------------------------------------------------------------------------


class Floats:
    kind, top = np.float64, 1e300

    def scaled(self, size: np.ndarray, spec: RelaySpec, t: int) -> np.ndarray:
        damping = spec.damping(t)
        return size if damping == 1.0 else size * damping

    def bias(self, lam: np.ndarray, marginals: np.ndarray, strength: np.ndarray) -> np.ndarray:
        return np.where(lam >= self.top, lam, (1.0 - strength) * lam + strength * marginals)

    def strength(self, gamma: np.ndarray) -> np.ndarray:
        return gamma

    def updated(self, bias: np.ndarray, incoming: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next messages and marginals; sums before and after each edge leave its own out without a subtraction."""
        before = np.cumsum(incoming, axis=2)
        after = np.cumsum(incoming[:, :, ::-1], axis=2)[:, :, ::-1]
        total = before[:, :, -1]
        nu = np.zeros_like(incoming)
        nu[:, :, 1:] += before[:, :, :-1]
        nu[:, :, :-1] += after[:, :, 1:]
        return bias[:, :, None] + nu, bias + total

    def weight(self, hard: np.ndarray, lam: np.ndarray) -> np.ndarray:
        return (hard * np.where(lam >= self.top, 0.0, lam)).sum(1)


class Integers:
    """The grid's rules: whole numbers, every stored value clipped, products as shifted sums."""

    kind = np.int64

    def __init__(self, grid) -> None:
        self.grid, self.top = grid, grid.limit

    def clipped(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, -self.grid.limit, self.grid.limit)

    def scaled(self, size: np.ndarray, spec: RelaySpec, t: int) -> np.ndarray:
        bits = spec.damping_bits(t)
        return size if bits is None or bits > 30 else size - (size >> bits)

    def strength(self, gamma: np.ndarray) -> np.ndarray:
        steps = (1.0 - gamma) * (1 << self.grid.grain_bits)
        return np.clip(np.sign(steps) * np.floor(np.abs(steps) + 0.5), 0, 2 << self.grid.grain_bits).astype(np.int64)

    def weighted(self, x: np.ndarray, steps: np.ndarray) -> np.ndarray:
        size = np.abs(x)
        return np.sign(x) * sum(((size >> b) & 1) * ((steps << b) >> self.grid.grain_bits) for b in range(self.grid.bits))

    def bias(self, lam: np.ndarray, marginals: np.ndarray, strength: np.ndarray) -> np.ndarray:
        last = self.clipped(marginals)
        return self.clipped(last - self.weighted(last, strength) + self.weighted(lam, strength))

    def updated(self, bias: np.ndarray, incoming: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = bias + incoming.sum(2)
        return self.clipped(total[:, :, None] - incoming), total

    def weight(self, hard: np.ndarray, lam: np.ndarray) -> np.ndarray:
        return (hard * lam).sum(1) / float(self.grid.units)


def numbers(ar):
    return Integers(ar.grid) if hasattr(ar, "grid") else Floats()


# ---- one leg ------------------------------------------------------------------------------------------


def check_messages(g: Graph, nu: np.ndarray, fired: np.ndarray, spec: RelaySpec, t: int, ar) -> np.ndarray:
    """Per edge the parity and the smallest other magnitude of its row; an edge alone sends the largest message."""
    size = np.abs(nu)
    least = np.minimum.reduceat(size, g.starts, axis=1)
    low = size == least[:, g.row]
    often = np.add.reduceat(low, g.starts, axis=1, dtype=np.int64)
    second = np.minimum(np.minimum.reduceat(np.where(low, ar.top, size), g.starts, axis=1), ar.top)
    second = np.where(often > 1, least, second)
    least = np.minimum(least, ar.top)
    out = ar.scaled(np.where(low, second[:, g.row], least[:, g.row]), spec, t)
    parity = (np.add.reduceat(nu < 0, g.starts, axis=1, dtype=np.int64) + fired) % 2
    return np.where((parity[:, g.row] == 1) != (nu < 0), -out, out)


def leg(g: Graph, fired: np.ndarray, lost: np.ndarray, marginals: np.ndarray, strength: np.ndarray | None, budget: np.ndarray,
        limit: int, spec: RelaySpec, ar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Iterations, whether converged, hard decisions and marginals of a batch after at most ``limit`` iterations."""
    n = len(fired)
    done, it, hard = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros((n, len(g.faults)), bool)
    nu = np.broadcast_to(g.lam[g.column], (n, g.edges)).astype(ar.kind)
    marginals = marginals.copy()
    at = np.arange(n)  # the rows that still run
    for t in range(limit):
        at = at[~done[at] & (budget[at] > t)]
        if not len(at):
            break
        nu_at = nu[at]
        eta = check_messages(g, nu_at, fired[at], spec, t, ar)
        incoming = np.concatenate([eta, np.zeros((len(at), 1), ar.kind)], axis=1)[:, g.of_column]
        bias = np.broadcast_to(g.lam.astype(ar.kind), (len(at), len(g.faults))) if strength is None else ar.bias(g.lam, marginals[at], strength[at])
        out, sigma = ar.updated(bias, incoming)
        nu[at], marginals[at], it[at] = out[:, g.column, g.place], sigma, t + 1
        hard[at] = sigma <= 0
        odd = (np.add.reduceat(hard[at][:, g.column], g.starts, axis=1, dtype=np.int64) + fired[at]) % 2 == 1
        done[at] = ~((odd & g.asked).any(1) | lost[at])
    return it, done, hard, marginals


Strengths = Callable[[np.ndarray, np.ndarray], np.ndarray]  # (sids, faults) -> a matrix


def same_for_all(values: np.ndarray) -> Strengths:
    return lambda sids, faults: np.broadcast_to(values, (len(sids), len(faults)))


def drawn_for_each(seed: int, leg_number: int, low: float, high: float) -> Strengths:
    """The draws of ``hashing.gamma_draw``."""
    def draw(sid: int, fault: int) -> float:
        return int(hashlib.md5(f"{seed}:{sid}:{leg_number}:{fault}".encode()).hexdigest()[:13], 16) / (1 << 52)

    return lambda sids, faults: low + np.array([[draw(s, f) for f in faults.tolist()] for s in sids.tolist()]).reshape(len(sids), len(faults)) * (high - low)


def run_leg(state: DataFrame, sent, spec: RelaySpec, limit: int, strengths: Strengths | None, arith) -> DataFrame:
    """One pass over the syndromes: adds it, done, weight, support and the new marginals to the control columns.

    state(sid, fired_rows, lost, marg, budget, ...): marg is null before the first leg.
    """
    ar = numbers(arith)
    kept = [c for c in state.columns if c not in ("marg", "it", "done", "weight", "support")]
    of = {c: i for i, c in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        step = max(1, BATCH_MESSAGES // max(1, g.edges))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                n = batch.num_rows
                rows = batch.column(of["fired_rows"])
                fired = np.zeros((n, len(g.dets)), np.int64)
                sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                fired[np.repeat(np.arange(n), sizes), np.searchsorted(g.dets, rows.flatten().to_numpy())] = 1
                old = batch.column(len(kept))
                if old.null_count:
                    marginals = np.broadcast_to(g.lam.astype(ar.kind), (n, len(g.faults)))
                else:
                    marginals = old.flatten().to_numpy().reshape(n, len(g.faults)).astype(ar.kind)
                sids = batch.column(of["sid"]).to_numpy()
                strength = None if strengths is None else ar.strength(strengths(sids, g.faults))
                it, done, hard, marginals = leg(
                    g, fired, batch.column(of["lost"]).to_numpy(zero_copy_only=False).astype(bool), marginals, strength,
                    batch.column(of["budget"]).to_numpy(), limit, spec, ar)
                which, column = np.nonzero(hard)
                offsets = np.searchsorted(which, np.arange(n + 1))
                support = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(g.faults[column], pa.int64()))
                spread = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * len(g.faults)).astype(np.int32)), pa.array(marginals.astype(np.float64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(kept))), spread, pa.array(it), pa.array(done), pa.array(ar.weight(hard, g.lam).astype(np.float64)), support],
                    names=[*kept, "marg", "it", "done", "weight", "support"])

    types = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", marg array<double>, it long, done boolean, weight double, support array<long>"
    return state.select(*kept, "marg").mapInArrow(run, schema)


def start(edges: DataFrame, fired: DataFrame, sids: DataFrame, lost: DataFrame) -> DataFrame:
    """(sid, fired_rows, lost, marg): every syndrome with its fired detectors that have edges."""
    touched = fired.join(edges.select("det").distinct(), "det", "left_semi").groupBy("sid").agg(F.collect_set(F.col("det").cast("long")).alias("fired_rows"))
    base = sids.select("sid").distinct().join(touched, "sid", "left").join(lost, "sid", "left")
    empty: Column = F.array().cast("array<bigint>")
    return base.select("sid", F.coalesce("fired_rows", empty).alias("fired_rows"), F.coalesce("lost", F.lit(False)).alias("lost"),
                       F.lit(None).cast("array<double>").alias("marg"))
