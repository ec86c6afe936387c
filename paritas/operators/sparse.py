"""Sliding-window decoding of windows of any size, in batch.

A shot is one row that holds its fired detectors as an ascending array, so a window's syndrome is a
filter of that array and a commit is a symmetric difference: shots never move between windows. Per
window the distinct syndromes are decoded by an inner decoder on the plan's edge table, supports become
commits and flips as products over GF(2) per distinct syndrome, and the answers are joined back on the
syndrome. Silent windows, usually most of them, take one answer without a join. There is no bound on the
columns or rows of a window; arrays are as long as a shot's syndrome or a syndrome's correction.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from paritas.functions.bits import bit
from paritas.functions.hashing import gamma_stream
from paritas.operators import windowed
from paritas.operators.bp import counted_broadcast, relay_decode
from paritas.operators.gf2 import odd
from paritas.plans.spec import RelaySpec
from paritas.plans.windows import PLACE, WindowPlan
from paritas.session import cut_lineage

RECORD = ("struct<window:bigint,attempts:int,converged:boolean,cap_hit:boolean,iterations:bigint,legs:bigint,ties:bigint,weight:double,committed_weight:double,"
          "unexplained:bigint,virtual:bigint,flagged:boolean,low:boolean,residual_first:array<bigint>,solution:array<bigint>,committed:array<bigint>,frame:bigint>")
SILENT = -1


@dataclass(frozen=True)
class Local:
    """The problem of one placement: columns(fault, lam, cls, commit, global_fault), edges(det, fault), asked(det)."""

    window: int
    attempt: int
    columns: DataFrame
    edges: DataFrame
    asked: DataFrame


class Inner(Protocol):
    """Decodes syndromes(sid, det) of a placement: results(sid, converged, cap_hit, iterations, legs, ties, weight, low) and
    support(sid, fault). ``shared``: equal syndromes of a placement have equal answers."""

    shared: bool

    def decode(self, local: Local, syndromes: DataFrame, sids: DataFrame, cap: int | None) -> tuple[DataFrame, DataFrame]: ...


class MessagePassing:
    """Relay decoding. With strengths drawn per stream every (shot, window, attempt) is a stream of its own."""

    def __init__(self, spec: RelaySpec, gammas=None, low: Column | None = None, per_stream: bool = False):
        self.spec, self.gammas, self.low, self.shared = spec, gammas, low, not per_stream

    def decode(self, local: Local, syndromes: DataFrame, sids: DataFrame, cap: int | None) -> tuple[DataFrame, DataFrame]:
        spec = self.spec if cap is None else replace(self.spec, cap=cap)
        got = relay_decode(local.edges, local.columns, syndromes, sids, spec, self.gammas, dets=local.asked)
        results = got.results.select(
            "sid", F.col("success").alias("converged"), "cap_hit", F.col("iterations").cast("bigint").alias("iterations"),
            F.col("legs").cast("bigint").alias("legs"), F.lit(1).cast("bigint").alias("ties"), "weight")
        return results.withColumn("low", F.lit(False) if self.low is None else F.coalesce(self.low, F.lit(False))), got.support


class Lookup:
    """Exact decoding of placements with at most 63 columns and rows, by the tables of ``lookup``."""

    shared = True

    def __init__(self, plan: WindowPlan, max_size: int | None = None):
        self.loaded = windowed.load_plan(plan)
        self.tables = windowed.lookup_inner(plan.columns.sparkSession, self.loaded, max_size)  # one per shape, built once

    def decode(self, local: Local, syndromes: DataFrame, sids: DataFrame, cap: int | None) -> tuple[DataFrame, DataFrame]:
        place = self.loaded.places[local.window, local.attempt]
        offset = (place.first_round - 1) * self.loaded.per_round
        keys = syndromes.groupBy("sid").agg(F.bit_or(bit(F.col("det") - offset)).alias("key"))
        keys = sids.join(keys, "sid", "left").select("sid", F.coalesce("key", F.lit(0).cast("bigint")).alias("key"))
        found = cut_lineage(keys.join(self.tables(place, None).select("key", "weight", "cols", "ties"), "key", "left"))
        faults = [r["fault"] for r in local.columns.select("fault").orderBy("fault").collect()]  # at most 63
        names = F.array(*[F.lit(f).cast("bigint") for f in faults])
        results = found.select("sid", F.col("weight").isNotNull().alias("converged"), F.lit(False).alias("cap_hit"), F.lit(0).cast("bigint").alias("iterations"),
                               F.lit(1).cast("bigint").alias("legs"), F.coalesce("ties", F.lit(0).cast("bigint")).alias("ties"), "weight", F.lit(False).alias("low"))
        return results, found.select("sid", F.explode("cols").alias("_i")).select("sid", F.element_at(names, F.col("_i") + 1).alias("fault"))


def shot_rows(fired: DataFrame, shots: DataFrame) -> DataFrame:
    """(shot, left): the fired detectors of every shot, ascending."""
    held = fired.groupBy("shot").agg(F.sort_array(F.collect_set(F.col("det").cast("bigint"))).alias("left"))
    return shots.select("shot").join(held, "shot", "left").select("shot", F.coalesce("left", _none()).alias("left"))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _between(name: str, low: int, high: int) -> Column:
    return F.filter(name, lambda d: (d >= low) & (d < high))


def answers(local: Local, results: DataFrame, support: DataFrame) -> DataFrame:
    """results with solution, committed, virtual, flips, cls and committed_weight per sid; arrays are as long as a correction."""
    columns = counted_broadcast(local.columns.select("fault", "lam", "cls", "commit", "global_fault"))
    chosen = support.join(columns, "fault")
    commits = chosen.where("commit")
    finite = F.when(F.abs("lam") < float("inf"), F.col("lam")).otherwise(F.lit(0.0))
    per = chosen.groupBy("sid").agg(
        F.sort_array(F.collect_list("global_fault")).alias("solution"),  # virtual columns have none and drop out
        F.sort_array(F.collect_list(F.when(F.col("commit"), F.col("global_fault")))).alias("committed"),
        F.count_if(F.col("commit") & F.col("global_fault").isNull()).alias("virtual"), F.bit_xor(F.when(F.col("commit"), F.col("cls"))).alias("cls"),
        F.sum(F.when(F.col("commit"), finite)).alias("committed_weight"))
    flips = odd(commits.select("sid", "fault").join(counted_broadcast(local.edges), "fault"), ["sid", "det"]).groupBy("sid").agg(F.collect_list(F.col("det").cast("bigint")).alias("flips"))
    zero = F.lit(0).cast("bigint")
    return results.join(per, "sid", "left").join(flips, "sid", "left").select(
        "sid", "converged", "cap_hit", "iterations", "legs", "ties", "weight", "low", F.coalesce("solution", _none()).cast("array<bigint>").alias("solution"),
        F.coalesce("committed", _none()).cast("array<bigint>").alias("committed"), F.coalesce("virtual", zero).alias("virtual"),
        F.coalesce("flips", _none()).alias("flips"), F.coalesce("cls", zero).cast("bigint").alias("cls"), F.coalesce("committed_weight", F.lit(0.0)).alias("committed_weight"))


FIELDS = ("converged", "cap_hit", "iterations", "legs", "ties", "weight", "low", "solution", "committed", "virtual", "flips", "cls", "committed_weight")


def answered(state: DataFrame, local: Local, inner: Inner, cap: int | None, written: bool = False) -> DataFrame:
    """state(shot, _open, _key, ...) with the inner decoder's answer of every open row as _<field>; written: read from a table as it is."""
    state = state if written else cut_lineage(state)
    if not inner.shared:
        state = state.withColumn("_sid", gamma_stream(F.col("shot").cast("bigint"), F.lit(local.window), F.lit(local.attempt)))
        ran = state.where("_open")
        results, support = inner.decode(local, ran.select(F.col("_sid").alias("sid"), F.explode("_key").alias("det")), ran.select(F.col("_sid").alias("sid")), cap)
        answer = cut_lineage(answers(local, results, support))
        return state.join(answer.select(F.col("sid").alias("_sid"), *[F.col(f).alias(f"_{f}") for f in FIELDS]), "_sid", "left").drop("_sid")
    loud = cut_lineage(state.where(F.col("_open") & (F.size("_key") > 0)).select("_key").distinct().withColumn("sid", F.monotonically_increasing_id()))
    silent = state.sparkSession.range(1).select(F.lit(SILENT).cast("bigint").alias("sid"))
    results, support = inner.decode(local, loud.select("sid", F.explode("_key").alias("det")), loud.select("sid").union(silent), cap)
    answer = cut_lineage(answers(local, results, support))
    quiet = answer.where(F.col("sid") == SILENT).select(F.struct(*FIELDS)).scalar()  # one row, as long as a correction
    named = answer.join(loud, "sid").select("_key", F.struct(*FIELDS).alias("_a"))
    joined = state.join(counted_broadcast(named), "_key", "left").withColumn("_a", F.when(F.size("_key") == 0, quiet).otherwise(F.col("_a")))
    return joined.select(*state.columns, *[F.when(F.col("_open"), F.col(f"_a.{f}")).alias(f"_{f}") for f in FIELDS])


@dataclass(frozen=True)
class Windows:
    """A plan's tables, written once, and its placements: one small row per window and attempt."""

    plan: WindowPlan
    columns: DataFrame
    edges: DataFrame
    rows: DataFrame
    placed: dict[tuple[int, int], Row]

    def local(self, window: int, attempt: int) -> Local:
        here = (F.col("window") == window) & (F.col("attempt") == attempt)
        return Local(window, attempt, self.columns.where(here).drop(*PLACE), self.edges.where(here).select("det", "fault"),
                     self.rows.where(here & F.col("converge")).select("det"))

    def attempts(self, window: int) -> list[int]:
        return sorted(a for w, a in self.placed if w == window)

    def rounds(self, window: int, attempt: int) -> tuple[int, int]:
        place = self.placed[window, attempt]
        return place["first_round"], min(place["last_round"], self.plan.rounds_total)


def open_plan(plan: WindowPlan) -> Windows:
    placed = {(r["window"], r["attempt"]): r for r in plan.placements.collect()}
    return Windows(plan, cut_lineage(plan.columns), cut_lineage(plan.edges), cut_lineage(plan.rows), placed)


STATE = {"frame": "bigint", "over": "boolean", "window": "bigint", "attempt": "int", "iter": "bigint", "all_legs": "bigint", "first": "array<bigint>", "records": f"array<{RECORD}>"}


def unbegun() -> dict[str, Column]:
    """The state of a decode that has not begun."""
    return {name: (F.array() if kind.startswith("array") else F.lit(0)).cast(kind) for name, kind in STATE.items()}


def fresh(shots: DataFrame) -> DataFrame:
    return shots.withColumns(unbegun())


def attempt_step(state: DataFrame, windows: Windows, window: int, attempt: int, inner: Inner, on_low: str, ready: Column, written: bool = False) -> DataFrame:
    """One attempt of one window for the shots whose turn it is and that are ``ready``; other columns of state stay.

    written: state is a written table, which is not written once more.

    A solution is committed, or the shot waits for a wider attempt. A window commits what its decoder returned, also where
    that does not satisfy the syndrome. Without a solution it is flagged where either policy asks for action.
    """
    spec, m, zero = windows.plan.spec, windows.plan.per_round, F.lit(0).cast("bigint")
    place, (first_round, last) = windows.placed[window, attempt], windows.rounds(window, attempt)
    low, end = (first_round - 1) * m, last if place["final"] else min(first_round + place["commit_rounds"] - 1, last)
    state = state.withColumn("_open", ~F.col("over") & (F.col("window") == window) & (F.col("attempt") == attempt) & ready)
    if attempt == 0:
        state = state.withColumn("first", F.when(F.col("_open"), F.transform(_between("left", low, low + m), lambda d: d - low)).otherwise(F.col("first")))
    keyed = state.withColumn("_key", F.when(F.col("_open"), _between("left", low, last * m)).otherwise(_none()))
    found = answered(keyed, windows.local(window, attempt), inner, spec.iteration_cap, written)
    ok, doubtful = F.coalesce("_converged", F.lit(False)), F.coalesce("_low", F.lit(False))
    more = attempt + 1 in windows.attempts(window)
    retry = F.col("_open") & ((~ok & F.lit(more and spec.on_failure == "defer")) | (ok & doubtful & F.lit(more and on_low == "defer")))
    flagged = (~ok & F.lit(spec.on_failure != "commit_anyway" or on_low != "none")) | (ok & doubtful & F.lit(on_low != "none"))
    flips = F.coalesce("_flips", _none())
    found = found.withColumns({
        "iter": F.col("iter") + F.coalesce("_iterations", zero), "all_legs": F.col("all_legs") + F.coalesce("_legs", zero), "_retry": retry,
        "_done": F.col("_open") & ~retry, "_left": F.array_sort(F.concat(F.array_except("left", flips), F.array_except(flips, F.col("left")))),
        "_frame": F.col("frame").bitwiseXOR(F.coalesce("_cls", zero))})
    record = F.struct(
        F.lit(window).cast("bigint").alias("window"), F.lit(attempt + 1).alias("attempts"), ok.alias("converged"), F.coalesce("_cap_hit", F.lit(False)).alias("cap_hit"),
        F.col("iter").alias("iterations"), F.col("all_legs").alias("legs"), F.coalesce("_ties", zero).alias("ties"),
        F.when(ok, F.col("_weight")).otherwise(F.lit(float("inf"))).alias("weight"), F.coalesce("_committed_weight", F.lit(0.0)).alias("committed_weight"),
        F.size(_between("_left", low, end * m)).cast("bigint").alias("unexplained"), F.coalesce("_virtual", zero).alias("virtual"), flagged.alias("flagged"),
        doubtful.alias("low"), F.col("first").alias("residual_first"), F.coalesce("_solution", _none()).alias("solution"),
        F.coalesce("_committed", _none()).alias("committed"), F.col("_frame").alias("frame")).cast(RECORD)
    done = F.col("_done")
    new = {
        "left": F.when(done, F.col("_left")).otherwise(F.col("left")), "frame": F.when(done, F.col("_frame")).otherwise(F.col("frame")),
        "over": F.col("over") | (done & F.lit(place["final"])), "records": F.when(done, F.array_append("records", record)).otherwise(F.col("records")),
        "window": F.when(done, F.col("window") + 1).otherwise(F.col("window")),
        "attempt": F.when(done, F.lit(0)).when(F.col("_retry"), F.col("attempt") + 1).otherwise(F.col("attempt")),
        "iter": F.when(done, zero).otherwise(F.col("iter")), "all_legs": F.when(done, zero).otherwise(F.col("all_legs"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns if c != "_open"])


def check_action(on_low: str) -> None:
    if on_low not in ("none", "flag", "defer"):
        raise ValueError(f"unknown low-confidence action {on_low!r}")


def decode_windows(fired: DataFrame, shots: DataFrame, plan: WindowPlan, inner: Inner, on_low: str = "none") -> DataFrame:
    """(shot, left, frame, records): every window of every shot, decoded in order.

    on_failure of the plan's specification: commit_anyway, flag, or defer (retry on wider placements). on_low: none,
    flag, or defer for solutions the inner decoder marks low. Windows after a final attempt have no record.
    """
    check_action(on_low)
    windows = open_plan(plan)
    state = fresh(shot_rows(fired, shots))
    for window in range(plan.positions):
        for attempt in windows.attempts(window):
            state = attempt_step(state, windows, window, attempt, inner, on_low, F.lit(True))
    return cut_lineage(state).select("shot", "left", "frame", "records")


def residual_rows(decoded: DataFrame) -> DataFrame:
    """(shot, det) still fired after every commit."""
    return decoded.select("shot", F.explode("left").alias("det"))
