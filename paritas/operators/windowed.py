"""Sliding-window decoding of whole tables of shots.

A shot is one row: its residual syndrome as one word per round. Per window, the words of the
window's rounds form a key, the key is joined with a table of solutions, and the solution's flips,
class and record are applied to the row. With lookup tables the whole decode is a chain of joins
against small bounded tables: no shuffle after the words are packed, whatever the number of shots.
An inner decoder that needs the keys (message passing) decodes the distinct keys of each window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.bits import bit
from paritas.operators import lookup
from paritas.operators.bp import relay_decode
from paritas.plans.spec import RelaySpec, WindowSpec
from paritas.plans.windows import PLACE, WindowPlan
from paritas.session import bounded_broadcast, cut_lineage

RECORD = ("struct<window:bigint,attempts:int,converged:boolean,iterations:bigint,legs:bigint,ties:bigint,weight:double,committed_weight:double,"
          "unexplained:bigint,virtual:bigint,flagged:boolean,low:boolean,residual_first:bigint,key:bigint,"
          "solution:array<bigint>,committed:array<bigint>,frame:bigint>")


@dataclass(frozen=True)
class Place:
    """One (window, attempt) with its local problem; small, read once from the plan."""

    window: int
    attempt: int
    first_round: int
    last_round: int
    commit_rounds: int
    final: bool
    shape: int
    problem: lookup.SmallProblem
    faults: tuple[int | None, ...]  # global fault per local column
    asked: int  # mask of the rows the convergence test looks at


@dataclass(frozen=True)
class LoadedPlan:
    spec: WindowSpec
    rounds: int
    per_round: int
    positions: int
    places: dict[tuple[int, int], Place]


def load_plan(plan: WindowPlan) -> LoadedPlan:
    """The plan's local problems on the driver: at most 63 columns and rows per placement."""
    heights = plan.rows.groupBy(*PLACE).agg(F.count("*").alias("rows"))
    sizes = plan.columns.groupBy(*PLACE).agg(F.count("*").alias("n")).join(heights, PLACE).agg(F.max("n").alias("n"), F.max("rows").alias("rows")).first()
    if sizes.n > 63 or sizes.rows > 63:
        raise ValueError(f"a window with {sizes.n} columns and {sizes.rows} rows is too large to decode by words; at most 63 of each")
    offset = (F.col("window") * plan.spec.commit) * plan.per_round
    masks = plan.edges.groupBy(*PLACE, "fault").agg(F.bit_or(bit(F.col("det") - offset)).alias("mask"))
    columns = plan.columns.join(masks, [*PLACE, "fault"]).groupBy(*PLACE).agg(
        F.array_sort(F.collect_list(F.struct("fault", "mask", "lam", "cls", "commit", "global_fault"))).alias("c"))
    asked = plan.rows.groupBy(*PLACE).agg(
        F.sum(F.when(F.col("converge"), bit(F.col("det") - offset)).otherwise(F.lit(0))).alias("asked"), F.count("*").alias("rows"))
    table = plan.placements.join(columns, PLACE).join(asked, PLACE)
    places, shapes = {}, {}
    for r in sorted(table.collect(), key=lambda r: (r.window, r.attempt)):
        problem = lookup.SmallProblem(r.rows, tuple(c.mask for c in r.c), tuple(c.lam for c in r.c), tuple(c.cls for c in r.c), tuple(c.commit for c in r.c))
        shape = shapes.setdefault((problem, r.asked), len(shapes))
        places[r.window, r.attempt] = Place(r.window, r.attempt, r.first_round, r.last_round, r.commit_rounds, r.final, shape, problem,
                                            tuple(c.global_fault for c in r.c), r.asked)
    return LoadedPlan(plan.spec, plan.rounds_total, plan.per_round, plan.positions, places)


def pack_rounds(fired: DataFrame, shots: DataFrame, rounds: int, per_round: int) -> DataFrame:
    """(shot, words): one word of fired detectors per round. Words combine on the map side."""
    word = F.floor(F.col("det") / per_round).cast("int")
    sums = [F.bit_or(F.when(word == r, bit(F.col("det") % per_round))).alias(f"_w{r}") for r in range(rounds)]
    packed = fired.groupBy("shot").agg(*sums)
    zero = F.lit(0).cast("bigint")
    return shots.select("shot").join(packed, "shot", "left").select(
        "shot", F.array(*[F.coalesce(f"_w{r}", zero) for r in range(rounds)]).alias("words"))


# ---- inner decoders ---------------------------------------------------------------------------------

# An inner decoder maps a placement and the distinct keys it must answer (or None) to a table
# (key, weight, cols, ties, flip, commit_cls, commit_cols, committed_weight, converged, iterations, legs[, low]).
Inner = Callable[[Place, DataFrame | None], DataFrame]


def lookup_inner(spark, plan: LoadedPlan, max_size: int | None = None) -> Inner:
    """The exact decoder: one table per distinct window shape, built once."""
    tables: dict[int, DataFrame] = {}

    def decode(place: Place, keys: DataFrame | None) -> DataFrame:
        if place.shape not in tables:
            table = lookup.lookup_table(spark, place.problem, max_size).withColumn("converged", F.lit(True)).withColumn(
                "iterations", F.lit(0).cast("bigint")).withColumn("legs", F.lit(1).cast("bigint")).drop("cls")
            tables[place.shape] = cut_lineage(table)
        return bounded_broadcast(tables[place.shape], place.problem.bound)

    decode.needs_keys = False
    return decode


def message_passing_inner(spark, spec: RelaySpec, gammas=None, block: int = 5) -> Inner:
    """Message passing on the distinct syndromes of each window."""
    def decode(place: Place, keys: DataFrame | None) -> DataFrame:
        p = place.problem
        column = F.explode(F.array(*[
            F.struct(F.lit(i).alias("fault"), F.lit(m).alias("mask"), F.lit(lam).alias("lam"), F.lit(c).alias("cls"), F.lit(k).alias("commit"))
            for i, (m, lam, c, k) in enumerate(zip(p.masks, p.lam, p.cls, p.commit, strict=True))]))
        columns = spark.range(1).select(column.alias("c")).select("c.*")
        rows = F.sequence(F.lit(0), F.lit(p.rows - 1))
        edges = columns.select("fault", "mask", F.explode(rows).alias("det")).where(F.getbit("mask", F.col("det")) == 1).select("det", "fault")
        sids = keys.select(F.col("key").alias("sid"))
        fired = sids.withColumn("det", F.explode(rows)).where(F.getbit("sid", F.col("det")) == 1)
        asked = spark.range(p.rows).select(F.col("id").alias("det")).where(F.getbit(F.lit(place.asked), F.col("det")) == 1)
        got = relay_decode(edges, columns, fired, sids, spec, gammas, dets=asked, block=block)
        chosen = got.support.join(F.broadcast(columns), "fault").groupBy("sid").agg(
            F.sort_array(F.collect_list("fault")).alias("cols"),
            F.sort_array(F.collect_list(F.when(F.col("commit"), F.col("fault")))).alias("commit_cols"),
            F.bit_xor(F.when(F.col("commit"), F.col("mask"))).alias("flip"), F.bit_xor(F.when(F.col("commit"), F.col("cls"))).alias("commit_cls"),
            F.sum(F.when(F.col("commit") & (F.abs("lam") < float("inf")), F.col("lam"))).alias("committed_weight"))
        empty = F.array().cast("array<int>")
        return got.results.join(chosen, "sid", "left").select(
            F.col("sid").alias("key"), F.col("weight").cast("double").alias("weight"), F.coalesce("cols", empty).alias("cols"), F.lit(1).cast("bigint").alias("ties"),
            F.coalesce("flip", F.lit(0)).cast("bigint").alias("flip"), F.coalesce("commit_cls", F.lit(0)).cast("bigint").alias("commit_cls"),
            F.coalesce("commit_cols", empty).alias("commit_cols"), F.coalesce("committed_weight", F.lit(0.0)).alias("committed_weight"),
            F.col("success").alias("converged"), F.col("iterations").cast("bigint").alias("iterations"), F.col("legs").cast("bigint").alias("legs"))

    decode.needs_keys = True
    return decode


def with_low(inner: Inner, low: Callable[[], Column]) -> Inner:
    """Marks solutions of low confidence by a predicate on the inner decoder's columns."""
    def decode(place: Place, keys: DataFrame | None) -> DataFrame:
        return inner(place, keys).withColumn("low", low())

    decode.needs_keys = inner.needs_keys
    return decode


# ---- the decode -------------------------------------------------------------------------------------


def _key(place: Place, plan: LoadedPlan) -> Column:
    key = F.lit(0).cast("bigint")
    for r in range(place.first_round, min(place.last_round, plan.rounds) + 1):
        key = key.bitwiseOR(F.shiftleft(F.element_at("words", r), plan.per_round * (r - place.first_round)))
    return key


def _named(cols: str, place: Place) -> Column:
    """Local columns -> ascending global faults; virtual columns drop out."""
    names = F.array(*[F.lit(f).cast("bigint") for f in place.faults]) if place.faults else F.array().cast("array<bigint>")
    picked = F.transform(F.col(cols), lambda i: F.element_at(names, i + 1))
    return F.sort_array(F.array_compact(picked))


def _apply(state: DataFrame, place: Place, plan: LoadedPlan) -> tuple[Column, Column]:
    """(new words, unexplained) after the placement's flips."""
    m, first = plan.per_round, place.first_round
    last = min(place.last_round, plan.rounds)
    left = F.col("_key").bitwiseXOR(F.col("_flip"))
    inside = [F.shiftrightunsigned(left, m * (r - first)).bitwiseAND(F.lit((1 << m) - 1)) for r in range(first, last + 1)]
    words = [F.element_at("words", r) for r in range(1, plan.rounds + 1)]
    words[first - 1:last] = inside
    end = last if place.final else min(first + place.commit_rounds - 1, last)
    counted = F.bit_count(left.bitwiseAND(F.lit((1 << (m * max(0, end - first + 1))) - 1)))
    return F.array(*words), counted.cast("bigint")


FIELDS = ("weight", "cols", "ties", "flip", "commit_cls", "commit_cols", "committed_weight", "converged", "iterations", "legs", "low")


def decode_windows(words: DataFrame, plan: LoadedPlan, inner: Inner, on_low: str = "none", every: int = 8) -> DataFrame:
    """words(shot, words) -> (shot, words left, frame, records): every window decoded in order.

    on_failure of the plan's specification: commit_anyway, flag, or defer (retry on wider
    placements). on_low: none, flag, or defer for solutions the inner decoder marks low.
    """
    spec = plan.spec
    if on_low not in ("none", "flag", "defer"):
        raise ValueError(f"unknown low-confidence action {on_low!r}")
    state = words.withColumn("frame", F.lit(0).cast("bigint")).withColumn("over", F.lit(False)).withColumn(
        "records", F.array().cast(f"array<{RECORD}>"))
    for window in range(plan.positions):
        attempts = sorted(a for w, a in plan.places if w == window)
        state = state.withColumn("_open", ~F.col("over")).withColumn("_iter", F.lit(0).cast("bigint")).withColumn("_legs", F.lit(0).cast("bigint"))
        first = plan.places[window, 0]
        state = state.withColumn("_first", _key(first, plan).bitwiseAND(F.lit((1 << plan.per_round) - 1)))
        for attempt in attempts:
            place = plan.places[window, attempt]
            state = state.withColumn("_key", F.when(F.col("_open"), _key(place, plan)))
            keys = None
            if inner.needs_keys:
                state = cut_lineage(state)
                keys = cut_lineage(state.where("_open").select(F.col("_key").alias("key")).distinct())
            answer = inner(place, keys)
            if "low" not in answer.columns:
                answer = answer.withColumn("low", F.lit(False))
            if inner.needs_keys:
                answer = cut_lineage(answer)
            answer = answer.select(F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}" if c != "legs" else "_legs1") for c in FIELDS])
            joined = state.join(bounded_broadcast(answer, place.problem.bound), "_key", "left")
            ok = F.coalesce("_converged", F.lit(False))
            low = F.coalesce("_low", F.lit(False))
            more = attempt != attempts[-1]
            retry = F.lit(False)
            if more and spec.on_failure == "defer":
                retry = retry | ~ok
            if more and on_low == "defer":
                retry = retry | (ok & low)
            done = F.col("_open") & ~retry
            flagged = (~ok & F.lit(spec.on_failure != "commit_anyway" or on_low != "none")) | (ok & low & F.lit(on_low != "none"))
            zero = F.lit(0).cast("bigint")
            joined = joined.withColumn("_flip", F.coalesce("_flip", zero)).withColumn(
                "_iter", F.when(F.col("_open"), F.col("_iter") + F.coalesce("_iterations", zero)).otherwise(F.col("_iter"))).withColumn(
                "_legs", F.when(F.col("_open"), F.col("_legs") + F.coalesce("_legs1", F.lit(1))).otherwise(F.col("_legs"))).withColumn("_done", done)
            left, unexplained = _apply(joined, place, plan)
            empty = F.array().cast("array<int>")
            joined = joined.withColumn("_cols", F.coalesce("_cols", empty)).withColumn("_commit_cols", F.coalesce("_commit_cols", empty))
            frame = F.col("frame").bitwiseXOR(F.coalesce("_commit_cls", zero))
            committed = _named("_commit_cols", place)
            record = F.struct(
                F.lit(window).cast("bigint").alias("window"), F.lit(attempt + 1).alias("attempts"), ok.alias("converged"), F.col("_iter").alias("iterations"),
                F.col("_legs").alias("legs"), F.coalesce("_ties", zero).alias("ties"), F.when(ok, F.col("_weight")).otherwise(F.lit(float("inf"))).alias("weight"),
                F.coalesce("_committed_weight", F.lit(0.0)).alias("committed_weight"), unexplained.alias("unexplained"),
                (F.size("_commit_cols") - F.size(committed)).cast("bigint").alias("virtual"), flagged.alias("flagged"), low.alias("low"),
                F.col("_first").alias("residual_first"), F.col("_key").alias("key"), _named("_cols", place).alias("solution"), committed.alias("committed"), frame.alias("frame")).cast(RECORD)
            state = joined.select(
                "shot", F.when(done, left).otherwise(F.col("words")).alias("words"), F.when(done, frame).otherwise(F.col("frame")).alias("frame"),
                (F.col("over") | (done & F.lit(place.final))).alias("over"),
                F.when(done, F.array_append("records", record)).otherwise(F.col("records")).alias("records"),
                (F.col("_open") & ~done).alias("_open"), "_iter", "_legs", "_first")
        state = state.drop("_open", "_iter", "_legs", "_first")
        if (window + 1) % every == 0 and window + 1 < plan.positions:
            state = cut_lineage(state)
    return state.drop("over")


def window_records(decoded: DataFrame) -> DataFrame:
    return decoded.select("shot", F.explode("records").alias("r")).select("shot", "r.*")


def window_commits(decoded: DataFrame) -> DataFrame:
    return window_records(decoded).select("shot", "window", F.explode("committed").alias("fault"))


def residual_rows(decoded: DataFrame, per_round: int) -> DataFrame:
    """(shot, det) still fired after every commit."""
    spread = decoded.select("shot", F.posexplode("words").alias("_r", "_w")).where("_w <> 0").withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit(per_round - 1))))
    return spread.where(F.getbit("_w", F.col("_b")) == 1).select("shot", (F.col("_r") * per_round + F.col("_b")).cast("bigint").alias("det"))
