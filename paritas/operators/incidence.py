"""Incidence tables: building, folding, restricting, merging and checking them.

edges(det, fault) and obs_edges(obs, fault) hold the ones of the two matrices, faults(fault, p, lam)
the priors, detectors(det, check, round, kind) the metadata.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.bits import pack_class
from paritas.operators.gf2 import odd
from paritas.operators.ranks import dense_numbers, running_totals


@dataclass(frozen=True)
class Incidence:
    edges: DataFrame
    obs_edges: DataFrame
    faults: DataFrame
    detectors: DataFrame

    def column_class(self) -> DataFrame:
        return pack_class(self.obs_edges)


def log_ratio(p: Column) -> Column:
    """ln((1 - p) / p); p = 0 gives +infinity."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(F.ln((1.0 - p) / p))


def with_lambda(faults: DataFrame) -> DataFrame:
    return faults.withColumn("lam", log_ratio(F.col("p")))


def decided(p: Column, threshold: float) -> tuple[Column, Column]:
    """(practically impossible, practically certain)."""
    if not 0.0 <= threshold < 0.5:
        raise ValueError(f"threshold must be in [0, 0.5), got {threshold}")
    return p <= threshold, p >= 1.0 - threshold


def prune_decided(inc: Incidence, threshold: float = 0.0) -> tuple[Incidence, DataFrame]:
    """Drops decided faults and renumbers the rest in order; also returns (fault, parent)."""
    never, always = decided(F.col("p"), threshold)
    kept = dense_numbers(inc.faults.where(~(never | always)).withColumnRenamed("fault", "parent"), ["parent"], "fault")
    mapping = kept.select("parent", "fault")

    def renumber(edges: DataFrame) -> DataFrame:
        return edges.withColumnRenamed("fault", "parent").join(mapping, "parent").drop("parent")

    pruned = replace(inc, edges=renumber(inc.edges), obs_edges=renumber(inc.obs_edges), faults=kept.drop("parent"))
    return pruned, mapping


def fold_bias(inc: Incidence, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Certain faults folded into (det) and (obs) tables of positions that start flipped."""
    _, always = decided(F.col("p"), threshold)
    certain = inc.faults.where(always).select("fault")
    return (odd(inc.edges.join(certain, "fault").select("det"), ["det"]),
            odd(inc.obs_edges.join(certain, "fault").select("obs"), ["obs"]))


def with_round(detectors: DataFrame, round_of: Column) -> tuple[DataFrame, DataFrame]:
    """Detectors with the integer round given by a column expression, and those where it is not one."""
    valued = detectors.withColumn("_r", round_of.cast("double"))
    whole = F.col("_r").isNotNull() & (F.col("_r") == F.floor("_r"))
    good = valued.where(whole).withColumn("round", F.col("_r").cast("int")).drop("_r")
    return good, valued.where(~F.coalesce(whole, F.lit(False))).drop("_r")


def csr_pointers(edges: DataFrame, dets: DataFrame) -> DataFrame:
    """(det, begin, end): where each row's entries lie in the row-major order of the edges."""
    degrees = dets.select("det").join(edges.groupBy("det").agg(F.count("*").alias("_n")), "det", "left").select(
        "det", F.coalesce("_n", F.lit(0)).cast("bigint").alias("_n"))
    placed = running_totals(degrees, ["det"], {"end": "_n"})
    return placed.select("det", (F.col("end") - F.col("_n")).alias("begin"), "end")


def edges_to_csr(edges: DataFrame, dets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pointers, indices): indices(position, fault) in row-major, ascending-column order.

    Entries stay rows, so a detector touching a third of all faults is not gathered in one array.
    """
    return csr_pointers(edges, dets), dense_numbers(edges, ["det", "fault"], "position").select("position", "fault")


def csr_to_edges(pointers: DataFrame, indices: DataFrame) -> DataFrame:
    """The edges behind (pointers, indices): each row's position range is unrolled, then an equi-join.

    The unrolled ranges are as many rows as the edges; the optimizer's size estimate is that of the pointers, so the join is named.
    """
    filled = pointers.where(F.col("end") > F.col("begin"))
    spread = filled.select("det", F.explode(F.sequence("begin", F.col("end") - 1)).alias("position"))
    return spread.hint("merge").join(indices, "position").select("det", "fault")


def transpose(edges: DataFrame) -> DataFrame:
    """Column form: (fault, position, det) with positions in ascending (fault, det) order."""
    return dense_numbers(edges, ["fault", "det"], "position").select("fault", "position", "det")


def column_rounds(inc: Incidence) -> DataFrame:
    """(fault, first_round, last_round)."""
    rounds = inc.detectors.select("det", "round")
    return inc.edges.join(rounds, "det").groupBy("fault").agg(
        F.min("round").alias("first_round"), F.max("round").alias("last_round"))


def degree_stats(edges: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(min, max, mean, zero, n) of the number of edges per id."""
    degrees = ids.select(key).join(edges.groupBy(key).agg(F.count("*").alias("_d")), key, "left").select(
        F.coalesce("_d", F.lit(0)).alias("d"))
    return degrees.agg(F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"),
                       F.count_if(F.col("d") == 0).alias("zero"), F.count("*").alias("n"))


def merged_prior(p: Column) -> Column:
    """Aggregate: the probability that an odd number of independent events occur.

    P = (1 - prod(1 - 2 p)) / 2, the closed form of folding p(1-q) + q(1-p); it combines on the
    map side and needs no order.
    """
    return (1.0 - F.product(1.0 - 2.0 * p)) / 2.0


def column_supports(edges: DataFrame) -> DataFrame:
    """(fault, support): the ascending detectors of each fault."""
    return edges.groupBy("fault").agg(F.sort_array(F.collect_list("det")).alias("support"))


def merge_identical(inc: Incidence) -> tuple[DataFrame, DataFrame]:
    """Groups faults with the same support.

    Returns merged(fault, support, p, members, cls, conflict), named by the smallest member, and
    membership(fault, member). ``conflict`` marks members that flip different observables.
    """
    supports = column_supports(inc.edges)
    classes = inc.column_class()
    rows = supports.join(inc.faults.select("fault", "p"), "fault").join(classes, "fault", "left").withColumn(
        "cls", F.coalesce("cls", F.lit(0)))
    merged = rows.groupBy("support").agg(
        F.min("fault").alias("fault"), merged_prior(F.col("p")).alias("p"), F.count("*").alias("members"),
        F.min("cls").alias("cls"), (F.min("cls") != F.max("cls")).alias("conflict"))
    membership = rows.select("support", F.col("fault").alias("member")).join(
        merged.select("support", "fault"), "support").select("fault", "member")
    return merged, membership


def infer_observable_kind(inc: Incidence) -> DataFrame:
    """(obs, kind, fits): the detector kind that every fault flipping the observable touches.

    kind is NULL when no kind or more than one fits.
    """
    kinds = inc.edges.join(inc.detectors.select("det", "kind"), "det").select("fault", "kind").distinct()
    flipping = inc.obs_edges.groupBy("obs").agg(F.count_distinct("fault").alias("_all"))
    seen = inc.obs_edges.join(kinds, "fault").groupBy("obs", "kind").agg(F.count_distinct("fault").alias("_seen"))
    fits = seen.join(flipping, "obs").where(F.col("_seen") == F.col("_all"))
    counted = fits.groupBy("obs").agg(F.count("*").alias("fits"), F.min("kind").alias("_kind"))
    return flipping.join(counted, "obs", "left").select(
        "obs", F.when(F.col("fits") == 1, F.col("_kind")).alias("kind"), F.coalesce("fits", F.lit(0)).alias("fits"))


def split_rows(inc: Incidence, kind: int, obs_kind: DataFrame) -> tuple[Incidence, DataFrame]:
    """One detector kind of the problem, and the faults that block the split.

    Faults without a detector of that kind are dropped; a dropped fault that still flips a paired
    observable is returned as a violation.
    """
    dets = inc.detectors.where(F.col("kind") == kind)
    edges = inc.edges.join(dets.select("det"), "det", "left_semi")
    obs = inc.obs_edges.join(obs_kind.where(F.col("kind") == kind).select("obs"), "obs", "left_semi")
    kept = edges.select("fault").distinct()
    hidden = obs.join(kept, "fault", "left_anti").select("fault").distinct()
    half = Incidence(edges=edges, obs_edges=obs.join(kept, "fault", "left_semi"),
                     faults=inc.faults.join(kept, "fault", "left_semi"), detectors=dets)
    return half, hidden


def split_shots(fired: DataFrame, truth: DataFrame, rows: DataFrame, observables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shots of one half: rows(det, half_det) and observables(obs, half_obs) renumber what is kept."""
    return (fired.join(rows, "det").select("shot", F.col("half_det").alias("det")),
            truth.join(observables, "obs").select("shot", F.col("half_obs").alias("obs")))


def force_class(inc: Incidence, fired: DataFrame, truth: DataFrame, num_dets: int) -> tuple[DataFrame, DataFrame]:
    """Observables stacked under the checks: edges and syndromes of the forced-class problem."""
    below = (F.col("obs") + num_dets).cast("bigint").alias("det")
    edges = inc.edges.select("det", "fault").unionByName(inc.obs_edges.select(below, "fault"))
    return edges, fired.select("shot", "det").unionByName(truth.select("shot", below))


def column_syndromes(edges: DataFrame, faults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One shot per chosen fault, in order from 1, after the all-zero shot 0.

    Returns shots(shot, fault) (fault NULL for shot 0) and fired(shot, det).
    """
    numbered = dense_numbers(faults.select("fault").distinct(), ["fault"], "shot").withColumn("shot", F.col("shot") + 1)
    zero = numbered.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("shot"), F.lit(None).cast("bigint").alias("fault"))
    return numbered.select("shot", "fault").unionByName(zero), numbered.join(edges, "fault").select("shot", "det")


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., side, columns): keys on one side only and cells that differ, NULLs being equal."""
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in values], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in values], F.lit(True).alias("_in_b"))
    both = left.join(right, keys, "full_outer")
    unequal = F.concat_ws(",", *[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in values])
    side = F.when(F.col("_in_b").isNull(), "left").when(F.col("_in_a").isNull(), "right").otherwise("both")
    return both.select(*keys, side.alias("side"), F.when(side == "both", unequal).alias("columns")).where(
        (F.col("side") != "both") | (F.col("columns") != ""))


def lift_edges(edges: DataFrame, det_orbits: DataFrame, fault_orbits: DataFrame, group: tuple[int, int]) -> DataFrame:
    """(det_orbit, fault_orbit, ds, dt, edges): base edges of a cyclic-shift invariant graph.

    det_orbits(det, orbit, s, t) and fault_orbits(fault, orbit, s, t) give each node its orbit and
    shift. The lift is valid when every base edge stands for |group| edges.
    """
    na, nb = group
    d = det_orbits.select("det", F.col("orbit").alias("det_orbit"), F.col("s").alias("_ds"), F.col("t").alias("_dt"))
    f = fault_orbits.select("fault", F.col("orbit").alias("fault_orbit"), F.col("s").alias("_fs"), F.col("t").alias("_ft"))
    placed = edges.join(d, "det").join(f, "fault")
    return placed.groupBy(
        "det_orbit", "fault_orbit", F.pmod(F.col("_ds") - F.col("_fs"), F.lit(na)).alias("ds"),
        F.pmod(F.col("_dt") - F.col("_ft"), F.lit(nb)).alias("dt")).agg(F.count("*").alias("edges"))


def orbit_of_supports(supports: DataFrame, group: tuple[int, int]) -> DataFrame:
    """(fault, orbit, s, t): the orbit of each fault under cyclic shifts of the check index.

    supports(fault, entries: array of struct(block, a, b)) places a fault's detectors on an
    na x nb torus per block. The orbit's name is the smallest shifted support, and (s, t) the shift
    that takes that support to the fault's own. At most |group| shifted copies per fault exist at a
    time, and they meet in a map-side minimum.
    """
    na, nb = group
    shifts = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s in range(na) for t in range(nb)])
    spread = supports.withColumn("_g", F.explode(shifts))
    moved = F.sort_array(F.transform("entries", lambda e: F.struct(
        e["block"].alias("block"),
        F.pmod(e["a"] - F.col("_g.s"), F.lit(na)).alias("a"),
        F.pmod(e["b"] - F.col("_g.t"), F.lit(nb)).alias("b"))))
    best = spread.groupBy("fault").agg(F.min(F.struct(moved.alias("canon"), F.col("_g.s").alias("s"), F.col("_g.t").alias("t"))).alias("_m"))
    key = F.concat_ws(";", F.transform(F.col("_m.canon"), lambda e: F.concat_ws(",", e["block"], e["a"], e["b"])))
    return best.select("fault", key.alias("orbit"), F.col("_m.s").alias("s"), F.col("_m.t").alias("t"))
