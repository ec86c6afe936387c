"""Validations: each returns a table of violations (code, detail), empty when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.operators.gf2 import gf2_product, predict_class
from paritas.operators.incidence import Incidence, column_rounds


def _tag(df: DataFrame, code: str, detail: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# The codes of the checks below are fixed values that callers match on.


def check_incidence(inc: Incidence) -> DataFrame:
    """Ids out of range, duplicate edges, and ids that are not dense from 0."""
    pair = F.concat_ws(",", "det", "fault")
    faults, dets = inc.faults.select("fault"), inc.detectors.select("det")
    dup = inc.edges.groupBy("det", "fault").agg(F.count("*").alias("_c")).where(F.col("_c") > 1)
    dup_obs = inc.obs_edges.groupBy("obs", "fault").agg(F.count("*").alias("_c")).where(F.col("_c") > 1)

    def gaps(ids: DataFrame, key: str, code: str) -> DataFrame:
        s = ids.agg(F.count_distinct(key).alias("c"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        bad = s.where((F.col("c") > 0) & ((F.col("lo") != 0) | (F.col("hi") != F.col("c") - 1)))
        return _tag(bad, code, F.concat_ws(",", "lo", "hi", "c"))

    return _all([
        _tag(inc.edges.join(faults, "fault", "left_anti"), "fault_out_of_range", pair),
        _tag(inc.edges.join(dets, "det", "left_anti"), "detector_out_of_range", pair),
        _tag(inc.obs_edges.join(faults, "fault", "left_anti"), "fault_out_of_range", F.concat_ws(",", "obs", "fault")),
        _tag(dup, "duplicate_edge", pair),
        _tag(dup_obs, "duplicate_edge", F.concat_ws(",", "obs", "fault")),
        gaps(faults, "fault", "faults_not_dense"),
        gaps(dets, "det", "detectors_not_dense"),
    ])


def check_time_structure(inc: Incidence) -> DataFrame:
    """Rounds from 1 with equal sizes and rows grouped by round; faults span at most two rounds."""
    sizes = inc.detectors.groupBy("round").agg(
        F.count("*").alias("n"), F.min("det").alias("lo"), F.max("det").alias("hi"))
    first = sizes.agg(F.min("round").alias("r"))
    per_round = sizes.agg(F.min_by("n", "round").alias("m")).scalar()
    spans = column_rounds(inc)
    empty = inc.faults.select("fault").join(inc.edges.select("fault").distinct(), "fault", "left_anti")
    before = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)  # one row per round
    ordered = sizes.withColumn("_top", F.max("hi").over(before))
    return _all([
        _tag(first.where(F.col("r") != 1), "bad_round_numbering", F.col("r")),
        _tag(sizes.withColumn("_m", per_round).where(F.col("n") != F.col("_m")), "unequal_round_sizes", F.col("round")),
        _tag(ordered.where(F.col("lo") <= F.col("_top")), "rows_not_grouped_by_round", F.col("round")),
        _tag(empty, "empty_column", F.col("fault")),
        _tag(spans.where(F.col("last_round") > F.col("first_round") + 1), "column_spans_rounds", F.col("fault")),
    ])


def check_values(df: DataFrame, rules: dict[str, str], key: str) -> DataFrame:
    """Rows breaking a rule per column: prior ([0, 1), finite), binary (0/1), or finite."""
    bad = {
        "prior": lambda c: ~((F.col(c) >= 0) & (F.col(c) < 1)) | F.isnan(F.col(c).cast("double")),
        "binary": lambda c: ~F.col(c).isin(0, 1),
        "finite": lambda c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")),
    }
    parts = []
    for column, rule in rules.items():
        broken = F.col(column).isNull() | bad[rule](column)
        parts.append(_tag(df.where(broken), f"{column}_not_{rule}", F.col(key)))
    return _all(parts)


def check_uniform_rows(inc: Incidence) -> DataFrame:
    """Rounds whose ordered (kind, check) list differs from round 1's."""
    by_round = Window.partitionBy("round").orderBy("det")
    placed = inc.detectors.withColumn("_pos", F.row_number().over(by_round))
    model = placed.where(F.col("round") == 1).select("_pos", F.col("kind").alias("_k"), F.col("check").alias("_c"))
    size = model.agg(F.count("*")).scalar()
    compared = placed.join(model, "_pos", "left")
    same = F.col("kind").eqNullSafe(F.col("_k")) & F.col("check").eqNullSafe(F.col("_c"))
    per_round = compared.groupBy("round").agg(F.count("*").alias("n"), F.count_if(~same).alias("bad"))
    return _tag(per_round.withColumn("_m", size).where((F.col("bad") > 0) | (F.col("n") != F.col("_m"))),
                "row_order_differs", F.col("round"))


def check_commit_partition(commits: DataFrame, faults: DataFrame) -> DataFrame:
    """Faults that the windows do not commit exactly once."""
    counted = faults.select("fault").join(commits.groupBy("fault").agg(F.count("*").alias("_c")), "fault", "left")
    times = F.coalesce("_c", F.lit(0))
    return _tag(counted.where(times != 1), "not_committed_once", F.concat_ws(":", F.col("fault"), times))


def check_outcomes(inc: Incidence, fired: DataFrame, windows: DataFrame, commits: DataFrame,
                   residual: DataFrame, frames: DataFrame) -> DataFrame:
    """Invariants of windowed decoding: H c + residual = syndrome, A c = frame, unexplained counts
    add up, no fault committed twice, and a converged shot leaves nothing behind."""
    product = gf2_product(commits.select("shot", "fault"), inc.edges)
    parts = product.select("shot", "det").unionByName(residual.select("shot", "det")).unionByName(fired.select("shot", "det"))
    open_rows = parts.groupBy("shot", "det").agg(F.count("*").alias("_c")).where(F.col("_c") % 2 == 1)
    left = residual.groupBy("shot").agg(F.count("*").alias("_left"))
    sums = windows.groupBy("shot").agg(F.sum("unexplained").alias("_sum"), F.bool_and("converged").alias("_ok"))
    tallied = sums.join(left, "shot", "left").withColumn("_left", F.coalesce("_left", F.lit(0)))
    predicted = predict_class(commits, inc.column_class()).select("shot", F.col("mask").alias("_m"))
    framed = frames.join(predicted, "shot", "left")
    twice = commits.groupBy("shot", "fault").agg(F.count("*").alias("_c")).where(F.col("_c") > 1)
    return _all([
        _tag(open_rows, "syndrome_mismatch", F.concat_ws(":", "shot", "det")),
        _tag(tallied.where(F.col("_sum") != F.col("_left")), "unexplained_mismatch", F.col("shot")),
        _tag(tallied.where(F.col("_ok") & (F.col("_left") > 0)), "converged_with_residual", F.col("shot")),
        _tag(framed.where(F.col("frame") != F.coalesce("_m", F.lit(0))), "frame_mismatch", F.col("shot")),
        _tag(twice, "committed_twice", F.concat_ws(":", "shot", "fault")),
    ])


def check_legs(legs: DataFrame, shots: DataFrame, pre_iter: int, num_sets: int, set_max_iter: int,
               stopping: str, stop_count: int = 1) -> DataFrame:
    """Leg traces against the control flow of a relay decode.

    legs(shot, leg, iterations, converged, became_best), shots(shot, success, iterations).
    Everything is a per-shot aggregate; the rules are predicates on it.
    """
    limit = F.when(F.col("leg") == 0, pre_iter).otherwise(set_max_iter)
    off = (F.col("iterations") > limit) | (~F.col("converged") & (F.col("iterations") != limit))
    per = legs.groupBy("shot").agg(
        F.sum("iterations").alias("sum"), F.count("*").alias("n"), F.count_if("converged").alias("conv"),
        F.count_if(off).alias("off"), F.max_by("converged", "leg").alias("last"), F.min_by("converged", "leg").alias("first"),
        F.count_if("became_best").alias("best"), F.count_if(F.col("became_best") & ~F.col("converged")).alias("bad_best"))
    t = per.join(shots.select("shot", "success", F.col("iterations").alias("reported")), "shot")
    full = num_sets + 1
    rules = [
        ("iterations_do_not_add_up", F.col("sum") != F.col("reported")),
        ("success_disagrees", (F.col("conv") > 0) != F.col("success")),
        ("too_many_legs", F.col("n") > full),
        ("leg_limit", F.col("off") > 0),
        ("best_not_converged", F.col("bad_best") > 0),
    ]
    if stopping == "all_legs":
        rules.append(("stopping", F.col("n") != full))
    elif stopping == "after_leg0":
        rules.append(("stopping", F.col("n") != F.when(F.col("first"), 1).otherwise(full)))
    elif stopping == "after_n_converged":
        late = (F.col("conv") > stop_count) | ((F.col("conv") == stop_count) & ~F.col("last"))
        rules.append(("stopping", late | ((F.col("n") < full) & (F.col("conv") != stop_count))))
    else:
        raise ValueError(f"unknown stopping rule {stopping!r}")
    return _all([_tag(t.where(rule), code, F.col("shot")) for code, rule in rules])
