"""Recorded solutions of a decode: slots, distinct solutions, confidence, stop rules and replay.

A decode keeps at most ``capacity`` slots, so every window below works on a bounded group. The cut
to the first slots is a rank filter, which Spark also applies before the shuffle; legs beyond the
capacity are only counted, and a count combines on the map side. A decode that holds a third of
all legs therefore never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the largest number of recorded solutions per decode.
MAX_CAPACITY = 64

RULES = ("lowest_weight", "class_sum", "largest_agreement")
STOPS = ("fixed", "agree", "agree_distinct", "gap", "gap_extend")
SIGNALS = ("gap", "agreement", "weight", "first_legs", "first_iterations", "q_supp")


def slots(solutions: DataFrame, order: Sequence[str], capacity: int | None) -> DataFrame:
    """solutions(decode, order..., iterations, weight, cls, hash) -> the first ``capacity`` per decode, None for all.

    Adds slot (from 0), found (converged legs, also beyond the capacity), cumulative iterations up
    to the slot, is_new (first slot with its hash) and klass (class of that first slot).
    """
    if capacity is not None and not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be in [1, {MAX_CAPACITY}], got {capacity}")
    ranked = solutions.withColumn("_rn", F.row_number().over(Window.partitionBy("decode").orderBy(*order)))
    first = (ranked if capacity is None else ranked.where(F.col("_rn") <= capacity)).withColumn("slot", F.col("_rn") - 1).drop("_rn")
    counts = solutions.groupBy("decode").agg(F.count("*").alias("found"))
    running = Window.partitionBy("decode").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    kept = first.join(counts, "decode").withColumn("cumulative", F.sum("iterations").over(running))
    return mark_new(kept)


def mark_new(kept: DataFrame) -> DataFrame:
    same = Window.partitionBy("decode", "hash").orderBy("slot")
    return kept.withColumn("is_new", F.row_number().over(same) == 1).withColumn("klass", F.first("cls").over(same))


def cumulative_iterations(legs: DataFrame) -> DataFrame:
    """Running iterations over the legs of each decode (at most the schedule's legs per decode)."""
    w = Window.partitionBy("decode").orderBy("leg").rowsBetween(Window.unboundedPreceding, 0)
    return legs.withColumn("cumulative", F.sum("iterations").over(w))


def _when_new(c: Column) -> Column:
    return F.when(F.col("is_new"), c)


def lowest_weight(kept: DataFrame) -> DataFrame:
    """(decode, best_slot, weight, best_class): the lightest distinct solution, earliest on ties."""
    best = F.min(_when_new(F.struct("weight", "slot", "cls")))
    return kept.groupBy("decode").agg(best.alias("b")).select(
        "decode", F.col("b.slot").alias("best_slot"), F.col("b.weight").alias("weight"), F.col("b.cls").alias("best_class"))


def class_table(kept: DataFrame) -> DataFrame:
    """(decode, cls, count, legs, w_min, w_slot, first_slot, z, found, first): one row per class of a decode.

    z = sum of exp(-(weight - lowest weight)) over the distinct solutions of the class.
    """
    lightest = F.min(_when_new(F.col("weight"))).over(Window.partitionBy("decode"))
    scaled = kept.withColumn("_w0", lightest)
    light = F.min(_when_new(F.struct("weight", "slot")))
    table = scaled.groupBy("decode", F.col("klass").alias("cls")).agg(
        F.count_if("is_new").alias("count"), F.count("*").alias("legs"), light.alias("_l"),
        F.min(_when_new(F.col("slot"))).alias("first_slot"),
        F.sum(_when_new(F.exp(-(F.col("weight") - F.col("_w0"))))).alias("z"),
        F.max("found").alias("found"), F.min(F.struct("slot", _leg(kept).alias("leg"), "cumulative")).alias("first"))
    return table.select("decode", "cls", "count", "legs", F.col("_l.weight").alias("w_min"),
                        F.col("_l.slot").alias("w_slot"), "first_slot", "z", "found", "first")


def confidence(kept: DataFrame, decodes: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """One row per decode with every selection value.

    ``terms`` (decode, components, sum_sq, q_supp) of the returned corrections, from
    ``gf2.cluster_terms``, adds those columns. ``decodes`` (decode, returned) adds the decodes without any solution, whose decisions are the
    returned class. NULL stands for "no value", never for certainty.
    """
    per_class = class_table(kept)
    entry = F.struct("w_min", "w_slot", "cls", "count", "first_slot", "z")
    classes = per_class.groupBy("decode").agg(
        F.array_sort(F.collect_list(entry)).alias("c"),
        F.max_by("cls", F.struct(F.col("z"), -F.col("first_slot"))).alias("class_sum_class"), F.max("z").alias("class_sum_top"),
        F.max_by("cls", F.struct(F.col("count"), -F.col("w_min"), -F.col("first_slot"))).alias("agreement_class"),
        F.max_by("w_slot", F.struct(F.col("z"), -F.col("first_slot"))).alias("class_sum_slot"),
        F.max_by("w_slot", F.struct(F.col("count"), -F.col("w_min"), -F.col("first_slot"))).alias("agreement_slot"),
        F.sum("count").alias("distinct"), F.count("*").alias("classes"), F.max("found").alias("found"), F.sum("legs").alias("seen"),
        F.min("first").alias("_f"))
    best, second = F.col("c")[0], F.get("c", F.lit(1))
    out = classes.select(
        "decode", "found", "seen", "distinct", "classes", best["cls"].alias("best_class"), best["w_min"].alias("weight"),
        best["w_slot"].alias("best_slot"),
        F.when(F.col("classes") > 1, "defined").otherwise("single_class").alias("gap_state"),
        (second["w_min"] - best["w_min"]).alias("gap"), second["cls"].alias("second_class"),
        (best["count"] / F.col("distinct")).alias("agreement"), (F.col("_f.leg") + 1).alias("first_legs"), F.col("_f.cumulative").alias("first_iterations"),
        "class_sum_class", "class_sum_top", "class_sum_slot", "agreement_class", "agreement_slot")
    if terms is not None:
        out = out.join(terms.select("decode", "components", "sum_sq", "q_supp"), "decode", "left")
    if decodes is None:
        return out
    full = decodes.select("decode", "returned").join(out, "decode", "left")
    zero = [c for c in ("found", "seen", "distinct", "classes", "first_legs", "first_iterations")]
    decisions = [c for c in ("best_class", "class_sum_class", "agreement_class")]
    full = full.withColumn("weight", F.coalesce("weight", F.lit(float("inf")))).withColumn(
        "gap_state", F.coalesce("gap_state", F.lit("none")))
    for c in zero:
        full = full.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in decisions:
        full = full.withColumn(c, F.coalesce(c, "returned"))
    return full.drop("returned")


def _leg(kept: DataFrame) -> Column:
    return F.col("leg") if "leg" in kept.columns else F.col("slot")


def class_gap(conf: DataFrame) -> DataFrame:
    return conf.select("decode", "gap_state", "gap", "second_class")


def select_solution(conf: DataFrame, rule: str) -> DataFrame:
    """(decode, decided_class, decided_slot) under one of RULES."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    columns = {"lowest_weight": ("best_class", "best_slot"), "class_sum": ("class_sum_class", "class_sum_slot"),
               "largest_agreement": ("agreement_class", "agreement_slot")}[rule]
    return conf.select("decode", F.col(columns[0]).alias("decided_class"), F.col(columns[1]).alias("decided_slot"))


def signal(conf: DataFrame, name: str, threshold: float, single_class_is_low: bool = False) -> DataFrame:
    """(decode, score, low): the signal as an inverse confidence, larger meaning less trustworthy.

    Without a solution the score is infinite and the decode is low. A single class has no gap: its
    score is NULL and the caller's choice decides whether it is low.
    """
    none, single = F.col("gap_state") == "none", F.col("gap_state") == "single_class"
    t = F.lit(float(threshold))
    if name == "gap":
        score, low = -F.col("gap"), F.when(single, F.lit(single_class_is_low)).otherwise(F.col("gap") < t)
    elif name == "agreement":
        score, low = 1.0 - F.col("agreement"), F.col("agreement") < t
    elif name in SIGNALS:
        if name not in conf.columns:
            raise ValueError(f"the signal {name!r} needs its column; confidence adds it from cluster terms")
        score, low = F.col(name).cast("double"), F.coalesce(F.col(name) > t, F.lit(False))
    else:
        raise ValueError(f"unknown signal {name!r}")
    return conf.select("decode", F.when(none, F.lit(float("inf"))).otherwise(score).alias("score"),
                       F.when(none, F.lit(True)).otherwise(low).alias("low"))


def prefix_state(kept: DataFrame) -> DataFrame:
    """State after each slot: lowest weight and its class, counts of that class, and the gap so far."""
    w = Window.partitionBy("decode").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct("weight", "slot", F.col("klass").alias("k"), "is_new")).over(w)
    first = kept.withColumn("_s", seen).withColumn(
        "_all", F.min(F.struct("weight", "slot", "cls")).over(w))
    new = first.withColumn("_n", F.filter("_s", lambda e: e["is_new"]))
    best = new.withColumn("_b", F.array_min(F.transform("_n", lambda e: F.struct(e["weight"], e["slot"], e["k"]))))
    k = F.col("_b.k")
    others = F.filter("_n", lambda e: e["k"] != k)
    out = best.withColumn("_w2", F.array_min(F.transform(others, lambda e: e["weight"])))
    return out.select(
        "decode", "slot", "cumulative", _leg(kept).alias("leg"), "found",
        F.col("_b.weight").alias("best_weight"), k.alias("best_class"), F.col("_all.cls").alias("prefix_class"),
        F.size(F.filter("_s", lambda e: e["k"] == k)).alias("legs_in_best"),
        F.size(F.filter("_n", lambda e: e["k"] == k)).alias("distinct_in_best"),
        F.size("_n").alias("distinct"), (F.col("_w2") - F.col("_b.weight")).alias("gap"),
        F.when(F.col("_w2").isNull(), "single_class").otherwise("defined").alias("gap_state"))


def stop_condition(rule: str, count: int = 0, gap: float = 0.0) -> Column:
    if rule == "fixed":
        return F.lit(False)
    if rule == "agree":
        return F.col("legs_in_best") >= count
    if rule == "agree_distinct":
        return F.col("distinct_in_best") >= count
    wide = (F.col("gap_state") == "defined") & (F.col("gap") >= F.lit(float(gap)))
    if rule == "gap":
        return wide
    if rule == "gap_extend":
        return (F.col("slot") + 1 >= count) & ((F.col("gap_state") == "single_class") | wide)
    raise ValueError(f"unknown stop rule {rule!r}")


def first_stop(prefix: DataFrame, rule: str, count: int = 0, gap: float = 0.0) -> DataFrame:
    """(decode, stop_slot): the first slot at which the rule fires; decodes where it never does are absent."""
    return prefix.where(stop_condition(rule, count, gap)).groupBy("decode").agg(F.min("slot").alias("stop_slot"))


def check_replay(kept_capacity: int, s: int, recorded_stop: int | None = None) -> None:
    """A replay cannot look past what was recorded."""
    if s < 1 or s > kept_capacity:
        raise ValueError(f"replay of {s} solutions needs a recording of at least as many slots, got {kept_capacity}")
    if recorded_stop is not None and s > recorded_stop:
        raise ValueError(f"replay of {s} solutions, but the recording stopped after {recorded_stop}")


def replay_refusals(kept: DataFrame, sizes: DataFrame, capacity: int) -> DataFrame:
    """(most, s, refused) for sizes(s): whether a recording supports a replay of s solutions.

    most is the largest number of solutions that the recording holds of any decode.
    """
    recorded = kept.agg(F.max("found").alias("most"))
    refused = (F.col("s") < 1) | (F.col("s") > capacity) | F.coalesce(F.col("s") > F.col("most"), F.lit(True))
    return sizes.join(recorded, how="left").select("most", "s", refused.alias("refused"))


def replay(kept: DataFrame, decodes: DataFrame, s: int, rule: str, count: int = 0, gap: float = 0.0,
           recorded_capacity: int = MAX_CAPACITY, recorded_stop: int | None = None) -> DataFrame:
    """The run that would have kept s solutions and stopped by the rule.

    decodes(decode, returned, iterations, legs) are the recorded totals; recorded_stop is the number of
    solutions after which the recording itself stopped, beyond which nothing can be replayed. Output per decode:
    solutions, decision, iterations, legs, by_rule.
    """
    check_replay(recorded_capacity, s, recorded_stop)
    prefix = prefix_state(kept.where(F.col("slot") < s))
    per = prefix.groupBy("decode").agg(
        F.min(F.when(stop_condition(rule, count, gap), F.struct("slot", "prefix_class", "cumulative", "leg"))).alias("hit"),
        F.max(F.struct("slot", F.col("best_class").alias("cls"), "cumulative", "leg", "found")).alias("last"))
    joined = decodes.join(per, "decode", "left")
    fired, full = F.col("hit").isNotNull(), F.coalesce(F.col("last.found") >= s, F.lit(False))

    def pick(a: Column, b: Column, c: Column) -> Column:
        return F.when(fired, a).when(full, b).otherwise(c)

    return joined.select(
        "decode",
        pick(F.col("hit.slot") + 1, F.lit(s), F.coalesce(F.col("last.found"), F.lit(0))).alias("solutions"),
        pick(F.col("hit.prefix_class"), F.col("last.cls"), F.coalesce(F.col("last.cls"), F.col("returned"))).alias("decision"),
        pick(F.col("hit.cumulative"), F.col("last.cumulative"), F.col("iterations")).alias("iterations"),
        pick(F.col("hit.leg") + 1, F.col("last.leg") + 1, F.col("legs")).alias("legs"), fired.alias("by_rule"))


def failure_causes(kept: DataFrame, decodes: DataFrame) -> DataFrame:
    """(cause, n) over decodes(decode, truth, returned): correct, no_solution, not_returned, never_found."""
    best = lowest_weight(kept).select("decode", "best_class")
    truth = decodes.select("decode", "truth")
    seen = kept.join(truth, "decode").groupBy("decode").agg(F.bool_or(F.col("klass") == F.col("truth")).alias("seen"))
    t = decodes.join(best, "decode", "left").join(seen, "decode", "left")
    cause = (F.when(F.coalesce("best_class", "returned") == F.col("truth"), "correct")
             .when(F.col("best_class").isNull(), "no_solution").when(F.col("seen"), "not_returned").otherwise("never_found"))
    return t.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def rate_by_capacity(kept: DataFrame, decodes: DataFrame, capacity: int) -> DataFrame:
    """(s, shots, failures): failures of the lowest-weight decision with s = 1 .. capacity kept solutions.

    A decode's last slot stands for every larger s, so each prefix row is expanded at most
    ``capacity`` times and no decode is replayed twice.
    """
    prefix = prefix_state(kept.where(F.col("slot") < capacity))
    last = F.col("slot") + 1 >= F.least("found", F.lit(capacity))
    upto = F.when(last, F.lit(capacity)).otherwise(F.col("slot") + 1)
    decided = prefix.select("decode", F.col("best_class").alias("decision"), F.explode(F.sequence(F.col("slot") + 1, upto)).alias("s"))
    solved = decided.join(decodes.select("decode", "truth"), "decode").groupBy("s").agg(
        F.count("*").alias("_n"), F.count_if(F.col("decision") != F.col("truth")).alias("_f"))
    unsolved = decodes.join(kept.select("decode").distinct(), "decode", "left_anti")
    idle = unsolved.agg(F.count("*").alias("n"), F.count_if(F.col("returned") != F.col("truth")).alias("f")).select(
        F.explode(F.sequence(F.lit(1), F.lit(capacity))).alias("s"), "n", "f")
    return idle.join(solved, "s", "left").select(
        "s", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("shots"), (F.col("f") + F.coalesce("_f", F.lit(0))).alias("failures"))


def solution_summary(kept: DataFrame, capacity: int) -> DataFrame:
    """(decode, found) reduced to decodes, total found and decodes with unrecorded solutions."""
    per = kept.groupBy("decode").agg(F.max("found").alias("found"))
    return per.agg(F.count("*").alias("decodes"), F.sum("found").alias("found"), F.max("found").alias("most"),
                   F.count_if(F.col("found") > capacity).alias("beyond_capacity"))


def confidence_summary(conf: DataFrame, low: DataFrame, rule: str) -> DataFrame:
    """Counts of gap states, low decodes and decisions that differ from the lowest weight."""
    decided = select_solution(conf, rule)
    t = conf.join(low.select("decode", "low"), "decode").join(decided, "decode")
    state = F.col("gap_state")
    return t.agg(F.count("*").alias("decodes"), F.count_if(state == "none").alias("none"),
                 F.count_if(state == "single_class").alias("single_class"), F.count_if(state == "defined").alias("defined"),
                 F.count_if("low").alias("low"), F.count_if(F.col("decided_class") != F.col("best_class")).alias("changed"))


# ---- history over windows ------------------------------------------------------------------------


def signal_history(windows: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Signals over the last L windows of each shot, for every L in lengths.

    windows(shot, window, decoded, gap_state, gap, agreement, weight, first_legs, first_iterations,
    q_sum_sq, q_total, ones, rows) has one row per position. A decoded window without a solution
    makes the span undefined: weight is then infinite and every other signal NULL.
    """
    decoded, none = F.col("decoded"), F.col("gap_state") == "none"
    real = decoded & ~none
    spans = []
    for length in lengths:
        w = Window.partitionBy("shot").orderBy("window").rowsBetween(-(length - 1), 0)

        def total(c: str, w=w) -> Column:
            return F.sum(F.when(real, F.col(c))).over(w)

        def ever(c: Column, w=w) -> Column:
            return F.coalesce(F.bool_or(c).over(w), F.lit(False))

        spans.append(F.struct(
            F.lit(length).alias("length"), (ever(decoded) & ~ever(decoded & none)).alias("_u"),
            F.min(F.when(real & (F.col("gap_state") == "defined"), F.col("gap"))).over(w).alias("_gap"),
            F.product(F.when(real, F.col("agreement"))).over(w).alias("_agreement"), total("weight").alias("_weight"),
            total("first_legs").alias("_legs"), total("first_iterations").alias("_iterations"),
            total("q_sum_sq").alias("_sq"), total("q_total").alias("_total"),
            ever(real & (F.col("q_sum_sq").isNull() | F.col("q_total").isNull())).alias("_unknown"),
            total("ones").alias("_ones"), total("rows").alias("_rows")))
    # Every length shares one partitioning and one sort; the lengths become rows afterwards.
    measured = windows.select("shot", "window", F.array(*spans).alias("_spans"))
    out = measured.select("shot", "window", F.explode("_spans").alias("_s")).select("shot", "window", "_s.*")
    u = F.col("_u")
    return out.select(
        "shot", "window", "length",
        F.when(~u, "none").when(F.col("_gap").isNotNull(), "defined").otherwise("single_class").alias("state"),
        F.when(u, F.col("_gap")).alias("gap"), F.when(u, F.col("_agreement")).alias("agreement"),
        F.when(u, F.col("_weight").cast("double")).otherwise(F.lit(float("inf"))).alias("weight"),
        F.when(u, F.col("_legs")).alias("first_legs"), F.when(u, F.col("_iterations")).alias("first_iterations"),
        F.when(u & ~F.col("_unknown") & (F.col("_total") > 0), F.sqrt("_sq") / F.col("_total")).alias("q_supp"),
        F.when(u & (F.col("_rows") > 0), F.col("_ones") / F.col("_rows")).alias("density"))


def commit_history(positions: DataFrame, commits: DataFrame, faults: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """(shot, window, weight, q_supp) of the union of faults committed in the last ``length`` windows.

    Each commit is expanded to the windows that still see it (at most ``length``), then the
    component operators run with (shot, window) as their key.
    """
    from paritas.operators.gf2 import cluster_terms, support_components

    seen = commits.withColumn("window", F.explode(F.sequence(F.col("window"), F.col("window") + (length - 1))))
    keyed = seen.join(positions.select("shot", "window"), ["shot", "window"], "left_semi").select(
        F.struct("shot", "window").alias("shot"), "fault")
    terms = cluster_terms(support_components(keyed, edges), faults)
    lam = F.when(F.abs("lam") < float("inf"), F.col("lam")).otherwise(F.lit(0.0))
    weights = keyed.join(faults.select("fault", "lam"), "fault").groupBy("shot").agg(F.sum(lam).alias("weight"))
    both = terms.join(weights, "shot").select(F.col("shot.shot").alias("shot"), F.col("shot.window").alias("window"), "weight", "q_supp")
    return positions.select("shot", "window").join(both, ["shot", "window"], "left").select(
        "shot", "window", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("q_supp", F.lit(0.0)).alias("q_supp"))


def mark_skipped(windows: DataFrame) -> DataFrame:
    """Flags the positions after a committed final window."""
    before = Window.partitionBy("shot").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("skipped", F.coalesce(F.bool_or("final").over(before), F.lit(False)))
