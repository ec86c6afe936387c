"""Rates, paired comparisons and confidence-signal statistics over outcome tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.intervals import (
    JUDGED_EVENTS, Z95, block_per_cycle, katz_ratio, paired_ratio, per_qubit_per_cycle, wilson)
from paritas.operators.ranks import exact, running_totals
from paritas.session import cut_lineage


def rate_columns(k: Column, n: Column, rounds: int, qubits: int | None = None) -> dict[str, Column]:
    """Wilson interval, per-cycle rate and per-qubit rate of k failures in n shots."""
    rate, lo, hi = wilson(k, n)
    out = {"rate": rate, "lo": lo, "hi": hi, "judged": k >= JUDGED_EVENTS}
    for name, p in (("cycle_rate", rate), ("cycle_lo", lo), ("cycle_hi", hi)):
        out[name] = block_per_cycle(p, rounds)
    if qubits:
        for name, p in (("qubit_rate", rate), ("qubit_lo", lo), ("qubit_hi", hi)):
            out[name] = per_qubit_per_cycle(p, rounds, qubits)
    return out


def rate_table(outcomes: DataFrame, by: Sequence[str], rounds: int, qubits: int | None = None,
               failed: str = "failed") -> DataFrame:
    """(by..., shots, failures, rate, lo, hi, judged, cycle_*, qubit_*)."""
    counted = outcomes.groupBy(*by).agg(F.count("*").alias("shots"), F.count_if(F.col(failed)).alias("failures"))
    return counted.select("*", *[c.alias(a) for a, c in rate_columns(F.col("failures"), F.col("shots"), rounds, qubits).items()])


def pair_counts(pairs: DataFrame, by: Sequence[str] = (), ref: str = "ref_failed", test: str = "test_failed") -> DataFrame:
    r, t = F.col(ref), F.col(test)
    return pairs.groupBy(*by).agg(
        F.count_if(r & t).alias("n11"), F.count_if(r & ~t).alias("n10"),
        F.count_if(~r & t).alias("n01"), F.count_if(~r & ~t).alias("n00"))


def pair_table(pairs: DataFrame, by: Sequence[str] = (), ref: str = "ref_failed", test: str = "test_failed") -> DataFrame:
    """(by..., n11, n10, n01, n00, value, lo, hi, log_se, method)."""
    ratio = paired_ratio(F.col("n11"), F.col("n10"), F.col("n01"))
    return pair_counts(pairs, by, ref, test).select("*", *[c.alias(a) for a, c in ratio.items()])


def katz_table(outcomes: DataFrame, arm: str, reference: str, test: str, failed: str = "failed") -> DataFrame:
    """Unpaired ratio of two arms' failure rates."""
    def count(name: str, only: bool) -> Column:
        hit = F.col(arm) == name
        return F.count_if(hit & F.col(failed)) if only else F.count_if(hit)

    counted = outcomes.agg(count(test, True).alias("k1"), count(test, False).alias("n1"),
                           count(reference, True).alias("k2"), count(reference, False).alias("n2"))
    ratio, lo, hi = katz_ratio(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return counted.select("*", ratio.alias("ratio"), lo.alias("lo"), hi.alias("hi"))


def check_anchors(rates: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rates(keys, lo, hi) against anchors(keys, v_lo, v_hi, factor): do the intervals overlap?"""
    band_lo, band_hi = F.col("v_lo") / F.col("factor"), F.col("v_hi") * F.col("factor")
    return rates.join(anchors, list(keys)).select(
        *keys, "lo", "hi", band_lo.alias("band_lo"), band_hi.alias("band_hi"),
        ((F.col("lo") <= band_hi) & (band_lo <= F.col("hi"))).alias("passed"))


def risk_coverage(scored: DataFrame, fractions: Sequence[str | float], score: str = "score",
                  failed: str = "failed", key: str = "shot") -> DataFrame:
    """(fraction, discarded, kept, kept_failures, rate, lo, hi).

    Discards floor(f * n + 1/2) decodes, the largest scores first and lower keys first among ties.
    The order is global and range-partitioned; one row per fraction is picked from the running sum.
    """
    ranked = running_totals(
        scored.select(key, F.col(score).alias("_s"), F.col(failed).cast("bigint").alias("_f"), F.lit(1).cast("bigint").alias("_one")),
        [F.desc("_s"), F.asc(key)], {"_rank": "_one", "_fails": "_f"})
    totals = ranked.agg(F.sum("_one").alias("n"), F.sum("_f").alias("failures"))
    wanted = totals.select("n", "failures", F.explode(F.array(*[
        F.struct(F.lit(str(f)).alias("fraction"),
                 F.floor(F.lit(exact(f)).cast("decimal(18,9)") * F.col("n") + F.lit(exact("0.5"))).cast("bigint").alias("discarded"))
        for f in fractions])).alias("q")).select("n", "failures", "q.*")
    # One row per fraction: the big side stays where it is and only its matches come back.
    levels = F.broadcast(wanted.select("discarded").distinct())
    hits = ranked.select("_rank", "_fails").join(levels, F.col("_rank") == F.col("discarded")).select("discarded", "_fails")
    picked = wanted.join(hits, "discarded", "left")  # a discard count of 0 matches no row
    kept = picked.select("fraction", "discarded", (F.col("n") - F.col("discarded")).alias("kept"),
                         (F.col("failures") - F.coalesce("_fails", F.lit(0))).alias("kept_failures"))
    rate, lo, hi = wilson(F.col("kept_failures"), F.col("kept"))
    return kept.select("*", rate.alias("rate"), lo.alias("lo"), hi.alias("hi"))


def top_decodes(scored: DataFrame, n: int, least_trustworthy: bool = True, score: str = "score", key: str = "shot") -> DataFrame:
    """The n least (or most) trustworthy decodes; lower keys first among equal scores."""
    order = F.desc(score) if least_trustworthy else F.asc(score)
    return scored.orderBy(order, F.asc(key)).limit(n)


def detector_density(shots: DataFrame, fired: DataFrame, num_dets: int | Column) -> DataFrame:
    """(shot, density): fired detectors over all detectors, 0 for a silent shot."""
    counts = fired.groupBy("shot").agg(F.count("*").alias("_n"))
    m = F.lit(num_dets) if isinstance(num_dets, int) else num_dets
    return shots.select("shot").join(counts, "shot", "left").select(
        "shot", (F.coalesce("_n", F.lit(0)) / m).alias("density"))


def norm_fraction(clusters: DataFrame, totals: DataFrame, alpha: float) -> DataFrame:
    """(shot, q): (sum w^alpha)^(1/alpha) / total; alpha = inf takes the largest cluster; none gives 0."""
    if not alpha > 0:
        raise ValueError(f"alpha must be positive, got {alpha}")
    if math.isinf(alpha):
        norm = clusters.groupBy("shot").agg(F.max("w").alias("_n"))
    else:
        norm = clusters.groupBy("shot").agg(F.pow(F.sum(F.pow("w", F.lit(alpha))), F.lit(1.0 / alpha)).alias("_n"))
    return totals.join(norm, "shot", "left").select("shot", (F.coalesce("_n", F.lit(0.0)) / F.col("total")).alias("q"))


def sampling_stats(shots: DataFrame, fired: DataFrame, truth: DataFrame, num_dets: int | Column) -> DataFrame:
    """(shots, fire_rate, flip_fraction): mean detector rate and share of shots with a raw flip."""
    m = F.lit(num_dets) if isinstance(num_dets, int) else num_dets
    per_shot = shots.select("shot").join(fired.groupBy("shot").agg(F.count("*").alias("_n")), "shot", "left").join(
        truth.where("mask != 0").select("shot", F.lit(1).alias("_flip")), "shot", "left")
    return per_shot.agg(F.count("*").alias("shots"), F.sum(F.coalesce("_n", F.lit(0))).alias("_fired"),
                        F.count("_flip").alias("_flips")).select(
        "shots", (F.col("_fired") / (F.col("shots") * m)).alias("fire_rate"), (F.col("_flips") / F.col("shots")).alias("flip_fraction"))


def min_round_time(arms: DataFrame, iteration_time: float) -> DataFrame:
    """arms(arm, commit_rounds, iterations per window row) -> mean_iterations * tau / commit_rounds."""
    mean = arms.groupBy("arm", "commit_rounds").agg(F.avg("iterations").alias("mean_iterations"))
    return mean.select("*", (F.col("mean_iterations") * F.lit(iteration_time) / F.col("commit_rounds")).alias("min_round_time"))


# ---- logistic slope -------------------------------------------------------------------------

def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gap_histogram(df: DataFrame, gap: str = "gap", failed: str = "failed") -> DataFrame:
    """(d, n, k): decodes and failures per gap value, the sufficient statistics of the slope."""
    return df.groupBy(F.col(gap).cast("double").alias("d")).agg(
        F.count("*").alias("n"), F.count_if(F.col(failed)).alias("k"))


def logistic_profile(histogram: DataFrame, kappas: Sequence[float]) -> DataFrame:
    """(kappa, loglik, slope): log-likelihood of P(fail | d) = 1/(1 + exp(kappa d)) and its derivative.

    One pass over the histogram evaluates every kappa.
    """
    grid = histogram.withColumn("kappa", F.explode(F.array(*[F.lit(float(v)) for v in kappas])))
    t = F.col("kappa") * F.col("d")
    k, s = F.col("k"), F.col("n") - F.col("k")
    fail = 1.0 / (1.0 + F.exp(t))
    return grid.groupBy("kappa").agg(
        F.sum(-k * _softplus(t) - s * _softplus(-t)).alias("loglik"),
        F.sum(F.col("d") * (F.col("n") * fail - k)).alias("slope"))


def logistic_slope(df: DataFrame, gap: str = "gap", failed: str = "failed", z: float = Z95) -> DataFrame:
    """One row (kappa, lo, hi, se, loglik, shots, failures): maximum likelihood and profile interval.

    The driver only sees one number per grid point: each pass narrows the bracket 32-fold on
    sufficient statistics that stay distributed.
    """
    histogram = cut_lineage(gap_histogram(df, gap, failed))
    spark = df.sparkSession
    d, n, k = F.col("d"), F.col("n"), F.col("k")
    facts = histogram.agg(
        F.sum("n").alias("shots"), F.sum("k").alias("failures"), F.coalesce(F.sum(F.when(d == 0, n)), F.lit(0)).alias("ties"),
        F.count_if(d != 0).alias("values"), F.coalesce(F.sum(F.when(d != 0, F.abs(d) * n)) / F.sum(F.when(d != 0, n)), F.lit(1.0)).alias("size"),
        F.coalesce(F.sum(F.when(d > 0, -d * k).when(d < 0, d * (n - k))), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.when(d > 0, d * (n - k)).when(d < 0, -d * k)), F.lit(0.0)).alias("down")).first()
    inf, ties = float("inf"), -facts["ties"] * math.log(2.0)
    schema = "kappa double, lo double, hi double, se double, loglik double, shots bigint, failures bigint"

    def row(kappa, lo, hi, se, loglik):
        return spark.createDataFrame([(kappa, lo, hi, se, loglik, facts["shots"], facts["failures"])], schema)

    if facts["values"] == 0:
        return row(None, -inf, inf, None, ties)
    unit = 1.0 / facts["size"]

    def profile(points: list[float]) -> dict[float, tuple[float, float]]:
        return {r["kappa"]: (r["loglik"], r["slope"]) for r in logistic_profile(histogram, points).collect()}

    def root(value, lo: float, hi: float, passes: int = 8) -> float:
        """Zero of a function that is positive at lo and negative at hi (or the other way round)."""
        for _ in range(passes):
            points = [lo + (hi - lo) * i / 32 for i in range(33)]
            seen = profile(points)
            signs = [value(seen[p]) >= 0 for p in points]
            at = next((i for i in range(32) if signs[i] != signs[i + 1]), None)
            if at is None:
                break
            lo, hi = points[at], points[at + 1]
        return (lo + hi) / 2

    outward = [unit * 2.0**j for j in range(-4, 44)]
    if facts["up"] >= 0 or facts["down"] <= 0:
        sign = 1.0 if facts["up"] >= 0 else -1.0
        level = ties - z * z / 2
        points = sorted([-v for v in outward] + [0.0] + outward)
        seen = profile(points)
        signs = [seen[p][0] >= level for p in points]
        at = next(i for i in range(len(points) - 1) if signs[i] != signs[i + 1])
        bound = root(lambda v: v[0] - level, points[at], points[at + 1])
        return row(inf, bound, inf, None, ties) if sign > 0 else row(-inf, -inf, bound, None, ties)

    points = sorted([-v for v in outward] + [0.0] + outward)
    seen = profile(points)
    at = next(i for i in range(len(points) - 1) if seen[points[i]][1] > 0 >= seen[points[i + 1]][1])
    kappa = root(lambda v: v[1], points[at], points[at + 1])
    peak = profile([kappa])[kappa][0]
    level = peak - z * z / 2
    points = [kappa - v for v in reversed(outward)] + [kappa] + [kappa + v for v in outward]
    seen = profile(points)
    mid = len(outward)
    below = next(i for i in range(mid, 0, -1) if seen[points[i - 1]][0] < level)
    above = next(i for i in range(mid, len(points) - 1) if seen[points[i + 1]][0] < level)
    lo = root(lambda v: v[0] - level, points[below - 1], points[below])
    hi = root(lambda v: v[0] - level, points[above], points[above + 1])
    p = 1.0 / (1.0 + F.exp(F.lit(kappa) * d))
    info = histogram.agg(F.sum(n * d * d * p * (1.0 - p)).alias("i")).first()["i"]
    return row(kappa, lo, hi, 1.0 / math.sqrt(info) if info > 0 else None, peak)
