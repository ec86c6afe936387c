"""Runs, chunks, arms and halves: completion, combination, stopping and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.intervals import paired_ratio, wilson
from paritas.operators.ranks import cost_block, dense_numbers
from paritas.operators.statistics import pair_counts, rate_columns

SHOT = ["arm", "chunk", "shot"]


def completed_chunks(chunk_markers: DataFrame, done_markers: DataFrame, arm: str) -> DataFrame:
    """(chunk): chunks whose sampling marker and this arm's marker are both readable."""
    done = done_markers.where((F.col("arm") == arm) & F.col("readable")).select("chunk").distinct()
    return chunk_markers.where("readable").select("chunk").distinct().join(done, "chunk", "left_semi")


def common_chunks(chunk_markers: DataFrame, done_markers: DataFrame, a: str, b: str) -> DataFrame:
    return completed_chunks(chunk_markers, done_markers, a).intersect(completed_chunks(chunk_markers, done_markers, b))


def missing_chunks(requested: DataFrame, available: DataFrame) -> DataFrame:
    """(chunk, error) for chunks that were asked for but are not completed."""
    return requested.select("chunk").exceptAll(available.select("chunk")).withColumn("error", F.lit("chunk not completed"))


def pending_work(chunk_markers: DataFrame, arms: Sequence[str], done_markers: DataFrame) -> DataFrame:
    """(chunk, arm) pairs of sampled chunks without a readable completion marker."""
    todo = chunk_markers.where("readable").select("chunk", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    return todo.join(done_markers.where("readable").select("chunk", "arm"), ["chunk", "arm"], "left_anti")


def combine_halves(shots: DataFrame) -> DataFrame:
    """One row per (arm, chunk, shot): failed or flagged in any half, converged in all, summed and maximal costs."""
    return shots.groupBy(*SHOT).agg(
        F.bool_or("failed").alias("failed"), F.bool_or("flagged").alias("flagged"), F.bool_and("success").alias("success"),
        F.sum("iterations").alias("iterations_sum"), F.max("iterations").alias("iterations_max"),
        F.sum("legs").alias("legs_sum"), F.max("legs").alias("legs_max"), F.sum("weight").alias("weight_sum"))


def paired_shots(combined: DataFrame, reference: str, test: str, chunks: DataFrame) -> DataFrame:
    """(chunk, shot, ref_failed, test_failed) over the given common chunks.

    Both arms come from the same table, so one grouped pass pairs them instead of a self-join.
    """
    both = combined.where(F.col("arm").isin(reference, test)).join(chunks.select("chunk"), "chunk", "left_semi")
    paired = both.groupBy("chunk", "shot").agg(
        F.bool_or(F.when(F.col("arm") == reference, F.col("failed"))).alias("ref_failed"),
        F.bool_or(F.when(F.col("arm") == test, F.col("failed"))).alias("test_failed"))
    return paired.where(F.col("ref_failed").isNotNull() & F.col("test_failed").isNotNull())


def shot_in_chunk(shots: DataFrame) -> DataFrame:
    """Numbers the shots of each chunk from 0 in shot order, alike in all arms and halves.

    Distinct (chunk, shot) are numbered, then joined back; a large chunk spreads over many tasks.
    """
    numbers = dense_numbers(shots.select("chunk", "shot").distinct(), ["shot"], "shot_in_chunk", by=["chunk"])
    return shots.join(numbers, ["chunk", "shot"])


def half_costs(shots: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows per half and, as half 'combined', per shot over its halves (sums of costs)."""
    sums = [F.sum(v).alias(v) for v in values]
    levels = shots.groupingSets([[F.col(c) for c in (*SHOT, "half")], [F.col(c) for c in SHOT]], *SHOT, "half").agg(
        F.grouping("half").alias("_all"), F.bool_or("failed").alias("failed"), F.bool_and("success").alias("success"), *sums)
    return levels.withColumn("half", F.when(F.col("_all") == 1, "combined").otherwise(F.col("half"))).drop("_all")


def summarize(shots: DataFrame, rounds: int, qubits: int | None = None) -> DataFrame:
    """(arm, half): failure rates with intervals, convergence, and the iteration distribution."""
    rows = half_costs(shots, ["iterations", "legs"])
    by = ["arm", "half"]
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("shots"), F.count_if("failed").alias("failures"), F.count_if("success").alias("converged"),
        F.sum("legs").alias("legs"))
    rates = counts.select("*", *[c.alias(a) for a, c in rate_columns(F.col("failures"), F.col("shots"), rounds, qubits).items()])
    costs = cost_block(rows, "iterations", by).drop("n")
    return rates.join(costs, by)


def flagged_fractions(shots: DataFrame) -> DataFrame:
    """(arm, half, shots, flagged, rate, lo, hi): flagged shots with their interval, per half and, as half 'combined', in any half."""
    levels = shots.groupingSets([[F.col(c) for c in (*SHOT, "half")], [F.col(c) for c in SHOT]], *SHOT, "half").agg(
        F.grouping("half").alias("_all"), F.bool_or("flagged").alias("flagged"))
    named = levels.withColumn("half", F.when(F.col("_all") == 1, "combined").otherwise(F.col("half")))
    counts = named.groupBy("arm", "half").agg(F.count("*").alias("shots"), F.count_if("flagged").alias("flagged"))
    rate, lo, hi = wilson(F.col("flagged"), F.col("shots"))
    return counts.select("*", rate.alias("rate"), lo.alias("lo"), hi.alias("hi"))


def cost_blocks(shots: DataFrame, values: Sequence[str]) -> DataFrame:
    """(arm, half, cost, n, mean, min, p50, p90, p99, p999, max): the distribution of every cost, per half and over the halves' sums."""
    rows = half_costs(shots, values)
    out = None
    for value in values:
        block = cost_block(rows, value, ["arm", "half"]).withColumn("cost", F.lit(value))
        out = block if out is None else out.unionByName(block)
    return out


def window_blocks(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., decoded, converged, cap_hit, deferred, flagged, with_unexplained, unexplained, mean_iterations, max_iterations, rate, lo, hi):
    the windows of every group, with the interval of those that did not converge."""
    per = windows.where("attempts > 0").groupBy(*by).agg(
        F.count("*").alias("decoded"), F.count_if("converged").alias("converged"), F.count_if("cap_hit").alias("cap_hit"), F.count_if(F.col("attempts") > 1).alias("deferred"),
        F.count_if("flagged").alias("flagged"), F.count_if(F.col("unexplained") != 0).alias("with_unexplained"), F.sum("unexplained").alias("unexplained"),
        F.avg("iterations").alias("mean_iterations"), F.max("iterations").alias("max_iterations"))
    rate, lo, hi = wilson(F.col("decoded") - F.col("converged"), F.col("decoded"))
    return per.select("*", rate.alias("rate"), lo.alias("lo"), hi.alias("hi"))


def run_summary(shots: DataFrame, wall_seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """Block errors, non-convergence, costs and throughput of a run in one aggregate."""
    n = F.count("*")
    out = shots.groupBy(*by).agg(
        n.alias("shots"), F.count_if("failed").alias("failures"), F.count_if(~F.col("success")).alias("not_converged"),
        F.count_if(~F.col("success") & ~F.col("failed")).alias("not_converged_correct"),
        F.avg("iterations").alias("mean_iterations"), F.max("iterations").alias("max_iterations"),
        F.avg("legs").alias("mean_legs"), (n / F.lit(float(wall_seconds))).alias("shots_per_second"))
    rate, lo, hi = wilson(F.col("failures"), F.col("shots"))
    nrate, nlo, nhi = wilson(F.col("not_converged"), F.col("shots"))
    return out.select("*", rate.alias("rate"), lo.alias("lo"), hi.alias("hi"), nrate.alias("nc_rate"), nlo.alias("nc_lo"), nhi.alias("nc_hi"))


def rollup_windows(windows: DataFrame) -> DataFrame:
    """(shot): all windows converged, any flagged, summed iterations, legs and weights."""
    return windows.groupBy("shot").agg(
        F.bool_and("converged").alias("success"), F.bool_or("flagged").alias("flagged"), F.sum("iterations").alias("iterations"),
        F.sum("legs").alias("legs"), F.sum("weight").alias("weight"), F.count("*").alias("windows"))


def window_summary(windows: DataFrame, positions: int | Column) -> DataFrame:
    """One row over the decoded positions (attempts > 0); absent ones of a shot's ``positions`` count as skipped."""
    ran = windows.where("attempts > 0")
    n = F.count("*")
    per = ran.agg(
        n.alias("decoded"), F.count_if("converged").alias("converged"), F.count_if("cap_hit").alias("cap_hit"),
        F.count_if(F.col("attempts") > 1).alias("deferred"), F.sum(F.col("attempts") - 1).alias("deferral_attempts"),
        F.count_if("flagged").alias("flagged_windows"), F.count_if(F.col("unexplained") != 0).alias("with_unexplained"),
        F.sum("unexplained").alias("unexplained"), F.sum("virtual").alias("virtual_commits"),
        F.avg("iterations").alias("mean_iterations"), F.max("iterations").alias("max_iterations"))
    shots = windows.agg(F.count_distinct("shot")).scalar()
    flagged = windows.where("flagged").agg(F.count_distinct("shot")).scalar()
    tops = max_window_per_shot(ran)
    return per.withColumn("shots", shots).withColumn("flagged_shots", flagged).withColumn(
        "mean_top", tops.agg(F.avg("top")).scalar()).withColumn(
        "skipped", F.col("shots") * positions - F.col("decoded")).withColumn(
        "limit_reached", F.col("decoded") - F.col("converged"))


def max_window_per_shot(windows: DataFrame) -> DataFrame:
    return windows.groupBy("shot").agg(F.max("iterations").alias("top"))


def windows_over_halves(windows: DataFrame) -> DataFrame:
    """(shot, window): iterations summed and maximal over the halves, converged in every decoded half."""
    ran = F.col("attempts") > 0
    return windows.groupBy("shot", "window").agg(
        F.bool_or(ran).alias("decoded"), F.sum("iterations").alias("iterations_sum"), F.max("iterations").alias("iterations_max"),
        F.bool_and(F.col("converged") | ~ran).alias("converged"))


def window_events(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per kind of window event; also runs as a streaming aggregate."""
    return windows.groupBy(*by).agg(
        F.count_if(~F.col("converged")).alias("not_converged"), F.count_if(F.col("attempts") > 1).alias("deferred"),
        F.count_if((F.col("attempts") > 1) & ~F.col("converged")).alias("limit_reached"), F.count_if("cap_hit").alias("cap_hit"))


def campaign_status(chunk_markers: DataFrame, done_markers: DataFrame) -> DataFrame:
    """(arm): chunks done, shots, failures, converged and decode seconds, with the total compute seconds."""
    done = done_markers.where("readable")
    sampling = chunk_markers.where("readable").agg(F.coalesce(F.sum("sample_seconds"), F.lit(0.0))).scalar()
    decoding = done.agg(F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0))).scalar()
    return done.groupBy("arm").agg(
        F.count("*").alias("chunks_done"), F.sum("shots").alias("shots"), F.sum("failures").alias("failures"),
        F.sum("converged").alias("converged"), F.sum("elapsed_seconds").alias("decode_seconds")).withColumn(
        "compute_seconds", sampling + decoding)


def _criterion(df: DataFrame, name: str, value: Column, threshold: float, met: Column) -> DataFrame:
    return df.select(F.lit(name).alias("criterion"), value.cast("double").alias("value"),
                     F.lit(float(threshold)).alias("threshold"), F.coalesce(met, F.lit(False)).alias("met"))


def evaluate_stop(chunk_markers: DataFrame, done_markers: DataFrame, combined: DataFrame, *,
                  max_shots: int | None = None, max_seconds: float | None = None, failure_arm: str | None = None,
                  min_failures: int | None = None, pairs: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """(criterion, value, threshold, met): one row per configured criterion.

    A pair (reference, test, width) is met when its ratio's relative half-width is at most width;
    with several pairs the row ``paired`` holds when all of them are met.
    """
    parts = []
    readable = chunk_markers.where("readable")
    if max_shots is not None:
        s = readable.agg(F.coalesce(F.sum("shots"), F.lit(0)).alias("v"))
        parts.append(_criterion(s, "max_shots", F.col("v"), max_shots, F.col("v") >= max_shots))
    if max_seconds is not None:
        decode = done_markers.where("readable").agg(F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0))).scalar()
        s = readable.agg(F.coalesce(F.sum("sample_seconds"), F.lit(0.0)).alias("s")).select((F.col("s") + decode).alias("v"))
        parts.append(_criterion(s, "max_wall_seconds", F.col("v"), max_seconds, F.col("v") >= max_seconds))
    if min_failures is not None and failure_arm is not None:
        s = done_markers.where(F.col("readable") & (F.col("arm") == failure_arm)).agg(F.coalesce(F.sum("failures"), F.lit(0)).alias("v"))
        parts.append(_criterion(s, "min_failures", F.col("v"), min_failures, F.col("v") >= min_failures))
    widths = []
    for reference, test, width in pairs:
        chunks = common_chunks(chunk_markers, done_markers, reference, test)
        counts = pair_counts(paired_shots(combined, reference, test, chunks))
        r = paired_ratio(F.col("n11"), F.col("n10"), F.col("n01"))
        finite = (F.col("n11") + F.col("n10") > 0) & (F.col("n11") + F.col("n01") > 0)
        half = F.when(finite, F.greatest(r["hi"] / r["value"] - 1.0, 1.0 - r["lo"] / r["value"]))
        row = _criterion(counts.select(half.alias("v")), f"paired:{reference}/{test}", F.col("v"), width, F.col("v") <= width)
        widths.append(row)
        parts.append(row)
    if len(widths) > 1:
        listed = widths[0]
        for w in widths[1:]:
            listed = listed.unionByName(w)
        agreed = listed.agg(F.count_if("met").alias("v"), F.bool_and("met").alias("m"))
        parts.append(_criterion(agreed, "paired", F.col("v"), len(widths), F.col("m")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_hash(columns: Sequence[str]) -> Column:
    """A 60-bit digest of a row's values."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def chunk_checksums(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(chunk, rows, checksum): order-independent content digest.

    Sum and xor of row digests combine on the map side; a chunk with a third of all rows is never
    gathered. Duplicated rows change the sum even where they cancel in the xor.
    """
    h = row_hash(columns)
    return rows.groupBy("chunk").agg(F.count("*").alias("rows"), F.concat_ws(
        ":", F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")).alias("checksum"))


def verify_chunks(rows: DataFrame, columns: Sequence[str], markers: DataFrame) -> DataFrame:
    """(chunk, problem) where a chunk's content is absent, unmarked, short or different from its marker."""
    actual = chunk_checksums(rows, columns)
    wanted = markers.select("chunk", F.col("rows").alias("_rows"), F.col("checksum").alias("_sum"))
    both = actual.join(wanted, "chunk", "full_outer")
    problem = (F.when(F.col("rows").isNull(), "missing").when(F.col("_rows").isNull(), "unmarked")
               .when(F.col("rows") != F.col("_rows"), "truncated").when(F.col("checksum") != F.col("_sum"), "different"))
    return both.select("chunk", problem.alias("problem")).where("problem is not null")


def check_chunks(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(chunk, shots, expected, layouts, problem): rows against the marker's shots, one layout per chunk.

    rows(chunk, shot, windows) with windows the number of window positions of the shot.
    """
    per = rows.groupBy("chunk").agg(F.count("*").alias("shots"), F.count_distinct("windows").alias("layouts"), F.min("windows").alias("_k"))
    usual = rows.agg(F.mode("windows", True)).scalar()
    both = expected.select("chunk", F.col("shots").alias("expected")).join(per, "chunk", "left").withColumn("_usual", usual)
    problem = (F.when(F.col("shots").isNull(), "absent").when(F.col("shots") != F.col("expected"), "truncated")
               .when((F.col("layouts") > 1) | (F.col("_k") != F.col("_usual")), "conflicting").otherwise("ok"))
    return both.select("chunk", "shots", "expected", "layouts", problem.alias("problem"))
