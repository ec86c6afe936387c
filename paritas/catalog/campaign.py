"""Campaign tables, run summaries, markers, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritas.catalog import inputs as I
from paritas.catalog.base import Tables, cycle_sql, num, query, shaped, wilson_sql
from paritas.operators import campaign as C
from paritas.operators import gf2, ranks
from paritas.operators import statistics as S
from paritas.session import scratch_path
from paritas.sources import runs, shots

# A run: every order decoded by two arms in two halves.
RUN = """
run AS (SELECT o_orderkey AS shot, o_orderkey // 1000 AS chunk, arm, half,
 CASE WHEN arm = 'a' AND half = 'x' THEN o_orderpriority = '1-URGENT' WHEN arm = 'a' THEN o_totalprice > 450000
  WHEN half = 'x' THEN o_totalprice > 400000 ELSE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' END AS failed,
 o_custkey % 11 = 0 AS flagged, NOT (o_orderstatus = 'P' AND half = 'z' AND o_custkey % 5 = 0) AS success,
 floor(o_totalprice/1000)::BIGINT + CASE WHEN half = 'z' THEN o_custkey ELSE 0 END AS iterations,
 1 + o_custkey % 7 + CASE WHEN arm = 'b' THEN 1 ELSE 0 END AS legs, o_totalprice/1000 AS weight
 FROM orders, (VALUES ('a'), ('b')) x(arm), (VALUES ('x'), ('z')) y(half))"""
COMBINED = """combined AS (SELECT arm, chunk, shot, bool_or(failed) AS failed, bool_or(flagged) AS flagged, bool_and(success) AS success, sum(iterations)::BIGINT AS iterations_sum,
 max(iterations) AS iterations_max, sum(legs)::BIGINT AS legs_sum, max(legs) AS legs_max, sum(weight) AS weight_sum FROM run GROUP BY ALL)"""
# Markers: every chunk is sampled; arm b's marker is missing for chunks 3 mod 5 and unreadable for 4 mod 5.
MARKERS = """
cm AS (SELECT chunk, count(*) AS shots, chunk * 0.5 AS sample_seconds FROM (SELECT o_orderkey // 1000 AS chunk FROM orders) GROUP BY chunk),
dm0 AS (SELECT chunk, arm, count(*) AS shots, count(*) FILTER (failed) AS failures, count(*) FILTER (success) AS converged, 10.0 + chunk AS elapsed_seconds FROM combined GROUP BY ALL),
dm AS (SELECT *, NOT (arm = 'b' AND chunk % 5 = 4) AS readable FROM dm0 WHERE NOT (arm = 'b' AND chunk % 5 = 3)),
done AS (SELECT * FROM dm WHERE readable)"""
ALL = f"{RUN}, {COMBINED}, {MARKERS}"


def run(t: Tables):
    o = t.orders.select(
        F.col("o_orderkey").alias("shot"), F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("chunk"), "o_orderpriority", "o_orderstatus",
        "o_custkey", "o_totalprice", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(h).alias("half")) for a in "ab" for h in "xz"])).alias("r"))
    arm, half, price = F.col("r.arm"), F.col("r.half"), F.col("o_totalprice")
    failed = (F.when((arm == "a") & (half == "x"), F.col("o_orderpriority") == "1-URGENT").when(arm == "a", price > 450000)
              .when(half == "x", price > 400000).otherwise((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F")))
    return o.select(
        "shot", "chunk", arm.alias("arm"), half.alias("half"), failed.alias("failed"), (F.col("o_custkey") % 11 == 0).alias("flagged"),
        (~((F.col("o_orderstatus") == "P") & (half == "z") & (F.col("o_custkey") % 5 == 0))).alias("success"),
        (F.floor(price / 1000).cast("bigint") + F.when(half == "z", F.col("o_custkey")).otherwise(0)).alias("iterations"),
        (1 + F.col("o_custkey") % 7 + F.when(arm == "b", 1).otherwise(0)).cast("bigint").alias("legs"), (price / 1000).alias("weight"))


def combined(t: Tables):
    return C.combine_halves(run(t))


def markers(t: Tables, where: str | None = None):
    """Writes the marker files as JSON lines, one of them broken per the rule above, and reads them back."""
    path = where or scratch_path(t.spark, "markers")
    cm = t.orders.groupBy(F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("chunk")).agg(F.count("*").alias("shots")).withColumn(
        "seed", F.col("chunk") * 17).withColumn("sample_seconds", F.col("chunk") * 0.5)
    dm = combined(t).groupBy("chunk", "arm").agg(
        F.count("*").alias("shots"), F.count_if("failed").alias("failures"), F.count_if("success").alias("converged")).withColumn(
        "elapsed_seconds", 10.0 + F.col("chunk")).where("not (arm = 'b' and chunk % 5 = 3)")
    cm.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/chunk")
    text = F.to_json(F.struct("chunk", "arm", "shots", "failures", "converged", "elapsed_seconds"))
    broken = (F.col("arm") == "b") & (F.col("chunk") % 5 == 4)
    dm.select(F.when(broken, F.substring(text, 1, 20)).otherwise(text).alias("value")).write.text(f"{path}/done")
    return runs.read_markers(t.spark, f"{path}/chunk", runs.CHUNK_MARKER), runs.read_markers(t.spark, f"{path}/done", runs.DONE_MARKER)


@query("s12_read_markers", f"""WITH {ALL} SELECT CASE WHEN readable THEN chunk END AS chunk, CASE WHEN readable THEN arm END AS arm, CASE WHEN readable THEN failures END AS failures, CAST(readable AS INT)::BIGINT AS readable FROM dm""")
def read_markers(t: Tables):
    _, done = markers(t)
    r = F.col("readable")
    return shaped(done.select(F.when(r, F.col("chunk")).alias("chunk"), F.when(r, F.col("arm")).alias("arm"), F.when(r, F.col("failures")).alias("failures"), "readable"),
                  "chunk failures readable", "", "arm")


@query("j9_completed_chunks", f"WITH {ALL} SELECT cm.chunk FROM cm JOIN done ON done.chunk = cm.chunk AND arm = 'b'")
def completed(t: Tables):
    return C.completed_chunks(*markers(t), "b")


@query("u2_common_chunks", f"WITH {ALL} SELECT chunk FROM done WHERE arm = 'a' INTERSECT SELECT chunk FROM done WHERE arm = 'b'")
def common(t: Tables):
    return C.common_chunks(*markers(t), "a", "b")


@query("u5_missing_chunks", f"WITH {ALL} SELECT chunk, 'chunk not completed' AS error FROM (SELECT chunk FROM cm EXCEPT SELECT chunk FROM done WHERE arm = 'b')")
def missing(t: Tables):
    cm, dm = markers(t)
    return C.missing_chunks(cm, C.completed_chunks(cm, dm, "b"))


@query("j10_pending_work", f"WITH {ALL} SELECT chunk, arm FROM cm, (VALUES ('a'), ('b'), ('c')) x(arm) EXCEPT SELECT chunk, arm FROM done")
def pending(t: Tables):
    cm, dm = markers(t)
    return C.pending_work(cm, ["a", "b", "c"], dm)


@query("j11_combine_halves", f"""WITH {RUN}, {COMBINED} SELECT arm, chunk, shot, CAST(failed AS INT)::BIGINT AS failed, CAST(flagged AS INT)::BIGINT AS flagged, CAST(success AS INT)::BIGINT AS success,
iterations_sum, iterations_max, legs_sum, legs_max, round(weight_sum, 6) AS weight_sum FROM combined""")
def combine(t: Tables):
    return shaped(combined(t), "chunk shot failed flagged success iterations_sum iterations_max legs_sum legs_max", "weight_sum", "arm", digits=6)


PAIRED = "pr AS (SELECT a.chunk, a.shot, a.failed AS ref_failed, b.failed AS test_failed FROM combined a JOIN combined b ON a.arm = 'a' AND b.arm = 'b' AND a.chunk = b.chunk AND a.shot = b.shot WHERE a.chunk IN (SELECT chunk FROM done WHERE arm = 'a') AND a.chunk IN (SELECT chunk FROM done WHERE arm = 'b'))"


@query("j7_paired_shots", f"WITH {ALL}, {PAIRED} SELECT chunk, shot, CAST(ref_failed AS INT)::BIGINT AS ref_failed, CAST(test_failed AS INT)::BIGINT AS test_failed FROM pr")
def paired(t: Tables):
    chunks = C.common_chunks(*markers(t), "a", "b")
    return shaped(C.paired_shots(combined(t), "a", "b", chunks), "chunk shot ref_failed test_failed")


@query("s10_load_campaign", f"WITH {ALL} SELECT r.chunk, shot, half, dense_rank() OVER (PARTITION BY r.chunk ORDER BY shot) - 1 AS shot_in_chunk, iterations, CAST(failed AS INT)::BIGINT AS failed FROM run r WHERE arm = 'b' AND r.chunk IN (SELECT chunk FROM done WHERE arm = 'b')")
def load_campaign(t: Tables):
    path = scratch_path(t.spark, "run")
    runs.write_run({"shots": run(t)}, path)
    loaded = runs.load_campaign(t.spark, path, "b", ["iterations", "failed"], C.completed_chunks(*markers(t), "b"))
    return shaped(loaded, "chunk shot shot_in_chunk iterations failed", "", "half")


@query("s9_read_run", f"WITH {RUN} SELECT arm, half, count(*) AS n, sum(iterations)::BIGINT AS iterations FROM run GROUP BY ALL")
def read_run(t: Tables):
    path = scratch_path(t.spark, "run")
    runs.write_run({"shots": run(t)}, path)
    df = runs.read_run(t.spark, path, "shots", ["iterations"], ["decode_ns"])
    return df.groupBy("arm", "half").agg(F.count("*").alias("n"), F.sum("iterations").alias("iterations"))


@query("s8_write_run", f"WITH {RUN} SELECT 'shots' AS part, chunk, count(*) AS n FROM run GROUP BY ALL UNION ALL SELECT 'supports', o_orderkey // 1000, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def write_run(t: Tables):
    path = scratch_path(t.spark, "run")
    sup = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("a").alias("arm"), F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("chunk"), F.lit("x").alias("half"),
        F.col("l_orderkey").alias("shot"), F.col("l_partkey").alias("fault"))
    runs.write_run({"shots": run(t), "supports": sup}, path)
    parts = [t.spark.read.parquet(f"{path}/{n}").groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(F.count("*").alias("n")).select(
        F.lit(n).alias("part"), "chunk", "n") for n in ("shots", "supports")]
    return parts[0].unionByName(parts[1])


WS = wilson_sql("failures", "shots")
WN = wilson_sql("not_converged", "shots")


@query("a22_run_summary", f"""WITH {RUN}, c AS (SELECT arm, half, count(*) AS shots, count(*) FILTER (failed) AS failures, count(*) FILTER (NOT success) AS not_converged, count(*) FILTER (NOT success AND NOT failed) AS not_converged_correct,
avg(iterations) AS mean_iterations, max(iterations) AS max_iterations, avg(legs) AS mean_legs FROM run GROUP BY ALL)
SELECT arm, half, shots, failures, not_converged, not_converged_correct, round(mean_iterations, 6) AS mean_iterations, max_iterations, round(mean_legs, 6) AS mean_legs, round(shots/50.0::DOUBLE, 6) AS shots_per_second,
round({WS['rate']}, 6) AS rate, round({WS['lo']}, 6) AS lo, round({WS['hi']}, 6) AS hi, round({WN['rate']}, 6) AS nc_rate, round({WN['lo']}, 6) AS nc_lo, round({WN['hi']}, 6) AS nc_hi FROM c""")
def run_summary(t: Tables):
    return shaped(C.run_summary(run(t), 50.0, ["arm", "half"]), "shots failures not_converged not_converged_correct max_iterations",
                  "mean_iterations mean_legs shots_per_second rate lo hi nc_rate nc_lo nc_hi", "arm half", digits=6)


@query("a23_window_summary", f"""WITH {I.WINDOWS}, tops AS (SELECT shot, max(iterations) AS top FROM windows GROUP BY shot)
SELECT count(*) AS decoded, count(*) FILTER (converged) AS converged, count(*) FILTER (cap_hit) AS cap_hit, count(*) FILTER (attempts > 1) AS deferred, sum(attempts - 1)::BIGINT AS deferral_attempts,
count(*) FILTER (flagged) AS flagged_windows, count(*) FILTER (unexplained <> 0) AS with_unexplained, sum(unexplained)::BIGINT AS unexplained, sum(virtual)::BIGINT AS virtual_commits,
round(avg(iterations), 6) AS mean_iterations, max(iterations) AS max_iterations, count(DISTINCT shot) AS shots, count(DISTINCT shot) FILTER (flagged) AS flagged_shots,
round((SELECT avg(top) FROM tops), 6) AS mean_top, count(DISTINCT shot)*(max("window") - min("window") + 1) - count(*) AS skipped, count(*) - count(*) FILTER (converged) AS limit_reached FROM windows""")
def window_summary(t: Tables):
    windows = I.windows(t)
    positions = windows.agg(F.max("window") - F.min("window") + 1).scalar()
    return shaped(C.window_summary(windows, positions), "decoded converged cap_hit deferred deferral_attempts flagged_windows with_unexplained unexplained virtual_commits max_iterations shots flagged_shots skipped limit_reached",
                  "mean_iterations mean_top", digits=6)


@query("a24_windows_over_halves", f"""WITH ev AS (SELECT user_id AS shot, date_diff('day', DATE '2024-01-01', ts::DATE) AS "window", event_type, floor(value)::BIGINT AS it, event_id % 2 AS half FROM events),
w AS (SELECT shot, "window", half, sum(it)::BIGINT AS it, bool_and(event_type <> 'error') AS ok FROM ev GROUP BY ALL)
SELECT shot, "window", sum(it)::BIGINT AS iterations_sum, max(it) AS iterations_max, CAST(bool_and(ok) AS INT)::BIGINT AS converged, 1::BIGINT AS decoded FROM w GROUP BY ALL""")
def windows_over_halves(t: Tables):
    e = t.events.groupBy(F.col("user_id").alias("shot"), F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("bigint").alias("window"),
                         (F.col("event_id") % 2).alias("half")).agg(
        F.sum(F.floor("value").cast("bigint")).alias("iterations"), F.bool_and(F.col("event_type") != "error").alias("converged"), F.count("*").alias("attempts"))
    return shaped(C.windows_over_halves(e), "shot window decoded iterations_sum iterations_max converged")


@query("a27_rollup_windows", f"""WITH {I.WINDOWS} SELECT shot, CAST(bool_and(converged) AS INT)::BIGINT AS success, CAST(bool_or(flagged) AS INT)::BIGINT AS flagged, sum(iterations)::BIGINT AS iterations, sum(legs)::BIGINT AS legs, sum(weight)::BIGINT AS weight, count(*) AS windows FROM windows GROUP BY shot""")
def rollup(t: Tables):
    return shaped(C.rollup_windows(I.windows(t)), "shot success flagged iterations legs weight windows")


@query("t1_max_window_per_shot", f"WITH {I.WINDOWS} SELECT shot, max(iterations) AS top FROM windows GROUP BY shot")
def max_window(t: Tables):
    return C.max_window_per_shot(I.windows(t))


@query("x12_window_events", f"""WITH {I.WINDOWS} SELECT "window", count(*) FILTER (NOT converged) AS not_converged, count(*) FILTER (attempts > 1) AS deferred, count(*) FILTER (attempts > 1 AND NOT converged) AS limit_reached, count(*) FILTER (cap_hit) AS cap_hit FROM windows GROUP BY ALL""")
def window_events(t: Tables):
    return shaped(C.window_events(I.windows(t), ["window"]), "window not_converged deferred limit_reached cap_hit")


@query("a28_campaign_status", f"""WITH {ALL} SELECT arm, count(*) AS chunks_done, sum(shots)::BIGINT AS shots, sum(failures)::BIGINT AS failures, sum(converged)::BIGINT AS converged, round(sum(elapsed_seconds), 6)::DOUBLE AS decode_seconds,
round((SELECT sum(sample_seconds) FROM cm) + (SELECT sum(elapsed_seconds) FROM done), 6)::DOUBLE AS compute_seconds FROM done GROUP BY arm""")
def status(t: Tables):
    return shaped(C.campaign_status(*markers(t)), "chunks_done shots failures converged", "decode_seconds compute_seconds", "arm", digits=6)


@query("a29_evaluate_stop", f"""WITH {ALL}, {PAIRED}, c AS (SELECT count(*) FILTER (ref_failed AND test_failed) AS n11, count(*) FILTER (ref_failed AND NOT test_failed) AS n10, count(*) FILTER (NOT ref_failed AND test_failed) AS n01 FROM pr),
h AS (SELECT exp({1.959963984540054}*sqrt((n10+n01)/((n11+n01)*(n11+n10)))) - 1 AS ab FROM c), h2 AS (SELECT ab, ab AS ba FROM h),
r AS (SELECT 'max_shots' AS criterion, (SELECT sum(shots) FROM cm)::DOUBLE AS value, 10000.0::DOUBLE AS threshold, (SELECT sum(shots) FROM cm) >= 10000 AS met
UNION ALL SELECT 'max_wall_seconds', v::DOUBLE, 100000.0, v >= 100000 FROM (SELECT (SELECT sum(sample_seconds) FROM cm) + (SELECT sum(elapsed_seconds) FROM done) AS v)
UNION ALL SELECT 'min_failures', v::DOUBLE, 100.0, v >= 100 FROM (SELECT sum(failures) AS v FROM done WHERE arm = 'b')
UNION ALL SELECT 'paired:a/b', ab, 0.05, ab <= 0.05 FROM h2 UNION ALL SELECT 'paired:b/a', ba, 0.5, ba <= 0.5 FROM h2
UNION ALL SELECT 'paired', CAST(ab <= 0.05 AS INT) + CAST(ba <= 0.5 AS INT), 2.0, ab <= 0.05 AND ba <= 0.5 FROM h2)
SELECT criterion, round(value, 6) AS value, threshold, CAST(met AS INT)::BIGINT AS met FROM r""")
def evaluate_stop(t: Tables):
    cm, dm = markers(t)
    out = C.evaluate_stop(cm, dm, combined(t), max_shots=10000, max_seconds=100000, failure_arm="b", min_failures=100, pairs=[("a", "b", 0.05), ("b", "a", 0.5)])
    return shaped(out, "met", "value threshold", "criterion", digits=6)


@query("a30_summarize", f"""WITH {RUN}, lv AS (SELECT arm, half, chunk, shot, failed, success, iterations, legs FROM run UNION ALL
 SELECT arm, 'combined', chunk, shot, bool_or(failed), bool_and(success), sum(iterations)::BIGINT, sum(legs)::BIGINT FROM run GROUP BY arm, chunk, shot),
rk AS (SELECT *, row_number() OVER (PARTITION BY arm, half ORDER BY iterations) AS r, count(*) OVER (PARTITION BY arm, half) AS n FROM lv),
c AS (SELECT arm, half, count(*) AS shots, count(*) FILTER (failed) AS failures, count(*) FILTER (success) AS converged, sum(legs)::BIGINT AS legs, avg(iterations) AS mean, min(iterations) AS min, max(iterations) AS max,
 max(iterations) FILTER (r = ceil(0.5::DECIMAL(18,9)*n)) AS p50, max(iterations) FILTER (r = ceil(0.9::DECIMAL(18,9)*n)) AS p90, max(iterations) FILTER (r = ceil(0.99::DECIMAL(18,9)*n)) AS p99, max(iterations) FILTER (r = ceil(0.999::DECIMAL(18,9)*n)) AS p999 FROM rk GROUP BY ALL),
w AS (SELECT *, {WS['rate']} AS rate, {WS['lo']} AS lo, {WS['hi']} AS hi FROM c)
SELECT arm, half, shots, failures, converged, legs, round(mean, 6) AS mean, min, max, p50, p90, p99, p999, round(rate, 6) AS rate, round(lo, 6) AS lo, round(hi, 6) AS hi, round({cycle_sql('rate', 12)}, 6) AS cycle_rate FROM w""")
def summarize(t: Tables):
    return shaped(C.summarize(run(t), 12), "shots failures converged legs min max p50 p90 p99 p999", "mean rate lo hi cycle_rate", "arm half", digits=6)


@query("a30_summary_pairs", f"""WITH {ALL}, {PAIRED} SELECT 'a' AS reference, 'b' AS test, count(*) AS shots, count(*) FILTER (ref_failed AND test_failed) AS n11, count(*) FILTER (ref_failed AND NOT test_failed) AS n10,
count(*) FILTER (NOT ref_failed AND test_failed) AS n01, round(count(*) FILTER (test_failed)/count(*) FILTER (ref_failed), 9) AS value FROM pr""")
def summary_pairs(t: Tables):
    chunks = C.common_chunks(*markers(t), "a", "b")
    out = S.pair_table(C.paired_shots(combined(t), "a", "b", chunks)).select(
        F.lit("a").alias("reference"), F.lit("b").alias("test"), (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).alias("shots"), "n11", "n10", "n01", "value")
    return shaped(out, "shots n11 n10 n01", "value", "reference test")


LEVELS = """lv AS (SELECT arm, half, chunk, shot, flagged, iterations, legs FROM run UNION ALL
 SELECT arm, 'combined', chunk, shot, bool_or(flagged), sum(iterations)::BIGINT, sum(legs)::BIGINT FROM run GROUP BY arm, chunk, shot)"""
WF = wilson_sql("flagged", "shots")


@query("a30_flagged_block", f"""WITH {RUN}, {LEVELS}, c AS (SELECT arm, half, count(*) AS shots, count(*) FILTER (flagged) AS flagged FROM lv GROUP BY ALL)
SELECT arm, half, shots, flagged, round({WF['rate']}, 6) AS rate, round({WF['lo']}, 6) AS lo, round({WF['hi']}, 6) AS hi FROM c""")
def flagged_block(t: Tables):
    return shaped(C.flagged_fractions(run(t)), "shots flagged", "rate lo hi", "arm half", digits=6)


def _cost_sql(cost: str) -> str:
    ranked = ", ".join(f"max(v) FILTER (r = ceil({q}::DECIMAL(18,9)*n)) AS {name}" for name, q in ranks.COST_LEVELS.items())
    return f"""SELECT arm, half, '{cost}' AS cost, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, {ranked} FROM
(SELECT arm, half, {cost} AS v, row_number() OVER (PARTITION BY arm, half ORDER BY {cost}) AS r, count(*) OVER (PARTITION BY arm, half) AS n FROM lv) GROUP BY arm, half"""


@query("a30_cost_blocks", f"WITH {RUN}, {LEVELS} {_cost_sql('iterations')} UNION ALL {_cost_sql('legs')}")
def cost_blocks(t: Tables):
    return shaped(C.cost_blocks(run(t), ["iterations", "legs"]), "n min max p50 p90 p99 p999", "mean", "arm half cost", digits=6)


WC = wilson_sql("(decoded - converged)", "decoded")


@query("a30_window_blocks", f"""WITH {I.WINDOWS}, c AS (SELECT shot % 2 AS half, count(*) AS decoded, count(*) FILTER (converged) AS converged, count(*) FILTER (cap_hit) AS cap_hit, count(*) FILTER (attempts > 1) AS deferred,
count(*) FILTER (flagged) AS flagged, count(*) FILTER (unexplained <> 0) AS with_unexplained, sum(unexplained)::BIGINT AS unexplained, avg(iterations) AS mean_iterations, max(iterations) AS max_iterations FROM windows GROUP BY ALL)
SELECT half, decoded, converged, cap_hit, deferred, flagged, with_unexplained, unexplained, max_iterations, round(mean_iterations, 6) AS mean_iterations, round({WC['rate']}, 6) AS rate, round({WC['lo']}, 6) AS lo, round({WC['hi']}, 6) AS hi FROM c""")
def window_blocks(t: Tables):
    """Windows per half; odd and even users stand for the halves."""
    windows = I.windows(t).withColumn("half", F.col("shot") % 2)
    return shaped(C.window_blocks(windows, ["half"]), "half decoded converged cap_hit deferred flagged with_unexplained unexplained max_iterations", "mean_iterations rate lo hi", digits=6)


@query("s10_schema_agreement", """WITH p AS (SELECT DISTINCT o_orderkey // 1000 AS chunk, arm, half FROM orders, (VALUES ('a'), ('b')) x(arm), (VALUES ('x'), ('z')) y(half))
SELECT arm, chunk, half, 'legs' AS "column", 'lacking' AS problem FROM p WHERE arm = 'b' AND chunk % 4 = 1 UNION ALL
SELECT arm, chunk, half, 'iterations', 'type' FROM p WHERE half = 'z' AND chunk % 4 = 2 UNION ALL SELECT arm, chunk, half, 'energy', 'extra' FROM p WHERE chunk % 4 = 3""")
def schema_agreement(t: Tables):
    """A run in which some chunks lack a column, have one more, or hold another type, found from file footers alone."""
    path = scratch_path(t.spark, "run")
    rows = run(t)
    kind, z = F.col("chunk") % 4, F.col("half") == "z"
    lacks, typed, more = (kind == 1) & (F.col("arm") == "b"), (kind == 2) & z, kind == 3
    for part, table in ((~lacks & ~typed & ~more, rows), (lacks, rows.drop("legs")), (typed, rows.withColumn("iterations", F.col("iterations").cast("double"))),
                        (more, rows.withColumn("energy", F.col("weight") * 2))):
        table.where(part).write.mode("append").partitionBy(*runs.RUN_KEYS).parquet(f"{path}/shots")
    return shaped(runs.check_schemas(runs.partition_schemas(t.spark, path)), "chunk", "", "arm half column problem")


COLS = ["shot", "half", "iterations"]
HASH = "('0x' || substr(md5(shot || '|' || half || '|' || iterations), 1, 15))::BIGINT"


@query("a44_chunk_checksums", f"WITH {RUN}, h AS (SELECT chunk, {HASH} AS h FROM run WHERE arm = 'a') SELECT chunk, count(*) AS rows, sum(h::HUGEINT)::VARCHAR || ':' || bit_xor(h)::VARCHAR AS checksum FROM h GROUP BY chunk")
def chunk_checksums(t: Tables):
    return C.chunk_checksums(run(t).where("arm = 'a'"), COLS)


@query("a44_verify_chunks", f"""WITH {RUN}, c AS (SELECT DISTINCT chunk FROM run) SELECT chunk, CASE chunk % 5 WHEN 0 THEN 'different' WHEN 1 THEN 'missing' WHEN 2 THEN 'truncated' ELSE 'unmarked' END AS problem FROM c WHERE chunk % 5 < 4""")
def verify_chunks(t: Tables):
    rows = run(t).where("arm = 'a'")
    marks = C.chunk_checksums(rows, COLS).where("chunk % 5 <> 3")
    first = rows.groupBy("chunk").agg(F.min("shot").alias("_first"))
    damaged = rows.where("chunk % 5 <> 1").join(first, "chunk").where("not (chunk % 5 = 2 and shot = _first)")
    damaged = damaged.withColumn("iterations", F.when((F.col("chunk") % 5 == 0) & (F.col("shot") == F.col("_first")), F.col("iterations") + 1).otherwise(F.col("iterations")))
    return C.verify_chunks(damaged, COLS, marks)


@query("a45_check_chunks", """WITH s AS (SELECT o_orderkey // 1000 AS chunk, o_orderkey AS shot, CASE WHEN o_orderkey // 1000 % 7 = 3 THEN 4 ELSE 5 END AS k FROM orders WHERE NOT (o_orderkey // 1000 % 7 = 5 AND o_custkey % 50 = 0)),
m AS (SELECT o_orderkey // 1000 AS chunk, count(*) AS expected FROM orders GROUP BY 1), p AS (SELECT chunk, count(*) AS shots, count(DISTINCT k) AS layouts, min(k) AS k FROM s GROUP BY chunk)
SELECT m.chunk, shots, expected, layouts, CASE WHEN shots IS NULL THEN 'absent' WHEN shots <> expected THEN 'truncated' WHEN layouts > 1 OR k <> 5 THEN 'conflicting' ELSE 'ok' END AS problem FROM m LEFT JOIN p USING (chunk)""")
def check_chunks(t: Tables):
    chunk = F.floor(F.col("o_orderkey") / 1000).cast("bigint")
    rows = t.orders.where(~((chunk % 7 == 5) & (F.col("o_custkey") % 50 == 0))).select(chunk.alias("chunk"), F.col("o_orderkey").alias("shot"), F.when(chunk % 7 == 3, 4).otherwise(5).alias("windows"))
    return shaped(C.check_chunks(rows, t.orders.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("shots"))), "chunk shots expected layouts", "", "problem")


# ---- sources and sinks --------------------------------------------------------------------------------


@query("s1_read_mechanisms", """WITH m AS (SELECT l_discount AS p, l_suppkey AS a, l_partkey % 50 AS b, l_linenumber AS o FROM lineitem)
SELECT det, count(*) AS mechanisms, round(sum(p), 6) AS p_sum, sum(has_obs)::BIGINT AS with_obs FROM (SELECT p, unnest(CASE WHEN a = b THEN [a] ELSE [a, b] END) AS det, CASE WHEN o % 2 = 1 THEN 1 ELSE 0 END AS has_obs FROM m) GROUP BY det""")
def read_mechanisms(t: Tables):
    """Every line item as one decomposed error line: D a D b ^ D b ^ D b L o, whose repeats cancel."""
    path = scratch_path(t.spark, "mechanisms")
    a, b = F.col("l_suppkey").cast("string"), (F.col("l_partkey") % 50).cast("string")
    same = F.col("l_suppkey") == F.col("l_partkey") % 50
    targets = F.when(same, F.concat_ws("", F.lit("D"), a)).otherwise(F.concat_ws("", F.lit("D"), a, F.lit(" D"), b, F.lit(" ^ D"), b, F.lit(" ^ D"), b))
    obs = F.when(F.col("l_linenumber") % 2 == 1, " L1").otherwise(" L1 ^ L1")
    t.lineitem.select(F.concat(F.lit("error("), F.col("l_discount").cast("string"), F.lit(") "), targets, obs).alias("value")).write.text(path)
    mech, edges, obs_edges, _ = runs.read_mechanisms(t.spark, path)
    flips = obs_edges.select("fault", F.lit(1).alias("_o")).distinct()
    out = edges.join(mech, "fault").join(flips, "fault", "left").groupBy("det").agg(
        F.count("*").alias("mechanisms"), F.round(F.sum("p"), 6).alias("p_sum"), F.count("_o").alias("with_obs"))
    return out


@query("s2_read_incidence", f"WITH {I.SUPPLY} SELECT 'edges' AS part, count(*) AS n, sum(det * 31 + fault)::BIGINT AS s FROM edges UNION ALL SELECT 'obs', count(*), sum(obs * 31 + fault)::BIGINT FROM obs_edges UNION ALL SELECT 'detectors', count(*), sum(round)::BIGINT FROM detectors")
def read_incidence(t: Tables):
    path = scratch_path(t.spark, "incidence")
    runs.write_incidence(I.supply(t), path)
    inc = runs.read_incidence(t.spark, path)

    def tally(df, part, expr):
        return df.agg(F.count("*").alias("n"), F.sum(expr).cast("bigint").alias("s")).select(F.lit(part).alias("part"), "n", "s")

    return (tally(inc.edges, "edges", F.col("det") * 31 + F.col("fault")).unionByName(tally(inc.obs_edges, "obs", F.col("obs") * 31 + F.col("fault")))
            .unionByName(tally(inc.detectors, "detectors", F.col("round"))))


@query("s3_write_incidence", f"""WITH {I.SUPPLY}, d AS (SELECT 'row' AS side, det AS id, count(*) AS d FROM edges GROUP BY ALL UNION ALL SELECT 'column', fault, count(*) FROM edges GROUP BY ALL)
SELECT side, min(d) AS min, max(d) AS max, round(avg(d), 9) AS mean FROM d GROUP BY side""")
def write_incidence(t: Tables):
    path = scratch_path(t.spark, "incidence")
    runs.write_incidence(I.supply(t), path)
    return shaped(t.spark.read.parquet(f"{path}/statistics"), "min max", "mean", "side")


@query("s5_read_shots", f"WITH {I.FIRED} SELECT shot, det FROM fired WHERE shot >= 1000 AND shot < 11000")
def read_shots(t: Tables):
    path = scratch_path(t.spark, "shots")
    toy, faults = I.toy(t), I.true_faults(t)
    shots.write_shots(gf2.gf2_product(faults, toy.edges), gf2.predict_class(faults, toy.column_class()), path)
    fired, _, _ = shots.read_shots(t.spark, path, 1000, 10000, toy.detectors)
    return fired


RAG = "sup AS (SELECT l_orderkey AS shot, list(DISTINCT l_partkey ORDER BY l_partkey) AS v FROM lineitem GROUP BY 1), p AS (SELECT shot, v, sum(len(v)) OVER (ORDER BY shot)::BIGINT AS e FROM sup)"


def _supports(t: Tables):
    return gf2.canonical_support(t.lineitem.select(F.col("l_orderkey").alias("shot"), F.col("l_partkey").alias("fault")))


@query("s11_rows_to_ragged", f'WITH {RAG} SELECT shot, e - len(v) AS "begin", e AS "end" FROM p')
def rows_to_ragged(t: Tables):
    pointers, _ = runs.rows_to_ragged(_supports(t), ["shot"], "faults")
    return pointers


@query("s11_ragged_to_rows", f"WITH {RAG}, u AS (SELECT shot, e - len(v) AS b, v, unnest(range(len(v))) AS i FROM p) SELECT shot, b + i AS position, v[i + 1] AS value FROM u")
def ragged_to_rows(t: Tables):
    return runs.ragged_to_rows(*runs.rows_to_ragged(_supports(t), ["shot"], "faults"), ["shot"])


@query("s13_strict_json", """SELECT o_custkey, count(*) AS n, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN round(count(*)/count(*) FILTER (o_orderstatus = 'P'), 6) END AS ratio FROM orders GROUP BY 1""")
def strict_json(t: Tables):
    """Summaries with infinite ratios, written as JSON text and parsed back."""
    path = scratch_path(t.spark, "summary")
    p = F.count_if(F.col("o_orderstatus") == "P")
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.when(p == 0, float("inf")).otherwise(F.count("*") / p).alias("ratio"))
    runs.write_summary(per, path)
    parsed = t.spark.read.text(path).select(F.from_json("value", "o_custkey bigint, n bigint, ratio double").alias("j"))
    return shaped(parsed.select("j.*"), "o_custkey n", "ratio", digits=6)


@query("a16_scale_free_rank", "SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, o_orderkey FROM orders")
def dense_rank(t: Tables):
    return ranks.dense_numbers(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderkey"], "i", ["o_orderstatus"])
