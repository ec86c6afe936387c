"""Streaming queries: run over what is available into a sink, compared with the batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritas.catalog import inputs as I
from paritas.catalog import plans as PL
from paritas.catalog.base import Tables, query, shaped
from paritas.catalog.decoding import TIMED_SPEC, TimedWindowsSql, WindowSql, loaded, toy_shots
from paritas.catalog.selection import HISTORY, _history_sql, history_windows
from paritas.operators import campaign as C
from paritas.operators import gf2, sparse, windowed
from paritas.plans.spec import RelaySpec, WindowSpec
from paritas.plans.windows import plan_windows
from paritas.session import cut_lineage, scratch_path
from paritas.streaming import batches, history
from paritas.streaming import windowed as SW


#: Files that a micro-batch takes.
FILES = 8


def round_files(t: Tables) -> str:
    """Round files in three deliveries; the last rounds arrive first."""
    path = scratch_path(t.spark, "rounds")
    _, shots, fired, _ = toy_shots(t)
    rows = SW.round_rows(fired, shots, 7, 2)
    for part in ("round > 5", "round between 3 and 5", "round < 3"):
        rows.where(part).write.mode("append").parquet(path)
    return path


@query("s16_round_stream", f"WITH {I.FIRED} SELECT r + 1 AS round, (SELECT count(*) FROM shots) AS shots, (SELECT count(*) FROM fired WHERE det // 2 = r) AS fired, CAST(r = 6 AS INT)::BIGINT AS final FROM range(7) x(r)")
def round_stream(t: Tables):
    stream = SW.read_round_stream(t.spark, round_files(t), FILES)
    sink = SW.run_available(stream, scratch_path(t.spark, "stream"))
    out = sink.groupBy("round").agg(F.count("*").alias("shots"), F.sum(F.size("fired")).alias("fired"), F.bool_or("is_final").alias("final"))
    return shaped(out, "round shots fired final")


SUBSET = 'shot, "window", attempts, converged, unexplained, flagged, frame, weight, committed_weight, solution, committed'


def _commits(out):
    """The commit records of a batch decoder's output."""
    rows = out.where("kind = 'commit'").select("shot", "record.*")
    return rows.withColumn("solution", F.array_join("solution", ",")).withColumn("committed", F.array_join("committed", ","))


def _streamed(t: Tables, spec: WindowSpec, parts: list[str], max_size: int | None = None, repeat: bool = False):
    """Commits of the toy shots' rounds in deliveries, one micro-batch each, decoded set-at-a-time; ``repeat`` sends each row twice."""
    inc, shots, fired, _ = toy_shots(t)
    plan = plan_windows(inc, spec)
    decoder = batches.BatchDecoder(plan, sparse.Lookup(plan, max_size), scratch_path(t.spark, "decoder"))
    rows = SW.round_rows(fired, shots, 7, 2)
    return _commits(delivered(t, rows.unionByName(rows) if repeat else rows, [(part, "2024-01-01") for part in parts], decoder))


DELIVERIES = ["round > 5", "round between 3 and 5", "round < 3"]
REPORT = "shot window attempts converged unexplained flagged frame", "weight committed_weight", "solution committed"


def _tables(t: Tables, spec: WindowSpec, max_size=None):
    plan = loaded(t, spec)
    return plan, SW.collect_tables(plan, windowed.lookup_inner(t.spark, plan, max_size))


@query("x7_stream_decode", WindowSql(3, 1).sql(f"SELECT {SUBSET} FROM wins"))
def stream_decode(t: Tables):
    """Rounds arrive in reverse deliveries; the decode of open shots equals the batch decode."""
    return shaped(_streamed(t, WindowSpec(3, 1, 3), DELIVERIES), *REPORT, digits=6)


@query("x8_stream_deferral", WindowSql(2, 1, "defer", 2, 1).sql(f"SELECT {SUBSET} FROM wins"))
def stream_deferral(t: Tables):
    """Deferred windows wait for the rounds of their wider attempt, over several deliveries."""
    return shaped(_streamed(t, WindowSpec(2, 1, 2, on_failure="defer", max_deferrals=2), DELIVERIES, 1), *REPORT, digits=6)


@query("x9_contract_errors", f"""WITH e AS (SELECT user_id AS shot, k + 1 AS round, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS i FROM (SELECT user_id, event_id, (props::JSON->>'k')::BIGINT % 9 AS k FROM events))
SELECT CASE WHEN round > 7 THEN 'round ' || round || ' outside 1..7' END AS detail, count(*) AS n FROM e WHERE round > 7 GROUP BY ALL""")
def contract_errors(t: Tables):
    """Users as shots whose events claim rounds 1 to 9 of a seven-round experiment, with repeats."""
    plan, tables = _tables(t, WindowSpec(3, 1, 3))
    k = F.get_json_object("props", "$.k").cast("bigint") % 9
    rows = t.events.select(F.col("user_id").alias("shot"), (k + 1).cast("int").alias("round"), F.array(F.lit(0), F.lit(1)).alias("fired"), F.lit(False).alias("is_final"))
    out = SW.stream_decode(rows, plan, tables)
    return out.where("kind = 'error'").groupBy("detail").agg(F.count("*").alias("n"))


@query("x10_out_of_order", WindowSql(4, 2).sql('SELECT shot, "window", frame, committed FROM wins'))
def out_of_order(t: Tables):
    """Every round delivered twice, the last rounds first and again with the others: duplicates drop, results stay."""
    out = _streamed(t, WindowSpec(4, 2, 4), ["round > 3", "round < 4", "round > 5"], repeat=True)
    return shaped(out, "shot window frame", "", "committed")


def delivered(t: Tables, rows, parts: list[tuple[str, str]], decoder: batches.BatchDecoder):
    """The decoder's output after deliveries of round rows: (which rows, when they arrive). Every delivery restarts the stream."""
    path = scratch_path(t.spark, "deliveries")
    rows, out = cut_lineage(rows), None  # made once, not for every delivery
    for part, arrived in parts:
        sent = rows.where(part).withColumn("arrived", F.to_timestamp(F.lit(arrived)))
        sent.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in batches.ROUND_SCHEMA.split(", ")]).write.mode("append").parquet(path)
        out = batches.run_decoder(t.spark.readStream.schema(batches.ROUND_SCHEMA).parquet(path), decoder)
    return out


@query("x7_stream_any_inner", TimedWindowsSql().sql("""SELECT shot, "window", converged, iterations, unexplained, weight, committed_weight, solution, committed FROM wins"""))
def stream_any_inner(t: Tables):
    """Rounds of the timed incidence in three deliveries, windows of hundreds of columns decoded by message passing inside the stream."""
    inc = I.timed(t)
    plan = plan_windows(inc, TIMED_SPEC)
    fired = gf2.gf2_product(PL.order_shots(t), inc.edges)
    rows = SW.round_rows(fired, t.orders.select(F.col("o_custkey").alias("shot")).distinct(), plan.rounds_total, plan.per_round)
    decoder = batches.BatchDecoder(plan, sparse.MessagePassing(RelaySpec(TimedWindowsSql.ITERATIONS, alpha=None)), scratch_path(t.spark, "decoder"))
    out = delivered(t, rows, [("round > 60", "2024-01-01"), ("round <= 30", "2024-01-02"), ("round between 31 and 60", "2024-01-03")], decoder)
    return shaped(_commits(out), "shot window converged iterations unexplained", "weight committed_weight", "solution committed", digits=6)


LOST_ROUND = "shot % 50 = 6"


@query("x10_late_and_abandoned", WindowSql(4, 2).sql(f"""SELECT shot, 'commit' AS kind, "window", frame, committed, NULL::VARCHAR AS detail FROM wins WHERE NOT ({LOST_ROUND})
UNION ALL SELECT shot, 'error', NULL, NULL, NULL, 'abandoned' FROM shots WHERE {LOST_ROUND}"""))
def late_and_abandoned(t: Tables):
    """Four deliveries: even shots without some rounds 4, repeated rounds, a day later odd shots, then the missing rounds, too late.

    The watermark passes the even shots with the third delivery: incomplete ones are abandoned, and what is late of them is dropped.
    """
    inc, shots, fired, _ = toy_shots(t)
    plan = plan_windows(inc, WindowSpec(4, 2, 4))
    decoder = batches.BatchDecoder(plan, sparse.Lookup(plan), scratch_path(t.spark, "decoder"), delay_seconds=3600)
    even, lost = "shot % 2 = 0", f"({LOST_ROUND} AND round = 4)"
    out = delivered(t, SW.round_rows(fired, shots, 7, 2), [
        (f"{even} AND NOT {lost} AND round > 2", "2024-01-01 00:00:00"), (f"{even} AND NOT {lost} AND round < 5", "2024-01-01 00:10:00"),
        ("shot % 2 = 1", "2024-01-02 00:00:00"), (f"{even} AND round > 3", "2024-01-01 00:20:00")], decoder)
    return shaped(out.select("shot", "kind", "detail", "record.*").withColumn("committed", F.array_join("committed", ",")), "shot window frame", "", "kind committed detail")


@query("x9_contract_kinds", """WITH e AS (SELECT o_orderkey % 6 AS k FROM orders)
SELECT detail, count(*) AS n FROM (SELECT CASE k WHEN 0 THEN 'round_outside:9' WHEN 1 THEN 'detector_outside:1' WHEN 2 THEN 'out_of_order:3' WHEN 3 THEN 'missing_at_close:7' WHEN 4 THEN 'after_close:6' ELSE 'abandoned' END AS detail FROM e
UNION ALL SELECT 'abandoned' FROM e WHERE k = 4) GROUP BY detail""")
def contract_kinds(t: Tables):
    """Every contract error of a strict stream: a shot breaks the rule that its key chooses. Incomplete shots are abandoned a day later."""
    inc, shots, _, _ = toy_shots(t)
    plan = plan_windows(inc, WindowSpec(4, 2, 4))
    decoder = batches.BatchDecoder(plan, sparse.Lookup(plan), scratch_path(t.spark, "decoder"), strict=True, delay_seconds=3600)

    def row(number: int, dets: str = "", final: str = "false") -> str:
        return f"struct(1 AS part, {number} AS round, CAST(array({dets}) AS array<int>) AS fired, {final} AS is_final)"

    sent = {0: [row(9)], 1: [row(1, "5")], 2: [row(3)], 3: [row(7, "", "true")], 4: [*map(row, range(1, 5)), row(5, "", "true"), row(6).replace("1 AS part", "2 AS part")], 5: [row(1), row(2)]}
    cases = " ".join(f"WHEN {k} THEN array({', '.join(v)})" for k, v in sent.items())
    rows = shots.selectExpr("shot", f"explode(CASE shot % 6 {cases} END) AS r").select("shot", "r.*")
    clock = t.spark.range(1).selectExpr("-1L AS shot", f"{row(1)} AS r").select("shot", "r.*").withColumn("part", F.lit(3))
    parts = [("part = 1", "2024-01-01 00:00:00"), ("part = 2", "2024-01-01 00:30:00"), ("part = 3", "2024-01-02 00:00:00")]
    out = delivered(t, rows.unionByName(clock), parts, decoder)
    return out.where("kind = 'error'").groupBy("detail").agg(F.count("*").alias("n"))


@query("x11_stream_history", f"WITH {HISTORY} {_history_sql(1)} UNION ALL {_history_sql(3)} UNION ALL {_history_sql(7)}")
def stream_history(t: Tables):
    path = scratch_path(t.spark, "confidences")
    rows = history_windows(t)
    for part in ("window < 10", "window >= 10"):
        rows.where(part).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in history.WINDOW_SCHEMA.split(", ")]).repartition("shot").write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(history.WINDOW_SCHEMA).option("maxFilesPerTrigger", FILES).parquet(path)
    sink = SW.run_available(history.stream_history(stream, [1, 3, 7]), scratch_path(t.spark, "stream"))
    return shaped(sink, "shot window length first_legs first_iterations", "gap agreement weight q_supp density", "state", digits=6)


@query("x12_stream_window_events", f"""WITH {I.WINDOWS} SELECT count(*) FILTER (NOT converged) AS not_converged, count(*) FILTER (attempts > 1) AS deferred, count(*) FILTER (attempts > 1 AND NOT converged) AS limit_reached, count(*) FILTER (cap_hit) AS cap_hit FROM windows""")
def stream_window_events(t: Tables):
    """The event counts as a streaming aggregate; each batch's result replaces the sink's table."""
    path = scratch_path(t.spark, "windows")
    I.windows(t).write.parquet(path)
    out = scratch_path(t.spark, "events")
    stream = t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = C.window_events(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(
        lambda df, _: df.write.mode("overwrite").parquet(f"{out}/table")).trigger(availableNow=True).start()
    q.awaitTermination()
    return shaped(t.spark.read.parquet(f"{out}/table"), "not_converged deferred limit_reached cap_hit")
