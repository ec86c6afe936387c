"""Window plans over the timed incidence (months are rounds) and its checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from paritas.catalog import inputs as I
from paritas.catalog.base import Tables, query, shaped
from paritas.operators import checks
from paritas.operators.gf2 import gf2_product
from paritas.plans import windows as P
from paritas.plans.spec import WindowSpec
from paritas.session import scratch_path
from paritas.sources import runs

W, CM = 4, 2
SPEC = WindowSpec(width=W, commit=CM, converge_rounds=W)
M = I.CHECKS

# The plan in SQL, for one attempt: windows by range condition.


def places_sql(w: int, c: int) -> str:
    return f"""rt AS (SELECT max(r) AS rt FROM rounds_of), kk AS (SELECT greatest(0, ceil((rt - {w})/{c}))::BIGINT + 1 AS k, rt FROM rt),
pl AS (SELECT w AS "window", 1 + w*{c} AS t, CASE WHEN w = k - 1 THEN rt ELSE w*{c} + {w} END AS last, w = k - 1 AS final, rt FROM kk, range((SELECT k FROM kk)) x(w))"""


def seen_sql(w: int, c: int) -> str:
    return f"""{I.TIMED}, {places_sql(w, c)}, seen AS (SELECT "window", t, last, final, fault, s, p, cls FROM pl JOIN t_faults ON s BETWEEN t AND last),
cl AS (SELECT seen.*, (SELECT list(det ORDER BY det) FROM t_edges e WHERE e.fault = seen.fault AND det < last*{M}) AS sup FROM seen),
col AS (SELECT "window", min(fault) AS fault, s, count(*) AS members, CASE WHEN count(*) = 1 THEN min(p) ELSE (1 - product(1 - 2*p))/2 END AS p,
 bool_and(final OR s < t + {c}) AS "commit", arg_min(cls, fault) AS cls0, sup FROM cl GROUP BY "window", s, sup, CASE WHEN NOT final AND s = last THEN -1 ELSE fault END)"""


PLACES, SEEN = places_sql(W, CM), seen_sql(W, CM)


def plan(t: Tables, spec: WindowSpec = SPEC):
    return P.plan_windows(I.timed(t), spec)


@query("x1_plan_windows", f"""WITH {SEEN} SELECT "window", fault, s, members, round(p, 9) AS p, CAST("commit" AS INT)::BIGINT AS "commit", CASE WHEN "commit" THEN cls0 ELSE 0 END::BIGINT AS cls FROM col""")
def plan_columns(t: Tables):
    return shaped(plan(t).columns, "window fault s members commit cls", "p")


@query("x1_plan_edges", f'WITH {SEEN} SELECT "window", fault, unnest(sup) AS det FROM col')
def plan_edges(t: Tables):
    return shaped(plan(t).edges, "window fault det")


@query("p8_commit_and_converge", f"""WITH {I.TIMED}, {PLACES.replace(str(W) + ' AS', str(W) + ' AS')} SELECT "window", det, CAST(final OR det // {M} + 1 <= t + 2 AS INT)::BIGINT AS converge FROM pl JOIN timed_detectors d ON d.round BETWEEN t AND last""")
def commit_and_converge(t: Tables):
    return shaped(plan(t, replace(SPEC, converge_rounds=3)).rows, "window det converge")


@query("j12_assign_windows", f'WITH {I.TIMED}, {PLACES} SELECT "window", fault, s FROM pl JOIN t_faults ON s BETWEEN t AND last')
def assign_windows(t: Tables):
    inc = I.timed(t)
    return shaped(P.assign_windows(inc, SPEC, P.time_shape(inc)[0]), "window fault s")


@query("j13_detector_rule_sets", f"""WITH {I.TIMED}, {PLACES} SELECT "window", fault, CAST(final OR s < t + {CM} AS INT)::BIGINT AS "commit" FROM pl JOIN t_faults ON s BETWEEN t AND last""")
def detector_rule_sets(t: Tables):
    inc = I.timed(t)
    return shaped(P.detector_rule_sets(inc, SPEC, P.time_shape(inc)[0]), "window fault commit")


T0 = 11


@query("p7_cut_window", f"""WITH {I.TIMED}, seen AS (SELECT * FROM t_faults WHERE s BETWEEN {T0} AND {T0 + W - 1}),
cl AS (SELECT seen.*, (SELECT list(det ORDER BY det) FROM t_edges e WHERE e.fault = seen.fault AND det < {(T0 + W - 1) * M}) AS sup FROM seen)
SELECT min(fault) AS fault, s, count(*) AS members, round(CASE WHEN count(*) = 1 THEN min(p) ELSE (1 - product(1 - 2*p))/2 END, 9) AS p, CAST(s < {T0 + CM} AS INT)::BIGINT AS "commit" FROM cl GROUP BY s, sup, CASE WHEN s = {T0 + W - 1} THEN -1 ELSE fault END""")
def cut_window(t: Tables):
    columns, _ = P.cut_window(I.timed(t), T0, SPEC)
    return shaped(columns, "fault s members commit", "p")


DEFER = replace(SPEC, on_failure="defer", max_deferrals=2)


@query("x1_plan_deferrals", f"""WITH {I.TIMED}, rt AS (SELECT max(r) AS rt FROM rounds_of), kk AS (SELECT greatest(0, ceil((rt - {W})/{CM}))::BIGINT + 1 AS k, rt FROM rt),
pl AS (SELECT w AS "window", a AS attempt, 1 + w*{CM} AS t, w*{CM} + {W} + a*{CM} AS e, rt FROM kk, range((SELECT k FROM kk)) x(w), range(3) y(a))
SELECT pl."window", attempt, least(e, rt) AS last_round, CAST(e >= rt AS INT)::BIGINT AS final, count(*) AS faults FROM pl JOIN t_faults ON s BETWEEN t AND e WHERE attempt = 0 OR e - {CM} < rt GROUP BY ALL""")
def plan_deferrals(t: Tables):
    p = plan(t, DEFER)
    counts = p.members.groupBy(*P.PLACE).agg(F.count("*").alias("faults"))
    return shaped(p.placements.join(counts, P.PLACE), "window attempt last_round final faults")


SHAPE_SQL = f"""{SEEN}, ent AS (SELECT "window", list([sup2::VARCHAR, p::VARCHAR, "commit"::VARCHAR, cls::VARCHAR] ORDER BY fault) AS content FROM (
 SELECT "window", fault, p, "commit", CASE WHEN "commit" THEN cls0 ELSE 0 END AS cls, list_transform(sup, lambda d: d - "window"*{CM * M}) AS sup2 FROM col) GROUP BY "window"),
sz AS (SELECT "window", count(*) AS n FROM pl JOIN timed_detectors d ON d.round BETWEEN t AND last GROUP BY "window"),
f AS (SELECT ent."window", min(ent."window") OVER (PARTITION BY content, n) AS f FROM ent JOIN sz USING ("window"))"""


@query("a38_dedup_shapes", f"""WITH {SHAPE_SQL} SELECT "window", dense_rank() OVER (ORDER BY f) - 1 AS shape FROM f""")
def dedup_shapes(t: Tables):
    return shaped(P.dedup_shapes(plan(t)), "window shape")


@query("a38_verify_shapes", f"""WITH {SHAPE_SQL}, s AS (SELECT "window", dense_rank() OVER (ORDER BY f) - 1 AS shape FROM f) SELECT shape, count(*) AS placements, 0::BIGINT AS different FROM s GROUP BY shape""")
def verify_shapes(t: Tables):
    p = plan(t)
    shapes = P.dedup_shapes(p)
    bad = P.verify_shapes(p, shapes).groupBy("shape").agg(F.count("*").alias("different"))
    return shaped(shapes.groupBy("shape").agg(F.count("*").alias("placements")).join(bad, "shape", "left").fillna(0, ["different"]), "shape placements different")


@query("a39_plan_stats", f"""WITH {SHAPE_SQL}, c AS (SELECT "window", count(*) AS n, sum(len(sup)) AS e, count(*) FILTER (members > 1) AS m FROM col GROUP BY "window")
SELECT count(DISTINCT f) AS shapes, count(*) AS placements, count(*) AS positions, (SELECT max(n) FROM sz) AS max_rows, (SELECT max(n) FROM c) AS max_columns, (SELECT max(e)::BIGINT FROM c) AS max_edges,
(SELECT sum(m)::BIGINT FROM c WHERE "window" IN (SELECT f FROM f)) AS merged_columns, 0::BIGINT AS committed_virtual FROM f""")
def plan_stats(t: Tables):
    p = plan(t)
    return shaped(P.plan_stats(p, P.dedup_shapes(p)), "shapes placements positions max_rows max_columns max_edges merged_columns committed_virtual")


@query("a41_commit_partition", f"WITH {I.TIMED} SELECT 'not_committed_once' AS code, fault || ':2' AS detail FROM t_faults WHERE s <= {CM}")
def commit_partition(t: Tables):
    """The plan's own sets are a partition; window 0's set is added twice to show what a violation looks like."""
    sets = P.commit_sets(plan(t))
    return checks.check_commit_partition(sets.unionByName(sets.where("window = 0")), I.timed(t).faults)


UNIFORM = WindowSpec(width=W, commit=CM, converge_rounds=W, boundary="uniform")
BULK = f"""{I.TIMED}, sup AS (SELECT fault, list(det ORDER BY det) AS sup FROM t_edges GROUP BY fault), rt AS (SELECT max(r) AS rt FROM rounds_of),
bulk AS (SELECT fault FROM t_faults WHERE s BETWEEN {1 + CM} AND {CM + W}),
sh AS (SELECT w AS "window", (w - 1)*{CM * M} AS shift FROM range((SELECT ceil(rt/{CM})::BIGINT FROM rt)) x(w)),
mv AS (SELECT b.fault, sh.shift, list_transform(s.sup, lambda d: d + sh.shift) AS sup FROM bulk b JOIN sup s USING (fault), sh),
mp AS (SELECT mv.fault, shift, min(t.fault) AS target, count(t.fault) AS matches FROM mv LEFT JOIN sup t ON t.sup = mv.sup GROUP BY ALL)"""


@query("j6_map_shifted_columns", f"WITH {BULK} SELECT fault, shift, target, matches FROM mp")
def map_shifted(t: Tables):
    inc = I.timed(t)
    rounds, m = P.time_shape(inc)
    first = P.column_rounds(inc).where(F.col("first_round").between(1 + CM, CM + W)).select("fault")
    shifts = t.spark.range(P.position_count(UNIFORM, rounds)).select(((F.col("id") - 1) * CM * m).alias("shift"))
    return shaped(P.map_shifted_columns(inc, first, shifts), "fault shift target matches")


@query("x2_uniform_plan", f"""WITH {BULK}, loc AS (SELECT f.*, (SELECT list(det ORDER BY det) FROM t_edges e WHERE e.fault = f.fault AND det < {(CM + W) * M}) AS sup FROM t_faults f WHERE s BETWEEN {1 + CM} AND {CM + W}),
g AS (SELECT min(fault) AS fault, count(*) AS members, s FROM loc GROUP BY s, sup, CASE WHEN s = {CM + W} THEN -1 ELSE fault END)
SELECT sh."window", g.fault, g.s, members, mp.target AS global_fault, CAST(g.s < {1 + 2 * CM} AS INT)::BIGINT AS "commit" FROM g JOIN mp USING (fault) JOIN sh ON sh.shift = mp.shift""")
def uniform_plan(t: Tables):
    return shaped(plan(t, UNIFORM).columns, "window fault s members global_fault commit")


def order_shots(t: Tables):
    """Shots on the timed incidence: a customer's orders are the faults that happened."""
    o = I.timed_orders(t).join(t.orders.select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("shot")), "order")
    named = o.select("shot", F.least("d1", "d2").alias("lo"), F.greatest("d1", "d2").alias("hi"))
    edges = I.timed(t).edges.groupBy("fault").agg(F.min("det").alias("lo"), F.max("det").alias("hi"))
    return named.join(edges, ["lo", "hi"]).groupBy("shot", "fault").agg(F.count("*").alias("c")).where("c % 2 = 1").select("shot", "fault")


ORDER_SHOTS = """sf AS (SELECT o_custkey AS shot, tf.fault FROM timed_orders t JOIN orders ON o_orderkey = t."order" JOIN tf ON tf.lo = least(d1, d2) AND tf.hi = greatest(d1, d2) GROUP BY ALL HAVING count(*) % 2 = 1),
sfired AS (SELECT shot, det FROM sf JOIN t_edges USING (fault) GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("j18_localize", f"""WITH {I.TIMED}, {PLACES}, {ORDER_SHOTS} SELECT "window", shot, det - "window"*{CM * M} AS "row" FROM sfired JOIN pl ON det >= (t - 1)*{M} AND det < last*{M}""")
def localize(t: Tables):
    fired = gf2_product(order_shots(t), I.timed(t).edges)
    return shaped(P.localize(fired, plan(t)), "window shot row")


@query("j18_globalize", f"""WITH {BULK}, loc AS (SELECT f.*, (SELECT list(det ORDER BY det) FROM t_edges e WHERE e.fault = f.fault AND det < {(CM + W) * M}) AS sup FROM t_faults f WHERE s BETWEEN {1 + CM} AND {CM + W}),
g AS (SELECT min(fault) AS fault FROM loc GROUP BY s, sup, CASE WHEN s = {CM + W} THEN -1 ELSE fault END)
SELECT sh."window", count(*) AS columns, count(mp.target) AS mapped FROM g JOIN mp USING (fault) JOIN sh ON sh.shift = mp.shift GROUP BY ALL""")
def globalize(t: Tables):
    p = plan(t, UNIFORM)
    out = P.globalize(p.columns.select(*P.PLACE, "fault"), p)
    return out.groupBy("window").agg(F.count("*").alias("columns"), F.count("global_fault").alias("mapped"))


@query("s15_window_plan_roundtrip", f"""WITH {SEEN} SELECT 'columns' AS part, count(*) AS n FROM col UNION ALL SELECT 'edges', sum(len(sup))::BIGINT FROM col UNION ALL SELECT 'placements', count(*) FROM pl
UNION ALL SELECT 'members', count(*) FROM seen UNION ALL SELECT 'rows', count(*) FROM pl JOIN timed_detectors d ON d.round BETWEEN t AND last""")
def plan_roundtrip(t: Tables):
    path = scratch_path(t.spark, "plan")
    p = plan(t)
    runs.write_window_plan(p.tables(), p.spec.json(), path)
    tables, spec = runs.read_window_plan(t.spark, path, list(p.tables()))
    if WindowSpec.parse(spec) != p.spec:
        raise ValueError("the stored specification differs")
    parts = [tables[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
