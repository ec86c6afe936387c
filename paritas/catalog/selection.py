"""Recorded solutions, confidence, stop rules, replay and history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paritas.catalog import inputs as I
from paritas.catalog.base import Tables, query, shaped, wilson_sql
from paritas.catalog.incidence import COMPONENTS, LAM
from paritas.functions.intervals import wilson
from paritas.operators import gf2
from paritas.operators import selection as L

CAPACITY = 5
ORDER = ["o1", "o2", "o3"]

SLOTS = f"""{I.LINES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY decode ORDER BY o1, o2, o3) - 1 AS slot, count(*) OVER (PARTITION BY decode) AS found FROM lines),
kept0 AS (SELECT *, sum(iterations) OVER (PARTITION BY decode ORDER BY slot)::BIGINT AS cumulative FROM ranked WHERE slot < {CAPACITY}),
kept AS (SELECT *, row_number() OVER (PARTITION BY decode, hash ORDER BY slot) = 1 AS is_new, first_value(cls) OVER (PARTITION BY decode, hash ORDER BY slot) AS klass FROM kept0)"""
NEW = "new AS (SELECT * FROM kept WHERE is_new), best AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY decode ORDER BY weight, slot) = 1)"


def kept(t: Tables, capacity: int = CAPACITY):
    return L.slots(I.lines(t), ORDER, capacity)


@query("w1_slots", f"WITH {SLOTS} SELECT decode, slot, found, cls, hash, round(weight, 6) AS weight FROM kept")
def slots(t: Tables):
    return shaped(kept(t), "decode slot found cls hash", "weight", digits=6)


@query("w2_mark_new", f"WITH {SLOTS} SELECT decode, slot, CAST(is_new AS INT)::BIGINT AS is_new, klass FROM kept")
def mark_new(t: Tables):
    return shaped(kept(t), "decode slot is_new klass")


@query("w3_lowest_weight", f"WITH {SLOTS}, {NEW} SELECT decode, slot AS best_slot, round(weight, 6) AS weight, cls AS best_class FROM best")
def lowest_weight(t: Tables):
    return shaped(L.lowest_weight(kept(t)), "decode best_slot best_class", "weight", digits=6)


@query("w10_cumulative_iterations", f"WITH {SLOTS} SELECT decode, slot AS leg, sum(iterations) OVER (PARTITION BY decode ORDER BY slot)::BIGINT AS cumulative FROM ranked")
def cumulative(t: Tables):
    leg = F.row_number().over(Window.partitionBy("decode").orderBy(*ORDER)) - 1
    return shaped(L.cumulative_iterations(I.lines(t).withColumn("leg", leg)), "decode leg cumulative")


@query("w4_class_gap", f"""WITH {SLOTS}, {NEW}, o AS (SELECT n.decode, n.weight - b.weight AS gap, n.cls FROM new n JOIN best b USING (decode) WHERE n.cls <> b.cls
QUALIFY row_number() OVER (PARTITION BY n.decode ORDER BY n.weight, n.slot) = 1)
SELECT decode, CASE WHEN gap IS NULL THEN 'single_class' ELSE 'defined' END AS gap_state, round(gap, 6) AS gap, o.cls AS second_class FROM best LEFT JOIN o USING (decode)""")
def class_gap(t: Tables):
    return shaped(L.class_gap(L.confidence(kept(t))), "decode second_class", "gap", "gap_state", digits=6)


CLASSES = """cl AS (SELECT n.decode, n.cls, count(*) AS cnt, min(n.weight) AS w, min(n.slot) AS f, sum(exp(-(n.weight - b.weight))) AS z,
 arg_min(n.slot, n.weight) AS w_slot FROM new n JOIN best b USING (decode) GROUP BY ALL),
cs AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY decode ORDER BY z DESC, f) = 1),
ag AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY decode ORDER BY cnt DESC, w, f) = 1)"""


@query("a36_class_sum", f"WITH {SLOTS}, {NEW}, {CLASSES} SELECT decode, cls AS class_sum_class, round(z, 6) AS class_sum_top FROM cs")
def class_sum(t: Tables):
    return shaped(L.confidence(kept(t)), "decode class_sum_class", "class_sum_top", digits=6)


@query("a37_agreement", f"""WITH {SLOTS}, {NEW}, {CLASSES}, n AS (SELECT decode, count(*) AS d FROM new GROUP BY decode)
SELECT ag.decode, ag.cls AS agreement_class, round(bc.cnt / d, 9) AS agreement FROM ag JOIN n USING (decode) JOIN best b ON b.decode = ag.decode JOIN cl bc ON bc.decode = b.decode AND bc.cls = b.cls""")
def agreement(t: Tables):
    return shaped(L.confidence(kept(t)), "decode agreement_class", "agreement")


CONF = f"""{SLOTS}, {NEW}, {CLASSES},
second AS (SELECT n.decode, n.weight AS w2, n.cls AS second_class FROM new n JOIN best b USING (decode) WHERE n.cls <> b.cls QUALIFY row_number() OVER (PARTITION BY n.decode ORDER BY n.weight, n.slot) = 1),
fx AS (SELECT decode, max(found) AS found, count(*) AS seen, count(*) FILTER (is_new) AS d, min(cumulative) AS first_iterations FROM kept GROUP BY decode),
cc AS (SELECT decode, count(*) AS classes FROM cl GROUP BY decode),
conf AS (SELECT o_orderkey AS decode, coalesce(fx.found, 0) AS found, coalesce(seen, 0) AS seen, coalesce(d, 0) AS "distinct", coalesce(classes, 0) AS classes,
 coalesce(best.cls, o_custkey % 4) AS best_class, coalesce(best.weight, 'inf'::DOUBLE) AS weight,
 CASE WHEN fx.found IS NULL THEN 'none' WHEN w2 IS NULL THEN 'single_class' ELSE 'defined' END AS gap_state, w2 - best.weight AS gap, second_class,
 bc.cnt / d AS agreement, CASE WHEN fx.found IS NULL THEN 0 ELSE 1 END AS first_legs, coalesce(first_iterations, 0) AS first_iterations,
 coalesce(cs.cls, o_custkey % 4) AS class_sum_class, cs.z AS class_sum_top, coalesce(ag.cls, o_custkey % 4) AS agreement_class,
 best.slot AS best_slot, cs.w_slot AS class_sum_slot, ag.w_slot AS agreement_slot, o_custkey * 7 % 4 AS truth
 FROM orders LEFT JOIN fx ON fx.decode = o_orderkey LEFT JOIN cc ON cc.decode = o_orderkey LEFT JOIN best ON best.decode = o_orderkey
 LEFT JOIN second ON second.decode = o_orderkey LEFT JOIN cs ON cs.decode = o_orderkey LEFT JOIN ag ON ag.decode = o_orderkey
 LEFT JOIN cl bc ON bc.decode = o_orderkey AND bc.cls = best.cls)"""


def decodes(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("decode"), (F.col("o_custkey") % 4).alias("returned"), (F.col("o_custkey") * 7 % 4).alias("truth"))


def conf(t: Tables):
    return L.confidence(kept(t), decodes(t))


@query("r1_confidence", f"""WITH {CONF} SELECT decode, found, seen, "distinct", classes::BIGINT AS classes, best_class, round(weight, 6) AS weight, gap_state, round(gap, 6) AS gap, second_class,
round(agreement, 6) AS agreement, first_legs::BIGINT AS first_legs, first_iterations, class_sum_class, round(class_sum_top, 6) AS class_sum_top, agreement_class FROM conf""")
def confidence(t: Tables):
    return shaped(conf(t), "decode found seen distinct classes best_class second_class first_legs first_iterations class_sum_class agreement_class",
                  "weight gap agreement class_sum_top", "gap_state", digits=6)


@query("r2_select_solution", f"""WITH {CONF} SELECT decode, 'lowest_weight' AS rule, best_class AS decided_class, best_slot AS decided_slot FROM conf
UNION ALL SELECT decode, 'class_sum', class_sum_class, class_sum_slot FROM conf UNION ALL SELECT decode, 'largest_agreement', agreement_class, agreement_slot FROM conf""")
def select_solution(t: Tables):
    parts = [L.select_solution(conf(t), rule).withColumn("rule", F.lit(rule)) for rule in L.RULES]
    return shaped(parts[0].unionByName(parts[1]).unionByName(parts[2]), "decode decided_class decided_slot", "", "rule")


SIGNALS = {"gap": 15.0, "agreement": 0.6, "weight": 20.0, "first_legs": 0.0, "first_iterations": 30.0}
_SCORE = {"gap": "-gap", "agreement": "1 - agreement"}
_LOW = {"gap": "CASE WHEN gap_state = 'single_class' THEN TRUE ELSE gap < 15 END", "agreement": "agreement < 0.6"}


@query("f8_signals", f"WITH {CONF} " + " UNION ALL ".join(
    f"""SELECT decode, '{s}' AS signal, round(CASE WHEN gap_state = 'none' THEN 'inf'::DOUBLE ELSE {_SCORE.get(s, s)} END, 6) AS score,
CAST(CASE WHEN gap_state = 'none' THEN TRUE ELSE {_LOW.get(s, f'{s} > {v}')} END AS INT)::BIGINT AS low FROM conf""" for s, v in SIGNALS.items()))
def signals(t: Tables):
    table = conf(t)
    parts = [L.signal(table, s, v, single_class_is_low=True).withColumn("signal", F.lit(s)) for s, v in SIGNALS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return shaped(out, "decode low", "score", "signal", digits=6)


@query("f8_support_signal", f"""{COMPONENTS}, {LAM}, l AS (SELECT shot, component, sum(CASE WHEN isfinite(lam) THEN lam ELSE 0 END) AS l FROM comp JOIN lam USING (fault) GROUP BY ALL),
qs AS (SELECT shot, sqrt(sum(l*l))/(SELECT sum(lam) FROM lam WHERE isfinite(lam)) AS q FROM l GROUP BY shot), {CONF}
SELECT decode, round(CASE WHEN gap_state = 'none' THEN 'inf'::DOUBLE ELSE q END, 5) AS score, CAST(gap_state = 'none' OR coalesce(q > 0.02, FALSE) AS INT)::BIGINT AS low FROM conf LEFT JOIN qs ON shot = decode""")
def support_signal(t: Tables):
    """How concentrated the returned correction is, as a signal."""
    inc = I.supply(t)
    terms = gf2.cluster_terms(gf2.support_components(I.supply_support(t), inc.edges), inc.faults).withColumnRenamed("shot", "decode")
    table = L.signal(L.confidence(kept(t), decodes(t), terms), "q_supp", 0.02)
    return shaped(table, "decode low", "score", digits=5)


PREFIX = f"""{SLOTS}, pj AS (SELECT s.decode, s.slot, s.cumulative, s.found, p.slot AS ps, p.weight AS w, p.klass AS k, p.cls AS c, p.is_new AS nw FROM kept s JOIN kept p ON p.decode = s.decode AND p.slot <= s.slot),
pb AS (SELECT decode, slot, any_value(cumulative) AS cumulative, any_value(found) AS found, min(w) FILTER (nw) AS bw, arg_min(c, w) AS prefix_class, count(*) FILTER (nw) AS d FROM pj GROUP BY ALL),
pc AS (SELECT pb.*, (SELECT k FROM pj WHERE pj.decode = pb.decode AND pj.slot = pb.slot AND nw ORDER BY w, ps LIMIT 1) AS bc FROM pb),
prefix AS (SELECT pc.decode, pc.slot, any_value(pc.cumulative) AS cumulative, any_value(pc.found) AS found, any_value(bw) AS best_weight, any_value(bc) AS best_class, any_value(prefix_class) AS prefix_class, any_value(d) AS "distinct",
 count(*) FILTER (k = bc) AS legs_in_best, count(*) FILTER (k = bc AND nw) AS distinct_in_best, min(w) FILTER (nw AND k <> bc) - any_value(bw) AS gap FROM pc JOIN pj ON pj.decode = pc.decode AND pj.slot = pc.slot GROUP BY ALL)"""


@query("w5_prefix_state", f"""WITH {PREFIX} SELECT decode, slot, round(best_weight, 6) AS best_weight, best_class, prefix_class, "distinct", legs_in_best, distinct_in_best, round(gap, 6) AS gap FROM prefix""")
def prefix_state(t: Tables):
    return shaped(L.prefix_state(kept(t)), "decode slot best_class prefix_class distinct legs_in_best distinct_in_best", "best_weight gap", digits=6)


STOPS = {"fixed": ("FALSE", {}), "agree": ("legs_in_best >= 2", {"count": 2}), "agree_distinct": ("distinct_in_best >= 2", {"count": 2}),
         "gap": ("gap >= 20", {"gap": 20.0}), "gap_extend": ("slot + 1 >= 2 AND (gap IS NULL OR gap >= 20)", {"count": 2, "gap": 20.0})}


@query("w6_first_stop", f"WITH {PREFIX} " + " UNION ALL ".join(
    f"SELECT decode, '{r}' AS rule, min(slot) AS stop_slot FROM prefix WHERE {c} GROUP BY decode" for r, (c, _) in STOPS.items()))
def first_stop(t: Tables):
    prefix = L.prefix_state(kept(t))
    out = None
    for rule, (_, args) in STOPS.items():
        part = L.first_stop(prefix, rule, **args).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return shaped(out, "decode stop_slot", "", "rule")


def recorded(t: Tables):
    totals = I.lines(t).groupBy("decode").agg(F.sum("iterations").alias("iterations"), F.count("*").alias("legs"))
    return decodes(t).join(totals, "decode", "left").withColumn("iterations", F.coalesce("iterations", F.lit(0))).withColumn("legs", F.coalesce("legs", F.lit(0)))


def _replay_sql(rule: str) -> str:
    return f"""WITH {PREFIX}, tot AS (SELECT decode, sum(iterations)::BIGINT AS iterations, count(*) AS legs FROM lines GROUP BY decode),
hit AS (SELECT * FROM prefix WHERE {STOPS[rule][0]} QUALIFY row_number() OVER (PARTITION BY decode ORDER BY slot) = 1),
lst AS (SELECT * FROM prefix QUALIFY row_number() OVER (PARTITION BY decode ORDER BY slot DESC) = 1)
SELECT o_orderkey AS decode, CASE WHEN h.decode IS NOT NULL THEN h.slot + 1 WHEN l.found >= {CAPACITY} THEN {CAPACITY} ELSE coalesce(l.found, 0) END AS solutions,
CASE WHEN h.decode IS NOT NULL THEN h.prefix_class ELSE coalesce(l.best_class, o_custkey % 4) END AS decision,
CASE WHEN h.decode IS NOT NULL THEN h.cumulative WHEN l.found >= {CAPACITY} THEN l.cumulative ELSE coalesce(t.iterations, 0) END AS iterations,
CASE WHEN h.decode IS NOT NULL THEN h.slot + 1 WHEN l.found >= {CAPACITY} THEN l.slot + 1 ELSE coalesce(t.legs, 0) END AS legs, CAST(h.decode IS NOT NULL AS INT)::BIGINT AS by_rule
FROM orders LEFT JOIN hit h ON h.decode = o_orderkey LEFT JOIN lst l ON l.decode = o_orderkey LEFT JOIN tot t ON t.decode = o_orderkey"""


def _replay(rule: str):
    def build(t: Tables):
        out = L.replay(kept(t), recorded(t), CAPACITY, rule, **STOPS[rule][1])
        return shaped(out, "decode solutions decision iterations legs by_rule")

    return build


for _rule in STOPS:
    query(f"r3_replay_{_rule}", _replay_sql(_rule))(_replay(_rule))


@query("r4_refused_replays", f"SELECT most, s, CAST(s < 1 OR s > {CAPACITY} OR s > most AS INT)::BIGINT AS refused FROM (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)), (SELECT DISTINCT l_linenumber + l_quantity::BIGINT % 3 - 1 AS s FROM lineitem)")
def refused_replays(t: Tables):
    """Which replay sizes the recording supports."""
    sizes = t.lineitem.select((F.col("l_linenumber") + F.col("l_quantity").cast("bigint") % 3 - 1).alias("s")).distinct()
    return shaped(L.replay_refusals(kept(t), sizes, CAPACITY), "most s refused")


@query("r5_failure_causes", f"""WITH {CONF}, sn AS (SELECT k.decode, bool_or(k.klass = c.truth) AS seen FROM kept k JOIN conf c USING (decode) GROUP BY k.decode)
SELECT CASE WHEN best_class = truth THEN 'correct' WHEN gap_state = 'none' THEN 'no_solution' WHEN sn.seen THEN 'not_returned' ELSE 'never_found' END AS cause, count(*) AS n FROM conf LEFT JOIN sn USING (decode) GROUP BY ALL""")
def failure_causes(t: Tables):
    return shaped(L.failure_causes(kept(t), decodes(t)), "n", "", "cause")


WS = wilson_sql("failures", "shots")


@query("r6_rate_by_capacity", f"""WITH {SLOTS}, s AS (SELECT s FROM range(1, {CAPACITY + 1}) r(s)),
b AS (SELECT s, decode, klass FROM kept JOIN s ON slot < s WHERE is_new QUALIFY row_number() OVER (PARTITION BY s, decode ORDER BY weight, slot) = 1),
c AS (SELECT s.s, count(*) AS shots, count(*) FILTER (coalesce(b.klass, o_custkey % 4) <> o_custkey * 7 % 4) AS failures FROM orders CROSS JOIN s LEFT JOIN b ON b.decode = o_orderkey AND b.s = s.s GROUP BY s.s)
SELECT s, shots, failures, round({WS['rate']}, 9) AS rate, round({WS['lo']}, 9) AS lo, round({WS['hi']}, 9) AS hi FROM c""")
def rate_by_capacity(t: Tables):
    table = L.rate_by_capacity(kept(t), decodes(t), CAPACITY)
    rate, lo, hi = wilson(F.col("failures"), F.col("shots"))
    return shaped(table.select("*", rate.alias("rate"), lo.alias("lo"), hi.alias("hi")), "s shots failures", "rate lo hi")


@query("a26_solution_summary", f"WITH {SLOTS}, p AS (SELECT decode, max(found) AS found FROM kept GROUP BY decode) SELECT count(*) AS decodes, sum(found)::BIGINT AS found, max(found) AS most, count(*) FILTER (found > {CAPACITY}) AS beyond_capacity FROM p")
def solution_summary(t: Tables):
    return shaped(L.solution_summary(kept(t), CAPACITY), "decodes found most beyond_capacity")


@query("a25_confidence_summary", f"""WITH {CONF} SELECT count(*) AS decodes, count(*) FILTER (gap_state = 'none') AS "none", count(*) FILTER (gap_state = 'single_class') AS single_class,
count(*) FILTER (gap_state = 'defined') AS defined, count(*) FILTER (gap_state = 'none' OR gap_state = 'defined' AND gap < 15) AS low, count(*) FILTER (class_sum_class <> best_class) AS changed FROM conf""")
def confidence_summary(t: Tables):
    table = conf(t)
    return shaped(L.confidence_summary(table, L.signal(table, "gap", 15.0), "class_sum"), "decodes none single_class defined low changed")


# ---- history ------------------------------------------------------------------------------------

# The positions of a shot: every day from the first event to the last.
POSITIONS = """pos AS (SELECT DISTINCT user_id AS shot, d AS "window" FROM events,
 (SELECT unnest(range(lo, hi + 1)) AS d FROM (SELECT min("window") AS lo, max("window") AS hi FROM ev)))"""
HISTORY = f"""{I.WINDOWS},
cw AS (SELECT shot, "window", CASE WHEN bool_and(event_type = 'error') THEN 'none' WHEN count(DISTINCT event_type) = 1 THEN 'single_class' ELSE 'defined' END AS gap_state,
 CASE WHEN count(DISTINCT event_type) > 1 THEN (max(k) - min(k))::DOUBLE END AS gap, (1.0 + count(*) FILTER (k < 50))/(1.0 + count(*)) AS agreement, min(k)::DOUBLE AS weight, count(*) AS first_legs,
 sum(iterations)::BIGINT AS first_iterations, sum(k*k)::DOUBLE AS q_sum_sq, (sum(k) + 1)::DOUBLE AS q_total, count(*) FILTER (k % 2 = 1) AS ones, count(*) AS "rows" FROM ev GROUP BY ALL),
{POSITIONS},
hw AS (SELECT pos.shot, pos."window", cw.shot IS NOT NULL AS decoded, cw.* EXCLUDE (shot, "window") FROM pos LEFT JOIN cw ON cw.shot = pos.shot AND cw."window" = pos."window")"""


def positions(t: Tables):
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("bigint")
    days = t.events.agg(F.sequence(F.min(day), F.max(day))).scalar()
    return t.events.select(F.col("user_id").alias("shot")).distinct().withColumn("_days", days).select("shot", F.explode("_days").alias("window"))


def history_windows(t: Tables):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = t.events.select(F.col("user_id").alias("shot"), F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("bigint").alias("window"),
                        "event_type", F.floor("value").cast("bigint").alias("iterations"), k.alias("k"))
    kinds = F.count_distinct("event_type")
    cw = e.groupBy("shot", "window").agg(
        F.when(F.bool_and(F.col("event_type") == "error"), "none").when(kinds == 1, "single_class").otherwise("defined").alias("gap_state"),
        F.when(kinds > 1, (F.max("k") - F.min("k")).cast("double")).alias("gap"),
        ((1.0 + F.count_if(F.col("k") < 50)) / (1.0 + F.count("*"))).alias("agreement"), F.min("k").cast("double").alias("weight"),
        F.count("*").alias("first_legs"), F.sum("iterations").alias("first_iterations"), F.sum(F.col("k") * F.col("k")).cast("double").alias("q_sum_sq"),
        (F.sum("k") + 1).cast("double").alias("q_total"), F.count_if(F.col("k") % 2 == 1).alias("ones"), F.count("*").alias("rows"))
    return positions(t).join(cw.withColumn("decoded", F.lit(True)), ["shot", "window"], "left").withColumn("decoded", F.coalesce("decoded", F.lit(False)))


def _history_sql(length: int) -> str:
    w = f'OVER (PARTITION BY shot ORDER BY "window" ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)'
    real = "decoded AND gap_state <> 'none'"
    return f"""SELECT shot, "window", {length}::BIGINT AS length, CASE WHEN NOT u THEN 'none' WHEN g IS NOT NULL THEN 'defined' ELSE 'single_class' END AS state, CASE WHEN u THEN g END AS gap,
round(CASE WHEN u THEN a END, 6) AS agreement, CASE WHEN u THEN w ELSE 'inf'::DOUBLE END AS weight, CASE WHEN u THEN l END AS first_legs, CASE WHEN u THEN it END AS first_iterations,
round(CASE WHEN u THEN sqrt(sq)/tot END, 6) AS q_supp, round(CASE WHEN u THEN o/r END, 6) AS density FROM (SELECT shot, "window", bool_or(decoded) {w} AND NOT coalesce(bool_or(decoded AND gap_state = 'none') {w}, FALSE) AS u,
min(CASE WHEN {real} AND gap_state = 'defined' THEN gap END) {w} AS g, product(CASE WHEN {real} THEN agreement END) {w} AS a, sum(CASE WHEN {real} THEN weight END) {w} AS w,
(sum(CASE WHEN {real} THEN first_legs END) {w})::BIGINT AS l, (sum(CASE WHEN {real} THEN first_iterations END) {w})::BIGINT AS it, sum(CASE WHEN {real} THEN q_sum_sq END) {w} AS sq,
sum(CASE WHEN {real} THEN q_total END) {w} AS tot, sum(CASE WHEN {real} THEN ones END) {w} AS o, sum(CASE WHEN {real} THEN "rows" END) {w} AS r FROM hw)"""


@query("w7_signal_history", f"WITH {HISTORY} {_history_sql(1)} UNION ALL {_history_sql(3)} UNION ALL {_history_sql(7)}")
def signal_history(t: Tables):
    return shaped(L.signal_history(history_windows(t), [1, 3, 7]), "shot window length first_legs first_iterations",
                  "gap agreement weight q_supp density", "state", digits=6)


COMMITS = f"""{I.WINDOWS}, commits AS (SELECT shot, k AS fault, min("window") AS "window" FROM ev GROUP BY ALL),
c_edges AS (SELECT k AS fault, k // 3 AS det FROM range(100) r(k) UNION SELECT k, k * 7 % 20 FROM range(100) r(k)), c_lam AS (SELECT k AS fault, (k + 1)/10.0 AS lam FROM range(100) r(k)),
{POSITIONS}"""


def commits(t: Tables):
    k = F.get_json_object("props", "$.k").cast("bigint")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("bigint")
    c = t.events.groupBy(F.col("user_id").alias("shot"), k.alias("fault")).agg(F.min(day).alias("window"))
    ids = t.spark.range(100).withColumnRenamed("id", "fault")
    edges = ids.select("fault", F.explode(F.array_distinct(F.array(F.floor(F.col("fault") / 3).cast("bigint"), F.col("fault") * 7 % 20))).alias("det"))
    return c, edges, ids.select("fault", ((F.col("fault") + 1) / 10.0).alias("lam"))


@query("w8_commit_history", f"""WITH RECURSIVE {COMMITS}, seen AS (SELECT p.shot, p."window", c.fault FROM pos p JOIN commits c ON c.shot = p.shot AND p."window" - c."window" BETWEEN 0 AND 2),
tt AS (SELECT shot, "window", fault, det FROM seen JOIN c_edges USING (fault)), nb AS (SELECT DISTINCT a.shot, a."window", a.fault, b.fault AS o FROM tt a JOIN tt b ON a.shot = b.shot AND a."window" = b."window" AND a.det = b.det),
reach AS (SELECT shot, "window", fault, fault AS r FROM seen UNION SELECT x.shot, x."window", x.fault, nb.o FROM reach x JOIN nb ON nb.shot = x.shot AND nb."window" = x."window" AND nb.fault = x.r),
comp AS (SELECT shot, "window", fault, min(r) AS c FROM reach GROUP BY ALL), l AS (SELECT shot, "window", c, sum(lam) AS l FROM comp JOIN c_lam USING (fault) GROUP BY ALL),
q AS (SELECT shot, "window", sum(l) AS weight, sqrt(sum(l*l))/(SELECT sum(lam) FROM c_lam) AS q FROM l GROUP BY ALL)
SELECT p.shot, p."window", round(coalesce(weight, 0), 6) AS weight, round(coalesce(q, 0), 6) AS q_supp FROM pos p LEFT JOIN q ON q.shot = p.shot AND q."window" = p."window" """)
def commit_history(t: Tables):
    c, edges, faults = commits(t)
    return shaped(L.commit_history(positions(t), c, faults, edges, 3), "shot window", "weight q_supp", digits=6)


@query("u4_commit_union", f"WITH {COMMITS} SELECT shot, count(*) AS faults, sum(fault)::BIGINT AS fault_sum FROM commits GROUP BY shot")
def commit_union(t: Tables):
    c, _, _ = commits(t)
    early, late = c.where("window % 2 = 0"), c.where("window % 2 = 1")
    return early.unionByName(late).groupBy("shot").agg(F.count("*").alias("faults"), F.sum("fault").alias("fault_sum"))


@query("w11_mark_skipped", f"""WITH {I.WINDOWS}, f AS (SELECT shot, "window", bool_or(cap_hit) AS final FROM windows GROUP BY ALL)
SELECT shot, "window", CAST(coalesce(bool_or(final) OVER (PARTITION BY shot ORDER BY "window" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS INT)::BIGINT AS skipped FROM f""")
def mark_skipped(t: Tables):
    return shaped(L.mark_skipped(I.windows(t).withColumn("final", F.col("cap_hit"))), "shot window skipped")
