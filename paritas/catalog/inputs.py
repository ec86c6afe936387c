"""How the driver's tables stand in for the domain's, on both sides.

Each input has a Spark builder and a SQL common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.catalog.base import Tables
from paritas.operators.gf2 import odd
from paritas.operators.incidence import Incidence, with_lambda

# The repetition problem that the toy goldens use (rounds, error rates).
TOY_ROUNDS = 7
P_DATA, P_MEASURE = 0.01, 0.02

# ---- toy incidence: 3-bit repetition code over seven rounds, from a rule ------------------------


def toy(t: Tables, rounds: int = TOY_ROUNDS) -> Incidence:
    r, kind = F.col("fault") % 5, F.floor(F.col("fault") / 5).cast("bigint")
    base = 2 * kind
    faults = t.spark.range(5 * (rounds - 1)).withColumnRenamed("id", "fault")
    dets = (F.when(r == 0, F.array(base, base + 1)).when(r == 1, F.array(base, base + 2)).when(r == 2, F.array(base))
            .when(r == 3, F.array(base + 1)).otherwise(F.array(base + 1, base + 3)))
    edges = faults.select(F.explode(dets).alias("det"), "fault")
    priors = faults.select("fault", F.when(r.isin(1, 4), P_MEASURE).otherwise(P_DATA).alias("p"))
    det = t.spark.range(2 * rounds)
    detectors = det.select(F.col("id").alias("det"), (F.col("id") % 2).alias("check"),
                           (F.floor(F.col("id") / 2) + 1).cast("int").alias("round"), F.lit(0).alias("kind"))
    return Incidence(edges=edges, obs_edges=faults.where(r == 2).select(F.lit(0).alias("obs"), "fault"),
                     faults=with_lambda(priors), detectors=detectors)


TOY = f"""
toy_faults AS (SELECT range AS fault, range % 5 AS b, range // 5 AS q,
  CASE WHEN range % 5 IN (1, 4) THEN {P_MEASURE} ELSE {P_DATA} END::DOUBLE AS p FROM range({5 * (TOY_ROUNDS - 1)})),
toy_edges AS (
  SELECT fault, 2*q AS det FROM toy_faults WHERE b IN (0, 1, 2) UNION ALL
  SELECT fault, 2*q + 1 FROM toy_faults WHERE b IN (0, 3, 4) UNION ALL
  SELECT fault, 2*q + 2 FROM toy_faults WHERE b = 1 UNION ALL
  SELECT fault, 2*q + 3 FROM toy_faults WHERE b = 4),
toy_lam AS (SELECT fault, ln((1 - p)/p) AS lam FROM toy_faults)"""

# ---- shots: an order is a shot, its returned lines are the faults that happened -----------------


def shots(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("shot"))


def true_faults(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'")
    return odd(returned.select(F.col("l_orderkey").alias("shot"), (F.col("l_partkey") % 30).alias("fault")), ["shot", "fault"])


SHOTS = """
shots AS (SELECT o_orderkey AS shot FROM orders),
true_faults AS (SELECT l_orderkey AS shot, l_partkey % 30 AS fault FROM lineitem WHERE l_returnflag = 'R'
  GROUP BY ALL HAVING count(*) % 2 = 1)"""

FIRED = f"""{TOY}, {SHOTS},
fired AS (SELECT shot, det FROM true_faults JOIN toy_edges USING (fault) GROUP BY ALL HAVING count(*) % 2 = 1)"""

# ---- large incidence: suppliers are detectors, parts are faults ---------------------------------


def supply(t: Tables) -> Incidence:
    edges = odd(t.lineitem.select(F.col("l_suppkey").alias("det"), F.col("l_partkey").alias("fault")), ["det", "fault"])
    obs = t.part.select((F.col("p_size") % 8).alias("obs"), F.col("p_partkey").alias("fault"))
    priors = t.part.select(F.col("p_partkey").alias("fault"), ((F.col("p_size") - 1) / F.lit(49.0)).alias("p"))
    detectors = t.supplier.select(
        F.col("s_suppkey").alias("det"), F.col("s_nationkey").cast("bigint").alias("check"),
        (F.floor(F.col("s_suppkey") / 10) + 1).cast("int").alias("round"), (F.col("s_nationkey") % 2).alias("kind"))
    return Incidence(edges=edges, obs_edges=obs, faults=with_lambda(priors), detectors=detectors)


SUPPLY = """
edges AS (SELECT l_suppkey AS det, l_partkey AS fault FROM lineitem GROUP BY ALL HAVING count(*) % 2 = 1),
obs_edges AS (SELECT p_size % 8 AS obs, p_partkey AS fault FROM part),
faults AS (SELECT p_partkey AS fault, (p_size - 1) / 49.0::DOUBLE AS p FROM part),
detectors AS (SELECT s_suppkey AS det, s_nationkey AS "check", s_suppkey // 10 + 1 AS round, s_nationkey % 2 AS kind FROM supplier)"""


def supply_support(t: Tables) -> DataFrame:
    """Supports on the large incidence: the parts an order returned."""
    returned = t.lineitem.where("l_returnflag = 'R'")
    return odd(returned.select(F.col("l_orderkey").alias("shot"), F.col("l_partkey").alias("fault")), ["shot", "fault"])


SUPPLY_SUPPORT = """
support AS (SELECT l_orderkey AS shot, l_partkey AS fault FROM lineitem WHERE l_returnflag = 'R'
  GROUP BY ALL HAVING count(*) % 2 = 1)"""

# ---- timed incidence: months are rounds, four checks per round, an order's fault spans one or two --

CHECKS = 4
ROUND = "((year(o_orderdate) - 1995) * 12 + month(o_orderdate))"


def timed_orders(t: Tables) -> DataFrame:
    """(order, d1, d2, p): the detectors an order touches; an open order reaches into the next round."""
    rounds = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.expr(ROUND).alias("r"))
    last = t.orders.select(F.max(F.expr(ROUND)).alias("m")).scalar()
    d1 = (F.col("r") - 1) * CHECKS + F.col("o_custkey") % CHECKS
    span = F.when((F.col("o_orderstatus") == "P") & (F.col("r") < last), 1).otherwise(0)
    d2 = (F.col("r") - 1 + span) * CHECKS + F.col("o_orderkey") % CHECKS
    return rounds.select(F.col("o_orderkey").alias("order"), d1.cast("bigint").alias("d1"), d2.cast("bigint").alias("d2"),
                         (F.col("o_totalprice") / 1e8).alias("p"))


def timed_raw(t: Tables) -> Incidence:
    """One fault per order: many orders share a support."""
    o = timed_orders(t)
    edges = o.select(F.col("order").alias("fault"), F.explode(F.array_distinct(F.array("d1", "d2"))).alias("det"))
    obs = o.where((F.col("d1") == F.col("d2")) & (F.col("d1") % CHECKS == 0)).select(F.lit(0).alias("obs"), F.col("order").alias("fault"))
    return Incidence(edges=edges, obs_edges=obs, faults=with_lambda(o.select(F.col("order").alias("fault"), "p")),
                     detectors=timed_detectors(t))


def timed_detectors(t: Tables) -> DataFrame:
    """Every check of every month up to the last one."""
    last = t.orders.agg(F.max(F.expr(ROUND)).alias("m"))
    rounds = last.select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("round"))
    spread = rounds.withColumn("check", F.explode(F.sequence(F.lit(0), F.lit(CHECKS - 1))))
    return spread.select(((F.col("round") - 1) * CHECKS + F.col("check")).cast("bigint").alias("det"),
                         F.col("check").cast("bigint").alias("check"), F.col("round").cast("int").alias("round"), F.lit(0).alias("kind"))


def timed(t: Tables) -> Incidence:
    """The distinct supports as faults, numbered in support order; crossing faults are likelier."""
    from paritas.operators.ranks import dense_numbers

    o = timed_orders(t).select(F.least("d1", "d2").alias("lo"), F.greatest("d1", "d2").alias("hi")).distinct()
    o = dense_numbers(o, ["lo", "hi"], "fault")
    single = F.col("lo") == F.col("hi")
    edges = o.select("fault", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("det"))
    priors = o.select("fault", F.when(single, P_DATA).otherwise(P_MEASURE).alias("p"))
    obs = o.where(single & (F.col("lo") % CHECKS == 0)).select(F.lit(0).alias("obs"), "fault")
    return Incidence(edges=edges, obs_edges=obs, faults=with_lambda(priors), detectors=timed_detectors(t))


TIMED_ORDERS = f"""
rounds_of AS (SELECT *, {ROUND} AS r, max({ROUND}) OVER () AS last_r FROM orders),
timed_orders AS (SELECT o_orderkey AS "order", (r - 1)*{CHECKS} + o_custkey % {CHECKS} AS d1,
  (r - 1 + CASE WHEN o_orderstatus = 'P' AND r < last_r THEN 1 ELSE 0 END)*{CHECKS} + o_orderkey % {CHECKS} AS d2,
  o_totalprice / 1e8 AS p FROM rounds_of),
timed_detectors AS (SELECT range AS det, range % {CHECKS} AS "check", range // {CHECKS} + 1 AS round
  FROM range((SELECT {CHECKS} * max(r) FROM rounds_of)))"""

TIMED_RAW = f"""{TIMED_ORDERS},
raw_edges AS (SELECT "order" AS fault, d1 AS det FROM timed_orders UNION SELECT "order", d2 FROM timed_orders),
raw_class AS (SELECT "order" AS fault, CASE WHEN d1 = d2 AND d1 % {CHECKS} = 0 THEN 1 ELSE 0 END AS cls FROM timed_orders)"""

TIMED = f"""{TIMED_ORDERS},
tf AS (SELECT *, row_number() OVER (ORDER BY lo, hi) - 1 AS fault FROM
  (SELECT DISTINCT least(d1, d2) AS lo, greatest(d1, d2) AS hi FROM timed_orders)),
t_edges AS (SELECT fault, lo AS det FROM tf UNION SELECT fault, hi FROM tf),
t_faults AS (SELECT fault, lo, hi, (CASE WHEN lo = hi THEN {P_DATA} ELSE {P_MEASURE} END)::DOUBLE AS p,
  CASE WHEN lo = hi AND lo % {CHECKS} = 0 THEN 1 ELSE 0 END AS cls, lo // {CHECKS} + 1 AS s FROM tf)"""

# ---- recorded solutions: an order is a decode, its lines are the converged legs -----------------


def lines(t: Tables) -> DataFrame:
    """(decode, leg order columns, iterations, weight, cls, hash) of every line."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("decode"), F.col("l_linenumber").alias("o1"), F.col("l_partkey").alias("o2"),
        F.col("l_suppkey").alias("o3"), F.col("l_quantity").cast("bigint").alias("iterations"),
        (F.col("l_extendedprice") / 1000.0).alias("weight"), (F.col("l_suppkey") % 4).alias("cls"),
        (F.col("l_partkey") % 16).alias("hash"))


LINES = """
lines AS (SELECT l_orderkey AS decode, l_linenumber AS o1, l_partkey AS o2, l_suppkey AS o3,
  l_quantity::BIGINT AS iterations, l_extendedprice / 1000.0 AS weight, l_suppkey % 4 AS cls, l_partkey % 16 AS hash
  FROM lineitem)"""

# ---- paired outcomes ----------------------------------------------------------------------------


def pairs(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("shot"), F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("chunk"), "o_orderpriority",
        "o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").alias("ref_failed"), (F.col("o_totalprice") > 400000).alias("test_failed"))


PAIRS = """
pairs AS (SELECT o_orderkey AS shot, o_orderkey // 1000 AS chunk, o_orderpriority, o_orderstatus,
  o_orderpriority = '1-URGENT' AS ref_failed, o_totalprice > 400000 AS test_failed FROM orders)"""

# ---- windows: a user is a shot, a day is a window ----------------------------------------------


def windows(t: Tables) -> DataFrame:
    """(shot, window, attempts, iterations, legs, converged, cap_hit, flagged, unexplained, virtual, half)."""
    e = t.events.select(
        F.col("user_id").alias("shot"), (F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))).cast("bigint").alias("window"),
        "event_type", F.floor("value").cast("bigint").alias("iterations"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("shot", "window").agg(
        F.least(F.count("*"), F.lit(3)).alias("attempts"), F.sum("iterations").alias("iterations"), F.count("*").alias("legs"),
        F.bool_and(F.col("event_type") != "error").alias("converged"), F.bool_or(F.col("k") >= 95).alias("cap_hit"),
        F.bool_or(F.col("event_type") == "signup").alias("flagged"), F.sum(F.col("k") % 3).alias("unexplained"),
        F.count_if(F.col("k") < 2).alias("virtual"), F.sum("k").alias("weight"))


WINDOWS = """
ev AS (SELECT user_id AS shot, date_diff('day', DATE '2024-01-01', ts::DATE) AS "window", event_type, ts,
  floor(value)::BIGINT AS iterations, (props::JSON->>'k')::BIGINT AS k FROM events),
windows AS (SELECT shot, "window", least(count(*), 3) AS attempts, sum(iterations)::BIGINT AS iterations, count(*) AS legs,
  bool_and(event_type <> 'error') AS converged, bool_or(k >= 95) AS cap_hit, bool_or(event_type = 'signup') AS flagged,
  sum(k % 3)::BIGINT AS unexplained, count(*) FILTER (k < 2) AS virtual, sum(k)::BIGINT AS weight FROM ev GROUP BY ALL)"""

# ---- scored outcomes ----------------------------------------------------------------------------


def scored(t: Tables) -> DataFrame:
    """Labelled documents: failed when toxic, scored by length."""
    return t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").select(
        F.col("doc_id").alias("shot"), F.col("n_chars").alias("score"), (F.col("toxic") == 1).alias("failed"),
        (F.col("quality") == 1).alias("good"), "lang")


SCORED = """
scored AS (SELECT l.doc_id AS shot, n_chars AS score, toxic = 1 AS failed, quality = 1 AS good, lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
