"""Column functions, message passing, lookup decoding and windowed decoding on the toy incidence.

Orders are the shots; the parts of their returned lines are the faults that happened.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from paritas.catalog import inputs as I
from paritas.catalog import plans as PL
from paritas.catalog.base import Tables, cycle_sql, query, shaped, wilson_sql
from paritas.catalog.incidence import SIGNED, splitmix_sql
from paritas.functions import hashing
from paritas.functions import fixedpoint
from paritas.operators import bp, checks, gf2, lookup, sparse, windowed
from paritas.operators import statistics as S
from paritas.plans.spec import RelaySpec, WindowSpec
from paritas.plans.windows import plan_windows
from paritas.session import bounded_broadcast

# ---- column functions ---------------------------------------------------------------------------

WRAP = "18446744073709551616::HUGEINT"


@query("f1_splitmix64", f"SELECT o_orderkey, {SIGNED.format(u='h')} AS h FROM (SELECT o_orderkey, {splitmix_sql('(o_orderkey * 1000003 + o_custkey)::UBIGINT')} AS h FROM orders)")
def splitmix(t: Tables):
    return t.orders.select("o_orderkey", hashing.splitmix64(F.col("o_orderkey") * 1000003 + F.col("o_custkey")).alias("h"))


SEED = 987654321


@query("f2_chunk_seeds", f"""WITH c AS (SELECT DISTINCT o_orderkey // 1000 AS chunk FROM orders), g AS (SELECT chunk, {splitmix_sql(f"xor({SEED}::UBIGINT, {splitmix_sql('(chunk + 1)::UBIGINT')})")} AS h FROM c)
SELECT chunk, ((({SEED}::HUGEINT * 1000003) + chunk) % 9223372036854775808::HUGEINT)::BIGINT AS seed, {SIGNED.format(u='h')} AS gamma_seed FROM g""")
def chunk_seeds(t: Tables):
    chunks = t.orders.select(F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("chunk")).distinct()
    return chunks.select("chunk", hashing.chunk_seed(SEED, F.col("chunk")).alias("seed"), hashing.chunk_gamma_seed(SEED, F.col("chunk")).alias("gamma_seed"))


@query("f3_gamma_stream", f"""WITH {I.WINDOWS}, h AS (SELECT shot, "window", attempts, (shot::HUGEINT + "window"::HUGEINT * 4294967296 + (attempts * 64)::HUGEINT * 72057594037927936) % {WRAP} AS h FROM windows)
SELECT shot, "window", attempts, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - {WRAP} ELSE h END)::BIGINT AS stream FROM h""")
def gamma_stream(t: Tables):
    w = I.windows(t)
    return shaped(w.select("shot", "window", "attempts", hashing.gamma_stream(F.col("shot"), F.col("window"), F.col("attempts") * 64).alias("stream")), "shot window attempts stream")


G_LOW, G_HIGH = -0.24, 0.66


def draw_sql(stream: str, leg: str, fault: str, seed: int = SEED) -> str:
    return f"({G_LOW} + (('0x' || substr(md5(concat_ws(':', {seed}, {stream}, {leg}, {fault})), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE * {G_HIGH - G_LOW!r}::DOUBLE)"


@query("f4_gamma_draws", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({draw_sql('l_orderkey', 'l_linenumber', 'l_partkey')}, 9) AS g FROM lineitem")
def gamma_draws(t: Tables):
    g = hashing.gamma_draw(SEED, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), G_LOW, G_HIGH)
    return shaped(t.lineitem.select("*", g.alias("g")), "l_orderkey l_linenumber l_partkey l_suppkey", "g").select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", "l_suppkey", "g")


GRID = fixedpoint.grid("int4.2.8")
HALF_AWAY = "(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * floor(abs({x}) + 0.5))"


@query("f5_quantise", f"""WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_extendedprice - 50000)/7000 AS lam, l_discount*25 - 1 AS gamma FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, least(greatest({HALF_AWAY.format(x='lam*2')}, -15), 15)::BIGINT AS lam, least(greatest({HALF_AWAY.format(x='((1-gamma)*8)')}, 0), 16)::BIGINT AS beta FROM v""")
def quantise(t: Tables):
    v = t.lineitem.select("*", ((F.col("l_extendedprice") - 50000) / 7000).alias("x"), (F.col("l_discount") * 25 - 1).alias("gamma"))
    return shaped(v.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fixedpoint.message(F.col("x"), GRID).alias("lam"), fixedpoint.strength(F.col("gamma"), GRID).alias("beta")),
                  "l_orderkey l_partkey l_suppkey l_linenumber lam beta")


def product_sql(beta: str, x: str, bits: int = 4, m: int = 8) -> str:
    terms = " + ".join(f"((abs({x}) >> {b}) & 1) * (({beta} << {b}) // {m})" for b in range(bits))
    return f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * ({terms}))"


@query("f6_shift_add_product", f"""WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_linenumber + l_quantity::BIGINT) % 31 - 15 AS x, l_suppkey % 17 AS beta FROM lineitem)
SELECT x, beta, count(*) AS n, sum({product_sql('beta', 'x')})::BIGINT AS s FROM v GROUP BY ALL""")
def product(t: Tables):
    v = t.lineitem.select(((F.col("l_linenumber") + F.col("l_quantity").cast("bigint")) % 31 - 15).cast("bigint").alias("x"), (F.col("l_suppkey") % 17).alias("beta"))
    return v.groupBy("x", "beta").agg(F.count("*").alias("n"), F.sum(fixedpoint.weighted(F.col("x"), F.col("beta"), GRID)).alias("s"))


@query("f7_alpha_schedule", """SELECT t, count(*) AS n, round(sum(l_quantity * (1 - pow(2, -(t + 1)))), 4) AS adaptive, sum(l_quantity::BIGINT - (l_quantity::BIGINT >> (t + 1)::INT))::BIGINT AS fixed, round(sum(l_quantity * 0.75), 4) AS constant
FROM lineitem, range(5) r(t) GROUP BY t""")
def alpha_schedule(t: Tables):
    adaptive, fixed, constant = RelaySpec(5, alpha=None), RelaySpec(5, alpha=None, arithmetic="int4.2.8"), RelaySpec(5, alpha=0.75)
    q = F.col("l_quantity")
    ar = bp.arithmetic("int4.2.8")
    rows = [F.struct(F.lit(i).cast("bigint").alias("t"), (q * adaptive.damping(i)).alias("a"), ar.scale(q.cast("bigint"), fixed, i).alias("f"), (q * constant.damping(i)).alias("c")) for i in range(5)]
    out = t.lineitem.select(F.explode(F.array(*rows)).alias("r")).select("r.*").groupBy("t").agg(
        F.count("*").alias("n"), F.round(F.sum("a"), 4).alias("adaptive"), F.sum("f").alias("fixed"), F.round(F.sum("c"), 4).alias("constant"))
    return out


# ---- inputs and SQL of message passing ------------------------------------------------------------


def toy_shots(t: Tables):
    """(incidence, shots, fired, true faults)."""
    inc, faults = I.toy(t), I.true_faults(t)
    return inc, I.shots(t), gf2.gf2_product(faults, inc.edges), faults


LAM_D, LAM_M = math.log(0.99 / 0.01), math.log(0.98 / 0.02)
SETS = 3


def gamma_table(t: Tables):
    """Explicit memory strengths: one row per (set, fault), drawn from the shared seed."""
    faults = I.toy(t).faults.select("fault")
    sets = faults.withColumn("t", F.explode(F.array(*[F.lit(i) for i in range(SETS)])))
    return sets.select("t", "fault", hashing.gamma_draw(SEED, F.lit(0), F.col("t"), F.col("fault"), G_LOW, G_HIGH).alias("g"))


class BpSql:
    """The decode spelled out as one chain of common table expressions, iteration by iteration."""

    also = ""  # a further condition of convergence

    def __init__(self, fixed: bool = False, per_shot: bool = False):
        self.fixed, self.per_shot = fixed, per_shot
        self.parts = [I.FIRED]
        lam = f"CASE WHEN b IN (1, 4) THEN {LAM_M!r} ELSE {LAM_D!r} END::DOUBLE"
        if fixed:
            lam = f"least(floor(2*({lam}) + 0.5), 15)::INT"
        self.parts.append(f"g AS (SELECT e.fault, e.det, {lam} AS lam FROM toy_edges e JOIN toy_faults USING (fault))")
        self.parts.append("gt AS (SELECT t, fault, " + draw_sql("0", "t", "fault") + f" AS g FROM toy_faults, range({SETS}) r(t))")

    def start(self, budget: int, gamma0: float | None) -> str:
        top = "1e300::DOUBLE" if not self.fixed else "15"
        self.top = top
        strength = "0" if gamma0 is None else (str(int(math.floor((1 - gamma0) * 8 + 0.5))) if self.fixed else f"{gamma0!r}::DOUBLE")
        self.parts.append(f"""m AS MATERIALIZED (SELECT s.shot, g.det, g.fault, g.lam, (f.det IS NOT NULL)::INT AS fired, g.lam AS nu, g.lam AS marg, FALSE AS hard, FALSE AS done, 0 AS it, {strength} AS st
 FROM shots s CROSS JOIN g LEFT JOIN fired f ON f.shot = s.shot AND f.det = g.det)""")
        return "m"

    def iterate(self, m: str, tag: str, t: int, memory: bool, alpha: float | None, limit: int) -> str:
        row, col = "PARTITION BY shot, det", "PARTITION BY shot, fault"
        if self.fixed:
            scaled = "{x}" if alpha == 1.0 else f"({{x}} - ({{x}} >> {t + 1}))"
        else:
            a = 1 - 2.0 ** -(t + 1) if alpha is None else alpha
            scaled = "{x}" if a == 1.0 else f"({{x}} * {a!r}::DOUBLE)"
        if not memory:
            bias = "lam"
        elif self.fixed:
            sat = "least(greatest(marg, -15), 15)"
            bias = f"least(greatest({product_sql('st', 'lam')} + {sat} - {product_sql('st', sat)}, -15), 15)"
        else:
            bias = "((1.0 - st)*lam + st*marg)"
        nu = "least(greatest(sig - eta, -15), 15)" if self.fixed else f"({bias} + coalesce(sum(eta) OVER ({col} ORDER BY det ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0))"
        self.parts += [
            f"a{tag} AS (SELECT *, min(abs(nu)) OVER ({row}) AS m1, (sum((nu < 0)::INT) OVER ({row}) + fired) % 2 AS par FROM {m})",
            f"b{tag} AS (SELECT *, sum((abs(nu) = m1)::INT) OVER ({row}) AS n1, min(CASE WHEN abs(nu) <> m1 THEN abs(nu) END) OVER ({row}) AS m2 FROM a{tag})",
            f"c{tag} AS (SELECT *, CASE WHEN abs(nu) = m1 THEN {scaled.format(x=f'(CASE WHEN n1 > 1 THEN m1 ELSE coalesce(m2, {self.top}) END)')} ELSE {scaled.format(x='m1')} END * CASE WHEN (par = 1) <> (nu < 0) THEN -1 ELSE 1 END AS eta FROM b{tag})",
            f"d{tag} AS (SELECT *, {bias} + sum(eta) OVER ({col}) AS sig FROM c{tag})",
            f"e{tag} AS (SELECT shot, det, fault, lam, fired, st, eta, sig, NOT done AND it < {limit} AS live, {nu} AS nu2, nu, marg, hard, done, it FROM d{tag})",
            f"f{tag} AS (SELECT shot, det, fault, lam, fired, st, CASE WHEN live THEN nu2 ELSE nu END AS nu, CASE WHEN live THEN sig ELSE marg END AS marg, CASE WHEN live THEN sig <= 0 ELSE hard END AS hard, done, live, CASE WHEN live THEN {t + 1} ELSE it END AS it FROM e{tag})",
            f"h{tag} AS (SELECT *, (sum(hard::INT) OVER ({row}) + fired) % 2 = 1 AS odd FROM f{tag})",
            f"k{tag} AS MATERIALIZED (SELECT shot, det, fault, lam, fired, st, nu, marg, hard, done OR (live AND NOT bool_or(odd) OVER (PARTITION BY shot){self.also}) AS done, it FROM h{tag})",
        ]
        return f"k{tag}"

    def leg(self, m: str, leg: int, memory: bool, alpha: float | None, limit: int) -> str:
        for t in range(limit):
            m = self.iterate(m, f"{leg}_{t}", t, memory, alpha, limit)
        div = "/2.0" if self.fixed else ""
        self.parts.append(f"""leg{leg} AS (SELECT shot, {leg} AS leg, max(it)::BIGINT AS iterations, bool_and(done) AS converged, (SELECT 1) AS one FROM {m} GROUP BY shot)""")
        self.parts.append(f"sup{leg} AS (SELECT DISTINCT shot, fault, lam FROM {m} WHERE hard)")
        self.parts.append(f"w{leg} AS (SELECT l.shot, {leg} AS leg, iterations, converged, coalesce(sum(lam){div}, 0)::DOUBLE AS weight FROM leg{leg} l LEFT JOIN sup{leg} s USING (shot) GROUP BY ALL)")
        return m

    def restart(self, m: str, leg: int, stop: str) -> str:
        gamma = draw_sql("m.shot", str(leg), "m.fault") if self.per_shot else "gt.g"
        strength = f"least(greatest(floor((1 - {gamma})*8 + 0.5), 0), 16)::INT" if self.fixed else gamma
        joined = "" if self.per_shot else f"JOIN gt ON gt.fault = m.fault AND gt.t = {leg % SETS}"
        self.parts.append(f"""r{leg} AS MATERIALIZED (SELECT m.shot, det, m.fault, lam, fired, lam AS nu, marg, FALSE AS hard, FALSE AS done, 0 AS it, {strength} AS st FROM {m} m {joined} WHERE m.shot NOT IN ({stop}))""")
        return f"r{leg}"

    def sql(self, tail: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + tail


def plain_bp(iterations: int, alpha, gamma0=None, fixed=False) -> tuple[BpSql, str]:
    b = BpSql(fixed)
    m = b.leg(b.start(iterations, gamma0), 0, gamma0 is not None, alpha, iterations)
    b.parts.append("pred AS (SELECT shot, count(*) FILTER (fault % 5 = 2) % 2 AS mask FROM sup0 GROUP BY shot)")
    return b, m


RESULT = """SELECT w0.shot, CAST(converged AS INT)::BIGINT AS success, iterations, 1::BIGINT AS legs, round(CASE WHEN converged THEN weight ELSE 'inf'::DOUBLE END, 6) AS weight,
coalesce(p.mask, 0)::BIGINT AS mask FROM w0 LEFT JOIN pred p USING (shot)"""


def decode_report(t: Tables, spec: RelaySpec, gammas=None, share: bool = True, **extension):
    inc, shots, fired, _ = toy_shots(t)
    out = bp.decode(inc, fired, shots, spec, gammas, share, **extension)
    mask = gf2.predict_class(out["support"], inc.column_class())
    joined = out["results"].join(mask, "shot", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return shaped(joined, "shot success iterations legs mask", "weight", digits=6)


# ---- single updates ---------------------------------------------------------------------------------

FIXED_SPEC = RelaySpec(1, gamma0=0.125, alpha=1.0, arithmetic="int4.2.8")


def _first_iteration(t: Tables):
    """(membership, state, arithmetic): the state after one fixed-point iteration of every distinct syndrome, the input of the single updates."""
    inc, shots, fired, _ = toy_shots(t)
    ar = bp.arithmetic("int4.2.8")
    membership, syndromes = bp.syndrome_classes(fired, shots)
    msg = bp.edge_messages(inc.edges, inc.faults, syndromes, membership.select("sid").distinct(), ar)
    msg = msg.withColumn("nu", F.col("lam")).withColumn("marg", F.col("lam")).withColumn("hard", F.lit(False)).withColumn("done", F.lit(False)).withColumn(
        "it", F.lit(0)).withColumn("budget", F.lit(2)).withColumn("strength", ar.strength(F.lit(0.125)))
    return membership, bp.iterate(msg, FIXED_SPEC, 0, True, ar), ar


def _of_shots(membership, state, *totals):
    """Totals of a syndrome's edges, for every shot that has it: edge rows grow with the distinct syndromes, not with the shots."""
    per_syndrome = bounded_broadcast(state.groupBy("sid").agg(*totals), 1 << (2 * I.TOY_ROUNDS))  # one row per subset of detectors at most
    return membership.join(per_syndrome, "sid").drop("sid")


def _update_sql(tail: str) -> str:
    b = BpSql(fixed=True)
    m = b.start(2, 0.125)
    m = b.iterate(m, "0_0", 0, True, 1.0, 2)
    b.iterate(m, "0_1", 1, True, 1.0, 2)
    return b.sql(tail)


@query("b1_check_update", _update_sql("SELECT shot, sum(eta)::BIGINT AS s, sum(eta*det*fault)::BIGINT AS mixed, max(eta)::BIGINT AS top FROM c0_1 GROUP BY shot"))
def check_update(t: Tables):
    membership, msg, ar = _first_iteration(t)
    out = bp.check_update(msg, FIXED_SPEC, 1, ar)
    return shaped(_of_shots(membership, out, F.sum("eta").alias("s"), F.sum(F.col("eta") * F.col("det") * F.col("fault")).alias("mixed"), F.max("eta").alias("top")), "shot s mixed top")


@query("b2_variable_update", _update_sql("SELECT shot, sum(sig)::BIGINT AS s, sum(nu2*det*fault)::BIGINT AS mixed FROM e0_1 GROUP BY shot"))
def variable_update(t: Tables):
    membership, msg, ar = _first_iteration(t)
    out = bp.variable_update(bp.check_update(msg, FIXED_SPEC, 1, ar), True, ar)
    return shaped(_of_shots(membership, out, F.sum("_sigma").alias("s"), F.sum(F.col("_nu") * F.col("det") * F.col("fault")).alias("mixed")), "shot s mixed")


SAT = "least(greatest(marg, -15), 15)"


@query("b3_memory_bias", _update_sql(f"SELECT shot, sum(least(greatest({product_sql('st', 'lam')} + {SAT} - {product_sql('st', SAT)}, -15), 15) * (fault + 1))::BIGINT AS s FROM k0_0 GROUP BY shot"))
def memory_bias(t: Tables):
    membership, msg, ar = _first_iteration(t)
    out = msg.withColumn("b", ar.bias(F.col("lam"), F.col("marg"), F.col("strength")))
    return shaped(_of_shots(membership, out, F.sum(F.col("b") * (F.col("fault") + 1)).alias("s")), "shot s")


@query("b4_hard_decision", _update_sql("SELECT shot, count(*) FILTER (hard) AS hard, CAST(bool_and(done) AS INT)::BIGINT AS done, max(it)::BIGINT AS it FROM k0_1 GROUP BY shot"))
def hard_decision(t: Tables):
    membership, msg, ar = _first_iteration(t)
    out = bp.iterate(msg, FIXED_SPEC, 1, True, ar)
    return shaped(_of_shots(membership, out, F.count_if("hard").alias("hard"), F.bool_and("done").alias("done"), F.max("it").alias("it")), "shot hard done it")


# ---- whole decodes ------------------------------------------------------------------------------------


@query("b5_min_sum", plain_bp(4, None)[0].sql(RESULT))
def min_sum(t: Tables):
    return decode_report(t, RelaySpec(pre_iter=4, alpha=None))


@query("b6_mem_bp", plain_bp(4, 0.75, 0.125)[0].sql(RESULT))
def mem_bp(t: Tables):
    return decode_report(t, RelaySpec(pre_iter=4, alpha=0.75, gamma0=0.125))


@query("b10_fixed_point", plain_bp(4, None, None, fixed=True)[0].sql(RESULT))
def fixed_point(t: Tables):
    return decode_report(t, RelaySpec(pre_iter=4, alpha=None, arithmetic="int4.2.8"))


def relay_sql(stop_rule: str, fixed: bool, legs: int = 2, pre: int = 2, each: int = 2, gamma0=0.125, per_shot: bool = False) -> BpSql:
    b = BpSql(fixed, per_shot)
    m = b.leg(b.start(pre, gamma0), 0, True, 1.0, pre)
    for leg in range(1, legs + 1):
        seen = " UNION ALL ".join(f"SELECT shot, converged, {i} AS leg FROM w{i}" for i in range(leg))
        stop = {"after_n_converged": f"SELECT shot FROM ({seen}) GROUP BY shot HAVING count(*) FILTER (converged) >= 1",
                "after_leg0": "SELECT shot FROM w0 WHERE converged", "all_legs": "SELECT NULL::BIGINT WHERE FALSE"}[stop_rule]
        m = b.leg(b.restart(m, leg, stop), leg, True, 1.0, each)
    b.parts.append("legs AS (" + " UNION ALL ".join(f"SELECT shot, leg, iterations, converged, weight FROM w{i}" for i in range(legs + 1)) + ")")
    b.parts.append("sups AS (" + " UNION ALL ".join(f"SELECT shot, {i} AS leg, fault FROM sup{i}" for i in range(legs + 1)) + ")")
    b.parts.append("best AS (SELECT shot, min(weight) AS weight, arg_min(leg, (weight, leg)) AS leg FROM legs WHERE converged GROUP BY shot)")
    b.parts.append("pred AS (SELECT s.shot, count(*) FILTER (fault % 5 = 2) % 2 AS mask FROM sups s LEFT JOIN best b ON b.shot = s.shot WHERE s.leg = coalesce(b.leg, 0) GROUP BY s.shot)")
    return b


RELAY_RESULT = """SELECT l.shot, CAST(bool_or(converged) AS INT)::BIGINT AS success, sum(iterations)::BIGINT AS iterations, count(*) AS legs, round(coalesce(any_value(b.weight), 'inf'::DOUBLE), 6) AS weight,
coalesce(any_value(p.mask), 0)::BIGINT AS mask FROM legs l LEFT JOIN best b ON b.shot = l.shot LEFT JOIN pred p ON p.shot = l.shot GROUP BY l.shot"""
RELAY = RelaySpec(pre_iter=2, num_sets=2, set_max_iter=2, gamma0=0.125, stopping="after_n_converged", stop_count=1, alpha=1.0, arithmetic="int4.2.8")


def explicit(t: Tables):
    return bp.explicit_gammas(gamma_table(t), SETS)


@query("b7_relay_decode", relay_sql("after_n_converged", True).sql(RELAY_RESULT))
def relay_decode(t: Tables):
    return decode_report(t, RELAY, explicit(t))


@query("b8_stop_after_leg0", relay_sql("after_leg0", True).sql(RELAY_RESULT))
def stop_after_leg0(t: Tables):
    return decode_report(t, replace(RELAY, stopping="after_leg0"), explicit(t))


@query("b8_stop_all_legs", relay_sql("all_legs", True).sql(RELAY_RESULT))
def stop_all_legs(t: Tables):
    return decode_report(t, replace(RELAY, stopping="all_legs"), explicit(t))


@query("b7_relay_float", relay_sql("after_n_converged", False).sql(RELAY_RESULT))
def relay_float(t: Tables):
    return decode_report(t, replace(RELAY, arithmetic="float"), explicit(t))


@query("b11_leg_trace", relay_sql("all_legs", True).sql("""SELECT shot, leg::BIGINT AS leg, iterations, CAST(converged AS INT)::BIGINT AS converged, round(CASE WHEN converged THEN weight ELSE 0 END, 6) AS weight,
CAST(converged AND weight < coalesce(min(CASE WHEN converged THEN weight END) OVER (PARTITION BY shot ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) AS INT)::BIGINT AS became_best,
(sum(iterations) OVER (PARTITION BY shot ORDER BY leg))::BIGINT AS cumulative FROM legs"""))
def leg_trace(t: Tables):
    inc, shots, fired, _ = toy_shots(t)
    out = bp.decode(inc, fired, shots, replace(RELAY, stopping="all_legs"), explicit(t))["legs"]
    return shaped(out.withColumn("weight", F.when(F.col("converged"), F.col("weight")).otherwise(F.lit(0.0))), "shot leg iterations converged became_best cumulative", "weight", digits=6)


@query("b11_recorded_solutions", relay_sql("all_legs", True).sql("""SELECT l.shot AS decode, l.leg::BIGINT AS leg, l.iterations, round(l.weight, 6) AS weight, (count(s.fault) FILTER (s.fault % 5 = 2) % 2)::BIGINT AS cls, count(s.fault) AS size
FROM legs l LEFT JOIN sups s ON s.shot = l.shot AND s.leg = l.leg WHERE l.converged GROUP BY ALL"""))
def recorded_solutions(t: Tables):
    inc, shots, fired, _ = toy_shots(t)
    out = bp.decode(inc, fired, shots, replace(RELAY, stopping="all_legs"), explicit(t))
    return shaped(bp.solutions(out["legs"], out["leg_support"], inc.column_class()), "decode leg iterations cls size", "weight", digits=6)


@query("a43_check_legs", "SELECT 0::BIGINT AS violations, (SELECT count(*) FROM orders) AS shots")
def check_legs(t: Tables):
    inc, shots, fired, _ = toy_shots(t)
    out = bp.decode(inc, fired, shots, RELAY, explicit(t))
    return _broken_shots(out, 2, 2, 2, "after_n_converged", 1)


def _broken_shots(out, *rules):
    """(violations, shots) over all shots: a syndrome's trace is checked once and counts for every shot that has it."""
    results = out["per_syndrome"].withColumnRenamed("sid", "shot")
    bad = checks.check_legs(out["syndrome_legs"].withColumnRenamed("sid", "shot"), results, *rules)
    found = bad.groupBy("detail").agg(F.count("*").alias("_v")).withColumnRenamed("detail", "_sid")
    sizes = out["membership"].groupBy("sid").agg(F.count("*").alias("_n")).join(out["per_syndrome"].select("sid"), "sid")
    told = sizes.join(found, F.col("sid").cast("string") == F.col("_sid"), "left")
    zero = F.lit(0).cast("bigint")
    return told.agg(F.coalesce(F.sum(F.col("_n") * F.coalesce("_v", zero)), zero).alias("violations"), F.coalesce(F.sum("_n"), zero).alias("shots"))


@query("a43_broken_legs", """WITH t AS (SELECT l_orderkey AS shot, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS conv, count(*) FILTER (l_quantity > 40 OR (l_returnflag <> 'R' AND l_quantity <> 40)) AS wrong,
 count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'R') AS bad FROM lineitem GROUP BY l_orderkey),
j AS (SELECT t.*, o_orderstatus = 'F' AS success FROM t JOIN orders ON o_orderkey = shot)
SELECT 'iterations_do_not_add_up' AS code, shot::VARCHAR AS detail FROM j WHERE shot % 3 = 0 UNION ALL SELECT 'success_disagrees', shot::VARCHAR FROM j WHERE (conv > 0) <> success
UNION ALL SELECT 'too_many_legs', shot::VARCHAR FROM j WHERE n > 5 UNION ALL SELECT 'leg_limit', shot::VARCHAR FROM j WHERE wrong > 0
UNION ALL SELECT 'best_not_converged', shot::VARCHAR FROM j WHERE bad > 0 UNION ALL SELECT 'stopping', shot::VARCHAR FROM j WHERE n <> 5""")
def broken_legs(t: Tables):
    """Leg traces that break every rule: an order's lines as legs of a schedule of five legs of 40 iterations, all of which must run."""
    legs = t.lineitem.select(F.col("l_orderkey").alias("shot"), F.col("l_linenumber").cast("bigint").alias("leg"), F.col("l_quantity").cast("bigint").alias("iterations"),
                             (F.col("l_returnflag") == "R").alias("converged"), (F.col("l_linestatus") == "O").alias("became_best"))
    told = t.orders.select(F.col("o_orderkey").alias("shot"), (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_orderkey") % 3 == 0).cast("bigint").alias("extra"))
    shots = legs.groupBy("shot").agg(F.sum("iterations").alias("sum")).join(told, "shot").select("shot", "success", (F.col("sum") + F.col("extra")).alias("iterations"))
    return checks.check_legs(legs, shots, 40, 4, 40, "all_legs")


# Two iterations of leg 0 leave one for leg 1, which is then cut short.
@query("b9_iteration_cap", relay_sql("after_n_converged", True, legs=1, pre=2, each=1).sql(f"""SELECT success, iterations, 1 - success AS cap_hit, count(*) AS n FROM ({RELAY_RESULT}) GROUP BY ALL"""))
def iteration_cap(t: Tables):
    """At most three iterations per decode: a decode cut short by the budget is a cap hit."""
    inc, shots, fired, _ = toy_shots(t)
    out = bp.decode(inc, fired, shots, replace(RELAY, cap=3), explicit(t))["results"]
    return shaped(out.groupBy("success", "iterations", "cap_hit").agg(F.count("*").alias("n")), "success iterations cap_hit n")


EXTRA_LEGS, LOW_WEIGHT = 2, 6.0


def low_confidence_sql() -> str:
    """All legs run; how many a decode keeps follows from which converged and from the lightest weight so far."""
    running = ", ".join(f"least({', '.join(f'd{j}' for j in range(i + 1))}) AS r{i}" for i in range(4))

    def after(i: int) -> str:  # legs of a decode that first converged at leg i
        if i == 3:
            return "4"
        if i == 2:
            return f"CASE WHEN r2 > {LOW_WEIGHT} THEN 4 ELSE 3 END"
        return f"CASE WHEN r{i} <= {LOW_WEIGHT} THEN {i + 1} WHEN isinf(d{i + 1}) OR r{i + 1} > {LOW_WEIGHT} THEN {i + 3} ELSE {i + 2} END"

    weights = ", ".join(f"max(CASE WHEN leg = {i} THEN CASE WHEN converged THEN weight ELSE 'inf'::DOUBLE END END) AS d{i}" for i in range(4))
    return relay_sql("all_legs", True, legs=3).sql(f"""SELECT CAST(NOT isinf(r3) AS INT)::BIGINT AS success, legs::BIGINT AS legs, count(*) AS n
FROM (SELECT *, CASE WHEN NOT isinf(d0) THEN {after(0)} WHEN NOT isinf(d1) THEN {after(1)} WHEN NOT isinf(d2) THEN {after(2)} ELSE 4 END AS legs
FROM (SELECT *, {running} FROM (SELECT shot, {weights} FROM legs GROUP BY shot))) GROUP BY ALL""")


@query("b12_low_confidence_legs", low_confidence_sql())
def low_confidence_legs(t: Tables):
    """Decodes of heavy solutions run up to two more legs after the stopping rule is met."""
    inc, shots, fired, _ = toy_shots(t)
    spec = replace(RELAY, num_sets=3)
    low = bp.low_confidence(inc.column_class(), "weight", LOW_WEIGHT)
    out = bp.decode(inc, fired, shots, spec, explicit(t), keep_going=low, extra_legs=EXTRA_LEGS)["results"]
    return shaped(out.groupBy("success", "legs").agg(F.count("*").alias("n")), "success legs n")


@query("j17_gammas_for_leg", f"""WITH {I.TOY}, legs AS (SELECT l_orderkey AS shot, l_linenumber AS leg, l_partkey % 30 AS fault FROM lineitem), gt AS (SELECT t, fault, {draw_sql('0', 't', 'fault')} AS g FROM toy_faults, range({SETS}) r(t))
SELECT leg::BIGINT AS leg, l.fault, count(*) AS n, round(min(g), 9) AS g FROM legs l JOIN gt ON gt.t = leg % {SETS} AND gt.fault = l.fault GROUP BY ALL""")
def gammas_for_leg(t: Tables):
    legs = t.lineitem.select((F.col("l_linenumber")).alias("leg"), (F.col("l_partkey") % 30).alias("fault"))
    joined = legs.withColumn("t", F.col("leg") % SETS).join(F.broadcast(gamma_table(t)), ["t", "fault"])  # SETS x 30 rows
    return shaped(joined.groupBy("leg", "fault").agg(F.count("*").alias("n"), F.min("g").alias("g")), "leg fault n", "g")


@query("v4_decode_batch", relay_sql("after_n_converged", True, per_shot=True).sql(f"""SELECT success, legs, mask, count(*) AS n, sum(iterations)::BIGINT AS iterations FROM ({RELAY_RESULT}) GROUP BY ALL"""))
def decode_batch(t: Tables):
    """Strengths drawn per shot: every shot decodes by itself."""
    drawn = bp.drawn_gammas(SEED, G_LOW, G_HIGH)
    report = decode_report(t, RELAY, drawn, share=False)
    return report.groupBy("success", "legs", "mask").agg(F.count("*").alias("n"), F.sum("iterations").alias("iterations"))


# ---- lookup ----------------------------------------------------------------------------------------------


def whole_problem(t: Tables) -> lookup.SmallProblem:
    return lookup.small_problem(I.toy(t), 14)


TOY_RULE = [(r, b) for r in range(1, 7) for b in range(5)]


def _toy_mask(r: int, b: int, first: int = 1, last: int = 7) -> int:
    rows = {0: [(r, 0), (r, 1)], 1: [(r, 0), (r + 1, 0)], 2: [(r, 0)], 3: [(r, 1)], 4: [(r, 1), (r + 1, 1)]}[b]
    return sum(1 << (2 * (rr - first) + c) for rr, c in rows if first <= rr <= last)


def _toy_lam(b: int) -> float:
    return LAM_M if b in (1, 4) else LAM_D


# Weights in SQL: whole parts of 2^-40, so that ties do not depend on the order of sums.
UNIT = 2 ** 40


def _units(lam: float) -> int:
    return round(lam * UNIT)


def _passes(state: str, start: str, entry, reduce_: str) -> str:
    """CTEs state0 to state30: one more column of the toy in each."""
    parts = [f"{state}0 AS MATERIALIZED (SELECT {start})"]
    for j, (r, b) in enumerate(TOY_RULE):
        parts.append(f"{state}{j + 1} AS MATERIALIZED (SELECT {reduce_.format(u=f'(SELECT * FROM {state}{j} UNION ALL SELECT {entry(j, r, b)} FROM {state}{j})')})")
    return ", ".join(parts)


SMALL = _passes(
    "best", "0::BIGINT AS key, 0::BIGINT AS units, []::BIGINT[] AS cols, 1::BIGINT AS ties, 0::BIGINT AS cls",
    lambda j, r, b: f"xor(key, {_toy_mask(r, b)}), units + {_units(_toy_lam(b))}, list_append(cols, {j}), ties, xor(cls, {int(b == 2)})",
    "key, units, min(cols) AS cols, sum(ties)::BIGINT AS ties, arg_min(cls, cols) AS cls FROM (SELECT *, min(units) OVER (PARTITION BY key) AS least FROM {u}) WHERE units = least GROUP BY key, units",
) + f""", table_ AS (SELECT key, units / {UNIT}::DOUBLE AS weight, cols, ties, cls FROM best30),
keys AS (SELECT shots.shot, coalesce(bit_or(1::BIGINT << det::INT), 0) AS key FROM shots LEFT JOIN fired USING (shot) GROUP BY shots.shot)"""


@query("b13_lookup_decode", f"""WITH {I.FIRED}, {SMALL} SELECT shot, CAST(t.key IS NOT NULL AS INT)::BIGINT AS converged, ties, t.cls::BIGINT AS cls, round(weight, 6) AS weight, array_to_string(cols, ',') AS cols FROM keys LEFT JOIN table_ t USING (key)""")
def lookup_decode(t: Tables):
    inc, shots, fired, _ = toy_shots(t)
    problem = whole_problem(t)
    table = lookup.lookup_table(t.spark, problem)
    out = lookup.lookup_decode(lookup.syndrome_keys(fired, shots), table, problem.bound)
    return shaped(out.withColumn("cols", F.array_join("cols", ",")), "shot converged ties cls", "weight", "cols", digits=6)


WF = wilson_sql("failures", "shots")


@query("b14_decode_rates", f"""WITH {I.FIRED}, {SMALL}, truth AS (SELECT shot, count(*) FILTER (fault % 5 = 2) % 2 AS mask FROM true_faults GROUP BY shot),
o AS (SELECT o_orderpriority, coalesce(t.cls, 0) <> coalesce(truth.mask, 0) AS failed, t.key IS NULL AS lost FROM orders JOIN keys ON keys.shot = o_orderkey LEFT JOIN table_ t USING (key) LEFT JOIN truth ON truth.shot = o_orderkey),
c AS (SELECT o_orderpriority, count(*) AS shots, count(*) FILTER (failed) AS failures, count(*) FILTER (lost) AS not_converged FROM o GROUP BY ALL), w AS (SELECT *, {', '.join(f'{e} AS {a}' for a, e in WF.items())} FROM c)
SELECT o_orderpriority, shots, failures, not_converged, round(rate, 9) AS rate, round(lo, 9) AS lo, round(hi, 9) AS hi, round({cycle_sql('rate', 7)}, 9) AS cycle_rate FROM w""")
def decode_rates(t: Tables):
    """Flagship: syndromes of all orders, exact decode, prediction against truth, rates per priority."""
    inc, shots, fired, faults = toy_shots(t)
    problem = whole_problem(t)
    decoded = lookup.lookup_decode(lookup.syndrome_keys(fired, shots), lookup.lookup_table(t.spark, problem), problem.bound)
    guess = decoded.select("shot", F.coalesce("cls", F.lit(0)).alias("mask"))
    failed = gf2.logical_failure(shots, guess, gf2.predict_class(faults, inc.column_class()))
    priority = t.orders.select(F.col("o_orderkey").alias("shot"), "o_orderpriority")
    outcome = failed.join(decoded.select("shot", (~F.col("converged")).alias("lost")), "shot").join(priority, "shot")
    lost = outcome.groupBy("o_orderpriority").agg(F.count_if("lost").alias("not_converged"))
    table = S.rate_table(outcome, ["o_orderpriority"], 7).join(lost, "o_orderpriority")
    return shaped(table, "shots failures not_converged", "rate lo hi cycle_rate", "o_orderpriority")


PRIORS = [0.02 if b in (1, 4) else 0.01 for _, b in TOY_RULE]


MASSES = _passes(
    "mass", "0::BIGINT AS key, 0::BIGINT AS cls, 1::DOUBLE AS p",
    lambda j, r, b: f"xor(key, {_toy_mask(r, b)}), xor(cls, {int(b == 2)}), p * {'0.02/0.98' if b in (1, 4) else '0.01/0.99'}",
    "key, cls, sum(p) AS p FROM {u} GROUP BY key, cls")


@query("r7_class_posterior", f"""WITH {I.FIRED}, {SMALL}, {MASSES},
ml AS (SELECT key, arg_max(cls, (p, -cls)) AS ml_class, max(p)/sum(p) AS posterior FROM mass30 GROUP BY key)
SELECT shot, ml_class::BIGINT AS ml_class, round(posterior, 6) AS posterior, CAST(ml_class = t.cls AS INT)::BIGINT AS agrees FROM keys JOIN ml USING (key) JOIN table_ t USING (key)""")
def class_posterior(t: Tables):
    _, shots, fired, _ = toy_shots(t)
    problem = whole_problem(t)
    ml = lookup.most_likely_class(lookup.class_posterior(t.spark, problem, PRIORS))
    table = lookup.lookup_table(t.spark, problem).select("key", "cls")
    out = lookup.syndrome_keys(fired, shots).join(ml, "key").join(table, "key").withColumn("agrees", F.col("ml_class") == F.col("cls"))
    return shaped(out, "shot ml_class agrees", "posterior", digits=6)


# ---- windowed decoding -------------------------------------------------------------------------------------


def loaded(t: Tables, spec: WindowSpec) -> windowed.LoadedPlan:
    return windowed.load_plan(plan_windows(I.toy(t), spec))


def words(t: Tables):
    _, shots, fired, _ = toy_shots(t)
    return windowed.pack_rounds(fired, shots, 7, 2)


def decoded_windows(t: Tables, spec: WindowSpec, max_size: int | None = None):
    plan = loaded(t, spec)
    return windowed.decode_windows(words(t), plan, windowed.lookup_inner(t.spark, plan, max_size))


MERGED = 0.02 * (1 - 0.01) + 0.01 * (1 - 0.02)
LAM_X = math.log((1 - MERGED) / MERGED)


class WindowSql:
    """Windowed lookup decoding of the toy in SQL, window by window, from the problem's rule."""

    def __init__(self, width: int, commit: int, policy: str = "commit_anyway", deferrals: int = 0, max_size: int | None = None,
                 low: float | None = None):
        self.parts = [I.FIRED, "st AS MATERIALIZED (SELECT shots.shot, coalesce(bit_or(1::BIGINT << det::INT), 0) AS resid, 0::BIGINT AS frame, FALSE AS over FROM shots LEFT JOIN fired USING (shot) GROUP BY shots.shot)"]
        state, outs, made = "st", [], {}
        k = 0
        while True:
            t = 1 + k * commit
            attempts = []
            for a in range(deferrals + 1 if policy == "defer" else 1):
                last = t + width + a * commit - 1
                attempts.append((a, min(last, 7), last >= 7))
                if last >= 7:
                    break
            opened = f"o{k}"
            self.parts.append(f"{opened} AS (SELECT shot, resid, frame, over, NOT over AS open, 0 AS legs FROM {state})")
            cur = opened
            for a, last, final in attempts:
                shape = ("final", t) if final else ("bulk", last - t + 1)
                if shape not in made:
                    made[shape] = self._table(f"tab{len(made)}", t, last, final, commit, max_size)
                tab, shift = made[shape], 2 * (t - 1)
                width_mask = (1 << (2 * (last - t + 1))) - 1
                end = last if final else t + commit - 1
                seen = (1 << (2 * (end - t + 1))) - 1
                again = "x.key IS NULL" if low is None else f"(x.key IS NULL OR x.weight > {low})"
                retry = again if policy == "defer" and a != attempts[-1][0] else "FALSE"
                flagged = "FALSE" if policy == "commit_anyway" else "x.key IS NULL"
                j = f"j{k}_{a}"
                self.parts.append(f"""{j} AS MATERIALIZED (SELECT c.shot, c.resid, c.frame, c.over, c.open, c.open AND NOT ({retry}) AS fin, x.key IS NOT NULL AS ok, c.legs + CASE WHEN c.open THEN 1 ELSE 0 END AS legs,
 xor(c.resid, coalesce(x.flip, 0) << {shift}) AS left_, xor(c.frame, coalesce(x.ccls, 0)) AS frame2, coalesce(x.ties, 0) AS ties, CASE WHEN x.key IS NULL THEN 'inf'::DOUBLE ELSE x.weight END AS weight, coalesce(x.cweight, 0) AS cweight,
 coalesce(list_transform(x.cols, lambda j: j + {5 * (t - 1)}), []) AS sol, coalesce(list_transform(x.ccols, lambda j: j + {5 * (t - 1)}), []) AS com, {flagged} AS flagged FROM {cur} c LEFT JOIN {tab} x ON x.key = (c.resid >> {shift}) & {width_mask})""")
                outs.append(f"""SELECT shot, {k}::BIGINT AS "window", {a + 1}::BIGINT AS attempts, CAST(ok AS INT)::BIGINT AS converged, legs::BIGINT AS legs, ties::BIGINT AS ties, round(weight, 6) AS weight, round(cweight, 6) AS committed_weight,
 bit_count((left_ >> {shift}) & {seen})::BIGINT AS unexplained, CAST(flagged AS INT)::BIGINT AS flagged, array_to_string(sol, ',') AS solution, array_to_string(com, ',') AS committed, frame2 AS frame FROM {j} WHERE fin""")
                nxt = f"n{k}_{a}"
                self.parts.append(f"""{nxt} AS MATERIALIZED (SELECT shot, CASE WHEN fin THEN left_ ELSE resid END AS resid, CASE WHEN fin THEN frame2 ELSE frame END AS frame, over OR (fin AND {final}) AS over, open AND NOT fin AS open, legs FROM {j})""")
                cur = nxt
            state = cur
            if attempts[0][2]:
                break
            k += 1
        self.final = state
        self.parts.append("wins AS (" + " UNION ALL ".join(outs) + ")")

    def _table(self, name: str, t: int, last: int, final: bool, commit: int, max_size: int | None) -> str:
        cols = []  # (relative fault, mask, lam, class when committed, committed)
        for r, b in TOY_RULE:
            if not t <= r <= last:
                continue
            cut = not final and r == last
            if cut and b in (2, 4):
                continue
            committed = final or r < t + commit
            cols.append((5 * (r - t) + b, _toy_mask(r, b, t, last), LAM_X if cut and b in (1, 3) else _toy_lam(b), int(committed and b == 2), committed))
        n = len(cols)

        def fold(values, only=None, op="xor"):
            out = "0::BIGINT"
            for i, v in enumerate(values):
                if only is not None and not only[i]:
                    continue
                term = f"CASE WHEN (s >> {i}) & 1 = 1 THEN {v!r} ELSE 0 END"
                out = f"xor({out}, {term})" if op == "xor" else f"({out} + {term})"
            return out

        masks, cls, com = ([c[i] for c in cols] for i in (1, 3, 4))
        lams = [_units(c[2]) for c in cols]

        def listed(only=None):
            return "list_filter([" + ", ".join(f"CASE WHEN (s >> {i}) & 1 = 1 THEN {c[0]} END" for i, c in enumerate(cols) if only is None or only[i]) + "], lambda v: v IS NOT NULL)"

        size = "" if max_size is None else f" WHERE bit_count(s) <= {max_size}"
        self.parts.append(f"s{name} AS (SELECT s, {fold(masks)} AS key, {fold(lams, None, '+')} AS units, {listed()} AS cols, {fold(masks, com)} AS flip, {fold(cls, com)} AS ccls, {listed(com)} AS ccols, {fold(lams, com, '+')} AS cweight FROM range({1 << n}) r(s){size})")
        self.parts.append(f"{name} AS MATERIALIZED (SELECT key, units / {UNIT}::DOUBLE AS weight, cols, flip, ccls, ccols, cweight / {UNIT}::DOUBLE AS cweight, count(*) OVER (PARTITION BY key, units) AS ties FROM s{name} QUALIFY row_number() OVER (PARTITION BY key ORDER BY units, cols) = 1)")
        return name

    def sql(self, tail: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + tail


INTS, DOUBLES, TEXTS = "shot window attempts converged legs ties unexplained flagged frame", "weight committed_weight", "solution committed"


def window_report(decoded):
    rows = windowed.window_records(decoded).withColumn("solution", F.array_join("solution", ",")).withColumn("committed", F.array_join("committed", ","))
    return shaped(rows, INTS, DOUBLES, TEXTS, digits=6)


@query("x3_decode_windows_3_1", WindowSql(3, 1).sql("SELECT * FROM wins"))
def decode_windows_31(t: Tables):
    return window_report(decoded_windows(t, WindowSpec(3, 1, 3)))


@query("x3_decode_windows_4_2", WindowSql(4, 2).sql("SELECT * FROM wins"))
def decode_windows_42(t: Tables):
    return window_report(decoded_windows(t, WindowSpec(4, 2, 4)))


@query("x4_commit_records", WindowSql(3, 1).sql('SELECT shot, "window", unnest(string_split(committed, \',\'))::BIGINT AS fault FROM wins WHERE committed <> \'\''))
def commit_records(t: Tables):
    return shaped(windowed.window_commits(decoded_windows(t, WindowSpec(3, 1, 3))), "shot window fault")


@query("x5_flag_unconverged", WindowSql(3, 1, "flag", 0, 1).sql("SELECT * FROM wins"))
def flag_unconverged(t: Tables):
    """A table of single faults only: windows with a richer syndrome do not converge and are flagged."""
    return window_report(decoded_windows(t, WindowSpec(3, 1, 3, on_failure="flag"), max_size=1))


@query("x5_defer_unconverged", WindowSql(2, 1, "defer", 2, 1).sql("SELECT * FROM wins"))
def defer_unconverged(t: Tables):
    return window_report(decoded_windows(t, WindowSpec(2, 1, 2, on_failure="defer", max_deferrals=2), max_size=1))


@query("x6_low_confidence_flag", WindowSql(3, 1).sql('SELECT shot, "window", CAST(weight > 6 AS INT)::BIGINT AS flagged, CAST(weight > 6 AS INT)::BIGINT AS low, frame FROM wins'))
def low_confidence_flag(t: Tables):
    """Windows whose solution weighs more than 6 are of low confidence and flagged."""
    plan = loaded(t, WindowSpec(3, 1, 3))
    inner = windowed.with_low(windowed.lookup_inner(t.spark, plan), lambda: F.col("weight") > 6)
    return shaped(windowed.window_records(windowed.decode_windows(words(t), plan, inner, on_low="flag")), "shot window flagged low frame")


@query("x6_low_confidence_defer", WindowSql(3, 1, "defer", 1, None, 6).sql("""SELECT "window", attempts, CAST(weight > 6 AS INT)::BIGINT AS low, count(*) AS n FROM wins GROUP BY ALL"""))
def low_confidence_defer(t: Tables):
    plan = loaded(t, WindowSpec(3, 1, 3, on_failure="defer", max_deferrals=1))
    inner = windowed.with_low(windowed.lookup_inner(t.spark, plan), lambda: F.col("weight") > 6)
    rows = windowed.window_records(windowed.decode_windows(words(t), plan, inner, on_low="defer"))
    return shaped(rows.groupBy("window", "attempts", "low").agg(F.count("*").alias("n")), "window attempts low n")


class TimedWindowsSql(BpSql):
    """Windows of the timed incidence with message passing inside, unrolled over windows and iterations."""

    WIDTH, COMMIT, ITERATIONS, POSITIONS = 12, 10, 3, 8
    ROUNDS = WIDTH + COMMIT * (POSITIONS - 1) - 2  # the months that orders span; the last window is cut

    def __init__(self):
        m = I.CHECKS
        self.fixed, self.per_shot, self.top = False, False, "1e300::DOUBLE"
        self.parts = [PL.seen_sql(self.WIDTH, self.COMMIT), PL.ORDER_SHOTS, "shots AS (SELECT DISTINCT o_custkey AS shot FROM orders)", "r0 AS MATERIALIZED (SELECT shot, det FROM sfired)"]
        records = []
        for k in range(self.POSITIONS):
            t = 1 + k * self.COMMIT
            final = k == self.POSITIONS - 1
            last = self.ROUNDS if final else t + self.WIDTH - 1
            low, high, end = (t - 1) * m, last * m, (last if final else t + self.COMMIT - 1) * m
            self.parts += [
                f"""g{k} AS MATERIALIZED (SELECT fault, unnest(sup) AS det, ln((1 - p)/p) AS lam, "commit", cls0 FROM col WHERE "window" = {k})""",
                f"lost{k} AS (SELECT DISTINCT shot FROM r{k} WHERE det >= {low} AND det < {high} AND det NOT IN (SELECT det FROM g{k}))",
                f"""m{k} AS MATERIALIZED (SELECT s.shot, g.det, g.fault, g.lam, (f.det IS NOT NULL)::INT AS fired, g.lam AS nu, g.lam AS marg, FALSE AS hard, FALSE AS done, 0 AS it, 0 AS st
 FROM shots s CROSS JOIN g{k} g LEFT JOIN r{k} f ON f.shot = s.shot AND f.det = g.det)"""]
            self.also = f" AND shot NOT IN (SELECT shot FROM lost{k})"
            state = f"m{k}"
            for i in range(self.ITERATIONS):
                state = self.iterate(state, f"{k}_{i}", i, False, None, self.ITERATIONS)
            self.parts += [
                f"leg{k} AS (SELECT shot, max(it)::BIGINT AS iterations, bool_and(done) AS converged FROM {state} GROUP BY shot)",
                f"""sup{k} AS MATERIALIZED (SELECT DISTINCT x.shot, x.fault, x.lam, g."commit", cls0 FROM {state} x JOIN g{k} g USING (fault) WHERE hard)""",
                f"""r{k + 1} AS MATERIALIZED (SELECT shot, det FROM (SELECT shot, det FROM r{k} UNION ALL SELECT shot, det FROM sup{k} s JOIN (SELECT fault, det FROM g{k}) g USING (fault) WHERE s."commit") GROUP BY ALL HAVING count(*) % 2 = 1)""",
                f"left{k} AS (SELECT shot, count(*) AS n FROM r{k + 1} WHERE det >= {low} AND det < {end} GROUP BY shot)",
                f"""w{k} AS (SELECT shot, sum(lam) AS weight, sum(lam) FILTER ("commit") AS cweight, string_agg(fault, ',' ORDER BY fault) AS sol, string_agg(fault, ',' ORDER BY fault) FILTER ("commit") AS com,
 bit_xor(cls0) FILTER ("commit") AS flip FROM sup{k} GROUP BY shot)"""]
            records.append(f"""SELECT l.shot, {k}::BIGINT AS "window", CAST(converged AS INT)::BIGINT AS converged, iterations, coalesce(n, 0)::BIGINT AS unexplained,
 round(CASE WHEN converged THEN coalesce(weight, 0) ELSE 'inf'::DOUBLE END, 6) AS weight, round(coalesce(cweight, 0), 6) AS committed_weight, coalesce(flip, 0)::BIGINT AS flip,
 coalesce(sol, '') AS solution, coalesce(com, '') AS committed FROM leg{k} l LEFT JOIN w{k} USING (shot) LEFT JOIN left{k} USING (shot)""")
        self.parts.append("wins AS (" + " UNION ALL ".join(records) + ")")


TIMED_SPEC = WindowSpec(TimedWindowsSql.WIDTH, TimedWindowsSql.COMMIT, TimedWindowsSql.WIDTH)


def timed_windows(t: Tables, spec: WindowSpec = TIMED_SPEC, inner: sparse.MessagePassing | None = None):
    """(incidence, fired, decoded windows) of the customers' shots on the timed incidence; its windows have some 300 columns."""
    inc = I.timed(t)
    fired = gf2.gf2_product(PL.order_shots(t), inc.edges)
    shots = t.orders.select(F.col("o_custkey").alias("shot")).distinct()
    inner = inner or sparse.MessagePassing(RelaySpec(TimedWindowsSql.ITERATIONS, alpha=None))
    return inc, fired, sparse.decode_windows(fired, shots, plan_windows(inc, spec), inner)


@query("x3_decode_timed_windows", TimedWindowsSql().sql("""SELECT shot, "window", converged, iterations, unexplained, xor_ AS frame, weight, committed_weight, solution, committed
FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list(flip) OVER (PARTITION BY shot ORDER BY "window")), lambda a, b: xor(a, b)) AS xor_ FROM wins)"""))
def decode_timed_windows(t: Tables):
    """Windows of hundreds of columns, decoded by message passing on the plan's edges."""
    _, _, decoded = timed_windows(t)
    rows = windowed.window_records(decoded).withColumn("solution", F.array_join("solution", ",")).withColumn("committed", F.array_join("committed", ","))
    return shaped(rows, "shot window converged iterations unexplained frame", "weight committed_weight", "solution committed", digits=6)


@query("x6_iteration_cap", TimedWindowsSql().sql("""SELECT "window", count(*) AS shots, count(*) FILTER (iterations > 2) AS capped FROM wins WHERE "window" = 0 GROUP BY ALL"""))
def window_iteration_cap(t: Tables):
    """Shots whose first window needs more than the two iterations that the plan allows: they hit the cap."""
    _, _, decoded = timed_windows(t, replace(TIMED_SPEC, iteration_cap=2))
    first = windowed.window_records(decoded).where("window = 0")
    return shaped(first.groupBy("window").agg(F.count("*").alias("shots"), F.count_if("cap_hit").alias("capped")), "window shots capped")


@query("v1_pluggable_inner", TimedWindowsSql().sql("""SELECT "window", converged, count(*) AS n, sum(iterations)::BIGINT AS iterations, sum(unexplained)::BIGINT AS unexplained FROM wins GROUP BY ALL"""))
def pluggable_inner(t: Tables):
    """The windowed decode with message passing in place of the lookup tables."""
    rows = windowed.window_records(timed_windows(t)[2])
    return shaped(rows.groupBy("window", "converged").agg(F.count("*").alias("n"), F.sum("iterations").alias("iterations"), F.sum("unexplained").alias("unexplained")),
                  "window converged n iterations unexplained")


@query("a42_check_timed_outcomes", TimedWindowsSql().sql("""SELECT 0::BIGINT AS violations, count(DISTINCT shot) AS shots, count(*) AS windows, count(*) FILTER (converged = 0) AS lost FROM wins"""))
def check_timed_outcomes(t: Tables):
    """The invariants of windowed decoding on windows of any size."""
    inc, fired, decoded = timed_windows(t)
    records = windowed.window_records(decoded)
    bad = checks.check_outcomes(inc, fired, records, windowed.window_commits(decoded), sparse.residual_rows(decoded), decoded.select("shot", "frame"))
    tally = records.agg(F.struct(F.countDistinct("shot").alias("shots"), F.count("*").alias("windows"), F.count_if(~F.col("converged")).alias("lost"))).scalar()
    return bad.agg(F.count("*").alias("violations")).withColumn("_t", tally).select("violations", "_t.*")


@query("v2_round_function", f"WITH {I.FIRED} SELECT det // 2 + 1 AS round, count(*) AS fired FROM fired GROUP BY ALL")
def round_function(t: Tables):
    from paritas.operators.incidence import with_round

    inc, _, fired, _ = toy_shots(t)
    rounds, _ = with_round(inc.detectors.select("det"), F.floor(F.col("det") / 2) + 1)
    return shaped(fired.join(rounds, "det").groupBy("round").agg(F.count("*").alias("fired")), "round fired")


@query("a42_check_outcomes", "SELECT 0::BIGINT AS violations, count(*) AS shots FROM orders")
def check_outcomes(t: Tables):
    inc, _, fired, _ = toy_shots(t)
    decoded = decoded_windows(t, WindowSpec(3, 1, 3))
    bad = checks.check_outcomes(inc, fired, windowed.window_records(decoded), windowed.window_commits(decoded), windowed.residual_rows(decoded, 2), decoded.select("shot", "frame"))
    return bad.agg(F.count("*").alias("violations")).withColumn("shots", decoded.agg(F.count("*")).scalar())


@query("a42_broken_outcomes", f"""WITH {I.FIRED} SELECT 'syndrome_mismatch' AS code, count(*) AS n FROM fired UNION ALL SELECT 'unexplained_mismatch', count(*) FROM shots""")
def broken_outcomes(t: Tables):
    """Outcomes that committed nothing, claim one unexplained row each and no residual: every fired row is a violation."""
    inc, shots, fired, faults = toy_shots(t)
    windows = shots.select("shot", F.lit(1).alias("unexplained"), F.lit(False).alias("converged"))
    none = faults.where("fault < 0")
    bad = checks.check_outcomes(inc, fired, windows, none, fired.where("det < 0"), shots.withColumn("frame", F.lit(0)))
    return bad.groupBy("code").agg(F.count("*").alias("n"))
