"""Rates, intervals, quantiles, paired comparisons and confidence signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritas.catalog import inputs as I
from paritas.catalog.base import Tables, cycle_sql, num, query, qubit_sql, shaped, shaped_sql, wilson_sql
from paritas.operators import bootstrap, ranks
from paritas.operators import statistics as S

ROUNDS, QUBITS = 12, 8
W = wilson_sql("failures", "shots")


def _rates_sql(source: str, by: str) -> str:
    cols = {**W, "judged": "failures >= 100"}
    inner = ", ".join(f"{e} AS {a}" for a, e in cols.items())
    return f"""WITH {source}, counted AS (SELECT {by}, count(*) AS shots, count(*) FILTER (test_failed) AS failures FROM pairs GROUP BY ALL),
w AS (SELECT *, {inner} FROM counted)
SELECT {by}, shots, failures, CAST(judged AS INT)::BIGINT AS judged, round(rate, 9) AS rate, round(lo, 9) AS lo, round(hi, 9) AS hi"""


@query("a7_wilson_rate_table", _rates_sql(I.PAIRS, "o_orderpriority") + " FROM w")
def wilson_rates(t: Tables):
    table = S.rate_table(I.pairs(t), ["o_orderpriority"], ROUNDS, failed="test_failed")
    return shaped(table, "shots failures judged", "rate lo hi", "o_orderpriority")


@query("a8_block_rate_per_cycle", _rates_sql(I.PAIRS, "chunk") + f""", round({cycle_sql('rate', ROUNDS)}, 9) AS cycle_rate,
round({cycle_sql('lo', ROUNDS)}, 9) AS cycle_lo, round({cycle_sql('hi', ROUNDS)}, 9) AS cycle_hi FROM w""")
def cycle_rates(t: Tables):
    table = S.rate_table(I.pairs(t), ["chunk"], ROUNDS, failed="test_failed")
    return shaped(table, "chunk shots failures judged", "rate lo hi cycle_rate cycle_lo cycle_hi")


@query("a9_rate_per_qubit_per_cycle", _rates_sql(I.PAIRS, "o_orderstatus") + f""", round({qubit_sql('rate', ROUNDS, 2)}, 9) AS qubit_rate,
round({qubit_sql('lo', ROUNDS, 2)}, 9) AS qubit_lo, round({qubit_sql('hi', ROUNDS, 2)}, 9) AS qubit_hi FROM w""")
def qubit_rates(t: Tables):
    table = S.rate_table(I.pairs(t), ["o_orderstatus"], ROUNDS, 2, failed="test_failed")
    return shaped(table, "shots failures judged", "rate lo hi qubit_rate qubit_lo qubit_hi", "o_orderstatus")


COUNTS = """counts AS (SELECT {by} count(*) FILTER (ref_failed AND test_failed) AS n11, count(*) FILTER (ref_failed AND NOT test_failed) AS n10,
count(*) FILTER (NOT ref_failed AND test_failed) AS n01, count(*) FILTER (NOT ref_failed AND NOT test_failed) AS n00 FROM pairs {group})"""


@query("a10_pair_counts", f"WITH {I.PAIRS}, {COUNTS.format(by='chunk,', group='GROUP BY chunk')} SELECT * FROM counts")
def pair_counts(t: Tables):
    return shaped(S.pair_counts(I.pairs(t), ["chunk"]), "chunk n11 n10 n01 n00")


# V per customer: small groups, so every degenerate rule occurs.
HALF = "0.024999999999999994"
A11 = f"""WITH per AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS ref_failed, o_totalprice > 400000 AS test_failed FROM orders),
pairs AS (SELECT * FROM per), {COUNTS.format(by='o_custkey,', group='GROUP BY o_custkey')},
c AS (SELECT *, n11 + n01 AS tf, n11 + n10 AS rf, n10 + n01 AS d FROM counts),
m AS (SELECT *, CASE WHEN tf = 0 AND rf = 0 THEN 'undefined' WHEN d = 0 THEN 'poisson-zero-discordant'
  WHEN tf = 0 OR rf = 0 THEN 'exact-conditional' ELSE 'log-normal' END AS method,
  CASE WHEN tf > 0 AND rf > 0 THEN tf / rf END AS v,
  CASE WHEN tf > 0 AND rf > 0 THEN sqrt(d / (tf * rf)) END AS se, -ln(0.025) AS up FROM c)
SELECT o_custkey, n11, n10, n01, n00, method,
round(CASE method WHEN 'undefined' THEN NULL WHEN 'poisson-zero-discordant' THEN 1 WHEN 'log-normal' THEN v
  ELSE CASE WHEN tf = 0 THEN 0 ELSE 'inf'::DOUBLE END END, 6) AS value,
round(CASE method WHEN 'undefined' THEN 0 WHEN 'poisson-zero-discordant' THEN n11 / (n11 + up)
  WHEN 'log-normal' THEN v * exp(-1.959963984540054 * se)
  ELSE CASE WHEN tf = 0 THEN 0 ELSE pow(0.025, 1/d) / (1 - pow(0.025, 1/d)) END END, 6) AS lo,
round(CASE method WHEN 'undefined' THEN 'inf'::DOUBLE WHEN 'poisson-zero-discordant' THEN (n11 + up) / n11
  WHEN 'log-normal' THEN v * exp(1.959963984540054 * se)
  ELSE CASE WHEN tf = 0 THEN (1 - pow(0.025, 1/d)) / pow(0.025, 1/d) ELSE 'inf'::DOUBLE END END, 6) AS hi FROM m"""


@query("a11_pair_table", A11)
def pair_table(t: Tables):
    per = t.orders.select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("ref_failed"), (F.col("o_totalprice") > 400000).alias("test_failed"))
    return shaped(S.pair_table(per, ["o_custkey"]), "o_custkey n11 n10 n01 n00", "value lo hi", "method", digits=6)


@query("a12_katz_ratio", """WITH c AS (SELECT count(*) FILTER (o_orderstatus='P' AND o_totalprice>400000) AS k1, count(*) FILTER (o_orderstatus='P') AS n1,
count(*) FILTER (o_orderstatus='F' AND o_totalprice>400000) AS k2, count(*) FILTER (o_orderstatus='F') AS n2 FROM orders),
v AS (SELECT *, (k1/n1)/(k2/n2) AS v, sqrt(1/k1 - 1/n1 + 1/k2 - 1/n2) AS se FROM c)
SELECT k1, n1, k2, n2, round(v, 9) AS ratio, round(v*exp(-1.959963984540054*se), 9) AS lo, round(v*exp(1.959963984540054*se), 9) AS hi FROM v""")
def katz(t: Tables):
    arms = t.orders.select(F.col("o_orderstatus").alias("arm"), (F.col("o_totalprice") > 400000).alias("failed"))
    return shaped(S.katz_table(arms, "arm", "F", "P"), "k1 n1 k2 n2", "ratio lo hi")


BOOT = 40
DRAW = "('0x' || substr(md5('{seed}:' || b || ':' || i), 1, 15))::BIGINT % n"


def _mean_sql(source: str, x: str, seed: int) -> str:
    return f"""WITH h AS (SELECT {x} AS v, count(*) AS c FROM {source} GROUP BY ALL),
cum AS (SELECT *, sum(c) OVER (ORDER BY v)::BIGINT AS upto, (sum(c) OVER ())::BIGINT AS n FROM h),
draws AS (SELECT b, {DRAW.format(seed=seed)} AS d FROM (SELECT any_value(n) AS n FROM cum), range({BOOT}) r(b), range((SELECT count(*) FROM {source})) s(i)),
m AS (SELECT b, avg(v) AS s FROM draws ASOF JOIN (SELECT v, upto - c AS start FROM cum) c ON d >= start GROUP BY b),
k AS (SELECT s, row_number() OVER (ORDER BY s) AS r FROM m)
SELECT {BOOT}::BIGINT AS resamples, round((SELECT avg({x}) FROM {source}), 6) AS mean,
round((SELECT s FROM k WHERE r = greatest(ceil(0.025 * {BOOT}), 1)), 6) AS lo, round((SELECT s FROM k WHERE r = ceil(0.975 * {BOOT})), 6) AS hi"""


@query("a13_bootstrap_mean", _mean_sql("orders", "floor(o_totalprice/1000)::DOUBLE", 7))
def bootstrap_mean(t: Tables):
    x = t.orders.select(F.floor(F.col("o_totalprice") / 1000).alias("x"))
    return shaped(bootstrap.bootstrap_mean(x, "x", BOOT, 7), "resamples", "mean lo hi", digits=6)


@query("a13_bootstrap_mean_multinomial", _mean_sql("lineitem", "l_quantity::DOUBLE", 5))
def bootstrap_mean_of_few_values(t: Tables):
    """Fifty distinct values, so that their multiplicities are what a resample is."""
    x = t.lineitem.select(F.col("l_quantity").alias("x"))
    return shaped(bootstrap.bootstrap_mean(x, "x", BOOT, 5), "resamples", "mean lo hi", digits=6)


LEVELS = ["0.5", "0.9", "0.99", "0.999"]
LEVEL_ROWS = ", ".join(f"('{q}', {q}::DECIMAL(18,9))" for q in LEVELS)


@query("a14_bootstrap_quantiles", f"""WITH h AS (SELECT floor(o_totalprice/1000)::DOUBLE AS v, count(*) AS c FROM orders GROUP BY ALL),
cum AS (SELECT *, sum(c) OVER (ORDER BY v)::BIGINT AS upto, (sum(c) OVER ())::BIGINT AS n FROM h),
draws AS (SELECT b, n, {DRAW.format(seed=11)} AS d FROM (SELECT any_value(n) AS n FROM cum), range({BOOT}) r(b), range((SELECT count(*) FROM orders)) s(i)),
m AS (SELECT b, n, v, row_number() OVER (PARTITION BY b ORDER BY v) AS r FROM draws ASOF JOIN (SELECT v, upto - c AS start FROM cum) c ON d >= start),
q AS (SELECT level, b, v AS s FROM m, (VALUES {LEVEL_ROWS}) l(level, q) WHERE r = least(greatest(ceil(q * n), 1), n)),
k AS (SELECT level, s, row_number() OVER (PARTITION BY level ORDER BY s) AS r FROM q)
SELECT level, count(*) AS resamples, round(max(s) FILTER (r = greatest(ceil(0.025 * {BOOT}), 1)), 6) AS lo,
round(max(s) FILTER (r = ceil(0.975 * {BOOT})), 6) AS hi FROM k GROUP BY level""")
def bootstrap_quantiles(t: Tables):
    x = t.orders.select(F.floor(F.col("o_totalprice") / 1000).alias("x"))
    return shaped(bootstrap.bootstrap_quantiles(x, "x", LEVELS, BOOT, 11), "resamples", "lo hi", "level", digits=6)


def _paired_sql(resamples: int, seed: int) -> str:
    return f"""WITH {I.PAIRS}, {COUNTS.format(by='', group='')},
draws AS (SELECT b, n11, n10, n01, {DRAW.format(seed=seed)} AS d FROM (SELECT *, n11+n10+n01+n00 AS n FROM counts), range({resamples}) r(b), range((SELECT count(*) FROM orders)) s(i)),
t AS (SELECT b, count(*) FILTER (d < n11) AS a, count(*) FILTER (d >= n11 AND d < n11+n10) AS r, count(*) FILTER (d >= n11+n10 AND d < n11+n10+n01) AS x FROM draws GROUP BY b),
s AS (SELECT CASE WHEN a + r = 0 THEN 'inf'::DOUBLE ELSE (a + x)/(a + r) END AS s FROM t WHERE a + r > 0 OR a + x > 0),
k AS (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS m FROM s)
SELECT (SELECT round((n11+n01)/(n11+n10), 9) FROM counts) AS value, max(m) AS resamples, {resamples} - max(m) AS left_out,
round(max(s) FILTER (rn = greatest(ceil(0.025*m), 1)), 9) AS lo, round(max(s) FILTER (rn = ceil(0.975*m)), 9) AS hi FROM k"""


@query("a15_paired_bootstrap", _paired_sql(BOOT, 3))
def paired_bootstrap(t: Tables):
    return shaped(bootstrap.paired_bootstrap(I.pairs(t), BOOT, 3), "resamples left_out", "value lo hi")


@query("a15_paired_bootstrap_multinomial", _paired_sql(100, 4))
def paired_bootstrap_of_more_resamples(t: Tables):
    return shaped(bootstrap.paired_bootstrap(I.pairs(t), 100, 4), "resamples left_out", "value lo hi")


RANKS = ["0", "0.07", "0.5", "0.9", "0.99", "0.999", "1"]
RANK_ROWS = ", ".join(f"('{q}', {q}::DECIMAL(18,9))" for q in RANKS)


@query("a16_nearest_rank", f"""WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r,
count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, level, n, round(l_extendedprice, 6) AS value FROM r, (VALUES {RANK_ROWS}) l(level, q) WHERE r = least(greatest(ceil(q*n), 1), n)""")
def nearest_rank(t: Tables):
    out = ranks.nearest_rank(t.lineitem, "l_extendedprice", RANKS, ["l_returnflag"]).withColumnRenamed("l_extendedprice", "value")
    return shaped(out, "n", "value", "level l_returnflag", digits=6)


COST_SQL = """SELECT {by} count(*) AS n, round(avg(x), 6) AS mean, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max,
max(x) FILTER (r = greatest(ceil(0.5::DECIMAL(18,9)*n), 1))::DOUBLE AS p50, max(x) FILTER (r = ceil(0.9::DECIMAL(18,9)*n))::DOUBLE AS p90,
max(x) FILTER (r = ceil(0.99::DECIMAL(18,9)*n))::DOUBLE AS p99, max(x) FILTER (r = ceil(0.999::DECIMAL(18,9)*n))::DOUBLE AS p999 FROM {source} {group}"""


@query("a17_cost_block", f"""WITH ranked AS (SELECT l_shipmode, x, row_number() OVER (PARTITION BY l_shipmode ORDER BY x) AS r, count(*) OVER (PARTITION BY l_shipmode) AS n
FROM (SELECT l_linestatus AS l_shipmode, l_quantity AS x FROM lineitem)) {COST_SQL.format(by='l_shipmode,', source='ranked', group='GROUP BY l_shipmode')}""")
def cost_block(t: Tables):
    x = t.lineitem.select(F.col("l_linestatus").alias("l_shipmode"), F.col("l_quantity").alias("x"))
    return shaped(ranks.cost_block(x, "x", ["l_shipmode"]), "n", "mean min max p50 p90 p99 p999", "l_shipmode", digits=6)


@query("a18_detector_density", f"""WITH {I.FIRED}, d AS (SELECT shot, count(*) AS n FROM fired GROUP BY shot)
SELECT shots.shot, round(coalesce(n, 0)/14, 9) AS density FROM shots LEFT JOIN d USING (shot)""")
def density(t: Tables):
    from paritas.operators.gf2 import gf2_product

    fired = gf2_product(I.true_faults(t), I.toy(t).edges)
    return shaped(S.detector_density(I.shots(t), fired, 14), "shot", "density")


CLUSTERS = """clusters AS (SELECT l_orderkey AS shot, l_suppkey % 10 AS c, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
totals AS (SELECT o_orderkey AS shot, 1000.0 + o_custkey AS total FROM orders)"""


def _clusters(t: Tables):
    returned = t.lineitem.where("l_returnflag = 'R'")
    clusters = returned.groupBy(F.col("l_orderkey").alias("shot"), (F.col("l_suppkey") % 10).alias("c")).agg(F.sum("l_quantity").alias("w"))
    return clusters, t.orders.select(F.col("o_orderkey").alias("shot"), (F.lit(1000.0) + F.col("o_custkey")).alias("total"))


@query("a19_norm_fraction", f"""WITH {CLUSTERS}, n AS (SELECT shot, sqrt(sum(w*w)) AS n2, max(w) AS nmax FROM clusters GROUP BY shot)
SELECT t.shot, round(coalesce(n2, 0)/total, 9) AS q2, round(coalesce(nmax, 0)/total, 9) AS qmax FROM totals t LEFT JOIN n USING (shot)""")
def norm_fraction(t: Tables):
    clusters, totals = _clusters(t)
    two = S.norm_fraction(clusters, totals, 2.0).withColumnRenamed("q", "q2")
    top = S.norm_fraction(clusters, totals, float("inf")).withColumnRenamed("q", "qmax")
    return shaped(two.join(top, "shot"), "shot", "q2 qmax")


GRID = [i / 10 for i in range(-20, 21)]
GAPS = "gaps AS (SELECT (5.0 - o_totalprice/100000)::DOUBLE AS d, o_orderpriority < '3' AS f FROM orders)"


def _gaps(t: Tables):
    return t.orders.select((F.lit(5.0) - F.col("o_totalprice") / 100000).alias("gap"), (F.col("o_orderpriority") < "3").alias("failed"))


@query("a20_logistic_profile", f"""WITH {GAPS}, g AS (SELECT k/10::DOUBLE AS kappa FROM range(-20, 21) t(k))
SELECT round(kappa, 9) AS kappa, round(sum(CASE WHEN f THEN -ln(1 + exp(kappa*d)) ELSE -ln(1 + exp(-kappa*d)) END), 5) AS loglik,
round(sum(CASE WHEN f THEN d/(1 + exp(kappa*d)) - d ELSE d/(1 + exp(kappa*d)) END), 5) AS slope FROM gaps, g GROUP BY kappa""")
def logistic_profile(t: Tables):
    profile = S.logistic_profile(S.gap_histogram(_gaps(t)), GRID)
    return profile.select(num("kappa").alias("kappa"), num("loglik", 5).alias("loglik"), num("slope", 5).alias("slope"))


@query("a20_logistic_slope", f"""WITH RECURSIVE {GAPS}, h AS MATERIALIZED (SELECT d, count(*) AS n, count(*) FILTER (f) AS k FROM gaps GROUP BY d),
s(i, lo, hi) AS (SELECT 0, -64.0::DOUBLE, 64.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN v > 0 THEN (lo + hi)/2 ELSE lo END, CASE WHEN v > 0 THEN hi ELSE (lo + hi)/2 END
  FROM (SELECT i, lo, hi, (SELECT sum(d*(n/(1 + exp((lo + hi)/2*d)) - k)) FROM h) AS v FROM s WHERE i < 50)),
best AS (SELECT lo AS kappa, (SELECT sum(-k*ln(1 + exp(lo*d)) - (n-k)*ln(1 + exp(-lo*d))) FROM h) AS l FROM s WHERE i = 50),
u(i, lo, hi) AS (SELECT 0, kappa, kappa + 4 FROM best UNION ALL
  SELECT i + 1, CASE WHEN v THEN (lo + hi)/2 ELSE lo END, CASE WHEN v THEN hi ELSE (lo + hi)/2 END
  FROM (SELECT i, lo, hi, (SELECT sum(-k*ln(1 + exp((lo + hi)/2*d)) - (n-k)*ln(1 + exp(-(lo + hi)/2*d))) FROM h) >= (SELECT l FROM best) - pow(1.959963984540054, 2)/2 AS v FROM u WHERE i < 50)),
w(i, lo, hi) AS (SELECT 0, kappa - 4, kappa FROM best UNION ALL
  SELECT i + 1, CASE WHEN v THEN lo ELSE (lo + hi)/2 END, CASE WHEN v THEN (lo + hi)/2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT sum(-k*ln(1 + exp((lo + hi)/2*d)) - (n-k)*ln(1 + exp(-(lo + hi)/2*d))) FROM h) >= (SELECT l FROM best) - pow(1.959963984540054, 2)/2 AS v FROM w WHERE i < 50))
SELECT round(kappa, 5) AS kappa, round((SELECT lo FROM w WHERE i = 50), 5) AS lo, round((SELECT lo FROM u WHERE i = 50), 5) AS hi,
round(l, 4) AS loglik, (SELECT sum(n)::BIGINT FROM h) AS shots, (SELECT sum(k)::BIGINT FROM h) AS failures FROM best""")
def logistic_slope(t: Tables):
    fit = S.logistic_slope(_gaps(t))
    return fit.select(num("kappa", 5).alias("kappa"), num("lo", 5).alias("lo"), num("hi", 5).alias("hi"),
                      num("loglik", 4).alias("loglik"), "shots", "failures")


@query("a21_min_round_time", """WITH m AS (SELECT o_orderstatus AS arm, length(o_orderpriority) AS commit_rounds, avg(o_totalprice) AS mean_iterations FROM orders GROUP BY ALL)
SELECT arm, commit_rounds::BIGINT AS commit_rounds, round(mean_iterations, 5) AS mean_iterations, round(mean_iterations*0.0004/commit_rounds, 6) AS min_round_time FROM m""")
def min_round_time(t: Tables):
    arms = t.orders.select(F.col("o_orderstatus").alias("arm"), F.length("o_orderpriority").alias("commit_rounds"), F.col("o_totalprice").alias("iterations"))
    out = S.min_round_time(arms, 0.0004)
    return out.select("arm", F.col("commit_rounds").cast("bigint"), num("mean_iterations", 5).alias("mean_iterations"), num("min_round_time", 6).alias("min_round_time"))


@query("a31_sampling_stats", f"""WITH {I.FIRED}, n AS (SELECT shot, count(*) AS n FROM fired GROUP BY shot),
fl AS (SELECT shot FROM true_faults WHERE fault % 5 = 2 GROUP BY shot HAVING count(*) % 2 = 1)
SELECT count(*) AS shots, round(sum(coalesce(n, 0))/(count(*)*14), 9) AS fire_rate, round(count(fl.shot)/count(*), 9) AS flip_fraction
FROM shots LEFT JOIN n USING (shot) LEFT JOIN fl ON fl.shot = shots.shot""")
def sampling_stats(t: Tables):
    from paritas.operators.gf2 import gf2_product, predict_class

    toy, faults = I.toy(t), I.true_faults(t)
    out = S.sampling_stats(I.shots(t), gf2_product(faults, toy.edges), predict_class(faults, toy.column_class()), 14)
    return shaped(out, "shots", "fire_rate flip_fraction")


FRACTIONS = ["0", "0.005", "0.015", "0.1", "0.29", "0.5", "1"]
FRACTION_ROWS = ", ".join(f"('{f}', {f}::DECIMAL(18,9))" for f in FRACTIONS)
WK = wilson_sql("kept_failures", "kept")


@query("w9_risk_coverage", f"""WITH {I.SCORED}, o AS (SELECT failed, row_number() OVER (ORDER BY score DESC, shot) AS r FROM scored),
d AS (SELECT fraction, floor(f*(SELECT count(*) FROM o) + 0.5)::BIGINT AS discarded FROM (VALUES {FRACTION_ROWS}) v(fraction, f)),
k AS (SELECT fraction, discarded, (SELECT count(*) FROM o) - discarded AS kept, (SELECT count(*) FROM o WHERE r > discarded AND failed) AS kept_failures FROM d)
SELECT fraction, discarded, kept, kept_failures, round({WK['rate']}, 9) AS rate, round({WK['lo']}, 9) AS lo, round({WK['hi']}, 9) AS hi FROM k""")
def risk_coverage(t: Tables):
    return shaped(S.risk_coverage(I.scored(t), FRACTIONS), "discarded kept kept_failures", "rate lo hi", "fraction")


@query("t3_top_decodes", f"""WITH {I.SCORED} (SELECT shot, score, 'least' AS side FROM scored ORDER BY score DESC, shot LIMIT 25)
UNION ALL (SELECT shot, score, 'most' FROM scored ORDER BY score, shot LIMIT 25)""")
def top_decodes(t: Tables):
    x = I.scored(t)
    least = S.top_decodes(x, 25).select("shot", "score", F.lit("least").alias("side"))
    most = S.top_decodes(x, 25, least_trustworthy=False).select("shot", "score", F.lit("most").alias("side"))
    return least.unionByName(most)


@query("j15_anchor_check", f"""WITH {I.PAIRS}, c AS (SELECT o_orderpriority, count(*) AS shots, count(*) FILTER (test_failed) AS failures FROM pairs GROUP BY ALL),
w AS (SELECT o_orderpriority, {W['lo']} AS lo, {W['hi']} AS hi FROM c),
a AS (SELECT o_orderpriority, avg(CAST(o_totalprice > 380000 AS INT)) AS v, 1.0 + length(o_orderpriority)/40.0 AS factor FROM orders GROUP BY ALL)
SELECT o_orderpriority, round(lo, 9) AS lo, round(hi, 9) AS hi, round(v/factor, 9) AS band_lo, round(v*factor, 9) AS band_hi,
CAST(lo <= v*factor AND v/factor <= hi AS INT)::BIGINT AS passed FROM w JOIN a USING (o_orderpriority)""")
def anchors(t: Tables):
    rates = S.rate_table(I.pairs(t), ["o_orderpriority"], ROUNDS, failed="test_failed")
    v = F.avg((F.col("o_totalprice") > 380000).cast("int"))
    published = t.orders.groupBy("o_orderpriority").agg(v.alias("v_lo"), v.alias("v_hi")).withColumn(
        "factor", F.lit(1.0) + F.length("o_orderpriority") / 40.0)
    return shaped(S.check_anchors(rates, published, ["o_orderpriority"]), "passed", "lo hi band_lo band_hi", "o_orderpriority")
