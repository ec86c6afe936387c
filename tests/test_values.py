"""Hand values: intervals, ranks, risk coverage, merging, fixed point, hashing, halves."""

import math

import pytest
from pyspark.sql import functions as F

from paritas.functions import fixedpoint, hashing
from paritas.functions.intervals import paired_ratio, per_qubit_per_cycle, wilson
from paritas.operators import campaign, ranks
from paritas.operators import statistics as S
from paritas.operators.incidence import merged_prior
from paritas.plans.spec import RelaySpec, WindowSpec


def one(df):
    return df.first().asDict()


def test_nearest_rank_takes_the_exact_decimal(spark):
    x = spark.range(1, 101).withColumnRenamed("id", "v")
    got = {r.level: r.v for r in ranks.nearest_rank(x, "v", ["0", "0.07", "0.5", "0.999", "1"]).collect()}
    assert got == {"0": 1, "0.07": 7, "0.5": 50, "0.999": 100, "1": 100}


def test_running_totals_survive_one_value_holding_most_rows(spark):
    x = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("v"), F.lit(1).cast("bigint").alias("one"))
    got = ranks.running_totals(x, ["v", "id"], {"n": "one"}).orderBy("v", "id").select("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_risk_coverage_hand_values(spark):
    rows = [(0, 5, True), (1, 1, False), (2, 3, True), (3, 3, False), (4, 0, False)]
    x = spark.createDataFrame(rows, "shot bigint, score int, failed boolean")
    got = {r.fraction: (r.discarded, r.kept_failures) for r in S.risk_coverage(x, ["0", "0.2", "0.4", "0.6", "1"]).collect()}
    assert got == {"0": (0, 2), "0.2": (1, 1), "0.4": (2, 0), "0.6": (3, 0), "1": (5, 0)}
    hundred = spark.range(100).select(F.col("id").alias("shot"), F.col("id").alias("score"), F.lit(False).alias("failed"))
    got = {r.fraction: r.discarded for r in S.risk_coverage(hundred, ["0.29", "0.005", "0.015"]).collect()}
    assert got == {"0.29": 29, "0.005": 1, "0.015": 2}


def test_merged_prior(spark):
    x = spark.createDataFrame([(0.02,), (0.01,)], "p double")
    assert math.isclose(x.agg(merged_prior(F.col("p")).alias("p")).first().p, 0.0296, rel_tol=1e-12)


def test_wilson_ends_are_exact(spark):
    x = spark.createDataFrame([(0, 50), (50, 50), (0, 0)], "k bigint, n bigint")
    rate, lo, hi = wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in x.select(rate, lo, hi).collect()]
    assert got[0][1] == 0.0 and got[1][2] == 1.0 and got[2] == (None, 0.0, 1.0)


def test_paired_ratio_degenerate_rules(spark):
    x = spark.createDataFrame([(0, 0, 0), (4, 0, 0), (0, 5, 0), (0, 0, 5), (10, 0, 1)], "n11 bigint, n10 bigint, n01 bigint")
    v = paired_ratio(F.col("n11"), F.col("n10"), F.col("n01"))
    got = x.select(*[c.alias(a) for a, c in v.items()]).collect()
    assert [r.method for r in got] == ["undefined", "poisson-zero-discordant", "exact-conditional", "exact-conditional", "log-normal"]
    assert got[0].value is None and got[0].hi == math.inf
    assert got[1].value == 1.0 and math.isclose(got[1].lo, 4 / (4 - math.log(0.025)), rel_tol=1e-9)
    assert got[2].value == 0.0 and got[3].value == math.inf
    last = got[4]
    assert round(last.lo / last.value - 1, 2) == -0.17 and round(last.hi / last.value - 1, 2) == 0.21


def test_rate_per_qubit_is_null_without_a_solution(spark):
    x = spark.createDataFrame([(0.1,), (0.75,), (1.0,)], "p double")
    got = [r[0] for r in x.select(per_qubit_per_cycle(F.col("p"), 12, 2)).collect()]
    assert got[0] > 0 and got[1] is None and got[2] is None


def test_shift_add_product(spark):
    g = fixedpoint.grid("int4.2.8")
    x = spark.createDataFrame([(15, 7), (-15, 7), (0, 3)], "x int, beta int")
    assert [r[0] for r in x.select(fixedpoint.weighted(F.col("x"), F.col("beta"), g)).collect()] == [11, -11, 0]


def test_splitmix_matches_integer_arithmetic(spark):
    mask = (1 << 64) - 1

    def plain(x):
        x = (x + hashing.GOLDEN) & mask
        for shift, factor in ((30, hashing.MIX_1), (27, hashing.MIX_2)):
            x = ((x ^ (x >> shift)) * factor) & mask
        return hashing.signed(x ^ (x >> 31))

    values = [0, 1, -1, 2**62, -(2**63), 123456789012345]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert [r[0] for r in df.select(hashing.splitmix64(F.col("v"))).collect()] == [plain(v & mask) for v in values]


def test_combine_halves(spark):
    rows = [("a", 0, s, h, f, False, ok, 1, 1, 1.0) for s, (fx, fz, ox, oz) in enumerate([(0, 0, 1, 1), (1, 0, 1, 0), (0, 1, 0, 1), (1, 1, 0, 0)])
            for h, f, ok in (("x", bool(fx), bool(ox)), ("z", bool(fz), bool(oz)))]
    df = spark.createDataFrame(rows, "arm string, chunk bigint, shot bigint, half string, failed boolean, flagged boolean, success boolean, iterations bigint, legs bigint, weight double")
    got = campaign.combine_halves(df).orderBy("shot").collect()
    assert [r.failed for r in got] == [False, True, True, True]
    assert [r.success for r in got] == [True, False, False, False]


def test_shot_in_chunk(spark):
    rows = [(c, s) for c, n in ((0, 5), (1, 3), (3, 2)) for s in range(n)]
    got = campaign.shot_in_chunk(spark.createDataFrame(rows, "chunk bigint, shot bigint")).orderBy("chunk", "shot").collect()
    assert [r.shot_in_chunk for r in got] == [0, 1, 2, 3, 4, 0, 1, 2, 0, 1]


def test_logistic_slope_separable_and_flat(spark):
    flat = S.logistic_slope(spark.createDataFrame([(0.0, True), (0.0, False)], "gap double, failed boolean"))
    assert one(flat)["kappa"] is None
    apart = one(S.logistic_slope(spark.createDataFrame([(1.0, False), (2.0, False)], "gap double, failed boolean")))
    assert apart["kappa"] == math.inf and apart["hi"] == math.inf and math.isfinite(apart["lo"])


def test_specifications_refuse_bad_values():
    with pytest.raises(ValueError):
        WindowSpec(3, 4, 3)
    with pytest.raises(ValueError):
        WindowSpec.parse({"width": 3})
    with pytest.raises(ValueError):
        RelaySpec(0)
    with pytest.raises(ValueError):
        RelaySpec(3, alpha=0.3, arithmetic="int4.2.8")
    with pytest.raises(ValueError):
        fixedpoint.grid("int9.2.8")
    assert [RelaySpec(3, alpha=a).damping_bits(t) for a, t in ((1.0, 0), (0.75, 4), (None, 3), (0.3, 0), (0.5, 0))] == [None, 2, 4, None, 1]


def test_shots_are_numbered_alike_in_both_halves(spark):
    rows = [(c, s, h) for c in (0, 1) for s in (4, 7, 9) for h in "xz"]
    got = {(r.chunk, r.shot, r.half): r.shot_in_chunk for r in campaign.shot_in_chunk(spark.createDataFrame(rows, "chunk bigint, shot bigint, half string")).collect()}
    assert got == {(c, s, h): (4, 7, 9).index(s) for c, s, h in rows}


def test_signal_and_replay_refuse_what_is_not_recorded(spark):
    from paritas.operators import selection

    conf = spark.createDataFrame([(1, "defined", 0.5)], "decode bigint, gap_state string, gap double")
    with pytest.raises(ValueError, match="q_supp"):
        selection.signal(conf, "q_supp", 0.1)
    with pytest.raises(ValueError, match="stopped after 3"):
        selection.check_replay(5, 4, 3)


def test_bootstrap_of_one_hot_value(spark):
    from paritas.operators import bootstrap

    x = spark.range(20_000).select(F.when(F.col("id") < 15_000, 1.0).otherwise(F.col("id")).alias("v"))
    got = bootstrap.bootstrap_quantiles(x, "v", ["0.5", "0.7"], 20, 1)
    assert {(r.level, r.lo, r.hi, r.resamples) for r in got.collect()} == {("0.5", 1.0, 1.0, 20), ("0.7", 1.0, 1.0, 20)}


def test_rounding_is_that_of_the_sql(spark, duck):
    from paritas.catalog.base import num

    values = [-0.0, 0.0, 0.0643125, 0.0021874999999999998, 1.0000005, -1.0000005, 2.5e-06, -1e-10, 0.49999999999999994e-6, 1e300, -1e303, 4503599627.370497, float("inf"), float("-inf"), float("nan"), None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", num("v", 6).alias("r")).orderBy("i").collect()
    want = [duck.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [repr(r.r) for r in got] == [repr(v) for v in want]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unrolled_positions_are_not_broadcast(spark):
    from paritas.operators.incidence import csr_to_edges, edges_to_csr
    from paritas.sources.runs import ragged_to_rows

    edges = spark.range(60).select((F.col("id") % 7).alias("det"), F.col("id").alias("fault"))
    pointers, indices = edges_to_csr(edges, spark.range(9).withColumnRenamed("id", "det"))
    back = csr_to_edges(pointers, indices)
    assert back.exceptAll(edges).isEmpty() and back.count() == 60 and "SortMergeJoin [position" in plan_of(back)
    ragged = spark.createDataFrame([(1, 0, 2), (2, 2, 3)], "shot bigint, begin bigint, end bigint")
    rows = ragged_to_rows(ragged, spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "position bigint, value int"), ["shot"])
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 5), (1, 1, 6), (2, 2, 7)] and "SortMergeJoin [position" in plan_of(rows)


def test_totals_after_a_bias_need_no_row_per_shot_and_position(spark):
    from paritas.operators import gf2

    rows = gf2.odd(spark.range(300).select((F.col("id") % 23).alias("shot"), (F.col("id") * 7 % 19).alias("det")), ["shot", "det"])
    rows = rows.unionByName(spark.createDataFrame([(99, 4), (None, 3), (30, None)], "shot bigint, det bigint"))
    shots = spark.range(40).withColumnRenamed("id", "shot").unionByName(spark.createDataFrame([(5,), (7,), (7,)], "shot bigint"))
    bias = spark.createDataFrame([(1,), (3,), (4,), (18,), (77,)], "det bigint")
    want = gf2.apply_bias(rows, shots, bias).groupBy("shot").agg(F.count("*"), F.sum("det"))
    got = gf2.biased_totals(rows, shots, bias)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert "Generate" not in plan_of(got)


def test_schemas_of_many_partitions_are_read_by_the_tasks(spark, tmp_path):
    from paritas.sources import runs

    rows = spark.range(60).selectExpr("id AS shot", "id % 20 AS chunk", "'a' AS arm", "'x' AS half", "1 AS n")
    rows.where("chunk <> 3").write.partitionBy(*runs.RUN_KEYS).parquet(f"{tmp_path}/shots")
    rows.where("chunk = 3").withColumn("n", F.lit(1.5)).write.mode("append").partitionBy(*runs.RUN_KEYS).parquet(f"{tmp_path}/shots")
    spark.sparkContext.setJobGroup("schemas", "schemas")
    schemas = runs.partition_schemas(spark, str(tmp_path))
    assert schemas.count() == 40
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("schemas")) < 10  # not one per partition
    assert [tuple(r) for r in runs.check_schemas(schemas).collect()] == [("a", 3, "x", "n", "type")]


def test_mechanisms_are_numbered_without_a_shuffle_of_lines(spark, tmp_path, monkeypatch):
    from collections import Counter

    from paritas.sources import runs

    lines = {"b": ["error(0.5) D1 ^ D2 D1 ^ D3 L0 ^ L0 L1", "", "error(2) D9", "  error(0) D7 D7"], "a": ["detector D1", "error(x) D1"],
             "c": [f"error(0.25) D{i} D{i % 7} L{i % 3}" + " D5" * (i % 4) for i in range(900)] + ["error(1)"]}
    for name, text in lines.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(text) + "\n")
    monkeypatch.setattr(runs, "dense_numbers", None, raising=False)  # sorts whole lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # many splits of a file
    try:
        mech, edges, obs, bad = (df.collect() for df in runs.read_mechanisms(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.value for r in bad) == ["error(2) D9", "error(x) D1"]
    kept = [line for name in "abc" for line in lines[name] if line.strip().startswith(("error(0", "error(1"))]
    assert sorted((r.fault, r.p, r.decomposed) for r in mech) == [(i, float(s.split("(")[1].split(")")[0]), "^" in s) for i, s in enumerate(kept)]
    for rows, letter in ((edges, "D"), (obs, "L")):
        want = [(int(t[1:]), i) for i, s in enumerate(kept) for t, n in Counter(w for w in s.split() if w[0] == letter).items() if n % 2]
        assert sorted(map(tuple, rows)) == sorted(want)


def test_a_run_of_many_chunks_takes_few_files(spark, tmp_path):
    from paritas.sources import runs

    rows = spark.range(1200).selectExpr("id AS shot", "id % 400 - 100 AS chunk", "IF(id % 3 = 0, 'a', 'b') AS arm", "'x' AS half", "id * 2 AS n")
    rows = rows.unionByName(spark.sql("SELECT 5000L AS shot, CAST(NULL AS bigint) AS chunk, 'a' AS arm, 'x' AS half, 1L AS n"))
    runs.write_run({"shots": rows}, str(tmp_path))
    assert len(list(tmp_path.glob("shots/**/*.parquet"))) <= 12  # not one per chunk and arm
    back = runs.read_run(spark, str(tmp_path), "shots", ["shot", "n"])
    assert back.columns == ["arm", "chunk", "half", "shot", "n"]
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, map(tuple, rows.select(*back.columns).collect())))
    loaded = runs.load_campaign(spark, str(tmp_path), "b", ["n"], spark.createDataFrame([(7,), (-99,)], "chunk bigint"))
    want = rows.where("arm = 'b' AND chunk IN (7, -99)").select("chunk", "shot", "n").collect()
    assert sorted((r.chunk, r.shot, r.n) for r in loaded.collect()) == sorted(map(tuple, want))
    schemas = runs.partition_schemas(spark, str(tmp_path))
    want = rows.select("arm", "chunk", "half").distinct().count()
    assert schemas.groupBy("arm", "chunk", "half").agg(F.sort_array(F.collect_list("column")).alias("c")).where("c = array('n', 'shot')").count() == want


def odd_supports(spark):
    """Supports and edges with nulls, repeats, unknown faults and a shot of many faults, and their product and stars by hand."""
    edges = [(d, f) for f in range(100) for d in {f % 7, f * 3 % 11, 20 + f % 2}] + [(None, 1), (None, 2), (None, 3), (5, 4), (5, 4), (6, None)]
    support = [(1, 1), (2, 1), (2, 2), (3, 5), (3, 5), (4, 400), (5, 3), (5, 8), (5, 15), (None, 1), (None, 9), (6, None), (8, 4), (8, 4), (8, 9)] + [(7, f) for f in range(100)]
    return (spark.createDataFrame(support, "shot bigint, fault bigint"), spark.createDataFrame(edges, "det bigint, fault bigint"), support, edges)


def test_products_and_residuals_of_odd_supports(spark):
    from collections import Counter

    from paritas.operators import gf2

    s, e, support, edges = odd_supports(spark)

    def fired(rows):
        hits = Counter((shot, det) for shot, fault in rows for det, other in edges if fault is not None and fault == other)
        return sorted((k for k, n in hits.items() if n % 2), key=str)

    got = gf2.gf2_product(s, e)
    assert sorted((tuple(r) for r in got.collect()), key=str) == fired(support)
    committed = [(1, 1), (2, 2), (5, 3), (7, 50), (9, 9)]
    left = gf2.residual_of(s, spark.createDataFrame(committed, "shot bigint, fault bigint"), e)
    want = fired(support + committed)
    assert sorted((tuple(r) for r in left.collect()), key=str) == want
    shots = spark.range(10).withColumnRenamed("id", "shot")
    both = gf2.satisfies_both(shots, left, spark.createDataFrame([(20,), (20,)], "det bigint"))
    assert sorted(map(tuple, both.collect())) == [(i, not any(k[0] == i for k in want), (i, 20) not in want) for i in range(10)]


def test_a_shot_of_few_faults_shuffles_no_row_per_detector(spark):
    """Neither the product nor the stars of small supports group by shot and detector before they are given out."""
    from paritas.operators import gf2

    s = spark.range(60).select((F.col("id") % 20).alias("shot"), (F.col("id") % 9).alias("fault"))
    e = spark.range(900).select((F.col("id") % 100).alias("det"), (F.col("id") % 9).alias("fault"))
    for frame in (gf2.gf2_product(s, e), gf2.residual_of(s, s.where("fault = 1"), e)):
        frame.collect()
        assert sum(n for n in shuffled_rows(frame)) < 2000, shuffled_rows(frame)


def shuffled_rows(df) -> list[int]:
    """The rows that each exchange of the run plan has written."""
    seen, found = [df._jdf.queryExecution().executedPlan()], {}
    while seen:
        node = seen.pop()
        if "AdaptiveSparkPlanExec" in node.getClass().getName():
            seen.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getName():
            seen.append(node.plan())
            continue
        if "ShuffleExchangeExec" in node.getClass().getName():
            found[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
    return list(found.values())


def test_stars_of_odd_supports(spark, monkeypatch):
    from paritas.operators import gf2

    s, e, support, edges = odd_supports(spark)
    touched = {(shot, fault, det) for shot, fault in support for det, other in edges if shot is not None and None not in (fault, det) and fault == other}
    first = {}
    for shot, fault, det in touched:
        first[shot, det] = min(fault, first.get((shot, det), fault))
    want = sorted({(shot, fault, first[shot, det]) for shot, fault, det in touched if fault != first[shot, det]})
    for few in (64, 200, 1):
        monkeypatch.setattr(gf2, "FEW_FAULTS", few)
        assert sorted(tuple(r) for r in gf2.shared_detectors(s.where("shot is not null"), e).collect()) == want


def test_stars_of_a_few_faults_shuffle_no_row_per_detector(spark):
    from paritas.operators import gf2

    s = spark.range(60).select((F.col("id") % 20).alias("shot"), (F.col("id") % 9).alias("fault"))
    e = spark.range(900).select((F.col("id") % 100).alias("det"), (F.col("id") % 9).alias("fault"))
    stars = gf2.shared_detectors(s, e)
    stars.collect()
    assert sum(shuffled_rows(stars)) < 2000, shuffled_rows(stars)


def test_few_values_meet_their_draws_without_a_shuffle_of_draws(spark, monkeypatch):
    """Each draw is computed once and only counts are shuffled; more values than the bound go the way of sorted cells, with the same counts."""
    from paritas.operators import bootstrap

    x = spark.range(3000).select((F.col("id") * F.col("id") % 37).alias("v"))
    table = bootstrap._resamples(x, "v", 20, 9)
    got = sorted(map(tuple, table.collect()))
    assert sum(shuffled_rows(table)) < 20_000 and plan_of(table).split("== Initial Plan ==")[0].count("md5(") == 1
    monkeypatch.setattr(bootstrap, "FEW_VALUES", 0)
    assert got == sorted(map(tuple, bootstrap._resamples(x, "v", 20, 9).collect()))
