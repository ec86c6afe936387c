"""Windowed goldens with every intermediate value, and decoders against brute force."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from paritas.catalog import inputs as I
from paritas.catalog.base import Tables
from paritas.operators import bp, checks, lookup, sparse, windowed
from paritas.operators.gf2 import gf2_product, support_components
from paritas.plans.spec import RelaySpec, WindowSpec
from paritas.plans.windows import plan_windows
from paritas.session import cut_lineage
from paritas.streaming import windowed as SW

# Hand-derived windows of three toy experiments:
# (first-round residual, solution, committed, frame) per window.
GOLDENS = {
    "A": (3, 1, [6, 15, 27], [(0, [6], [], 0), (1, [6, 15], [6], 0), (0, [15], [], 0), (3, [15, 26], [15], 0), (0, [27], [27], 1)]),
    "B": (4, 2, [9, 17, 29], [(0, [9, 16], [9], 0), (0, [17, 28], [17], 1), (0, [29], [29], 1)]),
    "C": (3, 1, [4, 9], [(2, [4, 9], [4], 0), (2, [9], [9], 0), (0, [], [], 0), (0, [], [], 0), (0, [], [], 0)]),
}


@pytest.fixture(scope="module")
def toy(spark, small):
    return I.toy(Tables(spark, str(small)))


def shot(spark, toy, faults):
    support = spark.createDataFrame([(1, f) for f in faults], "shot bigint, fault bigint")
    return gf2_product(support, toy.edges), spark.range(1, 2).withColumnRenamed("id", "shot")


@pytest.mark.parametrize("name", GOLDENS)
def test_windowed_goldens_in_batch_and_stream(spark, toy, name):
    width, commit, faults, expected = GOLDENS[name]
    fired, shots = shot(spark, toy, faults)
    plan = windowed.load_plan(plan_windows(toy, WindowSpec(width, commit, width)))
    inner = windowed.lookup_inner(spark, plan)
    rows = windowed.window_records(windowed.decode_windows(windowed.pack_rounds(fired, shots, 7, 2), plan, inner)).orderBy("window").collect()
    assert [(r.residual_first, r.solution, r.committed, r.frame) for r in rows] == expected
    assert all(r.ties == 1 and r.converged and r.unexplained == 0 for r in rows)
    out = SW.stream_decode(SW.round_rows(fired, shots, 7, 2), plan, SW.collect_tables(plan, inner), strict=True).orderBy("window").collect()
    assert [(r.solution, r.committed, r.frame) for r in out] == [e[1:] for e in expected]


def test_strict_stream_reports_contract_errors(spark, toy):
    plan = windowed.load_plan(plan_windows(toy, WindowSpec(3, 1, 3)))
    tables = SW.collect_tables(plan, windowed.lookup_inner(spark, plan))
    rows = spark.createDataFrame([(1, 1, [0], False), (1, 3, [], False), (2, 9, [], False), (3, 1, [5], False)], SW.ROUND_SCHEMA)
    out = {(r.shot, r.detail) for r in SW.stream_decode(rows, plan, tables, strict=True).where("kind = 'error'").collect()}
    assert {s for s, _ in out} == {1, 2, 3} and any("before the rounds" in d for _, d in out)


def test_one_window_equals_the_whole_shot(spark, toy):
    """A window as long as the experiment has no truncation: same answer as the unwindowed table."""
    plan = plan_windows(toy, WindowSpec(7, 7, 7))
    assert plan.positions == 1 and plan.columns.where("members > 1").isEmpty()
    assert plan.columns.where("commit").count() == 30


def test_lookup_against_brute_force(spark):
    masks, lam = (0b011, 0b110, 0b100, 0b001, 0b111), (1.0, 1.5, 0.5, 0.7, 2.0)
    problem = lookup.SmallProblem(3, masks, lam, (0, 1, 0, 1, 0), (True,) * 5)
    got = {r.key: (r.cols, round(r.weight, 9), r.ties) for r in lookup.lookup_table(spark, problem).collect()}
    for key in range(8):
        found = []
        for n in range(6):
            for cols in itertools.combinations(range(5), n):
                syndrome = 0
                for c in cols:
                    syndrome ^= masks[c]
                if syndrome == key:
                    found.append((sum(lam[c] for c in cols), list(cols)))
        best = min(w for w, _ in found)
        rivals = sorted(c for w, c in found if w == best)
        assert got[key] == (rivals[0], round(best, 9), len(rivals))


def plain_min_sum(edges, lam, fired, rows, iterations):
    """A straight reading of min-sum on one syndrome."""
    cols = sorted(lam)
    nu = {e: lam[e[1]] for e in edges}
    for t in range(iterations):
        alpha = 1 - 2.0 ** -(t + 1)
        eta = {}
        for det, fault in edges:
            others = [nu[e] for e in edges if e[0] == det and e[1] != fault]
            sign = (-1) ** (int(det in fired) + sum(v < 0 for v in others))
            eta[det, fault] = sign * alpha * (min(map(abs, others)) if others else 1e300)
        total = {j: lam[j] + sum(eta[e] for e in edges if e[1] == j) for j in cols}
        nu = {e: lam[e[1]] + sum(eta[x] for x in edges if x[1] == e[1] and x != e) for e in edges}
        hard = {j for j in cols if total[j] <= 0}
        if all((sum((d, j) in nu for j in hard) + (d in fired)) % 2 == 0 for d in rows):
            return True, t + 1, hard
    return False, iterations, hard


def test_min_sum_against_a_plain_loop(spark, toy):
    edges = {(r.det, r.fault) for r in toy.edges.collect()}
    lam = {r.fault: r.lam for r in toy.faults.collect()}
    supports = {1: [6], 2: [4, 17], 3: [0, 12, 29], 4: [5, 6, 7], 5: []}
    rows = spark.createDataFrame([(s, f) for s, fs in supports.items() for f in fs], "shot bigint, fault bigint")
    fired = gf2_product(rows, toy.edges)
    shots = spark.range(1, 6).withColumnRenamed("id", "shot")
    out = bp.decode(toy, fired, shots, RelaySpec(pre_iter=6, alpha=None), block=2)
    got = {r.shot: r for r in out["results"].collect()}
    chosen = {s: set() for s in supports}
    for r in out["support"].collect():
        chosen[r.shot].add(r.fault)
    lit = {s: {r.det for r in fired.where(F.col("shot") == s).collect()} for s in supports}
    for s in supports:
        ok, iterations, hard = plain_min_sum(edges, lam, lit[s], range(14), 6)
        assert (got[s].success, got[s].iterations, chosen[s]) == (ok, iterations, hard)


def test_components_of_a_long_chain(spark):
    n = 40
    support = spark.range(n).select(F.lit(1).cast("bigint").alias("shot"), F.col("id").alias("fault")).unionByName(
        spark.createDataFrame([(1, 100), (2, 5)], "shot bigint, fault bigint"))
    edges = spark.range(n).select(F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("det"), F.col("id").alias("fault"))
    got = {(r.shot, r.fault): r.component for r in support_components(support, edges).collect()}
    assert all(got[1, f] == 0 for f in range(n)) and got[1, 100] == 100 and got[2, 5] == 5


def test_iteration_cap_is_a_cap_hit(spark, toy):
    fired, shots = shot(spark, toy, [0, 7, 14, 21, 28, 9])
    got = bp.decode(toy, fired, shots, RelaySpec(pre_iter=5, alpha=1.0, cap=1))["results"].first()
    assert got.iterations == 1 and got.success != got.cap_hit


def test_fixed_point_weight_is_scaled(spark, toy):
    fired, shots = shot(spark, toy, [6])
    got = bp.decode(toy, fired, shots, RelaySpec(pre_iter=5, alpha=None, arithmetic="int4.2.8"))["results"].first()
    assert got.success and got.weight == math.floor(2 * math.log(49) + 0.5) / 2


def test_fired_detector_without_an_edge_never_converges(spark, toy):
    from paritas.operators.incidence import Incidence

    outside = toy.edges.agg({"det": "max"}).first()[0] + 50
    fired = spark.createDataFrame([(1, outside), (2, outside)], "shot bigint, det bigint").unionByName(
        toy.edges.where("fault = 0").selectExpr("CAST(2 AS BIGINT) AS shot", "det"))
    shots = spark.createDataFrame([(1,), (2,), (3,)], "shot bigint")
    got = {r.shot: r for r in bp.decode(toy, fired, shots, RelaySpec(pre_iter=4, alpha=None))["results"].collect()}
    assert [got[k].success for k in (1, 2, 3)] == [False, False, True] and got[1].iterations == got[2].iterations == 4
    bare = Incidence(**{**toy.__dict__, "edges": toy.edges.limit(0)})
    got = {r.shot: (r.success, r.iterations) for r in bp.decode(bare, fired, shots, RelaySpec(pre_iter=4, alpha=None))["results"].collect()}
    assert got == {1: (False, 4), 2: (False, 4), 3: (True, 1)}


def test_components_have_no_limit_on_length(spark):
    n = 5000
    support = spark.range(n).select(F.lit(1).cast("bigint").alias("shot"), F.col("id").alias("fault"))
    edges = spark.range(n).select(F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("det"), F.col("id").alias("fault"))
    assert support_components(support, edges).select("component").distinct().collect()[0][0] == 0


def test_lookup_of_the_toy_counts_all_ties(spark, toy):
    """Every key of the whole toy: supports and ties of the lightest corrections, weighed as pairs of counts."""
    problem = lookup.small_problem(toy, 14)
    kinds = sorted(set(problem.units))
    best = {0: ((0,) * len(kinds), (), 1)}

    def weight(counts):
        return sum(n * u for n, u in zip(counts, kinds))

    for j, (mask, unit) in enumerate(zip(problem.masks, problem.units)):
        new = dict(best)
        for key, (counts, cols, ties) in best.items():
            more = tuple(n + (u == unit) for n, u in zip(counts, kinds))
            here = (more, (*cols, j), ties)
            old = new.get(key ^ mask)
            if old is None or weight(more) < weight(old[0]):
                new[key ^ mask] = here
            elif more == old[0]:
                new[key ^ mask] = (more, min(old[1], here[1]), old[2] + ties)
            else:
                assert weight(more) != weight(old[0])
        best = new
    got = {r.key: (tuple(r.cols), r.ties) for r in lookup.lookup_table(spark, problem).collect()}
    assert got == {key: (cols, ties) for key, (_, cols, ties) in best.items()}


@pytest.mark.parametrize("spec", [WindowSpec(3, 1, 3), WindowSpec(2, 1, 2, on_failure="defer", max_deferrals=2)])
def test_windows_of_any_size_equal_small_ones(spark, small, spec):
    """The same windows with residuals as arrays and as words, by the same lookup of single faults."""
    toy = I.toy(Tables(spark, str(small)), 4)
    faults = spark.createDataFrame([(s, f) for s in range(40) for f in {s % 15, (7 * s + 3) % 15, (s * s) % 15}], "shot long, fault long")
    shots = spark.range(42).withColumnRenamed("id", "shot")
    fired = gf2_product(faults, toy.edges)
    plan = plan_windows(toy, spec)
    loaded = windowed.load_plan(plan)
    old = cut_lineage(windowed.decode_windows(windowed.pack_rounds(fired, shots, 4, 2), loaded, windowed.lookup_inner(spark, loaded, 1)))
    new = sparse.decode_windows(fired, shots, plan, sparse.Lookup(plan, 1))
    fields = ("shot", "window", "attempts", "converged", "legs", "ties", "weight", "committed_weight", "unexplained", "virtual", "flagged", "solution", "committed", "frame")

    def records(decoded):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in windowed.window_records(decoded).select(*fields).collect())

    assert records(new) == records(old) and any(r[2] > 1 for r in records(new)) == (spec.max_deferrals > 0)
    assert sorted(sparse.residual_rows(new).collect()) == sorted(windowed.residual_rows(old, 2).collect())
    assert sparse.decode_windows(fired.limit(0), shots.limit(0), plan, sparse.Lookup(plan)).count() == 0


def test_strengths_per_stream(spark, toy):
    """Equal syndromes of different shots may differ once strengths are drawn per shot, window and attempt; reruns agree."""
    shots = spark.range(6).withColumnRenamed("id", "shot")
    fired = shots.selectExpr("shot", "explode(array(2L, 5L, 9L)) AS det")
    plan = plan_windows(toy, WindowSpec(6, 4, 6, iteration_cap=40))
    inner = sparse.MessagePassing(RelaySpec(2, num_sets=2, set_max_iter=2, alpha=None), bp.drawn_gammas(5, -0.3, 0.7), per_stream=True)
    first, again = (sparse.decode_windows(fired, shots, plan, inner) for _ in range(2))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect())) and first.count() == 6
    bad = checks.check_outcomes(toy, fired, windowed.window_records(first), windowed.window_commits(first), sparse.residual_rows(first), first.select("shot", "frame"))
    assert bad.count() == 0


def test_edge_rows_equal_syndrome_rows(spark, toy, monkeypatch):
    """Graphs beyond the bound are decoded as rows of edges, with the same results."""
    from paritas.operators import messages

    faults = spark.createDataFrame([(s, f) for s in range(12) for f in {s % 30, (7 * s + 3) % 30}], "shot long, fault long")
    shots, fired = spark.range(13).withColumnRenamed("id", "shot"), gf2_product(faults, toy.edges)
    for spec in (RelaySpec(3, num_sets=2, set_max_iter=2, alpha=None, gamma0=0.2), RelaySpec(3, num_sets=1, set_max_iter=2, gamma0=0.125, arithmetic="int4.2.8")):
        got = []
        for bound in (messages.GRAPH_EDGES, 3):
            monkeypatch.setattr(messages, "GRAPH_EDGES", bound)
            out = bp.decode(toy, fired, shots, spec, bp.drawn_gammas(5, -0.3, 0.7))
            got.append([sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in out[k].select(*sorted(out[k].columns)).collect())
                        for k in ("results", "support", "legs")])
        assert got[0] == got[1]


def test_open_shots_of_a_stream_are_not_broadcast(spark, toy, tmp_path):
    """However small they look, they grow with the stream."""
    from paritas.operators import sparse
    from paritas.streaming import batches

    plan = plan_windows(toy, WindowSpec(4, 2, 4))
    decoder = batches.BatchDecoder(plan, sparse.Lookup(plan), str(tmp_path))
    arrived = spark.createDataFrame([(1, 2, [0], False, None)], batches.ROUND_SCHEMA)
    held = sparse.fresh(spark.createDataFrame([(1, [0], [1], False, None)], "shot bigint, left array<bigint>, got array<int>, closed boolean, heard timestamp"))
    held.write.parquet(f"{tmp_path}/held")
    merged, _ = decoder.merged(spark.read.parquet(f"{tmp_path}/held"), arrived)
    assert [(r.left, r.got) for r in merged.collect()] == [([0, 2], [1, 2])]
    assert "BroadcastHashJoin" not in merged._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["b1_check_update", "b2_variable_update", "b3_memory_bias", "b4_hard_decision"])
def test_single_updates_give_rows_of_edges_to_distinct_syndromes_only(spark, small, duck, monkeypatch, name):
    from oracle import compare

    given = []
    edge_messages = bp.edge_messages

    def seen(edges, faults, fired, sids, ar, dets=None):
        given.append((sids.count(), sids.distinct().count(), fired.groupBy("sid").agg(F.sort_array(F.collect_list("det")).alias("k")).groupBy("k").count().where("count > 1").count()))
        return edge_messages(edges, faults, fired, sids, ar, dets)

    monkeypatch.setattr(bp, "edge_messages", seen)
    verdict, _, _ = compare(spark, duck, name, small)
    assert verdict.startswith("ok"), verdict
    (rows, sids, repeated), = given
    assert rows == sids and not repeated


def test_legs_are_checked_once_a_syndrome_and_counted_for_every_shot(spark, toy):
    from paritas.catalog.decoding import _broken_shots

    faults = spark.createDataFrame([(s, f) for s in range(12) for f in (s % 3, 7)], "shot long, fault long")
    shots = spark.range(13).withColumnRenamed("id", "shot")
    out = bp.decode(toy, gf2_product(faults, toy.edges), shots, RelaySpec(3, num_sets=1, set_max_iter=2, stopping="all_legs"), bp.drawn_gammas(5, -0.3, 0.7))
    for rules in ((3, 1, 2, "all_legs"), (1, 0, 1, "all_legs"), (2, 2, 2, "after_n_converged", 1)):
        plain = checks.check_legs(out["legs"], out["results"], *rules)
        assert tuple(_broken_shots(out, *rules).first()) == (plain.count(), 13)
