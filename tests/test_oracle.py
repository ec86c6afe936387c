"""Registered queries against their SQL on the smallest scale, and the registry's own rules."""

import pytest

import __spark_entry__ as entry
from oracle import compare

# One query per family; tests/oracle.py runs them all.
CHOSEN = [
    "a1_odd_multiplicity", "a11_pair_table", "a16_nearest_rank", "a20_logistic_slope", "a3_merge_identical", "a30_summarize", "a33_support_hash",
    "a34_support_components", "a38_dedup_shapes", "a43_broken_legs", "a44_verify_chunks", "b12_low_confidence_legs", "b13_lookup_decode", "b14_decode_rates", "b5_min_sum", "b7_relay_decode", "f4_gamma_draws",
    "j11_combine_halves", "j13_detector_rule_sets", "j5_residual", "p1_prune_decided", "p9_check_incidence", "r1_confidence",
    "r3_replay_gap_extend", "r6_rate_by_capacity", "s1_read_mechanisms", "s10_load_campaign", "s4_edges_to_csr", "s6_unpack_bits",
    "u5_missing_chunks", "w7_signal_history", "w9_risk_coverage", "x2_uniform_plan", "x5_defer_unconverged", "x11_stream_history", "x7_stream_decode", "x9_contract_kinds",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_sql(spark, duck, small, name):
    verdict, _, _ = compare(spark, duck, name, small)
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_stream_decode_runs_no_shot_by_itself(spark, duck, small, monkeypatch):
    from paritas.streaming import windowed

    def refused(*_, **__):
        raise AssertionError("decoded shot by shot")

    monkeypatch.setattr(windowed, "stream_decode", refused)
    verdict, _, _ = compare(spark, duck, "x10_out_of_order", small)
    assert verdict.startswith("ok"), verdict
