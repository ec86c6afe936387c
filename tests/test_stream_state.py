"""State handling of the stream processors, with a stand-in for Spark's handle."""

import json
from datetime import datetime
from types import SimpleNamespace

import pandas as pd

from paritas.streaming.history import FIELDS, History
from paritas.streaming.windowed import RoundDecoder


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers, self.value = set(), Value()

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(self.timers)


def clock(now):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)


def test_only_the_last_arrival_counts_for_the_time_to_live():
    place = SimpleNamespace(first_round=1, last_round=3, shape=0, final=True, commit_rounds=3, faults=[])
    plan = SimpleNamespace(rounds=3, per_round=2, positions=1, places={(0, 0): place}, spec=SimpleNamespace(on_failure="flag"))
    decoder, handle = RoundDecoder(plan, {0: {0: (0.0, [], 0, 0, [], 0.0)}}, ttl_ms=100), Handle()
    decoder.init(handle)

    def rows(*numbers):
        return iter([pd.DataFrame({"round": numbers, "fired": [[] for _ in numbers], "is_final": [n == 3 for n in numbers]})])

    assert list(decoder.handleInputRows((7,), rows(1), clock(0))) == [] and handle.timers == {100}
    assert list(decoder.handleInputRows((7,), rows(2), clock(90))) == [] and handle.timers == {190}
    done = list(decoder.handleInputRows((7,), rows(3), clock(150)))
    assert done[0]["kind"].tolist() == ["commit"] and handle.timers == {250} and handle.value.exists()
    assert list(decoder.handleExpiredTimer((7,), clock(250), None)) == [] and not handle.value.exists()
    list(decoder.handleInputRows((8,), rows(2), clock(300)))
    lost = list(decoder.handleExpiredTimer((8,), clock(400), None))
    assert lost[0]["detail"].tolist() == ["abandoned before all rounds arrived"] and not handle.value.exists()


def test_late_window_changes_no_span():
    history, handle = History([1, 2]), Handle()
    history.init(handle)

    def window(number):
        return iter([pd.DataFrame([{f: number if f == "window" else False if f == "decoded" else None for f in FIELDS}])])

    def states(number):
        return next(history.handleInputRows((1,), window(number), None))["state"].tolist()

    assert states(1) == states(3) == ["none", "none"]
    before = handle.value.held
    assert states(2) == ["late", "late"] and handle.value.held == before
    assert [r["window"] for r in json.loads(before[0])] == [1, 3]


def test_rows_of_deliveries_are_made_once(spark, monkeypatch):
    from paritas.catalog import streams
    from paritas.catalog.base import Tables

    made, sent = spark.sparkContext.accumulator(0), []

    def counted(parts):
        for part in parts:
            made.add(len(part))
            yield part

    rows = spark.range(12).selectExpr("id AS shot", "int(id) AS round", "array(1) AS fired", "false AS is_final").mapInPandas(
        counted, "shot long, round int, fired array<int>, is_final boolean")
    monkeypatch.setattr(streams.batches, "run_decoder", lambda stream, decoder: sent.append(stream))
    streams.delivered(Tables(spark, ""), rows, [("round < 4", "2024-01-01"), ("round > 6", "2024-01-02"), ("round between 4 and 6", "2024-01-03")], None)
    assert made.value == 12 and len(sent) == 3


def rounds_of(spark, *rows):
    """(shot, round, fired, hour of arrival) as a micro-batch."""
    from paritas.streaming import batches

    return spark.createDataFrame([(s, r, f, False, datetime(2024, 1, 1, hour)) for s, r, f, hour in rows], batches.ROUND_SCHEMA)


def stream_decoder(spark, path, **options):
    from paritas.catalog import inputs as I
    from paritas.catalog.base import Tables
    from paritas.operators import sparse
    from paritas.plans.spec import WindowSpec
    from paritas.plans.windows import plan_windows
    from paritas.streaming import batches

    plan = plan_windows(I.toy(Tables(spark, "")), WindowSpec(4, 2, 4))
    return batches.BatchDecoder(plan, sparse.Lookup(plan), str(path), **options)


def test_shots_in_equal_states_take_the_steps_of_a_batch_as_one(spark, tmp_path, monkeypatch):
    from paritas.operators import sparse

    decoder, sizes, step = stream_decoder(spark, tmp_path), [], sparse.attempt_step

    def counted(state, *given, **options):
        sizes.append(state.count())
        return step(state, *given, **options)

    monkeypatch.setattr(sparse, "attempt_step", counted)
    decoder(rounds_of(spark, *[(s, r, [0] if s % 2 and r == 3 else [], 0) for s in range(40) for r in range(1, 8)]), 0)
    got = {}
    for row in decoder.output(spark).collect():
        got.setdefault(row.shot, []).append((row.record.window, row.record.committed, row.record.frame))
    assert sizes == [2, 2, 2] and len(got) == 40
    assert all(sorted(got[s]) == sorted(got[s % 2]) for s in got) and sorted(got[0]) != sorted(got[1])


def test_late_repeated_and_refused_rounds_with_a_watermark(spark, tmp_path):
    decoder = stream_decoder(spark, tmp_path, strict=True, delay_seconds=7200)

    def told(*rows):
        batch = told.batch = getattr(told, "batch", -1) + 1
        decoder(rounds_of(spark, *rows), batch)
        return sorted((r.shot, r.kind, r.detail) for r in spark.read.parquet(f"{tmp_path}/out/{batch}").collect())

    assert told((1, 1, [], 1), (2, 3, [], 1), (2, 3, [], 1)) == [(2, "error", "out_of_order:3")]
    assert told((2, 3, [], 2), (3, 1, [], 4)) == [(1, "error", "abandoned")]  # told once; the watermark is at 2 now
    assert told((1, 1, [], 3), (4, 1, [], 2)) == []  # a repeated round of the abandoned shot, a late one
    assert sorted(r.shot for r in decoder.table(spark, "open", 2).collect()) == [1, 3]
    assert told((5, 1, [], 9)) == [(3, "error", "abandoned")]
    assert [r.shot for r in decoder.table(spark, "open", 3).collect()] == [5]
