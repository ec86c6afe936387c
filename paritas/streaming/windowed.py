"""Sliding-window decoding of a stream of rounds, with per-shot state.

The stream carries one row per (shot, round). State per shot is its residual words, the rounds
received, the window position and the frame. A window is decoded as soon as its rounds are there,
from the same lookup tables as the batch decode; results equal the batch results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paritas.operators.windowed import Inner, LoadedPlan

ROUND_SCHEMA = "shot bigint, round int, fired array<int>, is_final boolean"
OUTPUT = ("shot bigint, kind string, window bigint, attempts int, converged boolean, weight double, committed_weight double, "
          "unexplained bigint, virtual bigint, flagged boolean, solution array<bigint>, committed array<bigint>, frame bigint, detail string")
STATE = "words array<bigint>, got array<boolean>, window int, attempt int, legs int, frame bigint, over boolean, closed boolean"
COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]

# Fixed value: lookup entries one task may hold.
MAX_ENTRIES = 200_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_round_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(ROUND_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def round_rows(fired: DataFrame, shots: DataFrame, rounds: int, per_round: int) -> DataFrame:
    """Batch shots as round rows: every shot has every round, silent rounds included."""
    by_round = fired.groupBy("shot", (F.floor(F.col("det") / per_round) + 1).cast("int").alias("round")).agg(
        F.sort_array(F.collect_set((F.col("det") % per_round).cast("int"))).alias("fired"))
    per_shot = by_round.groupBy("shot").agg(F.map_from_entries(F.collect_list(F.struct("round", "fired"))).alias("_by"))  # at most every round of a shot
    every = shots.select("shot").join(per_shot, "shot", "left").select("shot", "_by", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    return every.select("shot", "round", F.coalesce(F.try_element_at("_by", F.col("round")), F.array().cast("array<int>")).alias("fired"),
                        (F.col("round") == rounds).alias("is_final"))


def collect_tables(plan: LoadedPlan, inner: Inner) -> dict[int, dict]:
    """shape -> {key: solution}, for lookup inner decoders whose tables are bounded by the window's size."""
    tables: dict[int, dict] = {}
    for place in plan.places.values():
        if place.shape in tables:
            continue
        if place.problem.bound > MAX_ENTRIES:
            raise ValueError(f"a window table of up to {place.problem.bound} entries is too large for stream state; at most {MAX_ENTRIES}")
        tables[place.shape] = {r["key"]: (r["weight"], list(r["cols"]), r["flip"], r["commit_cls"], list(r["commit_cols"]), r["committed_weight"])
                               for r in inner(place, None).collect()}
    return tables


class RoundDecoder(StatefulProcessor):
    """Buffers rounds by number, drops duplicates, decodes windows when ready, reports contract errors.

    strict asks for rounds in order from batch to batch, as a live detector delivers them (rows of one
    batch have no order and count as sorted); otherwise late rounds wait in the buffer. With a time to
    live, counted from the last arrival, an incomplete shot is reported and forgotten, and a finished
    one, whose late duplicates were still known, is forgotten without a word.
    """

    def __init__(self, plan: LoadedPlan, tables: dict[int, dict], strict: bool = False, ttl_ms: int | None = None):
        self.plan, self.tables, self.strict, self.ttl_ms = plan, tables, strict, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shot = handle.getValueState("shot", STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        plan, (shot,) = self.plan, key
        s = self._load()
        out: list[dict] = []
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("round", kind="stable")
        for number, fired, is_final in zip(arrived["round"], arrived["fired"], arrived["is_final"], strict=True):
            problem = self._problem(s, int(number), fired)
            if problem == "duplicate":
                continue
            if problem:
                out.append(self._row(shot, "error", detail=problem))
                continue
            s["got"][number - 1] = True
            s["words"][number - 1] ^= sum(1 << int(d) for d in fired)
            s["closed"] = s["closed"] or bool(is_final)
            if self.strict:
                if is_final and not all(s["got"]):
                    out.append(self._row(shot, "error", detail="missing rounds at close"))
                out += self._advance(shot, s)
        out += self._advance(shot, s)
        self.shot.update((s["words"], s["got"], s["window"], s["attempt"], s["legs"], s["frame"], s["over"], s["closed"]))
        if self.ttl_ms is not None:
            for earlier in list(self.handle.listTimers()):
                self.handle.deleteTimer(earlier)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.shot.exists():
            s = self._load()
            if not s["over"]:
                yield pd.DataFrame([self._row(key[0], "error", detail="abandoned before all rounds arrived")], columns=COLUMNS)
            self.shot.clear()

    def _load(self) -> dict:
        if not self.shot.exists():
            n = self.plan.rounds
            return {"words": [0] * n, "got": [False] * n, "window": 0, "attempt": 0, "legs": 0, "frame": 0, "over": False, "closed": False}
        words, got, window, attempt, legs, frame, over, closed = self.shot.get()
        return {"words": [int(w) for w in words], "got": [bool(g) for g in got], "window": int(window), "attempt": int(attempt), "legs": int(legs),
                "frame": int(frame), "over": bool(over), "closed": bool(closed)}

    def _problem(self, s: dict, number: int, fired) -> str | None:
        if not 1 <= number <= self.plan.rounds:
            return f"round {number} outside 1..{self.plan.rounds}"
        if any(not 0 <= d < self.plan.per_round for d in fired):
            return f"round {number} has a detector outside 0..{self.plan.per_round - 1}"
        if s["got"][number - 1]:
            return "duplicate"
        if self.strict and s["closed"]:
            return f"round {number} after close"
        if self.strict and not all(s["got"][: number - 1]):
            return f"round {number} before the rounds it follows"
        return None

    def _advance(self, shot: int, s: dict) -> list[dict]:
        """Decodes every window whose rounds have arrived."""
        plan, out = self.plan, []
        m = plan.per_round
        while not s["over"] and s["window"] < plan.positions:
            place = plan.places[s["window"], s["attempt"]]
            first, last = place.first_round, min(place.last_round, plan.rounds)
            if not all(s["got"][first - 1:last]):
                break
            local = 0
            for r in range(first, last + 1):
                local |= s["words"][r - 1] << (m * (r - first))
            found = self.tables[place.shape].get(local)
            s["legs"] += 1
            if found is None and plan.spec.on_failure == "defer" and (s["window"], s["attempt"] + 1) in plan.places:
                s["attempt"] += 1
                continue
            weight, cols, flip, cls, commit_cols, committed_weight = found or (float("inf"), [], 0, 0, [], 0.0)
            left = local ^ flip
            for r in range(first, last + 1):
                s["words"][r - 1] = (left >> (m * (r - first))) & ((1 << m) - 1)
            s["frame"] ^= cls
            end = last if place.final else min(first + place.commit_rounds - 1, last)
            committed = sorted(place.faults[i] for i in commit_cols if place.faults[i] is not None)
            out.append(self._row(
                shot, "commit", window=s["window"], attempts=s["attempt"] + 1, converged=found is not None, weight=weight,
                committed_weight=committed_weight, unexplained=(left & ((1 << (m * max(0, end - first + 1))) - 1)).bit_count(),
                virtual=len(commit_cols) - len(committed), flagged=found is None and plan.spec.on_failure != "commit_anyway",
                solution=sorted(place.faults[i] for i in cols if place.faults[i] is not None), committed=committed, frame=s["frame"]))
            s["window"], s["attempt"], s["over"] = s["window"] + 1, 0, place.final
        return out

    @staticmethod
    def _row(shot: int, kind: str, **values) -> dict:
        return {"shot": shot, "kind": kind, **{c: values.get(c) for c in COLUMNS[2:]}}


def stream_decode(rounds: DataFrame, plan: LoadedPlan, tables: dict[int, dict], strict: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """A stream (or a table) of round rows -> commit and error rows."""
    mode = "ProcessingTime" if ttl_ms is not None else "None"
    rounds.sparkSession.streams.active  # noqa: B018  a table needs the state store coordinator too; this starts it
    return rounds.groupBy("shot").transformWithStateInPandas(
        statefulProcessor=RoundDecoder(plan, tables, strict, ttl_ms), outputStructType=OUTPUT, outputMode="Append", timeMode=mode)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available into a Parquet sink and reads the sink."""
    spark = stream.sparkSession
    schema = stream.schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(
            mode).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(schema).parquet(f"{path}/out")
