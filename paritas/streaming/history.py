"""Live signal history: the signals over the last L windows, emitted as windows arrive."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WINDOW_SCHEMA = ("shot bigint, window bigint, decoded boolean, gap_state string, gap double, agreement double, weight double, first_legs bigint, "
                 "first_iterations bigint, q_sum_sq double, q_total double, ones bigint, rows bigint")
OUTPUT = ("shot bigint, window bigint, length int, state string, gap double, agreement double, weight double, first_legs bigint, "
          "first_iterations bigint, q_supp double, density double")
FIELDS = [part.split()[0] for part in WINDOW_SCHEMA.split(", ")][1:]
COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]


def _missing(v) -> bool:
    return v is None or v != v


class History(StatefulProcessor):
    """Keeps the last max(lengths) windows of a shot.

    A window that comes after a later one of its shot can't enter the spans already reported: it gets
    rows of state "late" and changes nothing.
    """

    def __init__(self, lengths: Sequence[int]):
        self.lengths = list(lengths)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "windows string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = json.loads(self.ring.get()[0]) if self.ring.exists() else []
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("window")
        out = []
        for values in arrived[FIELDS].itertuples(index=False, name=None):
            record = {f: None if _missing(v) else v.item() if hasattr(v, "item") else v for f, v in zip(FIELDS, values, strict=True)}
            if ring and record["window"] <= ring[-1]["window"]:
                out += [(key[0], record["window"], n, "late", *[None] * 7) for n in self.lengths]
                continue
            ring = [*ring, record][-max(self.lengths):]
            out += [(key[0], record["window"], n, *self._signals(ring[-n:])) for n in self.lengths]
        self.ring.update((json.dumps(ring),))
        yield pd.DataFrame(out, columns=COLUMNS).astype({"first_legs": "Int64", "first_iterations": "Int64"})

    @staticmethod
    def _signals(span: list[dict]) -> tuple:
        decoded = [r for r in span if r["decoded"]]
        if not decoded or any(r["gap_state"] == "none" for r in decoded):
            return ("none", None, None, math.inf, None, None, None, None)
        gaps = [r["gap"] for r in decoded if r["gap_state"] == "defined"]

        def total(name: str):
            return sum(r[name] for r in decoded)

        known = all(not _missing(r["q_sum_sq"]) and not _missing(r["q_total"]) for r in decoded)
        scale, rows = total("q_total") if known else 0, total("rows")
        return ("defined" if gaps else "single_class", min(gaps) if gaps else None, math.prod(r["agreement"] for r in decoded), total("weight"),
                int(total("first_legs")), int(total("first_iterations")), math.sqrt(total("q_sum_sq")) / scale if scale > 0 else None,
                total("ones") / rows if rows else None)


def stream_history(windows: DataFrame, lengths: Sequence[int]) -> DataFrame:
    windows.sparkSession.streams.active  # noqa: B018  starts the state store coordinator, which a table needs too
    return windows.groupBy("shot").transformWithStateInPandas(
        statefulProcessor=History(lengths), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
