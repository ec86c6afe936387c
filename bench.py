"""Times the headline queries at one scale and prints one JSON line.

BENCH_SF_DIR names the scale directory, BENCH_CPUS the local cores, BENCH_QUERIES (optional, comma
separated) a choice of queries. Every query runs once, planning included, into a no-op sink, so
that all of its rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from paritas.catalog import QUERIES  # noqa: E402
from paritas.session import session  # noqa: E402

HEADLINE = [
    "a7_wilson_rate_table", "a11_pair_table", "a16_nearest_rank", "a30_summarize", "a3_merge_identical", "a33_support_hash",
    "a34_support_components", "a44_chunk_checksums", "j1_gf2_product", "j5_residual", "j11_combine_halves", "s4_edges_to_csr",
    "w1_slots", "w7_signal_history", "w9_risk_coverage", "r1_confidence", "r3_replay_gap_extend", "x1_plan_windows",
    "b14_decode_rates", "b5_min_sum", "b7_relay_decode", "x3_decode_windows_3_1",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = session("bench", cores, int(cores) if cores.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the executor threads
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = Path(directory).name.removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
