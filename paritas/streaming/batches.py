"""Sliding-window decoding of a stream of rounds with any inner decoder.

Every micro-batch is decoded set-at-a-time: its rounds are merged into the table of open shots, and the
windows whose rounds have arrived go through the steps of the batch decode, all shots of a window at
once, so message passing decodes each distinct syndrome once and no table is sent to the tasks. The
table of open shots and the output of batch n are written under n, from the table of batch n - 1: a
batch that runs again after a failure overwrites what it had begun. Old tables are left for the
caller's retention.

Rounds may come in any order and repeatedly; those that a shot has are known from the table of open
shots, refused ones from a table of their own. With a delay the latest arrival of the batches before,
less the delay, is the watermark: rounds behind it are dropped as late. A shot that was not heard of
until the watermark has passed its last round is reported as abandoned if it is incomplete; its row
stays for one more delay, so that its repeated rounds are known while they can still come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.operators import sparse
from paritas.operators.bp import counted_broadcast
from paritas.plans.windows import WindowPlan

ROUND_SCHEMA = "shot bigint, round int, fired array<int>, is_final boolean, arrived timestamp"
OUTPUT = f"shot bigint, kind string, detail string, record {sparse.RECORD}"
#: What the steps of a shot depend on; between batches it has no records.
ALIKE = ("left", "got", *(c for c in sparse.STATE if c != "records"))
#: Shots are decoded by state where there are at least so many for each.
FEW_STATES = 4
#: Contract errors of a stream.
ERRORS = ("round_outside", "detector_outside", "out_of_order", "after_close", "missing_at_close", "abandoned")


class BatchDecoder:
    """Decodes micro-batches of rounds(shot, round, fired, is_final, arrived).

    strict: a live detector's contract, in which every round follows its predecessor, rounds of one batch counting as sorted,
    and nothing follows the final one. delay_seconds: how long after its latest round a shot can still be heard of; with
    None every shot is kept, finished ones so that their repeated rounds are known, and no round is late.
    """

    def __init__(self, plan: WindowPlan, inner: sparse.Inner, path: str, on_low: str = "none", strict: bool = False, delay_seconds: int | None = None):
        sparse.check_action(on_low)
        self.windows, self.inner, self.path, self.on_low, self.strict, self.delay = sparse.open_plan(plan), inner, path.rstrip("/"), on_low, strict, delay_seconds

    # ---- tables of one batch

    def table(self, spark: SparkSession, name: str, batch: int) -> DataFrame | None:
        """What batch ``batch`` wrote, None before the first."""
        return None if batch < 0 else spark.read.parquet(f"{self.path}/{name}/{batch}")

    def write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        target = f"{self.path}/{name}/{batch}"
        df.write.mode("overwrite").parquet(target)
        return df.sparkSession.read.schema(df.schema).parquet(target)

    def output(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(OUTPUT).parquet(f"{self.path}/out/*")

    # ---- the decode

    def __call__(self, rounds: DataFrame, batch: int) -> None:
        spark = rounds.sparkSession
        arrived = self.write(rounds.select(*[f.split()[0] for f in ROUND_SCHEMA.split(", ")]), "arrived", batch)
        before, clock = self.table(spark, "open", batch - 1), self.table(spark, "clock", batch - 1)
        refused = None if self.delay is None else self.table(spark, "refused", batch - 1)
        line = self.line(clock)
        seen = arrived.select(F.max("arrived").alias("t"))
        clock = self.write((seen if clock is None else seen.union(clock)).agg(F.max("t").alias("t")), "clock", batch)
        merged, errors = self.merged(before, self.on_time(arrived, line, refused), line)
        state = self.advanced(merged)
        state, gone = self.expired(state, clock, line)
        if self.delay is not None:
            errors = self.write_refused(errors, refused, clock, batch)
        out = [e.select("shot", F.lit("error").alias("kind"), "detail", F.lit(None).cast(sparse.RECORD).alias("record")) for e in (errors, gone)]
        out.append(state.select("shot", F.lit("commit").alias("kind"), F.lit(None).cast("string").alias("detail"), F.explode("records").alias("record")))
        self.write(reduce(DataFrame.unionByName, out), "out", batch)
        self.write(state.where("keep").drop("keep").withColumn("records", F.array().cast(f"array<{sparse.RECORD}>")), "open", batch)

    def line(self, clock: DataFrame | None, delays: int = 1) -> Column | None:
        """The watermark after the batches that ``clock`` knows, None without one."""
        if self.delay is None or clock is None:
            return None
        return clock.select(F.col("t") - F.make_dt_interval(secs=F.lit(delays * self.delay))).scalar()

    def on_time(self, arrived: DataFrame, line: Column | None, refused: DataFrame | None) -> DataFrame:
        """The rounds that are not late and were not refused before."""
        if line is None:
            return arrived
        return arrived.where(F.coalesce(F.col("arrived") > line, F.lit(True))).join(refused, ["shot", "round"], "left_anti")

    def write_refused(self, errors: DataFrame, refused: DataFrame | None, clock: DataFrame, batch: int) -> DataFrame:
        """errors once for every round, written with the refused rounds that can still come again."""
        errors = errors.dropDuplicates(["shot", "round"])
        known = errors.withColumn("new", F.lit(True)) if refused is None else errors.withColumn("new", F.lit(True)).unionByName(refused.withColumn("new", F.lit(False)))
        kept = known.where(F.col("new") | F.coalesce(F.col("arrived") >= self.line(clock, 2), F.lit(True)))
        return self.write(kept, "refused", batch).where("new")

    def merged(self, before: DataFrame | None, arrived: DataFrame, line: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The open shots with the rounds of this batch, and the rounds that break the contract: (shot, round, arrived, detail)."""
        rounds, m = self.windows.plan.rounds_total, self.windows.plan.per_round
        wrong = F.when(~F.col("round").between(1, rounds), F.concat(F.lit("round_outside:"), F.col("round"))).when(
            F.exists("fired", lambda d: (d < 0) | (d >= m)), F.concat(F.lit("detector_outside:"), F.col("round")))
        checked = arrived.withColumn("detail", wrong)
        good = checked.where("detail IS NULL AND round IS NOT NULL").repartition("shot").groupBy("shot", "round").agg(  # one shuffle for both groupings
            F.min("fired").alias("fired"), F.bool_or("is_final").alias("is_final"), F.max("arrived").alias("arrived"))
        adds = good.groupBy("shot").agg(F.collect_list(F.struct("round", "fired", "is_final", "arrived")).alias("_rows"))  # at most every round of a shot
        held = sparse.fresh(arrived.sparkSession.createDataFrame([], "shot bigint, left array<bigint>, got array<int>, closed boolean, heard timestamp")) if before is None else before
        none, rounds_none, false = F.array().cast("array<bigint>"), F.array().cast("array<int>"), F.lit(False)
        gone = false if line is None else F.coalesce(F.col("heard") < line, false)  # only its repeated rounds are known
        joined = held.join(adds, "shot", "full").withColumn("_gone", gone).withColumn(
            "_new", F.filter("_rows", lambda r: ~F.array_contains(F.coalesce("got", rounds_none), r["round"]))).withColumn(
            "_got", F.when(F.col("_gone"), rounds_none).otherwise(F.coalesce("got", rounds_none))).withColumn("_closed", F.coalesce("closed", false) & ~F.col("_gone"))
        errors = checked.where("detail IS NOT NULL").select("shot", "round", "arrived", "detail")
        if self.strict:
            follows = F.array_sort(F.concat("_got", F.transform("_new", lambda r: r["round"])))
            told = F.transform("_new", lambda r: F.struct(r.alias("r"), F.when(F.col("_closed"), F.concat(F.lit("after_close:"), r["round"])).when(
                F.array_position("_follows", r["round"]) != r["round"],
                F.concat(F.when(r["is_final"], F.lit("missing_at_close:")).otherwise(F.lit("out_of_order:")), r["round"])).alias("detail")))
            joined = joined.withColumn("_follows", follows).withColumn("_told", told)
            broken = joined.select("shot", F.explode("_told").alias("t")).where("t.detail IS NOT NULL")
            errors = errors.unionByName(broken.select("shot", "t.r.round", "t.r.arrived", "t.detail"))
            joined = joined.withColumn("_new", F.transform(F.filter("_told", lambda t: t["detail"].isNull()), lambda t: t["r"]))
        more = F.coalesce(F.size("_new"), F.lit(0)) > 0
        dets = F.coalesce(F.flatten(F.transform("_new", lambda r: F.transform(
            F.coalesce(r["fired"], rounds_none), lambda d: (d + (r["round"] - 1) * m).cast("bigint")))), none)
        again = F.col("_gone") & more  # begins anew
        left = F.when(again, none).otherwise(F.coalesce("left", none))
        start = sparse.unbegun()
        return joined.where(F.col("got").isNotNull() | more).select(
            "shot", F.sort_array(F.concat(F.array_except(left, dets), F.array_except(dets, left))).alias("left"),
            F.when(again | ~F.col("_gone"), F.sort_array(F.concat("_got", F.coalesce(F.transform("_new", lambda r: r["round"]), rounds_none)))).otherwise(F.col("got")).alias("got"),
            F.when(again | ~F.col("_gone"), F.col("_closed") | F.coalesce(F.exists("_new", lambda r: r["is_final"]), false)).otherwise(F.col("closed")).alias("closed"),
            F.greatest("heard", F.array_max(F.transform("_new", lambda r: r["arrived"]))).alias("heard"),
            *[F.when(again, start[c]).otherwise(F.coalesce(F.col(c), start[c])).alias(c) for c in sparse.STATE]), errors

    def advanced(self, state: DataFrame) -> DataFrame:
        """Every window whose rounds are there, in order; windows that no shot is ready for cost one small count.

        Shots whose next window has to wait take no part in the steps. Shots in equal states take them as one, where that
        saves most of the rows and equal syndromes have equal answers.
        """
        state = sparse.cut_lineage(state)
        moves = F.coalesce(reduce(Column.__or__, (self.turn(*place) for place in self.windows.placed)), F.lit(False))
        waiting, moving = state.where(~moves), state.where(moves).withColumn("_was", F.struct(*ALIKE))
        sizes = moving.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("_was")).alias("states")).first()
        if not sizes["rows"]:
            return state
        if not self.inner.shared or sizes["states"] * FEW_STATES > sizes["rows"]:
            return self.stepped(moving.drop("_was")).unionByName(waiting)
        none = F.array().cast(f"array<{sparse.RECORD}>")
        states = sparse.cut_lineage(moving.select("_was").distinct().select(F.lit(None).cast("bigint").alias("shot"), "_was", "_was.*", none.alias("records")))
        after = counted_broadcast(self.stepped(states).select("_was", *[F.col(c).alias(f"_{c}") for c in (*ALIKE, "records")]))
        joined = moving.join(after, "_was")
        return joined.select(*[F.col(f"_{c}" if c in (*ALIKE, "records") else c).alias(c) for c in state.columns]).unionByName(waiting)

    def stepped(self, state: DataFrame) -> DataFrame:
        """The steps of a written table, all of whose rows have a window to decode."""
        for window, attempt in sorted(self.windows.placed):
            if state.where(self.turn(window, attempt)).isEmpty():
                continue
            state = sparse.cut_lineage(sparse.attempt_step(state, self.windows, window, attempt, self.inner, self.on_low, self.ready(window, attempt), written=True))
        return state

    def turn(self, window: int, attempt: int) -> Column:
        return ~F.col("over") & (F.col("window") == window) & (F.col("attempt") == attempt) & self.ready(window, attempt)

    def ready(self, window: int, attempt: int) -> Column:
        first, last = self.windows.rounds(window, attempt)
        return F.size(F.filter("got", lambda r: (r >= first) & (r <= last))) == last - first + 1

    def expired(self, state: DataFrame, clock: DataFrame, line: Column | None) -> tuple[DataFrame, DataFrame]:
        """state with keep, and the incomplete shots that the watermark has passed with this batch."""
        if self.delay is None:
            kept = state.withColumn("keep", F.lit(True))
            return kept, state.where(F.lit(False)).select("shot", F.lit("").alias("detail"))
        told = F.lit(False) if line is None else F.coalesce(F.col("heard") < line, F.lit(False))
        passed = ~F.col("over") & (F.col("heard") < self.line(clock)) & ~told
        kept = state.withColumn("keep", F.coalesce(F.col("heard") >= self.line(clock, 2), F.lit(True)))
        return kept, state.where(passed).select("shot", F.lit("abandoned").alias("detail"))


def run_decoder(stream: DataFrame, decoder: BatchDecoder) -> DataFrame:
    """Decodes what is available of a stream of rounds; returns all output so far."""
    query = stream.writeStream.foreachBatch(decoder).option("checkpointLocation", f"{decoder.path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return decoder.output(stream.sparkSession)
