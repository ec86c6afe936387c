"""Window plans as tables: which faults and rows every window sees, commits and merges.

Window k starts at round 1 + kC and covers W rounds; the first that reaches the last round is
final. Under deferral, attempt a of a window covers W + aC rounds. A fault's windows follow from
its first round by arithmetic, so assigning faults to windows is an explode and an equi-join, never
a range join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.bits import pack_class
from paritas.operators.incidence import Incidence, column_rounds, log_ratio, merged_prior
from paritas.plans.spec import WindowSpec

PLACE = ["window", "attempt"]


@dataclass(frozen=True)
class WindowPlan:
    """placements(window, attempt, first_round, last_round, commit_rounds, final),
    columns(window, attempt, fault, s, p, lam, commit, cls, members, global_fault),
    edges(window, attempt, det, fault), rows(window, attempt, det, converge),
    members(window, attempt, fault, member)."""

    spec: WindowSpec
    rounds_total: int
    per_round: int
    positions: int
    placements: DataFrame
    columns: DataFrame
    edges: DataFrame
    rows: DataFrame
    members: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("placements", "columns", "edges", "rows", "members")}


def time_shape(inc: Incidence) -> tuple[int, int]:
    """(number of rounds, detectors per round): two numbers."""
    got = inc.detectors.agg(F.max("round").alias("r"), F.count_if(F.col("round") == 1).alias("m")).first()
    return int(got["r"]), int(got["m"])


def position_count(spec: WindowSpec, rounds: int) -> int:
    """Windows up to and including the first final one (exact), or covering every round (uniform)."""
    if spec.boundary == "uniform":
        return -(-rounds // spec.commit)
    return max(0, -(-(rounds - spec.width) // spec.commit)) + 1


def placements(spark, spec: WindowSpec, rounds: int) -> DataFrame:
    """Every (window, attempt) of an exact plan. Attempts end with the first that is final."""
    t = F.col("window") * spec.commit + 1
    last = t + spec.width + F.col("attempt") * spec.commit - 1
    table = spark.range(position_count(spec, rounds)).withColumnRenamed("id", "window").withColumn(
        "attempt", F.explode(F.sequence(F.lit(0), F.lit(spec.max_deferrals))))
    table = table.where((F.col("attempt") == 0) | (last - spec.commit < rounds))
    final = last >= rounds
    return table.select("window", "attempt", t.alias("first_round"), F.least(last, F.lit(rounds)).alias("last_round"),
                        F.when(final, rounds - t + 1).otherwise(spec.commit).alias("commit_rounds"), final.alias("final"))


def _seen_by(s: Column, spec: WindowSpec, positions: int) -> Column:
    """Array of the windows whose attempt ``attempt`` contains round s."""
    reach = spec.width + F.col("attempt") * spec.commit
    low = F.greatest(F.ceil((s - reach) / spec.commit), F.lit(0)).cast("bigint")
    high = F.least(F.floor((s - 1) / spec.commit), F.lit(positions - 1)).cast("bigint")
    return F.when(low <= high, F.sequence(low, high))


def assign_windows(inc: Incidence, spec: WindowSpec, rounds: int) -> DataFrame:
    """(window, attempt, fault, s): every window attempt that sees a fault."""
    first = column_rounds(inc).select("fault", F.col("first_round").cast("bigint").alias("s"))
    tried = first.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(spec.max_deferrals))))
    return tried.withColumn("window", F.explode(_seen_by(F.col("s"), spec, position_count(spec, rounds)))).select(*PLACE, "fault", "s")


def detector_rule_sets(inc: Incidence, spec: WindowSpec, rounds: int) -> DataFrame:
    """(window, fault, commit) through detectors: a window holds the not-yet-committed faults touching
    one of its detectors and commits those touching its first C rounds."""
    k = position_count(spec, rounds)
    touched = inc.edges.join(inc.detectors.select("det", F.col("round").cast("bigint").alias("s")), "det").select("fault", "s").distinct()
    commit_at = touched.groupBy("fault").agg(F.min(F.least(F.floor((F.col("s") - 1) / spec.commit), F.lit(k - 1))).alias("_at"))
    seen = touched.withColumn("attempt", F.lit(0)).withColumn("window", F.explode(_seen_by(F.col("s"), spec, k))).select("window", "fault").distinct()
    return seen.join(commit_at, "fault").where(F.col("window") <= F.col("_at")).select(
        "window", "fault", (F.col("window") == F.col("_at")).alias("commit"))


def _clipped(inc: Incidence, seen: DataFrame, places: DataFrame, per_round: int) -> DataFrame:
    """(window, attempt, fault, s, det, ...) of the rows inside each window."""
    placed = seen.join(F.broadcast(places), PLACE)  # at most rounds x attempts rows
    full = placed.join(inc.edges, "fault")
    inside = (F.col("det") >= (F.col("first_round") - 1) * per_round) & (F.col("det") < F.col("last_round") * per_round)
    return full.where(inside)


def _local(inc: Incidence, spec: WindowSpec, seen: DataFrame, places: DataFrame, per_round: int, cls: DataFrame):
    """Columns, edges and members of the placements, merging identical truncated columns."""
    rows = _clipped(inc, seen, places, per_round)
    # The window's own range cuts a fault's support; its length is a column degree.
    support = rows.groupBy(*PLACE, "fault", "s", "first_round", "last_round", "commit_rounds", "final").agg(
        F.sort_array(F.collect_list("det")).alias("support"))
    cut = ~F.col("final") & (F.col("s") == F.col("last_round")) & F.lit(spec.merge_truncated)
    one = support.withColumn("_own", F.when(cut, F.lit(-1)).otherwise(F.col("fault"))).join(
        inc.faults.select("fault", "p"), "fault").join(cls, "fault", "left").withColumn("cls", F.coalesce("cls", F.lit(0)))
    commits = F.col("final") | (F.col("s") < F.col("first_round") + F.col("commit_rounds"))
    keys = [*PLACE, "_own", "support", "s"]
    grouped = one.groupBy(*keys).agg(
        F.min("fault").alias("fault"), F.count("*").alias("members"),
        F.when(F.count("*") == 1, F.min("p")).otherwise(merged_prior(F.col("p"))).alias("p"),
        F.bool_and(commits).alias("commit"), F.min_by("cls", "fault").alias("_cls"))
    columns = grouped.withColumn("cls", F.when(F.col("commit"), F.col("_cls")).otherwise(F.lit(0))).withColumn(
        "lam", log_ratio(F.col("p")))
    edges = columns.select(*PLACE, F.explode("support").alias("det"), "fault")
    members = one.select(*keys, F.col("fault").alias("member")).join(columns.select(*keys, "fault"), keys).select(*PLACE, "fault", "member")
    return columns.select(*PLACE, "fault", "s", "p", "lam", "commit", "cls", "members", "support"), edges, members


def window_rows(inc: Incidence, spec: WindowSpec, places: DataFrame, per_round: int) -> DataFrame:
    """(window, attempt, det, converge): rows of each window and whether convergence asks for them."""
    spread = places.withColumn("det", F.explode(F.sequence((F.col("first_round") - 1) * per_round, F.col("last_round") * per_round - 1)))
    asked = F.col("first_round") + spec.converge_rounds + F.col("attempt") * spec.commit - 1
    rnd = F.floor(F.col("det") / per_round) + 1
    return spread.select(*PLACE, "det", (F.col("final") | (rnd <= asked)).alias("converge"))


def plan_windows(inc: Incidence, spec: WindowSpec) -> WindowPlan:
    rounds, m = time_shape(inc)
    spark = inc.edges.sparkSession
    if spec.boundary == "uniform":
        return _plan_uniform(inc, spec, rounds, m)
    places = placements(spark, spec, rounds)
    seen = assign_windows(inc, spec, rounds)
    columns, edges, members = _local(inc, spec, seen, places, m, pack_class(inc.obs_edges))
    return WindowPlan(spec, rounds, m, position_count(spec, rounds), places,
                      columns.drop("support").withColumn("global_fault", F.col("fault")), edges,
                      window_rows(inc, spec, places, m), members)


def cut_window(inc: Incidence, t: int, spec: WindowSpec) -> tuple[DataFrame, DataFrame]:
    """(columns, edges) of the single window that starts at round t."""
    rounds, m = time_shape(inc)
    spark = inc.edges.sparkSession
    last = min(t + spec.width - 1, rounds)
    final = t + spec.width - 1 >= rounds
    place = spark.range(1).select(F.lit(0).cast("bigint").alias("window"), F.lit(0).alias("attempt"), F.lit(t).cast("bigint").alias("first_round"),
                                  F.lit(last).cast("bigint").alias("last_round"), F.lit(rounds - t + 1 if final else spec.commit).cast("bigint").alias("commit_rounds"), F.lit(final).alias("final"))
    seen = column_rounds(inc).where(F.col("first_round").between(t, last)).select(
        F.lit(0).cast("bigint").alias("window"), F.lit(0).alias("attempt"), "fault", F.col("first_round").cast("bigint").alias("s"))
    columns, edges, _ = _local(inc, spec, seen, place, m, pack_class(inc.obs_edges))
    return columns.drop(*PLACE, "support"), edges.drop(*PLACE)


# ---- uniform boundary -----------------------------------------------------------------------------


def map_shifted_columns(inc: Incidence, faults: DataFrame, shifts: DataFrame) -> DataFrame:
    """faults(fault), shifts(shift): (fault, shift, target, matches) by equality of shifted supports.

    target is NULL when no column has the shifted support (a virtual column).
    """
    supports = inc.edges.groupBy("fault").agg(F.sort_array(F.collect_list("det")).alias("support"))
    offsets = shifts.agg(F.sort_array(F.collect_set("shift"))).scalar()  # one entry per window position
    moved = supports.join(faults.select("fault"), "fault", "left_semi").withColumn("_offsets", offsets).withColumn(
        "shift", F.explode("_offsets")).withColumn("support", F.expr("transform(support, d -> d + shift)")).select("fault", "shift", "support")
    targets = supports.select(F.col("fault").alias("_t"), "support")
    return moved.join(targets, "support", "left").groupBy("fault", "shift").agg(
        F.min("_t").alias("target"), F.count("_t").alias("matches"))


def _plan_uniform(inc: Incidence, spec: WindowSpec, rounds: int, m: int) -> WindowPlan:
    """The window at round 1 + C, reused at every position; unmatched columns are virtual."""
    t1 = 1 + spec.commit
    widest = spec.width + spec.max_deferrals * spec.commit
    if spec.width >= rounds or t1 + widest > rounds - 1:
        raise ValueError("no bulk window: the reused window must end before the readout round")
    spark = inc.edges.sparkSession
    count = position_count(spec, rounds)
    attempts = spark.range(spec.max_deferrals + 1).select(F.col("id").cast("int").alias("attempt"))
    bulk = attempts.select(F.lit(1).cast("bigint").alias("window"), "attempt", F.lit(t1).cast("bigint").alias("first_round"),
                           (F.lit(t1 + spec.width - 1) + F.col("attempt") * spec.commit).cast("bigint").alias("last_round"),
                           F.lit(spec.commit).cast("bigint").alias("commit_rounds"), F.lit(False).alias("final"))
    seen = assign_windows(inc, spec, rounds).where("window = 1")
    columns, edges, members = _local(inc, spec, seen, bulk, m, pack_class(inc.obs_edges))
    offsets = spark.range(count).select(F.col("id").alias("window"), ((F.col("id") * spec.commit + 1 - t1) * m).alias("shift"))
    mapped = map_shifted_columns(inc, columns.select("fault").distinct(), offsets)
    everywhere = columns.drop("window", "support").join(mapped, "fault").join(F.broadcast(offsets), "shift")
    places = attempts.withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))).select(
        "window", "attempt", (F.col("window") * spec.commit + 1).alias("first_round"),
        (F.col("window") * spec.commit + spec.width + F.col("attempt") * spec.commit).alias("last_round"),
        F.lit(spec.commit).cast("bigint").alias("commit_rounds"), F.lit(False).alias("final"))
    at = edges.drop("window").withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))).join(
        F.broadcast(offsets), "window").select("window", "attempt", (F.col("det") + F.col("shift")).alias("det"), "fault")
    return WindowPlan(spec, rounds, m, count, places,
                      everywhere.select("window", "attempt", "fault", "s", "p", "lam", "commit", "cls", "members",
                                        F.col("target").alias("global_fault"), "matches"),
                      at, window_rows(inc, spec, places, m), members)


# ---- shapes -----------------------------------------------------------------------------------------


def shape_entries(plan: WindowPlan) -> DataFrame:
    """(window, attempt, idx, entry): each local column in order, in window-relative terms."""
    offset = (F.col("window") * plan.spec.commit) * plan.per_round
    support = plan.edges.groupBy(*PLACE, "fault").agg(F.sort_array(F.collect_list(F.col("det") - offset)).alias("_sup"))
    order = Window.partitionBy(*PLACE).orderBy("fault")
    return plan.columns.join(support, [*PLACE, "fault"]).select(
        *PLACE, F.row_number().over(order).alias("idx"), F.struct("_sup", "p", "commit", "cls").alias("entry"))


def dedup_shapes(plan: WindowPlan) -> DataFrame:
    """(window, attempt, shape): placements with the same local problem share a shape id, numbered by
    first use. Fingerprints are sums of entry hashes, so no window's content is gathered."""
    entries = shape_entries(plan).select(*PLACE, F.xxhash64("idx", "entry").alias("h"))
    rows = plan.rows.groupBy(*PLACE).agg(F.count("*").alias("rows"), F.count_if("converge").alias("converge"))
    prints = entries.groupBy(*PLACE).agg(
        F.count("*").alias("cols"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor"))
    full = plan.placements.select(*PLACE).join(rows, PLACE).join(prints, PLACE, "left")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("rows", "converge", "cols", "sum", "xor")])
    first = F.min(F.struct(*PLACE)).over(Window.partitionBy("_key"))
    named = full.withColumn("_key", key).withColumn("_first", first)
    return named.select(*PLACE, (F.dense_rank().over(Window.orderBy("_first")) - 1).cast("bigint").alias("shape"))  # one row per placement


def verify_shapes(plan: WindowPlan, shapes: DataFrame) -> DataFrame:
    """Placements whose content differs from their shape's first placement (a hash collision)."""
    entries = shape_entries(plan).join(shapes, PLACE)
    model = shapes.groupBy("shape").agg(F.min(F.struct(*PLACE)).alias("_f")).select("shape", "_f.window", "_f.attempt")
    first = entries.join(model, ["shape", *PLACE], "left_semi").select("shape", "idx", F.col("entry").alias("_e"))
    same = entries.join(first, ["shape", "idx"], "left")
    return same.where(~F.col("entry").eqNullSafe(F.col("_e"))).select("shape", *PLACE, "idx")


def plan_stats(plan: WindowPlan, shapes: DataFrame) -> DataFrame:
    """One row: shapes, placements, positions, largest window, merged and virtual committed columns."""
    def most(df: DataFrame) -> Column:
        return df.groupBy(*PLACE).agg(F.count("*").alias("n")).agg(F.max("n")).scalar()

    columns = plan.columns
    base = shapes.agg((F.max("shape") + 1).alias("shapes"), F.count("*").alias("placements"))
    merged = columns.join(_first_use(shapes), PLACE, "left_semi").agg(F.count_if(F.col("members") > 1)).scalar()
    virtual = columns.agg(F.count_if(F.col("commit") & F.col("global_fault").isNull())).scalar()
    return base.withColumn("positions", F.lit(plan.positions)).withColumn("max_rows", most(plan.rows)).withColumn(
        "max_columns", most(columns)).withColumn("max_edges", most(plan.edges)).withColumn(
        "merged_columns", merged).withColumn("committed_virtual", virtual)


def _first_use(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("shape").agg(F.min(F.struct(*PLACE)).alias("_f")).select("_f.window", "_f.attempt")


def globalize(local: DataFrame, plan: WindowPlan) -> DataFrame:
    """local(window, attempt, fault, ...) with the global fault (NULL when virtual)."""
    return local.join(plan.columns.select(*PLACE, "fault", "global_fault"), [*PLACE, "fault"])


def localize(fired: DataFrame, plan: WindowPlan) -> DataFrame:
    """fired(shot, det) as seen by each window: (window, attempt, shot, row) with window-relative rows."""
    offset = (F.col("window") * plan.spec.commit) * plan.per_round
    return fired.join(plan.rows.select(*PLACE, "det"), "det").select(*PLACE, "shot", (F.col("det") - offset).alias("row"))


def commit_sets(plan: WindowPlan) -> DataFrame:
    """(window, fault): what each window commits at its first attempt."""
    return plan.columns.where("commit and attempt = 0").select("window", F.col("global_fault").alias("fault"))
