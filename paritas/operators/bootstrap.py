"""Bootstrap intervals whose draws are a function of (seed, resample, draw), so any engine can repeat them.

A resample draws as many positions as there are rows, and a position belongs to the value whose run of
the sorted rows holds it. Draws come from one numbered range that Spark splits; positions are cut into
cells of fixed width, and a value's run is listed in every cell that it touches. So neither a value that
holds a third of all rows nor a resample is ever one row or one task. The runs of few distinct values
are sent to the draws, which are then only counted; with more values draws and runs are sorted by cell.
Bounds are order statistics of the resampled statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.hashing import index_draw
from paritas.functions.intervals import ALPHA95
from paritas.operators.ranks import exact, running_totals
from paritas.operators.statistics import pair_counts
from paritas.session import bounded_broadcast

# Positions per cell in which draws meet the runs of values.
CELL = 4096
# Up to so many distinct values the runs are sent to the draws, in so many cells.
FEW_VALUES, FEW_CELLS = 100_000, 200_000
# Draws per task.
TASK_DRAWS = 1 << 22


def _bounds(stats: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., lo, hi, resamples): order statistics at alpha/2 and 1 - alpha/2 (one row per resample)."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = stats.select(*by, value, F.row_number().over(w).alias("_r"), n.alias("_n"))
    level = exact(f"{ALPHA95 / 2:.9f}")
    lo = F.greatest(F.ceil(F.lit(level).cast("decimal(18,9)") * F.col("_n")), F.lit(1))
    hi = F.greatest(F.ceil(F.lit(1 - level).cast("decimal(18,9)") * F.col("_n")), F.lit(1))
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("_r") == lo, F.col(value))).alias("lo"),
                                   F.max(F.when(F.col("_r") == hi, F.col(value))).alias("hi"),
                                   F.count("*").alias("resamples"))


def _histogram(df: DataFrame, value: str) -> DataFrame:
    """(v, c, upto): distinct values with counts and running counts."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    return running_totals(counted, ["v"], {"upto": "c"})


def _draws(spark, total: int, resamples: int, seed: int) -> DataFrame:
    """(b, d): every draw of every resample, a position below total.

    No draw is null; saying so keeps Spark from computing each once more to test it.
    """
    b, i = F.expr(f"id div {max(total, 1)}L"), F.col("id") % F.lit(total)
    parts = max(spark.sparkContext.defaultParallelism, -(-total * resamples // TASK_DRAWS))
    return spark.range(0, total * resamples, 1, parts).select(b.alias("b"), F.coalesce(index_draw(F.lit(total), F.lit(seed), b, i), F.lit(0)).alias("d"))


def _resamples(df: DataFrame, value: str, resamples: int, seed: int) -> DataFrame:
    """(b, v, m): multiplicity of each distinct value in each resample; none of an empty input."""
    hist = _histogram(df, value)
    total, values = hist.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    start = F.col("upto") - F.col("c")
    if values <= FEW_VALUES:
        width = max(1, -(-total // FEW_CELLS))
        cells = F.sequence(F.expr(f"(upto - c) div {width}L"), F.expr(f"(upto - 1) div {width}L"))
        runs = hist.select("v", start.alias("start"), "upto", F.explode(cells).alias("cell"))
        drawn = _draws(df.sparkSession, total, resamples, seed).select("b", "d", F.coalesce(F.expr(f"d div {width}L"), F.lit(0)).alias("cell"))
        held = (F.col("d") >= F.col("start")) & (F.col("d") < F.col("upto"))
        placed = drawn.join(bounded_broadcast(runs, values + FEW_CELLS), "cell").where(held)  # a row per cell and one per value
        return placed.groupBy("b", "v").agg(F.count("*").alias("m"))
    runs = hist.select("v", start.alias("start"), F.explode(F.sequence(
        F.floor(start / CELL), F.floor((F.col("upto") - 1) / CELL))).alias("cell"))
    runs = runs.select("cell", F.greatest("start", F.col("cell") * CELL).alias("d"), F.lit(-1).cast("bigint").alias("b"), "v")
    drawn = _draws(df.sparkSession, total, resamples, seed).select(F.floor(F.col("d") / CELL).alias("cell"), "d", "b", F.lit(None).cast("double").alias("v"))
    up_to_here = Window.partitionBy("cell").orderBy("d", "b").rowsBetween(Window.unboundedPreceding, 0)
    placed = runs.union(drawn).select("b", F.last("v", ignorenulls=True).over(up_to_here).alias("v")).where("b >= 0")
    return placed.groupBy("b", "v").agg(F.count("*").alias("m"))


def bootstrap_mean(df: DataFrame, value: str, resamples: int, seed: int) -> DataFrame:
    """One row (mean, lo, hi, resamples)."""
    table = _resamples(df, value, resamples, seed)
    means = table.groupBy("b").agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("s"))
    mean = df.agg(F.avg(F.col(value).cast("double"))).scalar()
    return _bounds(means, "s").withColumn("mean", mean)


def bootstrap_quantiles(df: DataFrame, value: str, levels: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """(level, lo, hi, resamples): nearest-rank quantiles, every level on the same resamples."""
    table = _resamples(df, value, resamples, seed)
    within = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("b")  # at most one row per distinct value
    upto = table.withColumn("_upto", F.sum("m").over(within)).withColumn("_n", F.sum("m").over(whole))
    entries = F.array(*[
        F.struct(F.lit(str(q)).alias("level"), F.least(F.greatest(
            F.ceil(F.lit(exact(q)).cast("decimal(18,9)") * F.col("_n")).cast("bigint"), F.lit(1)), F.col("_n")).alias("rank"))
        for q in levels])
    hit = upto.withColumn("q", F.explode(entries)).where(
        (F.col("_upto") >= F.col("q.rank")) & (F.col("_upto") - F.col("m") < F.col("q.rank")))
    return _bounds(hit.select("b", F.col("q.level").alias("level"), F.col("v").alias("s")), "s", ["level"])


def paired_bootstrap(pairs: DataFrame, resamples: int, seed: int, ref: str = "ref_failed", test: str = "test_failed") -> DataFrame:
    """One row (value, lo, hi, resamples, left_out) for V on the four outcome counts.

    A resample without failures in either arm has no ratio; it is left out and counted. Only the four
    counts come to the driver.
    """
    counts = pair_counts(pairs, (), ref, test)
    n11, n10, n01, n00 = (x or 0 for x in counts.select("n11", "n10", "n01", "n00").first())
    d = F.col("d")
    table = _draws(pairs.sparkSession, n11 + n10 + n01 + n00, resamples, seed).groupBy("b").agg(
        F.count_if(d < n11).alias("a"), F.count_if((d >= n11) & (d < n11 + n10)).alias("r"),
        F.count_if((d >= n11 + n10) & (d < n11 + n10 + n01)).alias("t"))
    up, down = F.col("a") + F.col("t"), F.col("a") + F.col("r")
    defined = table.where((up > 0) | (down > 0)).select(
        F.when(down == 0, F.lit(float("inf"))).otherwise(up / down).alias("s"))
    value = counts.select(((F.col("n11") + F.col("n01")) / (F.col("n11") + F.col("n10"))).alias("x")).scalar()
    out = _bounds(defined, "s")
    return out.withColumn("left_out", F.lit(resamples) - F.col("resamples")).withColumn("value", value)
