"""Global orders without a single-task sort.

A running total over a whole table is split in two: rows are range-partitioned on the order keys
(ties may be split anywhere, so a value holding a third of the rows still spreads), each slice
gets its own running sum, and the slices' totals -- one row per shuffle partition -- give the
offsets. The range-partitioned rows are written out first, because the slice boundaries come from
sampling and must be the same for the totals and for the rows, also after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.session import cut_lineage


def running_totals(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str],
                   by: Sequence[str] = ()) -> DataFrame:
    """Adds inclusive running sums: sums maps the new column to the summed one.

    ``by`` restarts the sums per group. ``order`` must be total within a group.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    by = list(by)
    sliced = df.repartitionByRange(*[F.col(b) for b in by], *keys).withColumn("_slice", F.spark_partition_id())
    sliced = cut_lineage(sliced)
    totals = sliced.groupBy("_slice", *by).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", *by, *[
        F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in sums])
    if not by:
        offsets = F.broadcast(offsets)  # one row per shuffle partition
        joined = sliced.join(offsets, "_slice")
    else:
        condition = sliced["_slice"] == offsets["_slice"]
        for b in by:
            condition = condition & sliced[b].eqNullSafe(offsets[b])
        joined = sliced.join(offsets, condition).select(sliced["*"], *[offsets[f"_o_{o}"] for o in sums])
    within = Window.partitionBy("_slice", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    for o, c in sums.items():
        joined = joined.withColumn(o, F.sum(c).over(within) + F.col(f"_o_{o}"))
    return joined.drop("_slice", *[f"_o_{o}" for o in sums])


def dense_numbers(df: DataFrame, order: Sequence[Column | str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Numbers the rows 0, 1, ... in a total order, globally or per group."""
    numbered = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"}, by)
    return numbered.withColumn(name, F.col(name) - 1).drop("_one")


def exact(level: str | float) -> Decimal:
    """The decimal a level was written as: 0.07 stays 7/100."""
    return Decimal(str(level))


def nearest_rank(df: DataFrame, value: str, levels: Sequence[str | float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., level, n, value): the value of rank ceil(level * n), clamped to [1, n].

    Works on the histogram of the values, so a frequent value costs one row.
    """
    by = list(by)
    histogram = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    histogram = running_totals(histogram, [value], {"_upto": "_c"}, by)
    sizes = histogram.groupBy(*by).agg(F.sum("_c").alias("n"))
    if by:
        joined = histogram.join(sizes, [histogram[b].eqNullSafe(sizes[b]) for b in by]).select(
            histogram["*"], sizes["n"])
    else:
        joined = histogram.withColumn("n", sizes.scalar())
    entries = F.array(*[
        F.struct(F.lit(str(q)).alias("level"),
                 F.ceil(F.lit(exact(q)).cast("decimal(18,9)") * F.col("n")).cast("bigint").alias("rank"))
        for q in levels])
    ranked = joined.withColumn("_q", F.explode(entries)).withColumn(
        "_rank", F.least(F.greatest(F.col("_q.rank"), F.lit(1)), F.col("n")))
    hit = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank"))
    return ranked.where(hit).select(*by, F.col("_q.level").alias("level"), "n", value)


# Levels of the cost block and their column names.
COST_LEVELS = {"p50": "0.5", "p90": "0.9", "p99": "0.99", "p999": "0.999"}


def cost_block(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean, min, p50, p90, p99, p999, max) of a cost column."""
    by = list(by)
    names = {q: name for name, q in COST_LEVELS.items()}
    ranks = nearest_rank(df, value, list(COST_LEVELS.values()), by)
    picked = ranks.groupBy(*by).agg(*[
        F.max(F.when(F.col("level") == q, F.col(value))).alias(names[q]) for q in COST_LEVELS.values()])
    basics = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    if not by:
        block = picked.select(F.struct("*")).scalar()
        return basics.withColumn("_q", block).select(*basics.columns, "_q.*")
    return basics.join(picked, [basics[b].eqNullSafe(picked[b]) for b in by]).select(
        basics["*"], *[picked[n] for n in COST_LEVELS])
