"""Exact minimum-weight decoding of small problems by a table of all syndromes.

The table is built once, in Spark, for all shots, by a pass over the columns: every syndrome that some
columns so far can make, with its lightest correction. A few columns at a time, each entry is unrolled
over their choices and the lightest of each syndrome stays, so the table never exceeds min(2^columns,
2^rows) rows and no size of correction is left out. Decoding any number of shots is then one join on
the syndrome key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.functions.bits import bit
from paritas.operators.incidence import Incidence
from paritas.session import cut_lineage

# Columns that one step of the pass unrolls, and steps after which the table is written.
STEP, STEPS = 4, 3
# Weights are compared in whole units of this part of one: 63 columns of up to 2^16 each fit a long.
UNIT = 1 << 40


@dataclass(frozen=True)
class SmallProblem:
    """At most 63 columns and 63 rows: masks of rows, log ratios, classes, commit flags, in column order."""

    rows: int
    masks: tuple[int, ...]
    lam: tuple[float, ...]
    cls: tuple[int, ...]
    commit: tuple[bool, ...]

    def __post_init__(self) -> None:
        if self.rows > 63 or len(self.masks) > 63:
            raise ValueError(f"{self.rows} rows and {len(self.masks)} columns: a lookup handles at most 63 of each")

    @property
    def columns(self) -> int:
        return len(self.masks)

    @property
    def bound(self) -> int:
        return min(1 << self.columns, 1 << self.rows)

    @property
    def units(self) -> list[int]:
        """The log ratios in whole units, so that equal weights are equal in any order of adding them; unbounded ones weigh nothing."""
        return [round(v * UNIT) if abs(v) < float("inf") else 0 for v in self.lam]


def small_problem(inc: Incidence, num_dets: int) -> SmallProblem:
    """The whole incidence as one small problem (at most 63 columns are read)."""
    rows = inc.edges.groupBy("fault").agg(F.bit_or(bit(F.col("det"))).alias("mask")).join(
        inc.faults.select("fault", "lam"), "fault").join(inc.column_class(), "fault", "left").orderBy("fault").limit(64).collect()
    if [r.fault for r in rows] != list(range(len(rows))):
        raise ValueError("a lookup needs at most 63 columns numbered from 0")
    return SmallProblem(num_dets, tuple(r.mask for r in rows), tuple(r.lam for r in rows), tuple(r.cls or 0 for r in rows), (True,) * len(rows))


def _fold(subset: Column, values: Sequence, combine, zero):
    out = F.lit(zero)
    for i, v in enumerate(values):
        out = combine(out, F.when(F.getbit(subset, F.lit(i)) == 1, F.lit(v)).otherwise(F.lit(zero)))
    return out


def small_subsets(spark: SparkSession, n: int, size: int) -> DataFrame:
    """(subset): bit masks of the subsets of n columns with at most ``size`` columns."""
    level = spark.range(1).select(F.lit(0).cast("bigint").alias("subset"), F.lit(0).alias("next"))
    out = level.select("subset")
    for _ in range(size):
        level = level.where(F.col("next") < n).select("subset", F.explode(F.sequence(F.col("next"), F.lit(n - 1))).alias("j")).select(
            F.col("subset").bitwiseOR(bit(F.col("j"))).alias("subset"), (F.col("j") + 1).alias("next"))
        out = out.unionByName(level.select("subset"))
    return out


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def over_columns(spark: SparkSession, problem: SmallProblem, start: dict[str, Column], keep, **folds) -> DataFrame:
    """Passes over the columns: ``start`` is the entry of no column, ``keep`` reduces a step's rows.

    folds: per state column its values per problem column and how a chosen one is taken in. Key and
    subset are always kept up.
    """
    state = spark.range(1).select(F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("subset"), *[v.alias(k) for k, v in start.items()])
    folds = {"key": (problem.masks, xor), **folds}
    for step, first in enumerate(range(0, problem.columns, STEP), 1):
        columns = range(first, min(problem.columns, first + STEP))
        rows = state.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(columns)) - 1))).alias("_s"))
        new = {"subset": F.col("subset").bitwiseOR(F.shiftleft(F.col("_s").cast("bigint"), first))}
        for name, (values, combine) in folds.items():
            value = F.col(name)
            for i, j in enumerate(columns):
                value = F.when(F.getbit("_s", F.lit(i)) == 1, combine(value, F.lit(values[j]))).otherwise(value)
            new[name] = value
        state = keep(rows.withColumns(new).drop("_s"))
        if step % STEPS == 0:
            state = cut_lineage(state)
    return state


def lightest(spark: SparkSession, problem: SmallProblem, max_size: int | None = None) -> DataFrame:
    """(key, units, subset, cls, ties): the lightest correction of every syndrome, weighed in whole units.

    Among equal weights the lexicographically smallest support wins and ties counts all of them. As the
    weights are whole numbers, neither depends on the order in which columns are added.
    ``max_size`` asks for corrections of at most so many columns instead, as a decoder that is meant to
    fail on others.
    """
    n = problem.columns

    def keep(rows: DataFrame) -> DataFrame:
        least = F.min("units").over(Window.partitionBy("key"))  # as many rows as a step has choices, or fewer
        rivals = rows.withColumn("_least", least).where(F.col("units") == F.col("_least"))
        best = F.min(F.struct(members(F.col("subset"), n).alias("cols"), "subset", "cls", "units"))
        return rivals.groupBy("key").agg(best.alias("b"), F.sum("ties").alias("ties")).select("key", "b.units", "b.subset", "b.cls", "ties")

    def plus(a: Column, b: Column) -> Column:
        return a + b

    if max_size is not None:
        s = F.col("subset")
        return keep(small_subsets(spark, n, max_size).select(
            "subset", _fold(s, problem.masks, xor, 0).cast("bigint").alias("key"), _fold(s, problem.units, plus, 0).cast("bigint").alias("units"),
            _fold(s, problem.cls, xor, 0).cast("bigint").alias("cls"), F.lit(1).cast("bigint").alias("ties")))
    start = {"units": F.lit(0).cast("bigint"), "cls": F.lit(0).cast("bigint"), "ties": F.lit(1).cast("bigint")}
    return over_columns(spark, problem, start, keep, units=(problem.units, plus), cls=(problem.cls, xor))


def members(subset: Column, n: int) -> Column:
    """The ascending column indices of a subset."""
    return F.array_compact(F.array(*[F.when(F.getbit(subset, F.lit(i)) == 1, F.lit(i)) for i in range(n)]))


def lookup_table(spark: SparkSession, problem: SmallProblem, max_size: int | None = None) -> DataFrame:
    """(key, weight, cols, ties, cls, flip, commit_cls, commit_cols, committed_weight) per syndrome.

    The lightest subset wins; among equal weights the lexicographically smallest support, and ties
    counts them. flip is the commit columns' syndrome.
    """
    n = problem.columns
    best = lightest(spark, problem, max_size)
    commit = sum(1 << i for i, c in enumerate(problem.commit) if c)
    kept = F.col("subset").bitwiseAND(F.lit(commit))
    return best.select(
        "key", (F.col("units") / UNIT).alias("weight"), members(F.col("subset"), n).alias("cols"), "ties", "cls",
        _fold(kept, problem.masks, xor, 0).cast("bigint").alias("flip"), _fold(kept, problem.cls, xor, 0).cast("bigint").alias("commit_cls"),
        members(kept, n).alias("commit_cols"), (_fold(kept, problem.units, lambda a, b: a + b, 0).cast("bigint") / UNIT).alias("committed_weight"))


def syndrome_keys(fired: DataFrame, shots: DataFrame) -> DataFrame:
    """(shot, key): the fired detectors of each shot as one mask (at most 63 detectors)."""
    packed = fired.groupBy("shot").agg(F.bit_or(bit(F.col("det"))).alias("key"))
    return shots.select("shot").join(packed, "shot", "left").select("shot", F.coalesce("key", F.lit(0).cast("bigint")).alias("key"))


def lookup_decode(keys: DataFrame, table: DataFrame, bound: int) -> DataFrame:
    """keys(shot, key) with the table's row; converged is false where the syndrome is not listed."""
    from paritas.session import bounded_broadcast

    return keys.join(bounded_broadcast(table, bound), "key", "left").withColumn("converged", F.col("weight").isNotNull())


def class_posterior(spark: SparkSession, problem: SmallProblem, priors: Sequence[float]) -> DataFrame:
    """(key, cls, probability): the total probability of all corrections with that syndrome and class."""
    none = 1.0
    for p in priors:
        none *= 1.0 - p

    def keep(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key", "cls").agg(F.sum("probability").alias("probability"), F.min("subset").alias("subset"))

    start = {"probability": F.lit(none), "cls": F.lit(0).cast("bigint")}
    odds = [p / (1.0 - p) for p in priors]
    return over_columns(spark, problem, start, keep, probability=(odds, lambda a, b: a * b), cls=(problem.cls, xor)).drop("subset")


def most_likely_class(posterior: DataFrame) -> DataFrame:
    """(key, ml_class, posterior): the likeliest class of each syndrome, the smaller one on ties."""
    best = posterior.groupBy("key").agg(
        F.max(F.struct("probability", (-F.col("cls")).alias("_n"))).alias("b"), F.sum("probability").alias("_t"))
    return best.select("key", (-F.col("b._n")).alias("ml_class"), (F.col("b.probability") / F.col("_t")).alias("posterior"))
