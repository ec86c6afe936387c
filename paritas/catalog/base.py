"""The registry of queries and their oracle SQL, and the helpers both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The driver's tables of one scale directory, as lazily read DataFrames."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query; ``sql`` is its oracle."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, directory: build(Tables(spark, directory))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def num(c: Column | str, digits: int = 9) -> Column:
    return half_away((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def half_away(c: Column, digits: int) -> Column:
    """c rounded in double precision, halves away from zero, as SQL engines do: the scaled value is rounded to a whole number and scaled back.

    Spark's round goes through the decimal digits instead: it differs where scaling moves a value onto or off a half, and it drops the sign of zero.
    """
    scale = 10.0 ** digits
    scaled = c * F.lit(scale)
    size = F.abs(scaled)
    whole = F.rint(size) + (size - F.rint(size) == 0.5).cast("double")  # rint takes halves to the even number, half of them down
    return F.when(size < float("inf"), F.signum(scaled) * whole / F.lit(scale)).otherwise(c)


def whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def shaped(df: DataFrame, ints: str = "", doubles: str = "", texts: str = "", digits: int = 9) -> DataFrame:
    """Projects to BIGINT, rounded DOUBLE and STRING columns, by name."""
    return df.select(*[whole(c).alias(c) for c in ints.split()], *[num(c, digits).alias(c) for c in doubles.split()],
                     *[F.col(c).cast("string").alias(c) for c in texts.split()])


def shaped_sql(source: str, ints: str = "", doubles: str = "", texts: str = "", digits: int = 9) -> str:
    parts = [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    parts += [f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in doubles.split()]
    parts += [f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split()]
    return f"SELECT {', '.join(parts)} FROM {source}"


# ---- formulas in SQL, written independently of the Spark expressions ---------------------------

Z = "1.959963984540054"


def wilson_sql(k: str, n: str) -> dict[str, str]:
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    mid = f"(({k}) + {Z}*{Z}/2) / (({n}) + {Z}*{Z})"
    half = f"{Z} / (({n}) + {Z}*{Z}) * sqrt(({k})*(({n})-({k}))/({n}) + {Z}*{Z}/4)"
    return {
        "rate": f"CASE WHEN {n} > 0 THEN {k}/{n} END",
        "lo": f"CASE WHEN {n} = 0 OR {k} = 0 THEN 0.0 ELSE greatest(0.0, {mid} - {half}) END",
        "hi": f"CASE WHEN {n} = 0 OR {k} = {n} THEN 1.0 ELSE least(1.0, {mid} + {half}) END",
    }


def cycle_sql(p: str, rounds: int) -> str:
    return f"(1 - pow(1 - ({p}), 1.0/{rounds}))"


def qubit_sql(p: str, rounds: int, qubits: int) -> str:
    base = f"(2*pow(1 - ({p}), 1.0/{qubits}) - 1)"
    return f"CASE WHEN {base} > 0 THEN (1 - pow({base}, 1.0/{rounds})) / 2 END"
