"""Expressions and small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_broadcast

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Tables up to this many small rows are broadcast, once they have been counted.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    """The text without any of the given characters."""
    return F.translate(text, chars, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body or its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def counted_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most ``limit`` rows; beyond, Spark shuffles.

    df should be cheap to count: a written table or a small aggregate of one.
    """
    return bounded_broadcast(df, df.limit(limit + 1).count(), limit)


#: Bytes that a Python worker gets at once, about.
BATCH_BYTES = 8 << 20


def arrow_batches(spark: SparkSession, rows: int):
    """What runs inside sends Python workers at most ``rows`` rows and about BATCH_BYTES at once, which bounds their memory."""
    return _with_settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)})


def shuffles_dropped(spark: SparkSession):
    """What runs inside drops its shuffle files when a query ends instead of when the driver's memory is collected.

    For steps that write their tables and go on from those: no later query reads a shuffle of theirs.
    """
    return _with_settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


@contextmanager
def _with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
