"""Class masks and bit-packed rows. Masks are BIGINT patterns of at most 64 observables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit(position: Column) -> Column:
    """1 << position as BIGINT."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def pack_class(obs_edges: DataFrame) -> DataFrame:
    """obs_edges(obs, fault) -> column_class(fault, cls): bit o set when the fault flips o."""
    return obs_edges.groupBy("fault").agg(F.bit_xor(bit(F.col("obs"))).alias("cls"))


def frame_bits(masks: DataFrame, key: str, mask: str, observables: int) -> DataFrame:
    """One row (key, obs) for each observable set in the mask."""
    numbered = masks.withColumn("obs", F.explode(F.sequence(F.lit(0), F.lit(observables - 1))))
    return numbered.where(F.getbit(F.col(mask), F.col("obs")) == 1).select(key, "obs")


def pack_bits(fired: DataFrame, key: str = "shot", position: str = "det", word_bits: int = 8) -> DataFrame:
    """Long form -> packed words, least significant bit first: (key, word, value)."""
    place = bit(F.col(position) % word_bits)
    return fired.groupBy(key, F.floor(F.col(position) / word_bits).cast("bigint").alias("word")).agg(
        F.bit_or(place).alias("value"))


def unpack_bits(packed: DataFrame, key: str = "shot", position: str = "det", word_bits: int = 8) -> DataFrame:
    """Packed words -> long form: (key, position) of every set bit."""
    spread = packed.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(word_bits - 1))))
    return spread.where(F.getbit(F.col("value"), F.col("_bit")) == 1).select(
        key, (F.col("word") * word_bits + F.col("_bit")).cast("bigint").alias(position))
