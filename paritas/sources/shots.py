"""Shots: dense, sparse and packed forms, and the range-restricted source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRED_SCHEMA = "shot bigint, det bigint"
TRUTH_SCHEMA = "shot bigint, mask bigint"


def dense_to_fired(dense: DataFrame) -> DataFrame:
    """dense(shot, bits array) -> (shot, det) of the ones."""
    return dense.select("shot", F.posexplode("bits").alias("det", "_b")).where("_b = 1").select("shot", "det")


def fired_to_dense(shots: DataFrame, fired: DataFrame, num_dets: int) -> DataFrame:
    """(shot, bits): one 0/1 array of num_dets entries per shot."""
    sets = fired.groupBy("shot").agg(F.collect_set("det").alias("_s"))
    ones = F.coalesce("_s", F.array().cast("array<bigint>"))
    return shots.select("shot").join(sets, "shot", "left").select(
        "shot", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(num_dets - 1).cast("bigint")),
                            lambda i: F.array_contains(ones, i).cast("int")).alias("bits"))


def write_shots(fired: DataFrame, truth: DataFrame, path: str) -> None:
    fired.select("shot", "det").write.mode("overwrite").parquet(f"{path}/fired")
    truth.select("shot", "mask").write.mode("overwrite").parquet(f"{path}/truth")


def read_shots(spark: SparkSession, path: str, first: int = 0, count: int | None = None,
               detectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fired, truth, strangers) of shots first .. first + count - 1; the range reaches the scan.

    strangers are fired rows whose detector the linked incidence does not have.
    """
    fired = spark.read.schema(FIRED_SCHEMA).parquet(f"{path}/fired")
    truth = spark.read.schema(TRUTH_SCHEMA).parquet(f"{path}/truth")
    if first or count is not None:
        wanted = F.col("shot") >= first
        if count is not None:
            wanted = wanted & (F.col("shot") < first + count)
        fired, truth = fired.where(wanted), truth.where(wanted)
    strangers = fired.join(detectors, "det", "left_anti") if detectors is not None else fired.limit(0)
    return fired, truth, strangers
