"""A uniform shuffle into shards of exact size, by a communication matrix of hypergeometric counts.

Documents lie in partitions by a hash. How many documents each partition sends to each shard is
drawn first, from the exact joint law of a uniform shuffle with fixed shard sizes: partition after
partition takes a multivariate hypergeometric draw of what the shards still need. Each partition is
then permuted by a hash and cut by its counts, and every shard is permuted again as it arrives.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import counted_broadcast, text_or_empty

SHARDS = 40
#: Bytes a document costs besides its text.
OVERHEAD = 16
#: Partitions hold about this many documents, and so do the buckets in which a shard is permuted.
PARTITION_ROWS, BUCKET_ROWS = 65_536, 16_384
LEAST_PARTITIONS, LEAST_BUCKETS = 64, 8
#: Populations from which numpy's exact samplers draw.
NUMPY_POPULATION = 10**9


def hypergeometric(rng: np.random.Generator, good: int, population: int, draws: int) -> int:
    """How many of ``draws`` from the population are good; exact at any size.

    Beyond numpy's range the law is inverted from its mode outwards, some standard deviations long.
    """
    if population < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, population - good, draws)) if draws else 0
    low, high = max(0, draws - (population - good)), min(good, draws)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (population + 2)))
    weight = math.exp(log_choose(good, mode) + log_choose(population - good, draws - mode) - log_choose(population, draws))
    left, down, up, at_down, at_up = rng.random() - weight, mode, mode, weight, weight
    while left > 0 and (down > low or up < high):
        if up < high:
            at_up *= (good - up) * (draws - up) / ((up + 1) * (population - good - draws + up + 1))
            up += 1
            left -= at_up
            if left <= 0:
                return up
        if down > low:
            at_down *= down * (population - good - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= at_down
            if left <= 0:
                return down
    return mode


def communication_matrix(partition_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts per partition (row) and shard; columns sum to sizes at most one apart.

    The driver holds one number per partition and shard, of about 1/65,536 of the rows each.
    """
    rng, total = np.random.default_rng(seed), sum(partition_rows)
    need = [total // shards + (j < total % shards) for j in range(shards)]
    counts = np.zeros((len(partition_rows), shards), np.int64)
    for p, rows in enumerate(partition_rows):
        population, draws = sum(need), rows
        for j in range(shards):
            taken = hypergeometric(rng, need[j], population, draws)
            population, draws = population - need[j], draws - taken
            counts[p, j] = taken
            need[j] -= taken
    return counts


def mixed_hash(seed: int, salt: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), F.coalesce("doc_id", "row"), "text_crc32", "size")


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """Every document with its shard and its slot there: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 that of its UTF-8 (null as the
    empty text). Shard counts are at most one apart and slots are gapless from 0. Rows with a null
    doc_id are told apart by their place in the input; repeated rows get a slot each; with fewer
    rows than shards the first shards get one; an empty table gives none. Other columns are not read.
    """
    text = text_or_empty()
    rows = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    total = rows.count()
    partitions = max(LEAST_PARTITIONS, math.ceil(total / PARTITION_ROWS))
    buckets = max(LEAST_BUCKETS, math.ceil(total / shards / BUCKET_ROWS))
    placed = rows.withColumn("part", F.pmod(mixed_hash(seed, 0), F.lit(partitions)).cast("int"))
    held = sorted(placed.groupBy("part").count().collect())  # one row per partition
    matrix = communication_matrix([n for _, n in held], shards, seed)
    sent = rows.sparkSession.createDataFrame(
        [(part, [int(x) for x in np.cumsum(counts)]) for (part, _), counts in zip(held, matrix)], "part int, upto array<long>")
    place = F.row_number().over(W.partitionBy("part").orderBy(mixed_hash(seed, 1), "row")) - 1
    sharded = (
        placed.withColumn("place", place).join(counted_broadcast(sent), "part")
        .withColumn("shard", F.size(F.filter("upto", lambda c: c <= F.col("place"))).cast("int"))
        .withColumn("order", mixed_hash(seed, 2)).withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)).cast("int"))
        .select("row", "doc_id", "size", "text_crc32", "shard", "bucket", "order")
    )
    sharded = cut_lineage(sharded)
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("order", "row")) - 1
    return sharded.withColumn("inside", inside).join(counted_broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("inside")).cast("long").alias("slot"))


def assignments(docs: DataFrame, shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """shuffled_shards under its law: row counts at most one apart. There is no grown shard."""
    return shuffled_shards(docs, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
