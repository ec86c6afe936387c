"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation is learned on a bounded sample so that the signs of the rotated coordinates (64 bits)
keep angles. Codes are split into eight bytes, each of them an index. By the pigeonhole principle a
code within Hamming radius r of a query has a byte with at most r / 8 wrong bits, so probing the
buckets of all such bytes retrieves every code within r. Those are reranked by exact inner products.
Vectors lie in blocks of bounded size, as do queries; every query meets every block, and each meeting
keeps its best few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import counted_broadcast

NEIGHBOURS = 20
#: Vectors that the rotation and the radius are learned on at most, chosen by a hash.
SAMPLE_ROWS, SAMPLE_QUERIES = 10_000, 200
#: Share of the sample's true neighbours that the radius must cover. With more vectors than the
#: sample the true ones lie nearer, so it covers more of them.
COVERED = 0.97
BITS, BYTES = 64, 8
ROUNDS = 30
INDEX_BLOCK, QUERY_BLOCK, PROBE_ROWS = 8_192, 2_048, 64

WRONG_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def learned_projection(sample: np.ndarray, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to BITS coordinates: rotations that bring coordinates near to their signs.

    Fewer than BITS dimensions are rotated several times from different starts; of more, the ones
    of largest variance are used.
    """
    mean = sample.mean(0)
    centred = sample - mean
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:min(dims, BITS)].T if len(axes) >= min(dims, BITS) else np.eye(dims)[:, :min(dims, BITS)]
    reduced, parts = centred @ axes, []
    while sum(p.shape[1] for p in parts) < BITS:
        turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(reduced.T @ np.sign(reduced @ turn))
            turn = u @ v
        parts.append(axes @ turn)
    return mean, np.concatenate(parts, 1)[:, :BITS]


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits((vectors - mean) @ projection > 0, axis=1)


def extended(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors of one length: with a further coordinate angles to a query order as inner products."""
    rest = np.maximum(largest**2 - (vectors**2).sum(1), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], 1)


def covering_radius(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, largest: float) -> int:
    """The Hamming distance within which the share COVERED of the sample's own neighbours lies."""
    queries = sample[:SAMPLE_QUERIES]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :min(NEIGHBOURS, len(sample) - 1)]
    if not best.size:
        return BITS
    points = codes(extended(sample, largest), mean, projection)
    asked = codes(np.pad(queries, ((0, 0), (0, 1))), mean, projection)
    apart = WRONG_BITS[asked[:, None, :] ^ points[best]].sum(2)
    return int(np.quantile(apart, COVERED, method="higher"))


def probed(asked: np.ndarray, points: np.ndarray, radius: int) -> np.ndarray:
    """Which points each query retrieves: those in a bucket of some byte within radius / BYTES bits."""
    hits = np.zeros((len(asked), len(points)), bool)
    errors = radius // BYTES
    for k in range(BYTES):
        order = np.argsort(points[:, k], kind="stable")
        starts = np.searchsorted(points[order, k], np.arange(257))
        for value in np.flatnonzero(np.diff(starts)):
            near = np.flatnonzero(WRONG_BITS[asked[:, k] ^ np.uint8(value)] <= errors)
            if len(near):
                hits[near[:, None], order[starts[value]:starts[value + 1]]] = True
    return hits


def best_of_block(queries: np.ndarray, asked: np.ndarray, vectors: np.ndarray, points: np.ndarray, labels: np.ndarray,
                  radius: int, keep: int) -> list[tuple[int, int]]:
    """(query, point) positions of each query's best ``keep`` points within the radius.

    A query with fewer points within it takes its nearest codes besides, so that none comes short.
    """
    out = []
    for at in range(0, len(queries), PROBE_ROWS):
        mine = asked[at:at + PROBE_ROWS]
        hits = probed(mine, points, radius)
        rows, columns = np.nonzero(hits)
        apart = np.full(hits.shape, BITS + 1, np.uint8)
        apart[rows, columns] = WRONG_BITS[mine[rows] ^ points[columns]].sum(1)
        inside = apart <= radius
        for q in np.flatnonzero(inside.sum(1) < min(keep, len(points))):
            distance = WRONG_BITS[mine[q] ^ points].sum(1)
            inside[q, np.argsort(distance, kind="stable")[:keep]] = True
        scores = np.where(inside, queries[at:at + PROBE_ROWS] @ vectors.T, -np.inf)
        for q in range(len(mine)):
            found = np.flatnonzero(inside[q])
            if len(found) > keep:
                edge = np.partition(scores[q, found], -keep)[-keep]
                found = found[scores[q, found] >= edge - 1e-9 * max(1.0, abs(edge))]
            exact = np.einsum("ij,j->i", vectors[found], queries[at + q])
            out += [(at + q, int(found[k])) for k in np.lexsort((labels[found], -exact))[:keep]]
    return out


def nearest(rows: DataFrame, every: int = 20, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Each query's nearest vectors by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id ``every`` divides; candidates all rows but those with the
    query's vec_id. Rows with a null vec_id, an unusable vector, or another number of components
    than most have take no part. Equal vectors are searched once and all their rows listed, ties by
    vec_id; so repeated rows are listed each. With fewer candidates all are returned; an empty table
    gives none. Other columns are not read.
    """
    spark, schema = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    picked = picked.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = picked.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    held = cut_lineage(picked.filter(F.size("v") == sizes[0]["size"]).withColumn("cls", F.xxhash64("v")))
    kinds = cut_lineage(held.groupBy("cls").agg(
        F.min("vec_id").alias("label"), F.first("v").alias("v"), F.max((F.pmod("vec_id", F.lit(every)) == 0).cast("int")).alias("asks")))
    largest = kinds.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = np.array(kinds.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE_ROWS).select("v").toPandas()["v"].tolist())
    mean, projection = learned_projection(extended(sample, largest))
    radius = covering_radius(sample, mean, projection, largest)
    keep = neighbours + 1
    n, asking = kinds.agg(F.count("*"), F.sum("asks")).first()
    blocks, parts = -(-n // INDEX_BLOCK), -(-max(1, asking) // QUERY_BLOCK)

    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "cls", "label", "score"]
        if not len(points) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype=float if c == "score" else np.int64) for c in columns})
        x, q = np.array(points["v"].tolist()), np.array(queries["v"].tolist())
        at = codes(extended(x, largest), mean, projection)
        asked = codes(np.pad(q, ((0, 0), (0, 1))), mean, projection)
        labels = points["label"].to_numpy()
        found = np.array(best_of_block(q, asked, x, at, labels, radius, keep))
        i, j = found[:, 0], found[:, 1]
        return pd.DataFrame({"query": queries["cls"].to_numpy()[i], "cls": points["cls"].to_numpy()[j], "label": labels[j],
                             "score": np.einsum("ij,ij->i", q[i], x[j])})[columns]

    def spread(column: str, n_: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n_ - 1))).alias(column)

    index = kinds.select("cls", "label", "v", F.pmod("cls", F.lit(blocks)).cast("int").alias("block"), spread("part", parts))
    asks = kinds.filter("asks = 1").select("cls", "v", F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int").alias("part"), spread("block", blocks))
    met = index.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInPandas(search, "query long, cls long, label long, score double")
    best = met.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "label"))).filter(F.col("place") <= keep)
    members = held.withColumn("place", F.row_number().over(W.partitionBy("cls").orderBy("vec_id"))).filter(F.col("place") <= keep).select("cls", "vec_id")
    listed = best.select("query", "cls", "score").join(members, "cls")
    listed = listed.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= keep)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    queries = held.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query"))
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours)
    return queries.join(lists, "query").select("query_id", F.posexplode(own).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
