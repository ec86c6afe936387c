"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Every source's documents, in a hashed order, form one stream of words, which is cut into blocks of
equal length; a stream that must give more than it has starts again. A golden-ratio sequence of
points, mapped through the cumulative targets, says which source fills each slot of the mix, and
the k-th slot of a source takes its k-th block. So every stretch of the mix is near its weights.

Orders and ranks are computed per bucket of bounded size with offsets from bucket sums, so a source
that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import counted_broadcast, text_or_empty, words

#: Weights by source in code point order, repeating.
WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 1024
GOLDEN = (math.sqrt(5) - 1) / 2
#: Rows of the corpus per bucket of the hashed order, and slots per bucket of the schedule.
BUCKET_ROWS = 16_384


def order_key(seed: str = "mix") -> Column:
    """The hashed order of documents: a digest of the seed and doc_id (null: the empty string)."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def sized_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """row, doc_id, source, size (words; null text: 0) and the order key, as a written table.

    ``row`` identifies a row, so repeated documents stay apart. A column ``row`` that the input
    already has as its identity is kept.
    """
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    return cut_lineage(docs.select(
        row.alias("row"), "doc_id", "source", F.size(words(text_or_empty())).cast("long").alias("size"),
        order_key(seed).alias("key"), F.xxhash64("text").alias("tie"),
    ))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, sno (code point order, null last), source_size, target, quota.

    Targets share the words of all sources by weight. A target stops at ``repeats`` times its
    source's size and the excess is shared again by weight, until none is above: with sources sorted
    by cap per weight, those below the level of the remaining budget are capped. quota is the target
    in whole words, never above the cap. The table has one row per source, so its two global windows
    sort sources, not documents.
    """
    every = W.partitionBy()
    named = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sno", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sno") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * repeats)
    )
    before = W.orderBy(F.col("cap") / F.col("weight"), "sno").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        named.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")))
        .withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("cap")).cast("long"))
        .select("source", "sno", "source_size", "target", "quota")
    )


def word_positions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row with ``start``, the place of its first word in its source's stream."""
    bits = min(24, max(8, math.ceil(math.log2(max(1, sized.count()) / BUCKET_ROWS + 1))))
    placed = (
        sized.join(counted_broadcast(targets), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
        .withColumn("fine", F.shiftright(F.conv(F.substring("key", 1, 6), 16, 10).cast("int"), 24 - bits))
    )
    sums = placed.groupBy("sno", "fine").agg(F.sum("size").alias("held"))
    upto = W.unboundedPreceding
    coarse = F.shiftright(F.col("fine"), bits - 8)
    inner = W.partitionBy("sno", "coarse").orderBy("fine").rowsBetween(upto, -1)
    outer = W.partitionBy("sno").orderBy("coarse").rowsBetween(upto, -1)
    sums = sums.withColumn("coarse", coarse)
    tops = sums.groupBy("sno", "coarse").agg(F.sum("held").alias("held")).select(
        "sno", "coarse", F.coalesce(F.sum("held").over(outer), F.lit(0)).alias("top"))
    offsets = sums.select("sno", "coarse", "fine", F.coalesce(F.sum("held").over(inner), F.lit(0)).alias("within")).join(
        tops, ["sno", "coarse"]).select("sno", "fine", (F.col("top") + F.col("within")).alias("offset"))
    local = W.partitionBy("sno", "fine").orderBy("key", "tie", "row").rowsBetween(upto, -1)
    return placed.join(offsets, ["sno", "fine"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(local), F.lit(0)))


def slot_schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, sno and block: which block of which source fills each slot of the mix.

    Slot i belongs to the source in whose share of [0, 1) the point frac((i + 1/2) * golden ratio)
    lies. Points are matched to shares through equal cells, an equi-join. The sequence gives every
    source its number of blocks up to a few; slots beyond a source's need stay empty, and blocks it
    is short of follow at the end, so that quotas are met exactly.
    """
    spark = targets.sparkSession
    needs = targets.select("sno", "target", F.ceil(F.col("quota") / block_words).alias("need"))
    total, sources, words_ = needs.agg(F.sum("need"), F.count("*"), F.sum("target")).first()
    slots, cells = int(total or 0), 1 << max(4, math.ceil(math.log2(2 * (sources or 1))))
    upto = W.orderBy("sno").rowsBetween(W.unboundedPreceding, 0)
    shares = (
        needs.filter("need > 0").withColumn("high", F.sum("target").over(upto) / F.lit(float(words_ or 1)))
        .withColumn("low", F.lag("high", 1, 0.0).over(W.orderBy("sno")))
        .withColumn("high", F.when(F.lead("sno").over(W.orderBy("sno")).isNull(), F.lit(2.0)).otherwise(F.col("high")))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    )
    point = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(slots).withColumn("point", point - F.floor(point)).withColumn("cell", F.floor(F.col("point") * cells))
    owned = points.join(counted_broadcast(shares), "cell").filter("point >= low and point < high").select(
        F.col("id").alias("slot"), "sno", "need", F.floor(F.col("id") / BUCKET_ROWS).alias("part"))
    counts = owned.groupBy("sno", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("sno").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("sno", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = owned.join(offsets, ["sno", "part"]).withColumn(
        "block", F.col("offset") + F.row_number().over(W.partitionBy("sno", "part").orderBy("slot")) - 1)
    short = (
        needs.join(counts.groupBy("sno").agg(F.sum("n").alias("got")), "sno", "left")
        .withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
        .withColumn("block", F.explode(F.sequence(F.col("got"), F.col("need") - 1)))
    )
    return ranked.filter("block < need").select("slot", "sno", "block").union(
        short.select((F.lit(slots) + F.col("block") * F.lit(sources or 1) + F.col("sno")).alias("slot"), "sno", "block"))


def mix(positions: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: slot, row, epoch (how often the stream had started before), word_from, word_to.

    Each row is the part of one document in one block: words word_from (inclusive) to word_to of its
    text. A long document lies in several blocks. The pieces are made only as far as the quota goes.
    """
    size, start, quota = F.col("size"), F.col("start"), F.col("quota")
    pieces = (
        positions.filter((size > 0) & (start < quota))
        .select("row", "sno", "size", "quota", "start", "source_size",
                F.explode(F.sequence(F.lit(0), F.floor((quota - start - 1) / F.col("source_size")))).alias("epoch"))
        .withColumn("start", start + F.col("epoch") * F.col("source_size"))
        .withColumn("stop", F.least(F.col("start") + size, quota))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("stop") - 1) / block_words))))
    )
    return pieces.join(slot_schedule(targets, block_words), ["sno", "block"]).select(
        "slot", "row", "epoch",
        (F.greatest(F.col("start"), F.col("block") * block_words) - F.col("start")).alias("word_from"),
        (F.least(F.col("stop"), (F.col("block") + 1) * block_words) - F.col("start")).alias("word_to"))


def taken_words(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document with the words the mix takes of it, repeats counted.

    Returns doc_id, size, source_size, target, taken. A null or blank text has size 0 and takes 0; a
    null source is a source of its own; repeated rows count as documents of their own; an empty table
    gives none. Other columns of ``docs`` are not read.
    """
    sized = sized_documents(docs.select("doc_id", "source", "text"))
    targets = cut_lineage(source_targets(sized, weights, repeats))
    positions = word_positions(sized, targets)
    takes = mix(positions, targets, block_words).groupBy("row").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    labelled = sized.join(counted_broadcast(targets), sized["source"].eqNullSafe(targets["source"]))
    return labelled.join(takes, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per document and pass over its source.

    A document its source's quota cuts keeps its first words, joined by single spaces. Documents the
    mix doesn't take are left out; n_chars, where there is one, follows the text. The same holds for
    nulls, repeats and empty tables as for ``taken_words``.
    """
    held = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    sized = sized_documents(held.select("row", "doc.doc_id", "doc.source", "doc.text"))
    targets = cut_lineage(source_targets(sized, weights, repeats))
    passes = mix(word_positions(sized, targets), targets, block_words).groupBy("row", "epoch").agg(F.max("word_to").alias("word_to"))
    whole = sized.select("row", "size")
    cut = held.join(passes.join(whole, "row"), "row").withColumn("mixed", F.when(F.col("word_to") == F.col("size"), F.col("doc.text")).otherwise(
        F.array_join(F.slice(words(F.col("doc.text")), F.lit(1), F.col("word_to").cast("int")), " ")))
    columns = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return cut.select(*[columns.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
