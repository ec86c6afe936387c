"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set is its distinct five-word shingles, as sorted 64-bit hashes; documents with equal sets
form one class. Linked sets differ in size by at most the threshold, so sizes fall into bands whose
limits grow by that ratio: a set can be linked only within its band and the next ones on both sides. A
tile holds the sets of a band (homes) and of the band above (guests) that share one shingle of their
prefixes. A prefix holds so many of a set's shingles, in an order that all sets share, that two linked
sets must have one in common; the order puts shingles of many documents last, so that passages and lines
that stand everywhere make no tiles.

Tiles of few sets give out their pairs, which are counted: the prefixes of two linked sets share not one
shingle only but as many as their overlap must have beyond what stands behind a prefix, so pairs that
meet by chance drop out before a set is read. A pair's count is whole unless it shares a larger tile too,
where it is compared anyway.

In larger tiles sets are compared by bitmaps, in which every shingle sets the bit that its hash names: the
bits in which two bitmaps differ bound the overlap from above, by (n + m - differing) / 2. A bitmap has 8
to 16 bits per shingle and is folded to the narrower one's width. Only sets with a pair beyond the bound
are sent whole, and their pairs intersected.

Larger tiles are not expanded into their pairs. First every set is intersected with a few likely partners,
and components are made. Then only tiles with several components are compared, their largest component
with the other rows and those among themselves, in blocks of bounded size; a block gives out the links that
join components, fewer than it has rows. So no link between two components is lost, and what is given out
does not grow with the square of a group's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_batches, counted_broadcast, shuffles_dropped, text_or_empty
from .neardup import BATCH_ROWS, NARROW_ROWS, NULL_DOC, Rule, Words, as_set, components, confirmed, grouped, one_each_class, repeated_rows, stirred, text_bytes, texts_of

LINK = 80
#: A shingle in the prefixes of more sets than this goes to the end of the order, with all that share its slot of 2^24.
FREQUENT, SLOT_BITS = 64, 24
#: Tiles of at most so many sets give out their pairs.
PAIRED_ROWS = 64
#: First comparison: rows ahead in a tile, partners per set, and the share of a prefix that likely partners have in common.
AHEAD, NEAREST, LIKELY = 3, 6, 0.25
#: A block of a tile holds so many rows, or sets of about so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 1 << 24
PAIRS = "a long, b long"


def prefix_length(n: int, threshold: int) -> int:
    """Of n shingles, so many that a linked set cannot lack them all."""
    return n - -(-threshold * n // 100) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """A power of two of bits, 8 to 16 per shingle and 64 at least; a shingle's bit is named by its low bits."""
    width = max(64, 1 << (8 * len(shingles) - 1).bit_length())
    at = (stirred(shingles) & np.uint64(width - 1)).astype(np.int64)
    bits = np.zeros(width, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def ordered_prefix(shingles: np.ndarray, frequent: np.ndarray, threshold: int) -> np.ndarray:
    """The prefix in the order by hash, shingles in frequent slots last."""
    late = in_slots(shingles, frequent)
    return np.concatenate([shingles[~late], shingles[late]])[:prefix_length(len(shingles), threshold)].view(np.int64)


def reordered_prefix(lowest: np.ndarray, n: int, frequent: np.ndarray, threshold: int) -> np.ndarray | None:
    """The same from the lowest hashes of a set of n; None if they do not reach far enough."""
    late, size = in_slots(lowest, frequent), prefix_length(n, threshold)
    if len(lowest) == n or len(late) - late.sum() >= size:
        return np.concatenate([lowest[~late], lowest[late]])[:size].view(np.int64)
    return None


def in_slots(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    slot = shingles >> np.uint64(64 - SLOT_BITS)
    return (frequent[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def read_sets(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (equal for equal sets, null without) and lowest, written.

    lowest holds the lowest hashes of a set, twice as many as its prefix has, in order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sizes, keys, prefixes = [], [], []
            for text in text_bytes(batch.column(2)):
                s = words.shingles(text)
                sizes.append(len(s))
                keys.append(int(stirred(stirred(s + np.uint64(1)).sum(keepdims=True)).view(np.int64)[0]) if len(s) else None)
                prefixes.append(s[:2 * prefix_length(len(s), threshold)].view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), long_lists(prefixes)],
                                             names=["doc_id", "text_key", "n_shingles", "set_key", "lowest"])

    text = text_or_empty()
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return cut_lineage(picked.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key long, lowest array<long>"))


def classes(read: DataFrame) -> DataFrame:
    """One row per distinct set: cls, label (smallest doc_id), text_key of one such row, and n."""
    doc = F.coalesce("doc_id", F.lit(NULL_DOC))
    return cut_lineage(read.filter("set_key IS NOT NULL").groupBy(F.col("set_key").alias("cls")).agg(
        F.min(F.struct(doc.alias("doc"), "text_key")).alias("rep"), F.first("n_shingles").alias("n")
    ).select("cls", F.col("rep.doc").alias("label"), F.col("rep.text_key").alias("text_key"), "n"))


def lowest_of(read: DataFrame, kinds: DataFrame, repeated: DataFrame) -> DataFrame:
    """cls, label, text_key, n and lowest of every class, from the row that stands for it."""
    doc = F.coalesce("doc_id", F.lit(NULL_DOC)).alias("label")
    rows = read.select(F.col("set_key").alias("cls"), doc, "text_key", "lowest").join(counted_broadcast(kinds, NARROW_ROWS), ["cls", "label", "text_key"])
    rows = rows.select("cls", "label", "text_key", "n", "lowest")
    if repeated.isEmpty():
        return rows
    several = cut_lineage(kinds.join(repeated, ["label", "text_key"], "left_semi").select("cls"))
    return rows.join(several, "cls", "left_anti").union(rows.join(several, "cls", "left_semi").dropDuplicates(["cls"]))


def frequent_keys(kinds: DataFrame) -> DataFrame:
    """key and held: the prefix shingles of many classes."""
    return kinds.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > FREQUENT)


def frequent_slots(shared: DataFrame) -> np.ndarray | None:
    """A bit per slot that holds a frequent shingle: 2^24 bits however large the table is; none if no shingle is frequent."""
    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned(key, {64 - SLOT_BITS}) & 63))")
    found = shared.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    if found.empty:
        return None
    slots = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    slots[found["at"].to_numpy()] = found["bits"].to_numpy()
    return slots.view(np.uint64)


def plain_prefixes(kinds: DataFrame, threshold: int) -> DataFrame:
    """The classes with prefixes in the order by hash alone."""
    size = F.expr(f"cast(n - ({threshold} * n + 99) div 100 + 1 as int)")
    return kinds.select("cls", "label", "text_key", "n", F.slice("lowest", F.lit(1), size).alias("prefix"))


def reordered(kinds: DataFrame, docs: DataFrame, repeated: DataFrame, frequent: np.ndarray, threshold: int) -> DataFrame:
    """The classes with prefixes in the order that puts frequent shingles last, written.

    The lowest hashes of a set nearly always hold enough others; the few sets that consist of frequent
    shingles are read again.
    """
    sent = kinds.sparkSession.sparkContext.broadcast(frequent)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [reordered_prefix(x.values.to_numpy().view(np.uint64), n.as_py(), sent.value, threshold) for n, x in zip(batch.column(3), batch.column(4))]
            lists = long_lists([np.zeros(0, np.int64) if p is None else p for p in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["cls", "label", "text_key", "n", "prefix"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            parts = [ordered_prefix(words.shingles(t), sent.value, threshold) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), long_lists(parts)], names=["cls", "prefix"])

    done = cut_lineage(kinds.select("cls", "label", "text_key", "n", "lowest").mapInArrow(moved, "cls long, label long, text_key long, n long, prefix array<long>"))
    rest = cut_lineage(done.filter(F.size("prefix") == 0).drop("prefix"))
    if rest.isEmpty():
        return done
    fresh = one_each_class(texts_of(rest, docs).mapInArrow(again, "cls long, prefix array<long>"), rest, repeated)
    return cut_lineage(done.filter(F.size("prefix") > 0).union(rest.join(fresh, "cls").select(done.columns)))


def tiles(kinds: DataFrame, threshold: int) -> DataFrame:
    """key, tile, cls, n, guest, held and times: the rows of tiles that hold several classes, one of them at home.

    Of tiles of a band that hold the same classes, as those of a common passage do, one stands for all;
    times is their number. Two xors of 64-bit hashes tell them apart. One exchange on the key serves
    all counts.
    """
    band = F.floor(F.log("n") / F.lit(math.log(100 / threshold))).cast("int")
    rows = kinds.select("cls", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("key"))
    shared = rows.withColumn("rows", F.count("*").over(W.partitionBy("key"))).filter("rows > 1")
    both = F.explode(F.array(F.struct(band.alias("tile"), F.lit(False).alias("guest")), F.struct((band - 1).alias("tile"), F.lit(True).alias("guest"))))
    placed = shared.select("key", "cls", "n", both.alias("t")).select("key", "cls", "n", "t.tile", "t.guest")
    one = W.partitionBy("key", "tile")
    counted = placed.select(
        "key", "tile", "cls", "n", "guest", F.count("*").over(one).alias("held"), F.bool_and("guest").over(one).alias("empty"), (F.min("cls").over(one) == F.col("cls")).alias("lead"),
        *[F.bit_xor(F.xxhash64("cls", "guest", F.lit(salt))).over(one).alias(f"x{salt}") for salt in (1, 2)]).filter("held > 1 AND NOT empty")
    full = cut_lineage(counted.select("key", "tile", "cls", "n", "guest", "held", *[F.when(F.col("lead"), F.col(x)).alias(x) for x in ("x1", "x2")]))
    kept = full.filter("x1 IS NOT NULL").groupBy("tile", "held", "x1", "x2").agg(F.min("key").alias("key"), F.count("*").alias("times")).select("key", "tile", "times")
    return cut_lineage(full.drop("x1", "x2").join(counted_broadcast(cut_lineage(kept), NARROW_ROWS), ["key", "tile"]))


def counted_pairs(small: DataFrame, threshold: int) -> DataFrame:
    """a, b and times, the prefix shingles that they share, of the pairs of small tiles that can be linked, written.

    Of two linked sets let the prefix of x end first. Of the shingles that they share, those in the prefix
    of x are in the other's too, and at most all behind it come on top. Which prefix ends first is not known
    here, so the larger set's, which has more behind it, bounds both.
    """
    group = small.groupBy("key", "tile").agg(F.sort_array(F.collect_list(F.struct("n", "cls", "guest"))).alias("rows"), F.first("times").alias("times"))
    each = group.select("times", "rows", F.posexplode("rows").alias("at", "x"))
    fit = F.filter(F.slice("rows", F.col("at") + 2, F.size("rows")), lambda y: ~(y["guest"] & F.col("x.guest")) & (100 * F.col("x.n").cast("long") >= threshold * y["n"].cast("long")))
    met = each.select("times", "x", F.explode(fit).alias("y"))
    pairs = met.groupBy(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).agg(
        F.sum("times").alias("times"), F.first(F.col("x.n").cast("long")).alias("n"), F.first(F.col("y.n").cast("long")).alias("m"))
    behind = f"({threshold} * m + 99) div 100 - 1"  # n <= m
    return cut_lineage(pairs.filter(f"times + {behind} >= ({threshold} * (n + m) + {99 + threshold}) div {100 + threshold}").select("a", "b", "times"))


def near_rows(large: DataFrame, threshold: int) -> DataFrame:
    """a, b and times: each class with a few classes that follow it in many of its larger tiles."""
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("held") / BLOCK_ROWS))
    order = W.partitionBy("key", "tile", "part").orderBy("n", F.xxhash64("cls"))
    ahead = F.array(*[F.lead(F.struct("cls", "n", "guest"), k).over(order) for k in range(1, AHEAD + 1)])
    met = large.withColumn("part", part).select("cls", "n", "guest", "times", ahead.alias("ahead")).select("cls", "n", "guest", "times", F.explode("ahead").alias("o")).filter(F.col("o").isNotNull() & ~(F.col("guest") & F.col("o.guest")))
    fit = met.filter(F.lit(100).cast("long") * F.least("n", "o.n") >= F.lit(threshold).cast("long") * F.greatest("n", "o.n"))
    counted = fit.groupBy(F.least("cls", "o.cls").alias("a"), F.greatest("cls", "o.cls").alias("b")).agg(F.sum("times").alias("times"), F.min(F.least("n", "o.n")).alias("least"))
    return counted.filter(F.col("times") >= LIKELY * (100 - threshold) / 100 * F.col("least")).select("a", "b", "times")


def first_pairs(counted: DataFrame, large: DataFrame, threshold: int) -> DataFrame:
    """Each class with a few likely partners, those first that share most of its prefix."""
    likely = counted.union(near_rows(large, threshold)).groupBy("a", "b").agg(F.sum("times").alias("times"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("times"), "b"))
    return likely.withColumn("rank", rank).filter(F.col("rank") <= NEAREST).select("a", "b")


def full_sets(wanted: DataFrame, kinds: DataFrame, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """cls and shingles (sorted, 8 bytes each) of the wanted classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [words.shingles(t).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    picked = kinds.join(wanted, "cls", "left_semi")
    return one_each_class(texts_of(picked, docs).mapInArrow(run, "cls long, shingles binary"), picked, repeated)


def bitmaps(sets: DataFrame) -> DataFrame:
    """cls and bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bitmap(as_set(s)) for s in batch.column(1)], pa.binary())], names=["cls", "bits"])

    return sets.select("cls", "shingles").mapInArrow(run, "cls long, bits binary")


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all as wide as the narrowest."""
    words = min(map(len, bits)) // 8
    rows = np.empty((len(bits), words), np.uint64)
    for k, raw in enumerate(bits):
        rows[k] = np.bitwise_or.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)
    return rows


def beyond_bound(batch: pd.DataFrame, bits: np.ndarray, root: np.ndarray, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a block, sorted by n, with the later rows of other roots that the bitmaps don't rule out.

    root may change from row to row.
    """
    block, guest = batch["block"].to_numpy(), batch["guest"].to_numpy()
    n = batch["n"].to_numpy().astype(np.int64)
    low, high, inner = (batch[c].iloc[0] for c in ("low", "high", "inner"))
    for i in range(len(n) - 1):
        end = np.searchsorted(n, 100 * n[i] // rule.threshold, side="right")
        j = np.arange(i + 1, end)
        j = j[(root[j] != root[i]) & ~(guest[j] & guest[i]) & ((block[j] != block[i]) | (low == high) | (inner & (block[i] == low)))]
        if len(j):
            differing = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            most = np.minimum((n[i] + n[j] - differing) // 2, n[i])
            j = j[rule.linked(most, n[i] + n[j] - most)]
        if len(j):
            yield i, j


def open_rows(batch: pd.DataFrame, rule: Rule) -> np.ndarray:
    """Which rows of a block have a pair that the bitmaps don't rule out."""
    is_open = np.zeros(len(batch), bool)
    for i, j in beyond_bound(batch, folded(list(batch["bits"])), batch["root"].to_numpy(), rule):
        is_open[i] = is_open[j] = True
    return is_open


def joining_links(batch: pd.DataFrame, rule: Rule) -> np.ndarray:
    """Of the links between the rows of a block, those that join components, fewer than rows."""
    sets = [np.frombuffer(s, np.uint64) for s in batch["shingles"]]
    cls, root = batch["cls"].to_numpy(), batch["root"].to_numpy().copy()
    n = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(n)])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    at, has = at.astype(np.int32), np.zeros(len(names), bool)
    found = []
    for i, j in beyond_bound(batch, folded([bitmap(s) for s in sets]), root, rule):
        own = at[starts[i]:starts[i + 1]]
        has[own] = True
        for k in j:
            if root[k] != root[i]:
                both = int(has[at[starts[k]:starts[k + 1]]].sum())
                if rule.linked(both, n[i] + n[k] - both):
                    found.append(sorted((cls[i], cls[k])))
                    root[root == root[k]] = root[i]
        has[own] = False
    return np.array(found, np.int64).reshape(-1, 2)


def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of rows sorted by key and part, each sorted by n."""
    for batch in grouped(batches):
        group = batch[["key", "part"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
        for s, e in zip(starts, [*starts[1:], len(batch)]):
            yield batch.iloc[s:e].sort_values(["n", "cls"], kind="stable")


DEALT = "key long, part long, cls long, n int, guest boolean, root long, block long, low long, high long, inner boolean"


def dealt_blocks(large: DataFrame, roots: DataFrame, rule: Rule) -> DataFrame:
    """The rows of tiles with several components, in blocks.

    The rows of a tile's largest component are not compared with each other. Blocks are paired; a row is
    sent once per block that it is compared with.
    """
    tile = ["key", "tile"]
    rooted = large.join(roots, large["cls"] == roots["node"], "left").select(*tile, "cls", "n", "guest", F.coalesce("root", "cls").alias("root"))
    counts = rooted.groupBy(*tile, "root").agg(F.count("*").alias("rows")).groupBy(*tile).agg(
        F.sum("rows").alias("held"), F.max(F.struct("rows", "root")).alias("main")).filter("main.rows < held")
    several = F.col("main.rows") > 1
    size = F.greatest(F.lit(64), F.least(F.lit(BLOCK_ROWS), F.lit(BLOCK_BYTES) / (8 * F.pow(F.lit(100 / rule.threshold), F.col("tile") + 2)))).cast("long")
    sized = counts.select(*tile, F.when(several, F.col("main.root")).alias("main"), size.alias("size"), F.when(several, F.col("main.rows")).otherwise(0).alias("mains"), "held")
    cut = cut_lineage(sized.select(*tile, "main", F.ceil((F.col("held") - F.col("mains")) / F.col("size")).alias("others"), F.ceil(F.col("mains") / F.col("size")).alias("mains")))
    is_main, hash_ = F.coalesce(F.col("root") == F.col("main"), F.lit(False)), F.xxhash64("cls")
    block = F.when(is_main, F.col("others") + F.pmod(hash_, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(hash_, "others"))
    meets = F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    # a block of other rows is compared within itself beside the first block of the largest component, or on its own if there is none
    meets = F.when(is_main | (F.col("mains") == 0), meets).otherwise(F.filter(meets, lambda o: o != F.col("block")))
    placed = rooted.join(cut, tile).withColumn("block", block).withColumn("other", F.explode(meets))
    return placed.select(
        "key", F.xxhash64("tile", F.least("block", "other"), F.greatest("block", "other")).alias("part"), "cls", "n", "guest", "root", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.greatest("block", "other") == F.col("others")).alias("inner"))


def block_links(large: DataFrame, sets: DataFrame, roots: DataFrame, rule: Rule) -> DataFrame:
    """Links of larger tiles that join different components, as many as it takes to join all that are linked."""
    columns = [c.split()[0] for c in DEALT.split(", ")]

    def left_open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks_of(batches):
            yield block.loc[open_rows(block, rule), columns]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks_of(batches):
            yield pd.DataFrame(joining_links(block, rule), columns=["a", "b"])

    def together(rows: DataFrame, held: DataFrame) -> DataFrame:
        return rows.join(held, "cls").select(*columns, held.columns[1]).repartition("key", "part").sortWithinPartitions("key", "part")

    wanted = cut_lineage(large.select("cls").distinct())
    bits = bitmaps(sets.join(counted_broadcast(wanted, NARROW_ROWS), "cls", "left_semi"))
    rest = cut_lineage(together(dealt_blocks(large, roots, rule), bits).mapInPandas(left_open, DEALT))
    ends = cut_lineage(rest.select("cls").distinct())
    held = sets.join(counted_broadcast(ends, NARROW_ROWS), "cls", "left_semi").select("cls", "shingles")
    return together(rest, held).mapInPandas(linked, PAIRS).distinct()


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    at = [roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b")]
    rooted = pairs.join(at[0], "a", "left").join(at[1], "b", "left")
    return rooted.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def linked_documents(docs: DataFrame, threshold: int = LINK) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; threshold in percent.

    Documents without words have an empty set and stay alone. Rows with a null doc_id take part in
    links; a component of such rows only has a null component_id. Repeated rows have equal sets and
    share a component. Very long texts are sets like others. An empty table gives none. Other columns
    are not read.
    """
    rule = Rule(threshold)
    with arrow_batches(docs.sparkSession, BATCH_ROWS), shuffles_dropped(docs.sparkSession):
        read = read_sets(docs, threshold)
        named, repeated = classes(read), repeated_rows(read)
        found = lowest_of(read, named, repeated)
        frequent = frequent_slots(frequent_keys(plain_prefixes(found, threshold)))
        kinds = plain_prefixes(found, threshold) if frequent is None else reordered(found, docs, repeated, frequent, threshold)
        live = tiles(kinds, threshold)
        counted = counted_pairs(live.filter(F.col("held") <= PAIRED_ROWS), threshold)
        large = cut_lineage(live.filter(F.col("held") > PAIRED_ROWS))
        first = cut_lineage(first_pairs(counted, large, threshold))
        wanted = large.select("cls").union(counted.select("a")).union(counted.select("b")).distinct()
        sets = full_sets(wanted, kinds, docs, repeated)
        links = cut_lineage(confirmed(first, sets, rule))
        roots = cut_lineage(components(links))
        more = cut_lineage(confirmed(cut_lineage(across(counted, roots)), sets, rule).union(block_links(large, sets, roots, rule)))
        if more.limit(1).count():
            roots = cut_lineage(components(links.union(more)))
    named = named.select("cls", "label").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "label", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("label").alias("component_id"))
    labels = named.join(least, "root").select(F.col("cls").alias("set_key"), F.when(F.col("component_id") < NULL_DOC, F.col("component_id")).alias("component_id"))
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return read.join(labels, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"))
