"""Near-duplicates: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full sets.

A document's set is its distinct five-word shingles. Documents with equal sets form one class. Each
class has a signature of 64 indexed 16-bit symbols and 128 further 8-bit ones. The indexed symbols
are split into c chunks: two signatures that differ in at most 2c - 1 symbols agree in some chunk up
to one error (pigeonhole), so each class is filed under every chunk with each of its symbols left out
in turn, and every such pair meets in a bucket. The link rule's threshold decides c and the symbols
that may differ, so that a pair at the threshold is out of reach with a probability under ``MISSED``.

Buckets are never expanded into all their pairs. First every class is compared with a few others of
its bucket, the likeliest pairs are confirmed, and components are made. Then only buckets with several
components are compared, in blocks of bounded size: the largest component with the other rows, and
those among themselves. In a bucket with a large component every class knows which shingles of the
component's anchor it lacks, and has a bitmap of those that it has beside them; both bound the overlap
of two classes from above, so closely that hardly a pair is given out in vain. So a link between
components can be missing only where the signatures are out of reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_batches, counted_broadcast, text_or_empty

SHINGLE = 5
#: Sets are linked if 100 * intersection >= threshold * union: op7's threshold, and the corpus stage's.
LINK, STAGE_LINK = 85, 80
INDEXED, FURTHER = 64, 128
#: Bound on the probability that the signatures of a pair at the threshold differ in too many symbols.
MISSED = 1e-6
BLOCK_ROWS = 512
#: In the first comparison: rows ahead in the bucket, and confirmed pairs per class.
AHEAD, NEAREST = 3, 6
#: Symbols that may differ for a pair to be confirmed already after the first comparison.
LIKELY_DISTANCE = 34
#: Rows of one component in a bucket from which its anchor is used.
ANCHORED_ROWS = 16
#: Bits per shingle beside an anchor, and the widest bitmap of them.
BESIDE_BITS, WIDEST_BITS = 8, 1 << 14
NULL_DOC = 1 << 62
#: Stands for the anchor of buckets without one; a class of that number would only lose a bound on its overlaps.
NO_ANCHOR = -(1 << 63)
#: Tables of up to so many rows of one to three numbers are broadcast, once they have been counted.
NARROW_ROWS = 1_000_000
#: Rows that a Python worker gets at once: texts, or pairs with both sets.
BATCH_ROWS = 1_000

SPREAD = np.uint64(0xD6E8FEB86659FD93)
STEP = np.uint64(0x9E3779B97F4A7C15)


def tail(n: int, k: int, p: float) -> float:
    """The probability of more than k successes in n trials."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))


@dataclass(frozen=True)
class Rule:
    """When two sets are linked, and the limits of their signatures that follow from it."""

    threshold: int

    def linked(self, both, union):
        return 100 * both >= self.threshold * union

    @cached_property
    def chunks(self) -> int:
        """The fewest chunks that reach far enough."""
        return next(c for c in range(1, INDEXED + 1) if tail(INDEXED, 2 * c - 1, 1 - self.threshold / 100) < MISSED)

    @cached_property
    def index_distance(self) -> int:
        return 2 * self.chunks - 1

    @cached_property
    def whole_distance(self) -> int:
        """The least that keeps both tails together under the bound."""
        p, n = 1 - self.threshold / 100, INDEXED + FURTHER
        return next(k for k in range(n + 1) if tail(INDEXED, self.index_distance, p) + tail(n, k, p) < MISSED)

    @cached_property
    def bounds(self) -> np.ndarray:
        return np.linspace(0, INDEXED, self.chunks + 1).astype(int)

    @cached_property
    def chunk_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunks), np.diff(self.bounds))


def constants(name: str, n: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers of a purpose."""
    seed = int.from_bytes(name.encode(), "big") % (1 << 32)
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SPREAD
    return x ^ (x >> np.uint64(29))


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class Words:
    """Hashes of words; remembers up to a bound."""

    def __init__(self) -> None:
        self.memory: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        memory = self.memory
        if len(memory) > 100_000:
            memory.clear()
        for w in set(words):
            if w not in memory:
                memory[w] = word_hash(w)
        return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: bytes) -> np.ndarray:
        """The sorted distinct 64-bit hashes of the shingles of a text in UTF-8; none without words."""
        words = text.lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes(words)
        n = max(1, len(words) - SHINGLE + 1)
        s = np.full(n, np.uint64(min(len(words), SHINGLE)))
        for k in range(min(len(words), SHINGLE)):
            s = stirred(s * STEP + h[k:k + n])
        return np.unique(s)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at:at + 2048, None] * a + b).min(0), out=least)
    bits = stirred(least) >> np.uint64(48)
    return bits[:INDEXED].astype(np.uint16).tobytes() + bits[INDEXED:].astype(np.uint8).tobytes()


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """One text after the other, so that a batch's texts are not held twice."""
    for value in column:
        yield value.as_buffer().to_pybytes()


def signed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (equal for equal sets, null without) and sig, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, a, b = Words(), constants("slope", INDEXED + FURTHER), constants("shift", INDEXED + FURTHER)
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in text_bytes(batch.column(2)):
                s = words.shingles(text)
                sizes.append(len(s))
                keys.append(int(stirred(stirred(s * STEP).sum(keepdims=True)).view(np.int64)[0]) if len(s) else None)
                sigs.append(signature(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])

    text = text_or_empty()
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return cut_lineage(picked.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key long, sig binary"))


def classes(signed: DataFrame) -> DataFrame:
    """One row per distinct set: cls, label (smallest doc_id), text_key of one such row, n and sig."""
    doc = F.coalesce("doc_id", F.lit(NULL_DOC))
    return cut_lineage(signed.filter("set_key IS NOT NULL").groupBy(F.col("set_key").alias("cls")).agg(
        F.min(F.struct(doc.alias("doc"), "text_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    ).select("cls", F.col("rep.doc").alias("label"), F.col("rep.text_key").alias("text_key"), "n", "sig"))


def symbols(sigs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), 2 * INDEXED + FURTHER)
    return np.ascontiguousarray(raw[:, :2 * INDEXED]).view(np.uint16), raw[:, 2 * INDEXED:]


def bucket_keys(indexed: np.ndarray, rule: Rule) -> np.ndarray:
    """A key per class and symbol left out: the rest of its chunk, hashed."""
    terms = stirred(indexed.astype(np.uint64) * constants("symbol", INDEXED) + constants("place", INDEXED))
    sums = np.add.reduceat(terms, rule.bounds[:-1], axis=1)
    return stirred(sums[:, rule.chunk_of] - terms + constants("key", INDEXED)).view(np.int64)


def filed(kinds: DataFrame, rule: Rule) -> DataFrame:
    """Every class under its keys, as far as the key holds another class: key, place, cls, held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cls": batch["cls"], "keys": list(bucket_keys(symbols(batch["sig"])[0], rule))})

    keyed = kinds.select("cls", "sig").mapInPandas(run, "cls long, keys array<long>").select("cls", F.posexplode("keys").alias("place", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    return cut_lineage(keyed.join(shared, "key").select("key", "place", "cls", "held"))


PAIRS = "a long, b long, apart int"


def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut between groups: rows of one (key, part) stay together. Groups are of bounded size."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        group = batch[["key", "part"]].to_numpy()
        last = np.flatnonzero((group != group[-1]).any(1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        rest = batch.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


@dataclass(frozen=True)
class Beside:
    """What a class lacks of an anchor (a bit per shingle of it) and has beside it (their number, and a bitmap)."""

    lacking: int
    others: int
    bits: int
    width: int
    size: int

    def folded(self, width: int) -> int:
        bits, now = self.bits, self.width
        while now > width:
            now //= 2
            bits = (bits >> now) | (bits & ((1 << now) - 1))
        return bits


def beside_of(lacking: bytes | None, others: float, bits: bytes, size: float) -> Beside | None:
    return None if lacking is None else Beside(int.from_bytes(lacking, "big"), int(others), int.from_bytes(bits, "little"), 8 * len(bits), int(size))


def other_bits(others: np.ndarray) -> bytes:
    """A bit per shingle, named by its hash, in a bitmap that grows with their number up to a bound."""
    width = min(WIDEST_BITS, max(64, 1 << (BESIDE_BITS * len(others)).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(stirred(others) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def possible(x: Beside | None, y: Beside | None, n: int, m: int, rule: Rule) -> bool:
    """Whether two sets of sizes n and m can be linked, by what they lack and have beside one anchor.

    A bit that only one of the two bitmaps has stands for a shingle at least that the other lacks.
    """
    if x is None or y is None:
        return True
    width = min(x.width, y.width)
    p, q = x.folded(width), y.folded(width)
    shared = min(x.others - (p & ~q).bit_count(), y.others - (q & ~p).bit_count())
    most = x.size - (x.lacking | y.lacking).bit_count() + shared
    return bool(rule.linked(most, n + m - most))


def compared(batch: pd.DataFrame, ahead: int | None, rule: Rule, one_each: bool = False) -> pd.DataFrame:
    """Close pairs of the rows of each group: each row with the next ones, all or ``ahead`` of them.

    Of two blocks only pairs across are taken, and those within the lower one where ``inner`` says so.
    All of them are given out only where their first shared key is the group's own; ``one_each`` then
    keeps the closest pair of each two components of a group.
    """
    indexed, further = symbols(batch["sig"])
    cls, root, n, block, low, high, inner, place = (batch[c].to_numpy() for c in ("cls", "root", "n", "block", "low", "high", "inner", "place"))
    beside = [] if ahead else [beside_of(*row) for row in batch[["lacking", "others", "bits", "anchor_size"]].itertuples(index=False)]
    group = batch[["key", "part"]].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [len(batch)]])
    end = np.repeat(starts[1:], np.diff(starts))
    found, rows, step = [], np.arange(len(batch)), 0
    while len(rows) and (ahead is None or step < ahead):
        step += 1
        rows = rows[rows + step < end[rows]]
        x, y = rows, rows + step
        keep = (root[x] != root[y]) & (cls[x] != cls[y]) & rule.linked(np.minimum(n[x], n[y]), np.maximum(n[x], n[y]))
        keep &= (block[x] != block[y]) | (low[x] == high[x]) | (inner[x] & (block[x] == low[x]))
        x, y = x[keep], y[keep]
        for at in range(0, len(x), 16_384):
            i, j = x[at:at + 16_384], y[at:at + 16_384]
            wrong = indexed[i] != indexed[j]
            near = wrong.sum(1)
            close = near <= rule.index_distance
            i, j, wrong, near = i[close], j[close], wrong[close], near[close]
            apart = near + (further[i] != further[j]).sum(1)
            close = apart <= (LIKELY_DISTANCE if ahead else rule.whole_distance)
            if not ahead and close.any():
                errors = np.add.reduceat(wrong, rule.bounds[:-1], axis=1)
                chunk = (errors <= 1).argmax(1)
                inside = wrong & (rule.chunk_of[None, :] == chunk[:, None])
                first = np.where(inside.any(1), inside.argmax(1), rule.bounds[chunk])
                close &= first == place[i]
            if not ahead:
                close[close] = [possible(beside[p], beside[q], n[p], n[q], rule) for p, q in zip(i[close], j[close])]
            i, j = i[close], j[close]
            ends = [np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), apart[close]]
            found.append(np.stack([*ends, np.minimum(root[i], root[j]), np.maximum(root[i], root[j]), np.searchsorted(starts, i, side="right")], 1))
    out = np.concatenate(found).astype(np.int64) if found else np.zeros((0, 6), np.int64)
    if one_each and len(out):
        out = out[np.lexsort((out[:, 1], out[:, 0], out[:, 2], out[:, 4], out[:, 3], out[:, 5]))]
        out = out[np.concatenate([[True], (out[1:, 3:] != out[:-1, 3:]).any(1)])]
    return pd.DataFrame(out[:, :3], columns=["a", "b", "apart"])


def candidates(rows: DataFrame, ahead: int | None, rule: Rule, one_each: bool = False) -> DataFrame:
    """Close pairs of rows that share (key, part)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in grouped(batches):
            yield compared(batch, ahead, rule, one_each)

    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "block", F.xxhash64("cls", "key")).mapInPandas(run, PAIRS)


def first_pairs(live: DataFrame, kinds: DataFrame, rule: Rule) -> DataFrame:
    """Each class with a few likely partners: rows close by in its buckets, the nearest of them."""
    parts = F.ceil(F.col("held") / BLOCK_ROWS)
    rows = live.join(kinds.select("cls", "n", "sig"), "cls").select(
        "key", "place", "cls", "n", "sig", F.col("cls").alias("root"), F.pmod(F.xxhash64("cls"), parts).alias("part"),
        *[F.lit(0).cast("long").alias(c) for c in ("block", "low", "high")], F.lit(False).alias("inner"))
    pairs = candidates(rows, AHEAD, rule).dropDuplicates(["a", "b"])
    rank = F.row_number().over(W.partitionBy("a").orderBy("apart", "b"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= NEAREST).select("a", "b")


def rooted_rows(live: DataFrame, roots: DataFrame) -> DataFrame:
    """The filed classes of buckets that hold several components, with their component's root."""
    rooted = live.join(roots, live["cls"] == roots["node"], "left").select("key", "place", "cls", "held", F.coalesce("root", "cls").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return cut_lineage(rooted.join(mixed, "key"))


def bucket_anchors(rooted: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """key and anchor: of a bucket's largest component, if it is large, the member with most links."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    hubs = ends.groupBy("node").count().join(roots, "node").groupBy("root").agg(F.max(F.struct("count", "node"))["node"].alias("anchor"))
    largest = rooted.groupBy("key", "root").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max(F.struct("rows", "root")).alias("m"))
    return largest.filter(F.col("m.rows") >= ANCHORED_ROWS).select("key", F.col("m.root").alias("root")).join(hubs, "root").select("key", "anchor")


def against_anchors(rooted: DataFrame, anchors: DataFrame, sets: DataFrame) -> DataFrame:
    """anchor, cls, lacking (a bit per shingle of the anchor), others, their bits and anchor_size, once per pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lacking, others, bits, sizes = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = as_set(x), as_set(y)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                has = y[at] == x
                beside = np.delete(y, at[has])
                lacking.append(np.packbits(~has).tobytes())
                others.append(len(beside))
                bits.append(other_bits(beside))
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lacking, pa.binary()), pa.array(others, pa.int64()), pa.array(bits, pa.binary()), pa.array(sizes, pa.int64())],
                names=["anchor", "cls", "lacking", "others", "bits", "anchor_size"])

    wanted = cut_lineage(rooted.join(anchors, "key").select(F.col("anchor").alias("a"), F.col("cls").alias("b")).distinct())
    return cut_lineage(beside_sets(wanted, sets).mapInArrow(run, "anchor long, cls long, lacking binary, others long, bits binary, anchor_size long"))


def dealt_blocks(rooted: DataFrame) -> DataFrame:
    """The rows of each bucket in blocks, sent once to every block that they are compared with.

    The rows of a bucket's largest component are not compared with each other; a block of other rows is
    compared within itself beside the first block of the largest component, or on its own without one.
    """
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("rows")).groupBy("key").agg(F.sum("rows").alias("all"), F.max(F.struct("rows", "root")).alias("main"))
    mains = F.when(F.col("main.rows") > 1, F.col("main.rows")).otherwise(0)
    cut = cut_lineage(counts.select("key", F.when(F.col("main.rows") > 1, F.col("main.root")).alias("main"),
                                    F.ceil((F.col("all") - mains) / BLOCK_ROWS).alias("others"), F.ceil(mains / BLOCK_ROWS).alias("mains")))
    is_main, spread = F.coalesce(F.col("root") == F.col("main"), F.lit(False)), F.xxhash64("cls")
    block = F.when(is_main, F.col("others") + F.pmod(spread, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(spread, "others"))
    meets = F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    meets = F.when(is_main | (F.col("mains") == 0), meets).otherwise(F.filter(meets, lambda o: o != F.col("block")))
    placed = rooted.join(cut, "key").withColumn("block", block).withColumn("other", F.explode(meets))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return placed.select("key", "place", "cls", "root", "block", F.xxhash64(low, high).alias("part"), low.alias("low"), high.alias("high"),
                         (high == F.col("others")).alias("inner"))


def open_pairs(live: DataFrame, kinds: DataFrame, roots: DataFrame, links: DataFrame, sets: DataFrame, rule: Rule, one_each: bool = False) -> DataFrame:
    """The close pairs between different components, each once; buckets within one are left out.

    ``one_each``: of two components in a block only the closest pair.
    """
    rooted = rooted_rows(live, roots)
    anchors = cut_lineage(bucket_anchors(rooted, links, roots))
    against = against_anchors(rooted, anchors, sets)
    # what a row carries is put together once per class and anchor; rows of buckets without one carry only their signature
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("lacking", "binary"), ("others", "long"), ("bits", "binary"), ("anchor_size", "long"))]
    free = rooted.join(anchors, "key", "left_anti").select(F.lit(NO_ANCHOR).alias("anchor"), "cls", *nothing).distinct()
    carried = against.union(free).join(kinds.select("cls", "n", "sig"), "cls")
    joined = dealt_blocks(rooted).join(anchors, "key", "left").withColumn("anchor", F.coalesce("anchor", F.lit(NO_ANCHOR))).join(carried, ["anchor", "cls"]).select(
        "key", "place", "cls", "n", "sig", "root", "part", "block", "low", "high", "inner", "lacking", "others", "bits", "anchor_size")
    return candidates(joined, None, rule, one_each).select("a", "b").distinct()


def repeated_rows(signed: DataFrame) -> DataFrame:
    """label and text_key of rows that stand in the table several times; few rows of two numbers are shuffled for it."""
    doc = F.coalesce("doc_id", F.lit(NULL_DOC)).alias("label")
    return cut_lineage(signed.filter("set_key IS NOT NULL").groupBy(doc, "text_key").agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows"))


def one_each_class(found: DataFrame, kinds: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row per class of what was made from `texts_of`, written; only classes named by a repeated row can have several."""
    found = cut_lineage(found)
    if repeated.isEmpty():
        return found
    several = cut_lineage(kinds.join(repeated, ["label", "text_key"], "left_semi").select("cls"))
    return cut_lineage(found.join(several, "cls", "left_anti").union(found.join(several, "cls", "left_semi").dropDuplicates(["cls"])))


def texts_of(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and a text of every given class, as often as its row stands in the table."""
    text = text_or_empty()
    wanted = cut_lineage(kinds.select("cls", F.col("label").alias("_doc"), F.col("text_key").alias("_key")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("_doc"), F.xxhash64(text).alias("_key"), text.alias("text"))
    return rows.join(counted_broadcast(wanted, NARROW_ROWS), ["_doc", "_key"]).select("cls", "text")


def full_sets(docs: DataFrame, kinds: DataFrame, live: DataFrame, repeated: DataFrame) -> DataFrame:
    """The whole shingle set of every class that shares a bucket: cls and shingles (sorted, 8 bytes each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [words.shingles(t).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    wanted = kinds.join(live.select("cls").distinct(), "cls", "left_semi")
    return one_each_class(texts_of(wanted, docs).mapInArrow(run, "cls long, shingles binary"), wanted, repeated)


def as_set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    return int((merged[1:] == merged[:-1]).sum())


def beside_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b (a written table) with both sets as x and y; sets without a pair are left where they are."""
    ends = cut_lineage(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    held = sets.join(counted_broadcast(ends, NARROW_ROWS), "cls", "left_semi")
    left = pairs.join(held.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
    return left.join(held.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")


def confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose full sets are linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = as_set(x), as_set(y)
                both = common(x, y)
                keep.append(rule.linked(both, len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return beside_sets(pairs, sets).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node with an edge.

    Large and small stars in turn: neighbours move to the smallest one near them, in a number of
    rounds that grows with the logarithm of the size. Every round is written; it ends when a round
    changes no edge.
    """
    def both_ways(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        pairs = both_ways(e)
        pairs = pairs if large else pairs.filter("v < u")
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(least, "u")
        moved = joined.filter("v > u") if large else joined
        out = moved.select(F.col("v").alias("x"), "m")
        out = out if large else out.union(least.select(F.col("u").alias("x"), "m"))
        return out.filter("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()

    mark = (F.count("*"), F.bit_xor(F.xxhash64("a", "b")))
    e = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    seen = e.agg(*mark).first()
    while seen[0]:
        e = cut_lineage(star(star(e, True), False))
        now = e.agg(*mark).first()
        if now == seen:
            break
        seen = now
    roots = e.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.union(e.select("a", "a").distinct().join(roots, F.col("a") == F.col("node"), "left_anti"))


def linked_documents(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every document; threshold in percent.

    Documents without words have an empty set and stay alone and kept. Rows with a null doc_id take
    part in links; a component of such rows only has a null component_id and they are kept. Repeated
    rows have equal sets: they share a component, and each whose doc_id is its component's is kept.
    An empty table gives none. Other columns are not read.
    """
    rule = Rule(threshold)
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        signed = signed_documents(docs)
        kinds = classes(signed)
        live = filed(kinds, rule)
        sets = full_sets(docs, kinds, live, repeated_rows(signed))
        links = cut_lineage(confirmed(cut_lineage(first_pairs(live, kinds, rule)), sets, rule))
        roots = cut_lineage(components(links))
        more = cut_lineage(confirmed(cut_lineage(open_pairs(live, kinds, roots, links, sets, rule)), sets, rule))
        if more.limit(1).count():
            roots = cut_lineage(components(links.union(more)))
    named = kinds.select("cls", "label").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "label", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("label").alias("component_id"))
    labels = named.join(least, "root").select(F.col("cls").alias("set_key"), F.when(F.col("component_id") < NULL_DOC, F.col("component_id")).alias("component_id"))
    joined = signed.join(labels, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def judged(docs: DataFrame) -> DataFrame:
    return linked_documents(docs, LINK).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, threshold: int = STAGE_LINK) -> DataFrame:
    """One document of each group, with the columns of docs: that with the smallest doc_id.

    Of repeated rows of it one is kept; documents without words all stay, repeated ones once.
    """
    keep = linked_documents(docs, threshold).filter("kept").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    inner = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_or_empty()).alias("_text"))
    kept = inner.join(keep, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_key"))).dropDuplicates(["_id", "_text"])
    return kept.select("doc.*")
