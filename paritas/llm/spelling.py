"""Spelling variants: words one edit apart, found in the sorted rotations of terminator-marked words.

A word w has the rotations w[j:] $ w[:j]. An edit at place i of a word is looked up in the rotation that
ends with the edited character: without that character it reads w[i+1:] $ w[:i]. Words that share this
prefix and go on by one character are replacements of each other at i; a word whose own rotation equals
the prefix is the one with the character deleted. Both together are a group of the sorted rotations. As
the prefix fixes all but one character, a group has at most one row per letter of the alphabet and one
more, however large the vocabulary is. Every row takes from its group the number of its neighbours and the most
frequent one; pairs are not made unless `near_pairs` is asked for them.

A character inside a run of equal ones gives the same deletion as the first of the run; only that one
counts as a deletion. Words are numbered in code-point order, so rows carry numbers and ties go to the
smaller number. Rotations of over ``LONG`` letters are named by two 61-bit rolling hashes of the parts
around the edited character, which keeps the rows of a word of L letters at O(L) bytes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import dense_numbers
from ..session import cut_lineage
from .common import arrow_batches, text_or_empty

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a letter, which plants variants.
CHANGED = 31
LONG = 64
#: Distinct words that a task counts before it sends them on, and texts that it gets at once.
COUNTED_WORDS, BATCH_ROWS = 200_000, 500
MODULUS, BASE = (1 << 61) - 1, 1_000_003


def counted_words(docs: DataFrame) -> DataFrame:
    """word and n of all words of the corpus that take part, counted per task before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, counts = re.compile(RUN), Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                lower = text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")  # bytes: A-Z only
                for word, n in Counter(pattern.findall(lower)).items():
                    if len(word) < LEAST_LETTERS:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % CHANGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < LEAST_LETTERS:
                            continue
                    counts[word] += n
                if len(counts) > COUNTED_WORDS:
                    yield given()
                    counts.clear()
        if counts:
            yield given()

    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "word string, n long")
        return cut_lineage(parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT))


def long_rotations(words: DataFrame) -> DataFrame:
    """The rows of words of over LONG letters; a key of up to LONG letters is the rotation itself."""
    def key(word: str, before: list[int], after: list[int], i: int, j: int) -> str:
        """The rotation word[j:] $ word[:i]."""
        if len(word) - j + i <= LONG:
            return word[j:] + "$" + word[:i]
        return f"#{i}:{before[i]:x}:{after[j]:x}"

    def rolled(codes: list[int]) -> list[int]:
        h = [0]
        for c in codes:
            h.append((h[-1] * BASE + c) % MODULUS)
        return h

    def rows(word: str) -> Iterator[tuple[str, bool, bool]]:
        codes = [ord(c) for c in word]
        before, after = rolled(codes), rolled(codes[::-1])[::-1]
        for i in range(len(word) + 1):
            yield key(word, before, after, i, i), True, True
        for i in range(len(word)):
            yield key(word, before, after, i, i + 1), False, i == 0 or word[i] != word[i - 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, word, n in zip(batch["id"], batch["word"], batch["n"]):
                found = list(rows(word))
                for at in range(0, len(found), 10_000):
                    part = pd.DataFrame(found[at:at + 10_000], columns=["key", "whole", "first"])
                    yield part.assign(id=number, n=n)[["key", "whole", "first", "id", "n"]]

    with arrow_batches(words.sparkSession, 64):
        return words.select("id", "word", "n").mapInPandas(run, ROTATION)


ROTATION = "key string, whole boolean, first boolean, id long, n long"


def rotations(words: DataFrame) -> DataFrame:
    """key, whole (the rotation itself, else without its last character), first (in a run of equal letters), id and n."""
    length, i = F.length("word"), F.col("i")

    def letter(at: Column) -> Column:
        return F.substring("word", at, F.lit(1))

    head = F.substring("word", F.lit(1), i)
    short = words.filter(length <= LONG).withColumn("i", F.explode(F.sequence(F.lit(0), length))).withColumn("head", head)
    whole = short.select(F.concat(F.substring("word", i + 1, length), F.lit("$"), "head").alias("key"), F.lit(True).alias("whole"),
                         F.lit(True).alias("first"), "id", "n")
    cut = short.filter(i < length).select(F.concat(F.substring("word", i + 2, length), F.lit("$"), "head").alias("key"), F.lit(False).alias("whole"),
                                          ((i == 0) | (letter(i + 1) != letter(i))).alias("first"), "id", "n")
    return whole.union(cut).union(long_rotations(words.filter(length > LONG)))


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and best (struct of n and the negative id) of every word with a near word."""
    group, me = W.partitionBy("key"), F.struct("n", (-F.col("id")).alias("minus"))
    ordered = group.orderBy(F.desc("whole"), F.desc("n"), "id")

    def best(of: Column) -> Column:
        return F.max(F.when(of, me)).over(group)

    cut = ~F.col("whole")
    scanned = rotations(words).select(
        "id", "whole", "first", "n",
        F.sum(F.when(cut, 1).otherwise(0)).over(group).alias("cuts"), F.sum(F.when(cut & F.col("first"), 1).otherwise(0)).over(group).alias("deletions"),
        best(F.col("whole")).alias("shorter"), best(cut).alias("top"), best(cut & F.col("first")).alias("longer"),
        F.lead(me).over(ordered).alias("next"))
    replaced = F.when(F.col("top.minus") == -F.col("id"), F.col("next")).otherwise(F.col("top"))  # the best but the word itself
    shorter = F.when(F.col("first"), F.col("shorter"))
    count = F.when(F.col("whole"), F.col("deletions")).otherwise(F.col("cuts") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    found = scanned.select("id", count.alias("near"), F.when(F.col("whole"), F.col("longer")).otherwise(F.greatest(replaced, shorter)).alias("best"))
    return found.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of near words, once each: word and near, word first in code-point order.

    words holds distinct strings in a column word; nulls are left out. For callers who want the pairs; a
    group gives at most as many as its bounded number of rows allows.
    """
    named = numbered(words.filter("word IS NOT NULL").select("word", F.lit(0).cast("long").alias("n")))
    rows = rotations(named).select("key", "whole", "first", "id")
    a, b = rows.alias("a"), rows.alias("b")
    replaced = ~F.col("a.whole") & ~F.col("b.whole") & (F.col("a.id") < F.col("b.id"))
    deleted = F.col("a.whole") & ~F.col("b.whole") & F.col("b.first")
    ids = a.join(b, (F.col("a.key") == F.col("b.key")) & (replaced | deleted)).select(
        F.least("a.id", "b.id").alias("low"), F.greatest("a.id", "b.id").alias("high"))
    low, high = named.select(F.col("id").alias("low"), "word"), named.select(F.col("id").alias("high"), F.col("word").alias("near"))
    return ids.join(low, "low").join(high, "high").select("word", "near")


def numbered(words: DataFrame) -> DataFrame:
    """word, n and id, numbered in code-point order, written."""
    return cut_lineage(dense_numbers(words.select("word", "n"), ["word"], "id"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root: the end of the chain of forms, by pointer doubling. A form is at least RATIO times as frequent, so chains are short."""
    held = cut_lineage(forms.select("id", F.col("form").alias("root")))
    while True:
        further = held.select(F.col("id").alias("root"), F.col("root").alias("onward"))
        held = cut_lineage(held.join(further, "root", "left").select("id", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        if not held.filter("moved").limit(1).count():
            return held.select("id", "root")
        held = held.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus that takes part.

    A null text has no runs; a null doc_id counts as an empty one where letters are deleted. Repeated
    rows count as often as they stand there. Ties in n go to the smaller word. Very long runs are words
    like others. An empty table gives none; other columns are not read.
    """
    words = numbered(counted_words(docs))
    near = cut_lineage(neighbours(words).join(words.select("id", "n"), "id"))
    forms = near.filter(F.col("best.n") >= RATIO * F.col("n")).select("id", (-F.col("best.minus")).alias("form"), F.col("best.n").alias("form_n"))
    ended = forms.join(roots(forms), "id")
    names = words.select(F.col("id").alias("of"), F.col("word").alias("name"))
    named = (
        ended.join(names, F.col("form") == F.col("of")).select("id", "root", F.col("name").alias("form"), "form_n")
        .join(names, F.col("root") == F.col("of")).select("id", F.col("name").alias("root"), "form", "form_n"))
    return words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
