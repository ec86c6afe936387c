"""Quality rules: repetition counts, and the divergence of a text from its language's references.

A document's histogram of character classes and its histogram of common words are compared with the
mean histograms of its language by Jensen-Shannon distance. Short texts say little about a
distribution, so each comparison has a minimum length below which it passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE_CHARS, counted_broadcast, let, text_or_empty, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Very common words of the languages the references know: bins of the word histogram, whose last
#: bin holds all other words.
COMMON_WORDS = tuple(dict.fromkeys((
    "the of and to a in is that "
    "der die und das von zu mit ein "
    "le la les et de des un une "
    "el los y que en por para con"
).split()))
LONGEST_COMMON = 4
#: Character classes in words, counted one after the other; the rest is a class of its own.
CLASSES = (r"\p{Ll}+", rf"[{SYMBOLS}]+", r"\p{Lu}+", r"\p{N}+", r"[.,;:'\"()?!-]+", r"[=_/\\+@~^{}\[\]]+")
SYMBOL_CLASS = 1
#: A comparison needs this many characters in words, or words, to count.
LEAST_CHARS, LEAST_WORDS = 200, 60
#: Largest distances (base 2, from 0 to 1) that pass.
CLASS_DISTANCE, WORD_DISTANCE = 0.30, 0.55


def repeated_words(all_words: Column) -> Column:
    """How many words lie in a window of five that the list holds twice or more.

    Windows are compared by 64-bit hashes. Only a list with a repeated window sorts them.
    """
    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        doubled = let(placed, lambda s: F.filter(s, lambda x, k: (
            (k > 0) & (x["h"] == s[F.greatest(k - 1, F.lit(0))]["h"])) | (
            (k < F.size(s) - 1) & (x["h"] == s[F.least(k + 1, F.size(s) - 1)]["h"]))))
        starts = F.array_sort(F.transform(doubled, lambda x: x["i"]))
        summed = F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct(
            (i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")))
        return summed["n"]

    def windows(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(F.slice(w, i + 1, F.lit(WINDOW))))

    return let(all_words, lambda w: let(windows(w), lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measures(docs: DataFrame) -> DataFrame:
    """Per document: the counts of the rules and both histograms. Null texts count as empty."""
    letters = "-" + "".join(chr(ord("0") + k) for k in range(len(COMMON_WORDS)))
    bins = F.array(*map(F.lit, COMMON_WORDS))
    coded = F.array_join(F.transform("_words", lambda w: F.when(
        F.octet_length(w) <= LONGEST_COMMON, F.substring(F.lit(letters), F.array_position(bins, w).cast("int") + 1, F.lit(1))).otherwise("")), "")
    named = let(F.replace(coded, F.lit("-"), F.lit("")), lambda x: F.array(
        *[F.octet_length(x) - F.octet_length(F.replace(x, F.lit(c), F.lit(""))) for c in letters[1:]]))
    left = docs.withColumn("_text", text_or_empty()).withColumn("_words", words(F.col("_text"))).withColumn("_left0", F.array_join("_words", ""))
    for k, pattern in enumerate(CLASSES):  # each pass reads what the one before has left, soon very little
        left = left.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", pattern, ""))
    lengths = [F.length(f"_left{k}") for k in range(len(CLASSES) + 1)]
    return left.select(
        *docs.columns, lengths[0].alias("word_chars"), F.size("_words").alias("n_words"),
        (lengths[SYMBOL_CLASS] - lengths[SYMBOL_CLASS + 1]).alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.array(*[a - b for a, b in zip(lengths, lengths[1:])], lengths[-1]).alias("class_bins"),
        let(named, lambda c: F.concat(c, F.array(F.size("_words") - total(c)))).alias("word_bins"),
    )


def total(bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0), lambda a, x: a + x)


def shares(bins: Column) -> Column:
    return let(total(bins), lambda t: F.transform(bins, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def references(measured: DataFrame) -> DataFrame:
    """Mean histograms per language over all documents long enough to count; one row per lang."""
    def mean(bins: str, width: int, least: Column) -> list[Column]:
        return [F.avg(F.when(least, shares(F.col(bins))[k])) for k in range(width)]

    n_class, n_word = len(CLASSES) + 1, len(COMMON_WORDS) + 1
    return measured.groupBy("lang").agg(
        F.array(*mean("class_bins", n_class, F.col("word_chars") >= LEAST_CHARS)).alias("class_ref"),
        F.array(*mean("word_bins", n_word, F.col("n_words") >= LEAST_WORDS)).alias("word_ref"))


def divergence(bins: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (square root, base 2) of a histogram from a reference."""
    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(shares(bins), reference, lambda p, q: let((p + q) / 2, lambda m: (term(p, m) + term(q, m)) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def verdicts(docs: DataFrame) -> DataFrame:
    """Every row of docs (all columns, under ``doc``) with its counts, distances and the verdict.

    base_failed: fewer than 10 words, or over 20 % of them in repeated windows. kept: not so failed,
    and neither distance above its limit. Null and blank texts fail; a null lang has its own
    reference; repeated rows are judged alike; an empty table gives none; further columns are kept
    as they are, whatever their names. The counts pass through one written table, so each text is
    read once; the references are one row per language.
    """
    inner = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"), F.col("lang"))
    measured = cut_lineage(measures(inner).drop("text"))
    refs = references(measured)
    named = measured.join(counted_broadcast(refs.withColumnRenamed("lang", "_lang")), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    far_class = F.coalesce((F.col("word_chars") >= LEAST_CHARS) & (divergence(F.col("class_bins"), F.col("class_ref")) > CLASS_DISTANCE), F.lit(False))
    far_words = F.coalesce((F.col("n_words") >= LEAST_WORDS) & (divergence(F.col("word_bins"), F.col("word_ref")) > WORD_DISTANCE), F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return named.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far_class & ~far_words)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return verdicts(docs.select("doc_id", "text", "lang")).select(
        F.col("doc.doc_id").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in counts], "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    return verdicts(docs).filter("kept").select("doc.*")
