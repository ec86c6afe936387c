"""Personal data, and words that give it away.

Patterns find emails, IP addresses, card and phone numbers. Then, over the whole corpus, sentences are
counted: c(t, e) of them hold term t and entity e, n(t) hold the term, N are all. Pointwise mutual
information PMI(t; e) = log2(c(t,e) N / (n(t) c(e))) is compared with the entity's information IC(e) =
log2(N / c(e)): what is left to guess after seeing t is IC - PMI = -log2(c(t,e) / n(t)) bits. Every
pair is judged, also one seen once; for rare terms the estimate is smoothed by one more sentence with
the term and without the entity. A term that leaves at most one bit about some entity is generalised
wherever it stands, one that leaves next to nothing is removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import counted_broadcast, let, text_or_empty

LOCAL = "A-Za-z0-9._%+-"
#: Kinds in the order that breaks ties. Each pattern is a run that starts where no run is cut in
#: two, unless the last match ended there; possessive, so that no text makes it backtrack.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Terms are runs of letters and digits of at least this length, as they are written.
TERM_GAP, TERM_CHARS = r"[^\p{L}\p{N}]+", 3
#: Between sentences: line ends, and spaces after a stop unless a number may go on there, so that no
#: entity is cut in two.
SENTENCE_GAP = r"[\r\n]++|(?<=[.!?。！？])\x20++(?![0-9().-])"
#: Terms in at most so many sentences are rare: their estimate is smoothed.
RARE = 5
#: Bits left about the entity: generalised up to the first, removed up to the second.
GENERALISE_BITS, REMOVE_BITS = 1.0, 0.15


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    padded = F.lpad(digits, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")

    def digit(of: Column, i: Column) -> Column:
        return F.substring(of, i, F.lit(1)).cast("int")

    total = F.aggregate(F.sequence(F.lit(1), F.lit(19), F.lit(2)), F.lit(0), lambda a, i: a + digit(doubled, i) + digit(padded, i + 1))
    return total % 10 == 0


def genuine(kind: str, match: Column) -> Column:
    """Whether a match of a kind's pattern is one: octets up to 255, digit counts, Luhn."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]+", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def clue(text: Column, kind: str) -> Column:
    """Whether a text may hold a match of a kind, by a cheap test."""
    like = {"email": "%@%.%", "ip": "%.%.%.%"}.get(kind)
    return text.like(like) if like else text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}" if kind == "card" else r"\+[0-9]")


def matches(text: Column, kind: str) -> Column:
    """The genuine matches of a kind: structs of start, kind number, stop and value.

    The text splits into gaps around the matches, so positions are running lengths in code points.
    """
    number, pattern = KINDS.index(kind), PATTERNS[kind]
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(gaps: Column, acc: Column, pair: Column) -> Column:
        match, i = pair["m"], pair["i"]
        start = acc["at"] + F.length(gaps[i])
        stop = start + F.length(match)
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop"), match.alias("value")))
        return F.struct(stop.alias("at"), F.when(genuine(kind, match), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    numbered = F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    walked = let(gaps, lambda g: F.aggregate(numbered, start, lambda acc, pair: step(g, acc, pair))["out"])
    return F.when(clue(text, kind), walked).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """All genuine matches of a text by start, then kind as listed."""
    return F.array_sort(F.concat(*[matches(text, kind) for kind in PATTERNS]))


def span_string(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def terms(text: Column) -> Column:
    return F.filter(F.split(text, TERM_GAP), lambda w: F.length(w) >= TERM_CHARS)


def uncovered(text: Column, spans: Column) -> Column:
    """The text without the spans, which are sorted by start and may overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, span["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], span["stop"]).alias("at"), F.concat(acc["out"], gap, F.lit(" ")).alias("out"))

    walked = let(F.aggregate(spans, start, step), lambda g: F.concat(g["out"], F.substring(text, g["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, walked).otherwise(text)


def clued(text: Column) -> Column:
    return reduce(lambda x, y: x | y, [clue(text, kind) for kind in PATTERNS])


def sentences(docs: DataFrame, only_clued: bool = False) -> DataFrame:
    """entities (distinct structs of kind and entity) and terms (distinct, outside of entities) of every sentence.

    If asked, only of sentences that a cheap test can't rule out. The outer explode keeps Spark from
    inferring a filter that would compute its input twice.
    """
    rows = docs.select(F.explode_outer(F.split(text_or_empty(), SENTENCE_GAP)).alias("sentence"))
    sentence = F.col("sentence")
    rows = rows.filter(clued(sentence)) if only_clued else rows

    def taken_apart(spans: Column) -> Column:
        entities = F.array_distinct(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("entity"))))
        return F.struct(entities.alias("entities"), uncovered(sentence, spans).alias("rest"))

    none = F.struct(F.array().cast("array<struct<kind:int,entity:string>>").alias("entities"), sentence.alias("rest"))
    parts = F.when(clued(sentence), let(base_spans(sentence), taken_apart)).otherwise(none)
    return rows.select(parts.alias("_parts")).select("_parts.entities", F.array_distinct(terms(F.col("_parts.rest"))).alias("terms"))


def residual_bits(together: Column, spoken: Column) -> Column:
    """Bits that a term in ``spoken`` sentences leaves about an entity that stands in ``together`` of them."""
    return -F.log2(together / (spoken + F.when(spoken <= RARE, 1).otherwise(0)))


def disclosing_terms(docs: DataFrame, bits: float = GENERALISE_BITS) -> DataFrame:
    """term and residual: terms that leave at most ``bits`` about some entity, over all documents.

    One pass finds the sentences with entities and their terms; a second counts the sentences of
    those terms over the whole corpus. Terms that would leave more even if all entities beside them
    were one are settled by that; for the others (entity, term) pairs are counted, map-side first.
    Candidates filter as a broadcast if a count allows it, else in a shuffled join.
    """
    held = cut_lineage(sentences(docs.filter(clued(text_or_empty())), only_clued=True)).filter(F.size("entities") > 0)
    near = cut_lineage(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("near")))
    spoken = sentences(docs).select(F.explode_outer("terms").alias("term")).join(counted_broadcast(near.select("term")), "term", "left_semi")
    counts = spoken.groupBy("term").agg(F.count("*").alias("spoken"))
    likely = cut_lineage(near.join(counts, "term").filter(residual_bits(F.col("near"), F.col("spoken")) <= bits).select("term", "spoken"))
    beside = held.select("entities", F.explode("terms").alias("term")).join(counted_broadcast(likely), "term")
    pairs = beside.select("term", "spoken", F.explode("entities").alias("e")).groupBy("term", "spoken", "e").agg(F.count("*").alias("together"))
    best = pairs.groupBy("term", "spoken").agg(F.max("together").alias("together"))
    return best.select("term", residual_bits(F.col("together"), F.col("spoken")).alias("residual")).filter(F.col("residual") <= bits)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: equal texts have equal disclosing terms."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2")]


def term_lists(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """_k1, _k2 and the flagged terms of every text that holds one."""
    text = text_or_empty()
    found = docs.select(*text_key(text), F.explode(F.array_distinct(terms(text))).alias("term")).join(counted_broadcast(flagged), "term")
    return found.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("term", "residual")).alias("_flagged"))


def term_spans(text: Column, flagged: Column, base: Column) -> Column:
    """Where the flagged terms stand as whole terms outside the base spans."""
    names = F.array_sort(F.transform(flagged, lambda x: x["term"]))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(gaps: Column, acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(gaps[pair["i"]])
        stop = at + F.length(pair["m"])
        one = F.array(F.struct(at.alias("start"), F.lit(KINDS.index("term")).alias("kind"), stop.alias("stop"),
                               pair["m"].alias("value")))
        clear = ~F.exists(base, lambda b: (b["start"] < stop) & (at < b["stop"]))
        return F.struct(stop.alias("at"), F.when(clear, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = let(pattern, lambda p: F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m, i: F.struct(m.alias("m"), i.alias("i"))))
    return F.when(F.size(flagged) > 0, let(F.call_function("split", text, pattern), lambda g: F.aggregate(
        found, start, lambda acc, pair: step(g, acc, pair))["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def inspected(docs: DataFrame) -> DataFrame:
    """Every row of docs (all columns, under ``doc``) with base, extra and residuals.

    base are the spans of the patterns, extra those of disclosing terms; residuals maps each term
    found to the bits it leaves. Null and empty texts have none; repeated rows are treated alike;
    an empty table gives none; columns of any name pass through. Only texts with a disclosing term
    take part in the join that brings the terms: by broadcast if a count allows it.
    """
    flagged = cut_lineage(disclosing_terms(docs))
    lists = cut_lineage(term_lists(docs, flagged))
    text = text_or_empty()
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), text.alias("_text"), *text_key(text))
    joined = keyed.join(counted_broadcast(lists), ["_k1", "_k2"], "left")
    spans = joined.withColumn("base", base_spans(F.col("_text")))
    return spans.withColumn("extra", F.when(F.col("_flagged").isNull(), F.slice("base", 1, 0)).otherwise(
        term_spans(F.col("_text"), F.col("_flagged"), F.col("base")))).drop("_k1", "_k2")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts per kind, base_sha256, spans, and n_term of every document."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return inspected(docs.select("doc_id", "text")).select(
        F.col("doc.doc_id").alias("doc_id"), *map(number, PATTERNS), F.sha2(span_string(F.col("base")), 256).alias("base_sha256"),
        span_string(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by its kind in brackets, and disclosing terms by [TERM] or nothing.

    Where spans of several kinds overlap, the one that starts first (then the kind listed first) is
    replaced as a whole with what overlaps it. n_chars, where there is one, follows the text; null
    texts stay null.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.concat("base", "extra"))

    def mark(span: Column, flagged: Column) -> Column:
        gone = F.exists(flagged, lambda x: (x["term"] == span["value"]) & (x["residual"] <= REMOVE_BITS))
        return F.when((span["kind"] == KINDS.index("term")) & gone, F.lit("")).otherwise(names[span["kind"]])

    none = F.array().cast("array<struct<term:string,residual:double>>")
    item = F.array().cast("array<struct<start:int,stop:int,mark:string>>")
    merged = F.aggregate("_spans", item, lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["stop"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"),
            F.element_at(acc, -1)["mark"].alias("mark"))))).otherwise(
        F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"),
                                       mark(s, F.coalesce("_flagged", none)).alias("mark"))))))
    pieces = let(merged, lambda m: F.concat(
        F.transform(m, lambda s, i: F.concat(
            let(F.when(i == 0, F.lit(0)).otherwise(m[F.greatest(i - 1, F.lit(0))]["stop"]), lambda at: F.substring(F.col("_text"), at + 1, s["start"] - at)),
            s["mark"])),
        F.array(F.substring(F.col("_text"), F.element_at(m, -1)["stop"] + 1, F.length("_text")))))
    cleaned = F.when(F.size("_spans") == 0, F.col("doc.text")).otherwise(F.array_join(pieces, ""))
    found = inspected(docs).withColumn("_spans", spans).withColumn("_clean", cleaned)
    columns = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("long")}
    return found.select(*[columns.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
