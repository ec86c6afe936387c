"""Mixing, personal data and quality rules against plain Python."""

import collections
import hashlib
import random
import re

from paritas.llm import mixing, privacy, quality

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "kept"]


def luhn(digits):
    doubled = (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits)))
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def counts(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    seen, covered = collections.Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_measures_match_plain_counts(odd_docs):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(odd_docs).collect())
    assert got == collections.Counter((r.doc_id, *counts(r.text)) for r in odd_docs.collect())


def test_quality_keeps_columns_and_drops_odd_distributions(spark, odd_docs, no_docs):
    assert quality.passing(odd_docs).columns == COLUMNS and quality.judge(no_docs).count() == 0
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("the", "of", "and", "house", "garden", "window")) for _ in range(300))
             if i < 40 else " ".join("#" * rng.randrange(3, 9) + str(rng.random()) for _ in range(300)), "en") for i in range(42)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert not kept & {40, 41} and all(counts(rows[i][1])[-1] or i in kept for i in range(40))


def test_base_spans_match_plain_search(spark, odd_docs, no_docs):
    tricky = ["a@b.c@d.e", "a@b.c_d@e.f x@@y.zz", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "++44 20 7946 0958 4111-1111-1111-1111-+1 (555) 123-4567",
              "5" * 30_000, "a." * 20_000, "1" * 16 + " +1234567890", "x@y.co," * 3000]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in privacy.report(docs).collect():
        spans = base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(spans.count(f"{k}:") for k in PATTERNS)
        assert not spans or set(spans.split(",")) <= set(r.spans.split(","))
    assert privacy.report(no_docs).count() == 0


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    common = ["alpha", "beta", "gamma", "delta", "omega"]

    def filler(n):
        return " ".join(rng.choice(common) for _ in range(n))

    rows = [(i, f"{filler(30)} Zorblax writes from z@corp.example {filler(30)}") for i in range(6)] + [(10 + i, filler(80)) for i in range(40)]
    rows += [(90, "then Zorblax left"), (91, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_chars long")
    terms = {r.term: r.residual for r in privacy.disclosing_terms(docs).collect()}
    assert {"Zorblax", "writes", "from"} == set(terms) and 0 < terms["Zorblax"] < 1 and terms["from"] == 0
    clean = {r.doc_id: r for r in privacy.sanitised(docs).collect()}
    assert "Zorblax" not in clean[90].text and "[TERM]" in clean[90].text and clean[90].n_chars == len(clean[90].text)
    assert "[EMAIL]" in clean[0].text and clean[10].text == dict(rows)[10] and clean[91].text is None
    spans = {r.doc_id: r.spans for r in privacy.report(docs).collect()}
    assert spans[90] == "term:5:12" and spans[10] == ""


def test_terms_seen_once_and_far_from_the_entity_are_judged(spark):
    common = "alpha beta gamma delta omega " * 4
    rows = [(i, f"{common}and more.") for i in range(30)]
    rows += [(40, f"Quillfeather {common}{common}is at q@corp.example {common}today. Unrelated follows."),  # once, 40 words away
             (41, f"{common}Brambleton a@x.example. Then more."), (42, f"{common}Brambleton a@x.example, +1 (555) 123-4567. Thus Again."),
             (43, f"{common}Vantor b@x.example."), (44, f"{common}Vantor."), (45, f"{common}Vantor again.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.term: r.residual for r in privacy.disclosing_terms(docs).collect()}
    assert found.pop("Quillfeather") == 1 and abs(found.pop("Brambleton") - 0.585) < 1e-3 and found == {"today": 1}  # Vantor: one of three
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert clean[40].startswith("[TERM] alpha") and "[EMAIL]" in clean[40] and clean[41].endswith("[TERM] [EMAIL]. Then more.") and clean[45] == dict(rows)[45]
    spans = {r.doc_id: r.spans for r in privacy.report(docs).collect()}
    assert spans[42].count("term:") == 1 and "phone:" in spans[42]


def expected_targets(sizes, weights=(5, 2, 1), repeats=3):
    total, capped = sum(sizes), set()
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while True:
        rest = total - sum(repeats * sizes[i] for i in capped)
        free = sum(w for i, w in enumerate(weight) if i not in capped)
        target = [repeats * s if i in capped else rest * weight[i] / free for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and target[i] > repeats * sizes[i]}
        if not over:
            return target
        capped |= over


def test_mix_meets_its_targets(odd_docs, no_docs):
    rows = mixing.taken_words(odd_docs, block_words=64).collect()
    assert len(rows) == odd_docs.count() and mixing.taken_words(no_docs).count() == 0
    source = {(r.doc_id, r.text): r.source for r in odd_docs.collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    size = collections.Counter()
    for r in odd_docs.collect():
        size[r.source] += len((r.text or "").encode().split())
    want = dict(zip(names, expected_targets([size[n] for n in names])))
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size, r.target] += r.taken
    for (_, t), n in taken.items():
        assert abs(n - t) <= 1
    assert sorted(round(v, 6) for v in want.values() if v) == sorted(round(t, 6) for (_, t) in taken if t)
    again = mixing.taken_words(odd_docs, block_words=64).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, again))


def test_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    sized = mixing.sized_documents(docs)
    targets = mixing.source_targets(sized)
    slots = sorted((r.slot, r.sno) for r in mixing.slot_schedule(targets, 50).collect())
    share = {r.sno: r.target / 30_000 for r in targets.collect()}
    seen = collections.Counter()
    for k, (_, sno) in enumerate(slots, 1):
        seen[sno] += 1
        assert all(abs(seen[s] - k * share[s]) < 4 for s in share)


def test_mixed_documents_have_the_columns_and_the_words(odd_docs):
    mixed = mixing.mixed_documents(odd_docs, block_words=64)
    assert mixed.columns == COLUMNS
    words = sum(len((r.text or "").encode().split()) for r in mixed.collect())
    assert abs(words - sum(r.taken for r in mixing.taken_words(odd_docs, block_words=64).collect())) == 0
