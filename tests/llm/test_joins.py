"""Spelling variants, whitening and the n-gram join against brute force."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest

from odd_rows import edited, prose
from paritas.llm import jaccard, spelling, whitening
from test_free import shingles


def near(a, b):
    """Exactly one character inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    around = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and near(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return collections.Counter((w, form.get(w), root(w), n, len(around[w]), words.get(form.get(w))) for w, n in words.items())


def variants(docs):
    return collections.Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect())


def test_variants_match_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(5)
    base = ["necessary", "Gemütlichkeit", "ÀÉîôûœaaaabbb", "committee", "x" * 90, "abc" * 40, "ababababab"]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i in range(400):
        words = []
        for w in base:
            words += [w] * rng.choice([0, 1, 3])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                words.append(rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aeéz") + w[at + 1:], w[:at] + rng.choice("aeé") + w[at:]]))
        rows.append((rng.choice([None, i, -i]), rng.choice([" ", "-", "1"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = variants(docs), brute_variants(rows)
    assert got == want
    assert any(w[1] for w in want) and any(len(w[0]) > 64 and w[4] for w in want)
    assert spelling.variants(no_docs).count() == 0


def test_chains_of_forms_and_ties(spark):
    words = ["aaaaaaab"] * 2 + ["aaaaaaac"] * 20 + ["aaaaaaad"] * 200 + ["kkkkkkkk"] * 2 + ["kkkkkkka"] * 30 + ["akkkkkkk"] * 30
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    assert variants(docs) == brute_variants([(i, w) for i, w in enumerate(words)])


def test_near_pairs(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(120)} | {"a" * 70, "a" * 71, "a" * 69 + "b"})
    got = [(r.word, r.near) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in [*words, None]], "word string")).collect()]
    want = [(v, w) for v in words for w in words if v < w and near(v, w)]
    assert collections.Counter(got) == collections.Counter(want)


def eigen(x):
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(len(values))])
    return values, centred @ axes / np.sqrt(np.where(values > 0, values, 1.0))


def whiten(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, n string")
    return sorted(whitening.whitened(table, **more).collect(), key=lambda r: (r.vec_id, r.component))


def test_whitening_matches_an_eigen_solver(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    odd = [(900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 12)]
    got = whiten(spark, [(i, [float(c) for c in row], 7, "x") for i, row in enumerate(v)] + [(i, row, None, None) for i, row in odd])
    x = np.floor(1024 * v.astype(float)) + 100_000
    values, want = eigen(x)
    assert np.abs(np.array([r.whitened for r in got]).reshape(300, 8) - want[:, :8]).max() < 1e-9
    assert np.allclose([r.explained for r in got[:8]], values[:8] / values.sum(), rtol=1e-12)
    whole = [[int(c) for c in row] for row in x]
    sums = [sum(c) for c in zip(*whole)]
    assert [r.deviation for r in got[::8]] == [sum((300 * c - s) ** 2 for c, s in zip(row, sums)) for row in whole]
    assert {r.n for r in got} == {300} and max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("full", [whitening.FULL_STEPS, 0])
def test_whitening_of_few_directions(spark, monkeypatch, full):
    """Fewer directions than dimensions, equal eigenvalues when all steps are taken, early ends otherwise."""
    monkeypatch.setattr(whitening, "FULL_STEPS", full)
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((200, 3)) * [30, 7, 2]) @ np.linalg.qr(rng.standard_normal((10, 10)))[0][:3]
    got = whiten(spark, [(i, [float(c) for c in row], 1, "x") for i, row in enumerate(v)])
    x = np.floor(1024 * v.astype(np.float32).astype(float)) + 100_000
    values, want = eigen(x)
    there = int((values[:8] > 1e-12 * values[0]).sum())
    assert len(got) == 200 * there
    assert np.abs(np.array([r.whitened for r in got]).reshape(200, there)[:, :3] - want[:, :3]).max() < 1e-9
    if full:
        square = [(i, [float(c) for c in row], 1, "x") for i, row in enumerate(np.r_[np.eye(4), -np.eye(4)])]
        same = whiten(spark, square)
        assert len(same) == 32 and same[0].identity_error < 1e-12 and np.allclose([r.explained for r in same], 0.25)


def test_whitening_of_nothing(spark):
    assert whiten(spark, []) == [] and whiten(spark, [(1, [1.0, 2.0], 1, "x")]) == [] and whiten(spark, [(i, [1.0, 2.0], 1, "x") for i in range(5)]) == []
    assert whitening.exact_deviations(np.array([[3, 1 << 40]]), 1 << 20, np.array([0, 0])) == [None]


def brute_join(docs, threshold):
    """Components over all pairs that share a shingle."""
    sets, parent, holders = [shingles(t) for _, t in docs], list(range(len(docs))), collections.defaultdict(list)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        both = collections.Counter(j for x in s for j in holders[x])
        for j, n in both.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return collections.Counter((d, len(s), min(least[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def joined(docs, threshold=jaccard.LINK):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_documents(docs, threshold).collect())


def test_join_matches_all_pairs(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)  # several blocks per tile
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for g in range(4):
        text = prose(50 + g, 160)
        rows += [(1000 * (g + 1) + k, edited(text, k, 0.002 * (k % 9))) for k in range(50)]  # groups around the threshold
    passage = prose(77, 60)
    rows += [(20_000 + k, passage + " " + prose(9_000 + k, 10 + k % 30)) for k in range(120)]  # a passage of many documents
    chain = prose(99, 200)
    for k in range(12):
        rows.append((9_000 - k, chain))
        chain = edited(chain, 500 + k, 0.012)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs) == brute_join(rows, 80)
    assert joined(no_docs) == collections.Counter()


def test_join_of_large_tiles_gives_out_fewer_links_than_rows(spark, monkeypatch):
    """A group of near copies around the threshold, in blocks: links that join components, not all pairs."""
    monkeypatch.setattr(jaccard, "PAIRED_ROWS", 3)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    given, block_links = [], jaccard.block_links

    def counted(large, *args):
        links = jaccard.cut_lineage(block_links(large, *args))
        given.append((links.count(), large.count()))
        return links

    monkeypatch.setattr(jaccard, "block_links", counted)
    text = prose(31, 160)
    rows = [(k, edited(text, k, 0.002 * (k % 12))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs) == brute_join(rows, 80)
    assert len(given) == 1 and 0 < given[0][0] < given[0][1]


def test_joining_links_of_a_block():
    rng = np.random.default_rng(8)
    base, rule = np.sort(rng.integers(0, 1 << 63, 100, dtype=np.uint64)), jaccard.Rule(80)
    sets = [np.sort(np.concatenate([np.delete(base, k), rng.integers(0, 1 << 63, 1, dtype=np.uint64)])) for k in range(40)]
    sets.append(np.sort(np.concatenate([base[:60], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])))  # linked with none
    block = pd.DataFrame({"cls": range(41), "n": [len(s) for s in sets], "guest": False, "root": range(41), "block": 0, "low": 0, "high": 0, "inner": False,
                          "shingles": [s.tobytes() for s in sets], "bits": [jaccard.bitmap(s) for s in sets]})
    links = jaccard.joining_links(block, rule)
    assert len(links) == 39 and links.max() < 40 and (links[:, 0] < links[:, 1]).all()
    assert jaccard.open_rows(block, rule).tolist() == [True] * 40 + [False]
    assert not len(jaccard.joining_links(block.assign(guest=True), rule)) and not len(jaccard.joining_links(block.assign(root=1), rule))


def test_sets_that_meet_by_chance_give_out_no_pair(spark):
    """Two sets share a few shingles of their prefixes, two others all but one; a set with few shingles needs only one."""
    sets = [(1, 100, list(range(21))), (2, 100, [*range(100, 116), *range(5)]), (3, 100, [*range(1, 21), 300]), (4, 9, [100, 400]), (5, 9, [100, 401])]
    kinds = spark.createDataFrame(sets, "cls long, n long, prefix array<long>")
    pairs = jaccard.counted_pairs(jaccard.tiles(kinds, 80), 80).collect()
    assert sorted(map(tuple, pairs)) == [(1, 3, 20), (4, 5, 1)]


def test_bitmaps_bound_overlaps_from_above():
    rng = np.random.default_rng(2)
    for n, m, both in ((50, 60, 30), (100, 160, 90), (5, 7, 5), (1, 1, 0)):
        s = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        a, b = np.sort(s[:n]), np.sort(s[n - both:])
        bits = jaccard.folded([jaccard.bitmap(a), jaccard.bitmap(b)])
        most = (len(a) + len(b) - int(np.bitwise_count(bits[0] ^ bits[1]).sum())) // 2
        assert both <= most <= both + max(3, (n + m) // 10)
    assert [jaccard.prefix_length(n, 80) for n in (1, 4, 5, 10, 100)] == [1, 1, 2, 3, 21]


def test_the_join_leaves_no_shuffle_files_of_its_steps(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3) * 40 + k}" for k in range(30 + i % 3))) for i in range(60)], "doc_id long, text string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(key)
    rows = jaccard.linked_documents(docs)
    left = held() - before
    for _ in range(50):  # they are dropped in the background
        if not left:
            break
        time.sleep(0.2)
        left = held() - before
    assert not left
    assert spark.conf.get(key) == setting
    assert rows.where("component_id <> doc_id - doc_id % 3").count() == 0
