"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned by quantiles of a bounded training sample; each tree grows
level by level on histograms of gradients. Trees are kept as flat arrays, one row per tree, and a
batch of documents walks all trees at once, a level at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import counted_broadcast, text_or_empty
from .quality import COMMON_WORDS, SYMBOLS

#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.15, 2.0, 10
THRESHOLD = 0.3
FOLDS = 5

UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
STOPS, MARKS = b".,;:", b"!?"
HIGH = bytes(range(128, 256))
COMMON = frozenset(w.encode() for w in COMMON_WORDS)
STATISTICS = (
    "log_words", "word_length", "longest_word", "distinct_words", "distinct_pairs", "distinct_fives", "top_word", "common_words",
    "stuttering", "upper", "lower", "digits", "stops", "marks", "symbols", "high_bytes", "log_lines", "words_per_line",
    "repeated_lines", "lone_symbols", "capitalised", "shouted", "links", "at_signs",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; an empty text has none but zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)

    def part(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / len(raw)

    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    fives = set(zip(words, words[1:], words[2:], words[3:], words[4:]))
    upper = sum(w[:1].isupper() for w in counts.elements()) if n < 50 else sum(c for w, c in counts.items() if w[:1].isupper())
    return [
        np.log1p(n), sum(map(len, words)) / n, float(max(map(len, counts))), len(counts) / n, len(pairs) / max(1, n - 1),
        len(fives) / max(1, n - 4), counts.most_common(1)[0][1] / n, sum(counts[w] for w in COMMON) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, part(UPPER), part(LOWER), part(DIGITS), part(STOPS), part(MARKS),
        part(SYMBOLS.encode()), part(HIGH), np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n, upper / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, len(re.findall(rb"https?://", raw)) / n, raw.count(b"@") / n,
    ]


@dataclass
class Trees:
    """Flat trees: feature and threshold per inner node (children of k: 2k + 1, 2k + 2), value per leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for at in range(0, len(x), 4096):
            part = x[at:at + 4096]
            node = np.zeros((len(part), len(trees)), np.int32)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                right = part[rows, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            total[at:at + 4096] += self.value[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts logistic loss. Without rows, or with one label only, the trees are empty."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = Trees(0.0, np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return none
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Trees(base, none.feature, none.threshold, none.value)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin k: edge k - 1 < x <= edge k
    width, features = BINS + 1, x.shape[1]
    feature, threshold = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf)
    value, margin = np.zeros((TREES, leaves)), np.full(len(y), base)
    cells = binned + np.arange(features) * width
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            flat = ((node - first)[:, None] * (features * width) + cells).ravel()

            def histogram(w: np.ndarray) -> np.ndarray:
                return np.bincount(flat, np.repeat(w, features), many * features * width).reshape(many, features, width).cumsum(2)

            g, h, n = histogram(gradient), histogram(weight), histogram(np.ones(len(y)))
            gt, ht, nt = g[:, :1, -1:], h[:, :1, -1:], n[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (gt - g)**2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(n < LEAST_ROWS) | (nt - n < LEAST_ROWS)] = -np.inf
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, cut = divmod(int(best[k]), width)
                if gain[k, f, cut] > 1e-9 and cut < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
            right = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        value[t] = -RATE * g / (h + RIDGE)
        margin += value[t][leaf]
    return Trees(base, feature, threshold, value)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded sample: at most ``sample`` labelled rows outside fold 0.

    The sample is the rows with the smallest hash of doc_id; rows without a label or doc_id are
    left out. At most ``sample`` rows of numbers come to the driver.
    """
    chosen = cut_lineage(
        labels.select(F.col("doc_id").alias("_doc"), F.col("quality").cast("int").alias("label"))
        .filter(F.col("_doc").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("_doc")) != 0))
        .orderBy(F.xxhash64("_doc"), "_doc", "label").limit(sample))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(counted_broadcast(chosen), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [statistics(t) for t in batch["text"]], "label": batch["label"]})

    rows = texts.mapInPandas(run, "doc_id long, x array<double>, label int").limit(sample).toPandas().sort_values(["doc_id", "label"])
    return np.array(rows["x"].tolist(), float).reshape(len(rows), len(STATISTICS)), rows["label"].to_numpy(float)


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every document. Null texts count as empty; an empty table gives none."""
    model = (trees.base, trees.feature, trees.threshold, trees.value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = Trees(*model)
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]], float).reshape(len(batch), len(STATISTICS))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": walk.scores(x)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model fitted on the other folds.

    Only texts enter a score. A null doc_id counts as the empty string for its fold; repeated rows
    score alike; without usable labels every score is one half.
    """
    trees = fit(*training_rows(docs, labels))
    out = scored(docs, trees)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
