"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for vectorised traversal."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.shared import in_one_task, ready, save, small
from quern.llm.textkit import U, mix

# Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 sentence marks, 6 other ASCII marks, 7 beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 13]], _CLASS[10], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
STATS = ["bytes", "words", *[f"class_{k}" for k in range(8)], "word_bytes", "word_spread", "short_words", "long_words", "longest", "marked_ends", "bare_marks", "upper_words", "capitals", "distinct_words", "top_word", "distinct_pairs", "lines", "line_bytes", "distinct_lines"]


@dataclass(frozen=True)
class Boosting:
    """sample: most labelled documents that the fit takes, those whose hash is least (the bound of the sample)."""

    sample: int = 20_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    least: int = 10
    threshold: float = 0.3


def _sum(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATS for each whole text; all 0 for a null or empty one."""
    data, offsets = textkit.text_bytes(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATS)))
    if not len(data):
        return out
    classes = _CLASS[data]
    edges = np.arange(n)
    byte_row = np.repeat(edges, size)
    count = np.bincount(byte_row * 8 + classes, minlength=n * 8).reshape(n, 8)
    starts, ends, rows = textkit.runs(~textkit.SPACE[data], offsets)
    width = (ends - starts).astype(float)
    words = np.bincount(rows, minlength=n)
    per = np.maximum(words, 1)
    hashes = textkit.span_hash(textkit.prefix(textkit.lower(data)), starts, ends)
    first, last = classes[starts], classes[ends - 1]
    upper = np.concatenate([[0], np.cumsum(classes == 1)])
    letters = np.concatenate([[0], np.cumsum((classes <= 1) | (classes == 7))])
    ups, alphas = upper[ends] - upper[starts], letters[ends] - letters[starts]
    mean = _sum(width, rows, n) / per
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2:10] = count / np.maximum(size, 1)[:, None]
    out[:, 10] = mean
    out[:, 11] = np.sqrt(np.maximum(_sum(width**2, rows, n) / per - mean**2, 0))
    out[:, 12] = _sum(width <= 3, rows, n) / per
    out[:, 13] = _sum(width >= 12, rows, n) / per
    longest = np.zeros(n)
    np.maximum.at(longest, rows, width)
    out[:, 14] = np.log1p(longest)
    out[:, 15] = _sum(last == 6, rows, n) / per
    out[:, 16] = _sum(alphas == 0, rows, n) / per
    out[:, 17] = _sum((ups >= 2) & (ups == alphas), rows, n) / per
    out[:, 18] = _sum(first == 1, rows, n) / per
    at = np.searchsorted(rows, np.arange(n + 1))
    for i in np.flatnonzero(words):
        own = hashes[at[i] : at[i + 1]]
        _, times = np.unique(own, return_counts=True)
        pairs = mix(own[1:] * U(0x9FB21C651E98DF25) + own[:-1])
        out[i, 19], out[i, 20] = len(times) / len(own), times.max() / len(own)
        out[i, 21] = len(np.unique(pairs)) / max(len(pairs), 1)
    starts, ends, rows = textkit.runs(data != 10, offsets)
    lines = np.bincount(rows, minlength=n)
    hashes = textkit.span_hash(textkit.prefix(data), starts, ends) ^ mix(rows.astype(U))
    kinds = np.unique(np.stack([rows.astype(U), hashes], 1), axis=0)[:, 0].astype(np.int64)
    out[:, 22] = np.log1p(lines)
    out[:, 23] = np.log1p(_sum((ends - starts).astype(float), rows, n) / np.maximum(lines, 1))
    out[:, 24] = np.bincount(kinds, minlength=n) / np.maximum(lines, 1)
    return out


class Trees:
    """Complete binary trees as arrays: node i has children 2i + 1 and 2i + 2; a leaf keeps rows by an infinite threshold."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, p: Boosting) -> Trees:
    """Second-order boosting of the logistic loss over binned features, level by level."""
    n, width = x.shape
    rate = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    inner = 2**p.depth - 1
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    cell = binned + np.arange(width) * p.bins
    raw = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, prob * (1 - prob)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(p.depth):
            lo, here = 2**depth - 1, 2**depth
            index = ((node - lo)[:, None] * (width * p.bins) + cell).ravel()
            shape = (here, width, p.bins)
            g, h, c = (np.bincount(index, w, here * width * p.bins).reshape(shape).cumsum(2) for w in (np.repeat(grad, width), np.repeat(hess, width), np.ones(n * width)))
            all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + p.ridge) + (all_g - g) ** 2 / (all_h - h + p.ridge) - all_g**2 / (all_h + p.ridge)
            gain[(c < p.least) | (all_c - c < p.least)] = -np.inf
            best = gain.reshape(here, -1).argmax(1)
            good = gain.reshape(here, -1)[np.arange(here), best] > 1e-6
            f, b = best // p.bins, best % p.bins
            feature[lo : lo + here] = np.where(good, f, 0)
            threshold[lo : lo + here] = [cuts[i][j] if ok and j < len(cuts[i]) else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        own = node - inner
        leaf = -p.rate * np.bincount(own, grad, inner + 1) / (np.bincount(own, hess, inner + 1) + p.ridge)
        raw += leaf[own]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textkit.slices(batch):
            x = statistics(part.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "stats"])


def _score_batches(trees: Trees, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(trees.score(statistics(part.column("text"))))], names=[*names, "score"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents, those whose hash of doc_id is least; one row for each doc_id."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = save(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(small(ids, most), "doc_id").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, p: Boosting | None = None) -> Trees:
    """docs (doc_id, text, ...) and labels (doc_id, quality, ...) -> trees, fitted in one task on a bounded sample of the rows in both.

    Of several texts of one doc_id the one with the least statistics counts.
    """
    p = p or Boosting()
    ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", p.sample)
    stats = sample.select("doc_id", "text").mapInArrow(_stat_batches, "doc_id long, stats array<double>").groupBy("doc_id").agg(F.min("stats").alias("stats"))
    rows = stats.join(sample.select("doc_id", "label").dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "stats", "label")

    def run(table: pa.Table) -> bytes:
        table = table.sort_by("doc_id")
        x = table.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, len(STATS)) if len(table) else np.zeros((0, len(STATS)))
        return pickle.dumps(grow(x, table.column("label").to_numpy().astype(float), p))

    return pickle.loads(in_one_task(rows, run))


def score(docs: DataFrame, trees: Trees, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score), one row per document; score is the probability of good quality.

    A null or empty text is scored by its statistics, all 0. Repeated rows are scored each. Only doc_id and text are
    read. Without labels of both kinds every score is the same. keep: columns to return instead of doc_id, so that a
    filter needs no join; a column of docs named score is not among them.
    """
    ready(docs.sparkSession)
    names = [c for c in keep if c != "score"] if keep else ["doc_id"]
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string")).select(*dict.fromkeys([*names, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.mapInArrow(_score_batches(trees, names), f"{schema}, score double")
