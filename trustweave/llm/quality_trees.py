"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every whole text are computed in tasks from byte histograms and word hashes. Trees
grow on binned statistics of a bounded sample of labelled rows and are flattened into arrays, so
scoring a block of documents is ``DEPTH`` vectorised steps for each tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from ..scratch import cut

#: At most so many labelled rows are used, those with the smallest hash of their doc_id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.12, 20, 1.0
_SYMBOLS = b"#*$%&|<>!?.,;:-_=/\\()[]{}\"'"


def statistics(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a slice."""
    rows = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(rows), size)
    hist = np.bincount(owner * 256 + buf, minlength=rows * 256).reshape(rows, 256)
    some = np.maximum(size, 1)
    start, end, row = tk.words(buf, at)
    n = np.bincount(row, minlength=rows)
    words = np.maximum(n, 1)
    hashes = tk.word_hashes(buf, start, end)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    far = np.zeros(len(row), bool)
    far[5:] = (hashes[5:] == hashes[:-5]) & (row[5:] == row[:-5])
    letters = np.maximum(hist[:, 65:91].sum(1) + hist[:, 97:123].sum(1), 1)
    lines = hist[:, 10] + 1
    longest = np.zeros(rows)
    np.maximum.at(longest, row, end - start)
    loud = np.zeros(len(row), bool)
    if len(start):
        loud = (buf[end - 1] == 33) | (buf[end - 1] == 35) | (buf[end - 1] == 37) | (buf[end - 1] == 42) | (buf[end - 1] == 36) | (buf[end - 1] == 38)
    f = [
        np.log1p(size),
        np.log1p(n),
        np.bincount(row, weights=end - start, minlength=rows) / words,
        np.bincount(row[order], weights=new, minlength=rows) / words,
        np.bincount(row, weights=again, minlength=rows) / words,
        np.bincount(row, weights=far, minlength=rows) / words,
        np.bincount(row, weights=loud, minlength=rows) / words,
        longest,
        hist[:, 65:91].sum(1) / letters,
        hist[:, 48:58].sum(1) / some,
        hist[:, 128:].sum(1) / some,
        lines / words,
        hist[:, 32] / some,
        *(hist[:, c] / some for c in _SYMBOLS),
    ]
    return np.stack(f, axis=1).astype(np.float32)


class Trees:
    """Complete binary trees as arrays: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, feature, threshold, leaf, start):
        self.feature, self.threshold, self.leaf, self.start = feature, threshold, leaf, start

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (1 << DEPTH) + 1]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees on statistics ``x`` and labels ``y`` (0 or 1) by the logistic loss."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(prior / (1 - prior)))
    features, thresholds, leaves = [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
        total = np.full(len(y), start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            f, t = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for depth in range(DEPTH):
                first, width = (1 << depth) - 1, 1 << depth
                best = np.full(width, 1e-6)
                split = np.full((width, 2), -1)
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    cell = (node - first) * BINS + binned[:, k]
                    g, h, n = (np.bincount(cell, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (grad, hess, np.ones(len(y))))
                    gain = g**2 / (h + RIDGE) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                    gain[(n < LEAST) | (n[:, -1:] - n < LEAST)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    split[better] = np.stack([np.full(better.sum(), k), at[better]], axis=1)
                for i, (k, b) in enumerate(split):
                    if k >= 0 and b < len(cuts[k]):
                        f[first + i], t[first + i] = k, cuts[k][b]
                node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
            leaf = node - (1 << DEPTH) + 1
            g, h = (np.bincount(leaf, weights=w, minlength=1 << DEPTH) for w in (grad, hess))
            value = RATE * g / (h + RIDGE)
            total += value[leaf]
            features.append(f)
            thresholds.append(t)
            leaves.append(value)
    return Trees(features, thresholds, leaves, start)


def _measured(batches):
    for batch in batches:
        data, offs = tk.column(batch, "text")
        for lo, hi, buf, at in tk.slices(data, offs):
            x = statistics(buf, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), tk.lists(x.ravel(), np.arange(hi - lo + 1) * x.shape[1], pa.float32())],
                names=["doc_id", "held_out", "x"],
            )


def _judged(trees):
    def judge(batches):
        for batch in batches:
            rows = batch.num_rows
            x = np.asarray(batch.column(2).flatten()).reshape(rows, -1) if rows else np.zeros((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees(x) if rows else np.zeros(0))], names=["doc_id", "held_out", "score"])

    return judge


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id: long, text: string; other columns are ignored).

    Learns ``labels.quality`` from at most ``SAMPLE`` labelled rows whose crc32(doc_id as text) modulo 4 is
    not 2; repeated labels of a doc_id count once (the smallest), null labels and ids not at all. Returns
    one row per input row: doc_id, held_out, score (0 to 1) and predicted (1 if score >= ``threshold``).
    Null and empty texts are scored by statistics of zero; with labels of one kind only, or none, every
    score is their smoothed share; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    measured = cut(docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_measured, "doc_id long, held_out boolean, x array<float>"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = measured.where(~F.col("held_out")).join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("x", "quality").toArrow()
    y = sample["quality"].to_numpy().astype(np.float64)
    x = np.array(sample["x"].to_pylist(), np.float32).reshape(len(y), -1 if len(y) else 1)
    trees = docs.sparkSession.sparkContext.broadcast(grow(x, y))
    scored = measured.mapInArrow(lambda batches: _judged(trees.value)(batches), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
