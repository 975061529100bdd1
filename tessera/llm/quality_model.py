"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in batches on the executors. Trees are
grown on a bounded sample of labelled rows (``SAMPLE`` documents at most, those
with the smallest hashes of their ids): features are cut into histogram bins
at their quantiles, every level of a tree adds up gradients per bin, and the
finished trees are complete binary trees flattened into arrays, so scoring a
batch is a few numpy look-ups per level for all rows and trees at once.

Cases: null and empty texts have the statistics of an empty text and get a
score; rows without a label or outside the training part are only scored;
repeated rows get equal scores; with no labelled row every score is 0.5;
an empty table gives no rows. Language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, flat, slices, summed
from .quality_rules import counts

#: Labelled documents that trees are grown on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.2, 1.0, 20.0
CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:?",
    "mark": b"!",
    "bar": b"|",
    "high": bytes(range(192, 256)),
}
TABLES = {name: np.isin(np.arange(256), list(members)) for name, members in CLASSES.items()}
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "lines", "distinct", "same_as_last", *CLASSES)


def features(texts: pa.Array) -> np.ndarray:
    """Statistics of whole texts (a binary column), a row each."""
    data, offsets = flat(texts)
    c = counts(texts)
    n = np.maximum(c["n_words"], 1)
    size = np.maximum(np.diff(offsets), 1)
    distinct, same = np.zeros(len(texts)), np.zeros(len(texts))
    for i, x in enumerate(texts.to_pylist()):
        words = x.split()
        distinct[i] = len(set(words))
        same[i] = sum(map(bytes.__eq__, words, words[1:]))
    columns = [np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / n, c["n_lines"] / n, distinct / n, same / n]
    columns += [summed(table[data], offsets) / size for table in TABLES.values()]
    return np.stack(columns, 1)


@dataclass
class Trees:
    """Complete binary trees: feature and threshold by tree and inner node (breadth first), value by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1 for each row."""
        if not len(x):
            return np.zeros(0)
        depth = int(np.log2(self.feature.shape[1] + 1))
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(depth):
            right = x[row, self.feature[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        leaf = at - self.feature.shape[1]
        return 1 / (1 + np.exp(-(self.bias + self.value[tree, leaf].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for labels ``y`` (0 or 1)."""
    inner = (1 << depth) - 1
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return empty
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], 1)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(base / (1 - base)))
    margin = np.full(len(y), bias)
    feature, threshold, value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best, pick, cut = np.zeros(width), np.zeros(width, np.int64), np.full(width, BINS)
            for k in range(x.shape[1]):
                key = (node - first) * BINS + binned[:, k]
                gl = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hl = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                nl = np.bincount(key, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best + 1e-9
                best[better], pick[better], cut[better] = top[better], k, b[better]
            for w in np.flatnonzero(best > 0):
                f[first + w] = pick[w]
                t[first + w] = edges[pick[w]][cut[w]] if cut[w] < len(edges[pick[w]]) else np.inf
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf = node - inner
        v = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(np.array(feature), np.array(threshold), np.array(value), bias)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no model learns from: the remainder of a checksum of the id is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns to keep, and the statistics of each text as an array."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([docs.schema[k] for k in keep]).add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            x = features(as_bytes(batch.column("_text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), lists], names=[*keep, "x"])

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees for a label, grown on the driver from the statistics of at most ``sample`` labelled documents that are not held out."""
    chosen = labels.filter(F.col(label).isNotNull() & ~held_out()).select(F.col("doc_id"), F.col(label).cast("double").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by sample
    rows = statistics(joined, ["doc_id", "_y"]).orderBy("doc_id", "_y").limit(2 * sample).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return grow(x, rows.column("_y").to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The score of each document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample=sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"]]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = model.value.score(features(as_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
