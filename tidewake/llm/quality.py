"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of byte classes, word shapes, repetition) come from vectorised
passes over the bytes. The trees are grown on the driver from a sample of labelled rows whose size
is bounded by a parameter; every tree is a perfect binary tree in flat arrays (feature, threshold,
leaf value), so scoring walks all rows of a batch down one level with one numpy step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r\x0b\x0c",
    "stop": b".,;:?'\"-()",
    "bang": b"!",
    "table": b"|\\/_=+",
    "symbol": b"#$%&*@^~<>[]{}`",
}
_TABLE = np.full(256, len(_CLASSES), np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes)] = _k
_TABLE[0x80:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2
#: Statistics in the order of the columns of `statistics`.
STATISTICS = [
    *(f"share_{name}" for name in (*_CLASSES, "control", "beyond_ascii")),
    "log_bytes", "log_words", "mean_word_bytes", "long_words", "repeats_previous", "distinct_words", "capitalised", "ends_in_stop", "words_per_line",
]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text; a null or empty text gives zeros."""
    out = np.zeros((len(column), len(STATISTICS)), np.float64)
    for a, b, buffer, offsets in common.text_blocks(column):
        rows = out[a:b]
        sizes = np.diff(offsets)
        kinds = _TABLE[buffer]
        counts = np.bincount(np.repeat(np.arange(b - a) * _N_CLASSES, sizes) + kinds, minlength=(b - a) * _N_CLASSES).reshape(b - a, _N_CLASSES)
        full = np.maximum(sizes, 1)[:, None]
        rows[:, :_N_CLASSES] = counts / full
        starts, ends, first = common.word_bounds(buffer, offsets, common.SPACES)
        n_words = np.diff(first)
        some = np.maximum(n_words, 1)
        rows[:, _N_CLASSES] = np.log1p(sizes)
        rows[:, _N_CLASSES + 1] = np.log1p(n_words)
        if not len(starts):
            continue
        doc = np.repeat(np.arange(b - a), n_words)
        per_doc = lambda x, doc=doc, n=b - a: np.bincount(doc, x, n)
        lengths = ends - starts
        hashes = common.word_hashes(buffer, starts, ends)
        same = np.zeros(len(starts), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=b - a)
        rows[:, _N_CLASSES + 2] = per_doc(lengths) / some
        rows[:, _N_CLASSES + 3] = per_doc(lengths > 20) / some
        rows[:, _N_CLASSES + 4] = per_doc(same) / some
        rows[:, _N_CLASSES + 5] = distinct / some
        rows[:, _N_CLASSES + 6] = per_doc(kinds[starts] == 1) / some
        rows[:, _N_CLASSES + 7] = per_doc(kinds[ends - 1] == 5) / some
        rows[:, _N_CLASSES + 8] = np.log1p(n_words / (1 + counts[:, 4]))
    return out


@dataclass
class Trees:
    """Boosted trees, flattened: node k of a tree has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        raw = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Fit trees to labels 0/1 by second-order boosting over histograms of quantile bins."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), float(np.log((share + 0.01) / (1.01 - share))))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, prior)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = node - first
            best = np.zeros(count)
            cut = np.full(count, -1)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = at * bins + binned[:, j]
                g = np.bincount(key, gradient, count * bins).reshape(count, bins)
                h = np.bincount(key, hessian, count * bins).reshape(count, bins)
                gl, hl = np.cumsum(g, 1), np.cumsum(h, 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain[:, : len(edges[j])]
                k = gain.argmax(1)
                better = gain[np.arange(count), k] > best + 1e-9
                best[better] = gain[np.arange(count), k][better]
                feature[first : first + count][better], cut[better] = j, k[better]
            for c in np.flatnonzero(cut >= 0):
                threshold[first + c] = edges[feature[first + c]][cut[c]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        g, h = np.bincount(at, gradient, leaves), np.bincount(at, hessian, leaves)
        leaf = -rate * g / (h + ridge)
        raw += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), prior)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> Trees:
    """Fit trees on at most `most` labelled documents that are not held out.

    Where there are more, those with the smallest hashes of doc_id are taken, so the sample is the
    same on every run and small enough to broadcast. Null ids and labels are ignored. Of rows that
    share a doc_id, in either table, one is learnt from: that with the smallest label, then the
    smallest statistics. Without labels of both kinds every score is the labels' share (0.5 without
    any); an empty table of either gives such scores.
    """
    rows = labels.select("doc_id", F.col(label).cast("double").alias("_y")).filter(F.col("doc_id").isNotNull() & F.col("_y").isNotNull() & ~held_out())
    sample = rows.groupBy("doc_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), batch.column("_y")], ["doc_id", "x", "y"])

    measured = found.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(measure, "doc_id long, x array<double>, y double")
    got = measured.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # rows come in any order; sums of floats would differ
    return grow(x[order], y[order])


def score(docs: DataFrame, model: Trees, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs (or `columns` of it) with the score of each whole text as a further column `name`.

    Every row gets a score, whatever its other columns hold: null and empty texts that of a text of
    no bytes, equal texts equal scores. An empty table gives no rows. A column of docs that is called
    `name` is an error; other names never clash.
    """
    from pyspark.sql import types as T

    kept = columns if columns is not None else docs.columns
    if name.lower() in {c.lower() for c in kept}:
        raise ValueError(f"there is a column {name} already: give the score another name")
    (text,) = common.fresh(docs, "text")
    given = docs.select(*kept, F.col("text").cast("string").alias(text))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(statistics(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*kept, name])

    return given.mapInArrow(run, schema)
