"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are trained by Spark on binned statistics of a bounded sample of labelled documents, then flattened into
arrays of feature, threshold and children, which numpy traverses for a batch of documents at once, tree by tree and
level by level. Scoring is one narrow pass over the texts; statistics see whole texts.

Null and empty texts have statistics of zero and get a score like any other. With no labels, or of one kind only, the
score is that label's share (0.5 with none). Repeated rows score alike; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import chunks, text_bytes, texts, tidy, written
from strideline.llm.labelled import held_out, sampled, training_sample
from strideline.llm.windows import _TABLE, spans_hash, word_tokens

FOLDS, FOLD, THRESHOLD = 3, 1, 0.5
#: Labelled rows for training at most.
SAMPLE = 30_000
TREES, DEPTH, BINS, STEP, LEAF = 20, 4, 64, 0.3, 5
CHUNK = 1 << 20

_CLASSES = np.full(256, 7, np.uint8)
for _class, _bytes in enumerate((b" \t\x0b\x0c\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:!?\"'()-")):
    _CLASSES[np.frombuffer(_bytes, np.uint8)] = _class
N_FEATURES = 21


def _distinct(doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Different values in each document (44 bits of a hash)."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=docs)


def statistics(at: np.ndarray, data: bytes) -> np.ndarray:
    """A row of statistics for each document of a chunk."""
    docs = len(at) - 1
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    owner = np.repeat(np.arange(docs), np.diff(at))
    kind = np.bincount(owner * 8 + _CLASSES[raw], minlength=docs * 8).reshape(docs, 8).astype(float)
    size = np.maximum(1, np.diff(at)).astype(float)
    t = word_tokens(at, data)
    n = np.diff(t.first)
    word_doc = np.repeat(np.arange(docs), n)
    length = (t.ends - t.starts).astype(float)
    words = np.maximum(1, n).astype(float)
    mean = np.bincount(word_doc, length, docs) / words
    spread = np.sqrt(np.maximum(0, np.bincount(word_doc, length**2, docs) / words - mean**2))
    same = (t.codes[1:] == t.codes[:-1]) & (word_doc[1:] == word_doc[:-1])
    stutter = np.bincount(word_doc[1:][same], minlength=docs) / words
    different = _distinct(word_doc, t.codes, docs) / words
    place = np.arange(max(0, len(t.codes) - 4))
    place = place[word_doc[place] == word_doc[place + 4]] if len(place) else place
    five = np.maximum(1, n - 4)
    repeated = 1 - _distinct(word_doc[place], spans_hash(t.codes, place, place + 5), docs) / five if len(place) else np.zeros(docs)
    repeated = np.where(n > 4, repeated, 0)
    first = np.frombuffer(t.data, np.uint8)[t.starts] if len(t.starts) else np.zeros(0, np.uint8)
    last = np.frombuffer(t.data, np.uint8)[t.ends - 1] if len(t.starts) else np.zeros(0, np.uint8)
    ends_symbol = np.bincount(word_doc[_CLASSES[last] == 5], minlength=docs) / words
    ends_bang = np.bincount(word_doc[last == 33], minlength=docs) / words
    starts_upper = np.bincount(word_doc[_CLASSES[first] == 3], minlength=docs) / words
    single = np.bincount(word_doc[length == 1], minlength=docs) / words
    cuts = np.flatnonzero(raw == 10)
    starts = np.union1d(at[:-1] - at[0], cuts + 1)
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    line_doc = owner[starts] if len(starts) else starts
    lines = np.maximum(1, np.bincount(line_doc, minlength=docs)).astype(float)
    closed = ends - (raw[np.maximum(ends, 1) - 1] == 10) if len(starts) else ends
    line_hash = spans_hash(_TABLE[raw], starts, closed) if len(starts) else np.zeros(0, np.uint64)
    repeated_lines = 1 - _distinct(line_doc, line_hash, docs) / lines if len(starts) else np.zeros(docs)
    parts = [np.log1p(n), np.log1p(np.diff(at)), mean, spread, stutter, different, repeated, ends_symbol, ends_bang, starts_upper, single, np.log1p(lines), repeated_lines, *(kind / size[:, None]).T]
    return np.column_stack(parts)


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in arrays. feature -1: leaf. A leaf's children are itself."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    share: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.root):
            return np.full(len(x), self.share)
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f < 0, node, down)
            margin += self.value[node]
        return 1 / (1 + np.exp(-2 * margin))


def _nodes(node: object, weight: float, rows: list[list[float]]) -> int:
    """Add a node of a Spark tree and all below it to ``rows``; its place."""
    i = len(rows)
    rows.append([-1, 0, i, i, node.prediction() * weight])
    if node.getClass().getSimpleName() == "InternalNode":
        rows[i][0], rows[i][1] = node.split().featureIndex(), node.split().threshold()
        rows[i][2] = _nodes(node.leftChild(), weight, rows)
        rows[i][3] = _nodes(node.rightChild(), weight, rows)
    return i


def _arrays(roots: list[int], rows: list[list[float]], depth: int, share: float) -> Trees:
    f, threshold, left, right, value = np.array(rows, float).T
    return Trees(np.array(roots), f.astype(int), threshold, left.astype(int), right.astype(int), value, depth, share)


def flatten(model: object, share: float) -> Trees:
    """The trees of a fitted Spark model as arrays, leaf values times tree weights."""
    rows: list[list[float]] = []
    roots = [_nodes(tree._call_java("rootNode"), weight, rows) for tree, weight in zip(model.trees, model.treeWeights, strict=True)]
    return _arrays(roots, rows, DEPTH, share)


def flatten_tree(model: object) -> Trees:
    """One fitted classification tree: its classes 0 and 1 score below and above a half."""
    rows: list[list[float]] = []
    _nodes(model._call_java("rootNode"), 1.0, rows)
    for row in rows:
        row[4] = 2 * row[4] - 1
    return _arrays([0], rows, model.depth, 0.5)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Trees:
    """docs: doc_id, text."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            for lo, hi in chunks(at, CHUNK):
                x = pa.array(list(statistics(at[lo : hi + 1], data)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([x, batch.column("y").slice(lo, hi - lo)], ["x", "y"])

    sample = training_sample(labels, "quality", FOLDS, FOLD, most)
    rows = written(sampled(docs, sample).select("text", "y").mapInArrow(scan, "x array<double>, y int"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        nothing = np.zeros(0, int)
        return Trees(nothing, nothing, nothing, nothing, nothing, nothing, 0, ones / n if n else 0.5)
    vectors = rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")).coalesce(6)
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=STEP, minInstancesPerNode=LEAF, seed=1)
    return flatten(gbt.fit(vectors), ones / n)


def batch_scores(at: np.ndarray, data: bytes, trees: Trees) -> np.ndarray:
    return np.concatenate([trees.score(statistics(at[lo : hi + 1], data)) for lo, hi in chunks(at, CHUNK)] or [np.zeros(0)])


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    own = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    trees = train(own, labels, most)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(batch_scores(*text_bytes(batch.column("text")), trees))], ["doc_id", "score"])

    found = own.mapInArrow(scan, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    trees = train(texts(docs, F.col("doc_id").cast("long").alias("doc_id")), labels, most)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch_scores(*text_bytes(batch.column("text")), trees) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(tidy(scan), docs.schema)
