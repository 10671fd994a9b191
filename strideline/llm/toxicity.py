"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters and digits. A document's features are its different words, word pairs and pairs
with one word between, hashed into ``2**BITS`` coordinates. Each shard of a bounded sample of labelled rows is passed
over by FTRL-proximal with per-coordinate rates and L1, in parallel; a coordinate's weight is its mean over the shards
that saw it. L1 leaves few weights, so they are sent to the executors as a compact sorted array, and scoring is
one narrow pass over whole texts.

Null and empty texts have no features and get the bias. With no labels the score is 0.5. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import texts
from strideline.llm.labelled import held_out, sampled, training_sample
from strideline.llm.words import batches, words_of

FOLDS, FOLD, THRESHOLD = 4, 2, 0.3
#: Labelled rows for training at most, rows of a shard about, and passes over them.
SAMPLE, SHARD, EPOCHS = 30_000, 10_000, 6
BITS = 22
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
#: Documents of a shard that a coordinate needs; fewer cannot overcome L1.
LEAST = 3
CHUNK = 1 << 20

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def features(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) pairs, sorted, each once. Coordinate 0 is left for the bias."""
    doc, word = words_of(docs)
    doc = doc.astype(np.uint64)
    found, owner = [word], [doc]
    for lag in (1, 2):
        if len(word) > lag:
            same = doc[lag:] == doc[:-lag]
            found.append((word[:-lag] * _ODD[0] + word[lag:] * _ODD[1] + np.uint64(lag))[same])
            owner.append(doc[lag:][same])
    h = np.concatenate(found)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    key = np.unique((np.concatenate(owner) << np.uint64(32)) | ((h >> np.uint64(64 - BITS)) | np.uint64(1 << BITS)))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def ftrl(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates that were seen and their weights; the bias is coordinate -1, without L1."""
    count = np.zeros(1 << BITS, np.int32)
    for r in rows:
        count[r] += 1
    seen = np.flatnonzero(count >= LEAST)
    place = np.full(1 << BITS, -1, np.int32)
    place[seen] = np.arange(len(seen))
    parts = [p[p >= 0] for p in (place[r] for r in rows)]
    z, n = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    l1 = np.append(np.full(len(seen), L1), 0.0)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = np.append(parts[r], len(seen))
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[r]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return np.append(seen, -1), weights(np.arange(len(seen) + 1))


def hashed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, doc_id, h, text, y to shard, doc_id, h, y and the coordinates of the text."""
    for batch in batches_:
        column = batch.column("text").to_pylist()
        for i, j in batches(column, CHUNK):
            doc, at = features(column[i:j])
            cuts = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32)))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("shard", "doc_id", "h", "y")), lists], ["shard", "doc_id", "h", "y", "at"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """docs: doc_id, text. Sorted coordinates with a weight, those weights, and the bias.

    Texts become coordinates where they are read, so a shard holds integers and no texts.
    """

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "h"])
        at, w = ftrl([np.asarray(x, np.int32) for x in pdf["at"]], pdf["y"].to_numpy(float))
        seen = w != 0
        return pd.DataFrame({"at": at[seen], "w": w[seen]})

    sample = training_sample(labels, "toxic", FOLDS, FOLD, most)
    shards = max(1, round(min(most, sample.count()) / SHARD))
    rows = sampled(docs, sample).select(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).alias("shard"), "doc_id", F.xxhash64("text").alias("h"), "y", "text")
    ready = rows.mapInArrow(hashed, "shard long, doc_id long, h long, y int, at array<int>")
    mixed = ready.groupBy("shard").applyInPandas(fit, "at long, w double").groupBy("at").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"))
    found = mixed.toPandas()  # at most 2**BITS rows, and few in practice for L1
    bias = found.loc[found["at"] == -1]
    b = float((bias["w"] / bias["k"]).sum())
    found = found.loc[found["at"] >= 0].sort_values("at")
    return found["at"].to_numpy(np.int64), (found["w"] / found["k"]).to_numpy(), b


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    own = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    sent = docs.sparkSession.sparkContext.broadcast(train(own, labels, most))

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for batch in rows:
            column = batch.column("text").to_pylist()
            margin = np.full(len(column), bias)
            for i, j in batches(column, CHUNK):
                doc, place = features(column[i:j])
                margin[i:j] += np.bincount(doc, dense[place], j - i)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], ["doc_id", "score"])

    found = own.mapInArrow(scan, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
