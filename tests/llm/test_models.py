"""Quality and toxicity: held-out accuracy, the learners against plain versions, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from llm import cases
from strideline.llm import quality, toxicity
from strideline.llm.common import documents
from strideline.llm.labelled import training_sample
from strideline.llm.queries import labels

MID = "/root/testdata/sf0.01"


def auc(scores: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    for s in np.unique(scores):
        rank[scores == s] = rank[scores == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("module", "target", "folds", "fold", "least"), [(quality, "quality", 3, 1, 0.9), (toxicity, "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, module, target, folds, fold, least):
    docs = documents(spark, MID)
    rows = module.score(docs, labels(spark, MID)).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in rows)
    truth = {r["doc_id"]: r[target] for r in labels(spark, MID).collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    scores, y = (np.array(x, float) for x in zip(*held, strict=True))
    assert auc(scores, y) >= least
    assert ((scores >= module.THRESHOLD) == (y == 1)).mean() >= 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_tables_without_labels(spark, module):
    target = "quality" if module is quality else "toxic"
    given = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in [1, 2, 6, 7, 8, 9, 10, 11, 12]] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    rows = module.score(cases.odd(spark), given).collect()
    assert len(rows) == len(cases.odd_rows()) and all(r["score"] is not None and r["held_out"] is not None for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 11]
    assert same[0] == same[1]
    assert {r["score"] for r in module.score(cases.odd(spark), given.limit(0)).collect()} == {0.5}
    assert module.score(cases.none(spark), given).count() == 0
    ones = given.withColumn(target, given[target] * 0 + 1)
    assert all(r["score"] >= 0.5 for r in module.score(cases.odd(spark), ones).collect())


def test_training_never_sees_the_held_out_fold(spark):
    given = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in training_sample(given, "quality", 3, 1, 1000).collect()}
    assert kept == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert training_sample(given, "quality", 3, 1, 100).count() < 150


def test_flattened_trees_give_the_scores_of_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).round(2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    table = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label double").select("x", array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=8, maxDepth=quality.DEPTH, seed=1).fit(table)
    rows = model.transform(table).select("x", vector_to_array("probability").alias("p")).collect()
    mine = quality.flatten(model, 0.5).score(np.array([r["x"] for r in rows]))
    assert np.allclose(mine, [r["p"][1] for r in rows], atol=1e-9)


def test_statistics_of_a_text():
    text = b"Big cats cats run!\nBig cats cats run!\n a b c d e a b c d e #"
    row = quality.statistics(np.array([0, len(text)]), text)[0]
    words = text.split()
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    assert row[0] == np.log1p(len(words)) and row[1] == np.log1p(len(text))
    assert np.isclose(row[2], np.mean([len(w) for w in words])) and np.isclose(row[3], np.std([len(w) for w in words]))
    assert np.isclose(row[4], 2 / len(words)) and np.isclose(row[5], len(set(words)) / len(words))
    assert np.isclose(row[6], 1 - len(set(fives)) / len(fives)) and np.isclose(row[12], 1 / 3)


def test_ftrl_against_a_plain_version(monkeypatch):
    """One coordinate at a time, with the same order of rows."""
    monkeypatch.setattr(toxicity, "LEAST", 1)
    monkeypatch.setattr(toxicity, "L1", 0.2)
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    y = np.array([float(3 in r or 7 in r) for r in rows])
    z, n, order = {}, {}, np.random.default_rng(1)

    def weight(i: int) -> float:
        l1 = 0.0 if i < 0 else 0.2
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((toxicity.BETA + np.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for r in order.permutation(len(rows)):
            own = [*rows[r].tolist(), -1]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[r]
            for i in own:
                s = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    at, w = toxicity.ftrl(rows, y, 3)
    assert np.allclose(w, [weight(int(i)) for i in at], atol=1e-9)


def test_features_have_words_pairs_and_skips_within_documents():
    doc, at = toxicity.features(["a b c", "", "A, b"])
    assert np.bincount(doc, minlength=3).tolist() == [6, 0, 3]
    assert set(at[doc == 2]) < set(at[doc == 0])
