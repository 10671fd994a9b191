"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash at the radius of ``simhash_dedup`` links few such texts: at 0.8 two fingerprints differ in some 9 of 64 bits. So
each distinct text also has ``BANDS`` keys of ``ROWS`` MinHash values. Two texts at similarity s share a key but with a
chance of (1 - s**ROWS)**BANDS, 3 in a million at 0.8 and less above. Texts that share a key are candidates, and their
sets of shingles are compared in full. In a bucket each text that is linked is compared with all that are not yet, so the
links have the components of all pairs in it without all pairs being compared. Buckets over ``BLOCK`` members meet in blocks.

A group is what SimHash links and verified pairs connect. Only distinct texts are indexed; null and empty texts, short
texts, repeated rows and null ids are as in ``simhash_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm import simhash_dedup
from strideline.llm.common import chunks, small_batches, text_bytes, texts, tidy, written
from strideline.llm.components import components, named

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, BLOCK = 24, 4, 512
#: Bytes of text that are held as sets at once, and sets that come to Python at once.
CHUNK, BATCH = 1 << 20, 256
_DRAW = np.random.default_rng(simhash_dedup.SEED)
_ADD, _TIMES, _MIX = (_DRAW.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(3))
_TIMES, _MIX = _TIMES | np.uint64(1), _MIX | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(simhash_dedup.shingle_hashes(text, SHINGLE))


def band_keys(members: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes; an empty set has none."""
    if not len(members):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 4096):
        least = np.minimum(least, ((members[i : i + 4096, None] + _ADD) * _TIMES).min(axis=0))
    return ((least ^ (least >> np.uint64(29))) * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, rk (a hash of id and text), name (128 bits of the text) and text of each row."""
    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), F.unhex(F.md5("text")).alias("name"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, rk, name (of the text), fp and keys of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            for lo, hi in chunks(at, CHUNK):
                each = [data[a:b] for a, b in pairwise(at[lo : hi + 1].tolist())]
                fp = np.array([simhash_dedup.fingerprint(x) for x in each], np.uint64).view(np.int64)
                keys = pa.array([band_keys(shingle_set(x)) for x in each], pa.list_(pa.int64()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "rk", "name")), pa.array(fp), keys], ["doc_id", "rk", "name", "fp", "keys"])

    return _rows(docs).mapInArrow(tidy(scan), "doc_id long, rk long, name binary, fp long, keys array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each node that a row was found for, once for a task: a row found by its key alone may be another text."""
    seen: set[int] = set()
    for batch in batches:
        at, data = text_bytes(batch.column("text"))
        nodes, same = batch.column("node").to_pylist(), batch.column("same").to_pylist()
        for lo, hi in chunks(at, CHUNK):
            found = []
            for i, (a, b) in enumerate(pairwise(at[lo : hi + 1].tolist()), lo):
                if same[i] and nodes[i] not in seen:
                    seen.add(nodes[i])
                    found.append((nodes[i], shingle_set(data[a:b]).tobytes()))
            if found:
                node, members = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(members, pa.binary())], ["node", "members"])


def set_links(node: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that span the texts of one bucket whose sets are similar enough."""
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            i = waiting.pop()
            # Sets whose sizes are further apart than this can't be similar enough.
            fit = left[(size[left] >= LEAST * size[i]) & (size[i] >= LEAST * size[left])]
            if not len(fit):
                continue
            flat = np.concatenate([sets[j] for j in fit])
            place = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[fit])[:-1]]))
            # In whole numbers: both / (a + b - both) >= 4 / 5.
            near = fit[9 * both >= 4 * (size[i] + size[fit])]
            for j in near:
                yield int(node[i]), int(node[j])
            waiting += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: one bucket is held at a time."""
    at, nodes, sets = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        found = list(set_links(np.array(nodes, np.int64), sets)) if len(nodes) > 1 else []
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in (whole.slice(i, 256) for whole in batches for i in range(0, len(whole), 256)):
        for key, node, members in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "members")), strict=True):
            if key != at:
                yield from out()
                at, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(np.frombuffer(members, np.uint64))
    yield from out()


#: Nodes (about 50 bytes each) that are broadcast to find their texts; more are joined by a shuffle.
WANTED = 500_000


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: node, name, rk, keys of each distinct text. Links (a, b) between nodes that are similar enough."""
    w = Window.partitionBy("key")
    shared = nodes.select("node", F.explode("keys").alias("key")).select("node", F.count(F.lit(1)).over(w).alias("n"), F.bit_xor(F.xxhash64("node")).over(w).alias("all"))
    # Buckets with the same members are one.
    keyed = written(shared.where("n > 1").select("node", F.xxhash64("all", "n").alias("key")).distinct())
    wanted = written(nodes.join(keyed.select("node").distinct(), "node", "left_semi").select("node", F.col("name").alias("named"), "rk"))
    wanted = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
    # Of each text in a shared bucket one row is read again; no other text leaves its place.
    found = _rows(docs).join(wanted, "rk").select("node", (F.col("name") == F.col("named")).alias("same"), "text")
    sets = written(found.mapInArrow(tidy(_sets), "node long, members binary"))
    rows = simhash_dedup.dealt(keyed, "node", BLOCK).join(sets, "node").select("key", "node", "members")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_verify), "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable by either kind of link) of each row."""
    table = written(signatures(docs))
    same = table.groupBy("name").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()))
    first = components(simhash_dedup.links(nodes.select("fp").distinct())).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(first, "fp", "left").select("node", "least", F.coalesce("root", "fp").alias("group")))
    group = rooted.select("node", "group")
    pairs = links(docs, nodes)
    for end in ("a", "b"):
        pairs = pairs.join(group.select(F.col("node").alias(end), F.col("group").alias(f"group_{end}")), end)
    with small_batches(docs.sparkSession, BATCH):
        ends = written(pairs.select(F.col("group_a").alias("a"), F.col("group_b").alias("b")).distinct())
    second = components(ends).withColumnRenamed("node", "group")
    whole = rooted.join(second, "group", "left").select("node", "least", F.coalesce("root", "group").alias("root"))
    of_text = nodes.select("name", "node").join(named(whole), "node").select("name", "component_id")
    return table.select("doc_id", "name").join(of_text, "name").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group of near copies; of rows with one id, one."""
    return simhash_dedup.keep_one(docs, near_groups)
