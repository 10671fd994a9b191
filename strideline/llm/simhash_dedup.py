"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in over half the hashes of the document's 4-word shingles.
Fingerprints link at ``RADIUS`` or fewer differing bits. Each is cut into three segments of 22, 21 and 21 bits. If two
fingerprints differ in at most 4 bits, they differ in at most one bit of the first segment or of the second, or in none
of the third; so it is enough to enumerate the Hamming ball of radius 1 in the first two segments (only towards cleared
bits, as of two neighbours one has the bit) and to fetch exact matches in the third. Complete distances are verified
in the bucket, which returns links that span its linked members, never all pairs.

Only distinct fingerprints are indexed, so exact copies cost one row. A bucket with more than ``BLOCK`` fingerprints is
split into blocks that meet pairwise as separate groups. Segments suit up to some 10**9 fingerprints.

Null and empty texts (and texts of white space) have fingerprint zero and link like any other; repeated rows have equal
rows in the result; a null id never is a component's id unless all its documents have none; extra columns are unused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import text_bytes, texts, written
from strideline.llm.components import components, named

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCK = 2048
#: (shift, bits, radius) of each segment.
SEGMENTS = ((42, 22, 1), (21, 21, 1), (0, 21, 0))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of the text's runs of ``size`` words, repeats included; a shorter text is one run, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        shingles = [joined]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[:-1])]
        shingles = map(joined.__getitem__, map(slice, starts, ends[size - 1 :]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            found = [fingerprint(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(scan, "doc_id long, fp long")


def bucket_links(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the linked members of one bucket."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = np.arange(len(fp))
    while True:
        low = np.where(near, label[None, :], len(fp)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    some = label != np.arange(len(fp))
    return fp[some], fp[label[some]]


def _pairs(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in all buckets of ``key`` (sorted): small buckets by comparing neighbours at each lag, large ones densely."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cuts, len(key)))
    for a, n in zip(cuts[size > 24], size[size > 24], strict=True):
        yield bucket_links(fp[a : a + n])
    small = np.repeat((size > 1) & (size <= 24), size)
    key, fp = key[small], fp[small]
    for lag in range(1, 24):
        same = key[lag:] == key[:-lag]
        if not same.any():
            break
        near = same & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= RADIUS)
        if near.any():
            yield fp[lag:][near], fp[:-lag][near]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest_k = rest_f = None

    def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in _pairs(key, fp):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if rest_k is not None:
            key, fp = np.concatenate([rest_k, key]), np.concatenate([rest_f, fp])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield from out(key[:last], fp[:last])
        rest_k, rest_f = key[last:], fp[last:]
    if rest_k is not None and len(rest_k):
        yield from out(rest_k, rest_f)


def probes(fp: Column) -> Column:
    """Bucket keys of a fingerprint: its own in each segment and, where the radius is 1, those with one bit cleared."""
    keys = []
    for i, (shift, bits, radius) in enumerate(SEGMENTS):
        own = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + F.lit(i << 24).cast("long")
        keys.append(F.array(own))
        if radius:
            single = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])
            keys.append(_cleared(own, single))
    return F.concat(*keys)


def _cleared(own: Column, single: Column) -> Column:
    return F.transform(F.filter(single, lambda b: own.bitwiseAND(b) != 0), lambda b: own - b)


def dealt(keyed: DataFrame, node: str, block: int) -> DataFrame:
    """keyed: ``node``, key. The same with buckets of over ``block`` members as groups of two blocks each, so that all pairs meet."""
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select(F.col("key"), F.ceil(F.col("size") / (block // 2)).cast("int").alias("blocks"))
    joined = keyed.join(hot, "key", "left")
    mine = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    group = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j).cast("long") * F.col("blocks") + F.greatest(mine, j) + 1)
    )
    rows = joined.select(node, F.col("key").alias("bucket"), F.explode(group).alias("block"))
    return rows.select(node, F.when(F.col("block") == 0, F.col("bucket")).otherwise(F.xxhash64("bucket", "block")).alias("key"))


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp. Links (a, b) whose components are those of all fingerprints within the radius."""
    keyed = distinct.select("fp", F.explode(probes(F.col("fp"))).alias("key"))
    return dealt(keyed, "fp", BLOCK).repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of each row."""
    table = written(fingerprints(docs))
    distinct = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    found = named(distinct.withColumnRenamed("fp", "node").join(roots, "node", "left"))
    return table.join(found.withColumnRenamed("node", "fp"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_groups) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group of near copies; of rows with one id, one.

    A row without an id counts as one with a larger id than all others, one for each text: it goes if its group has a
    row with an id, and of a group without any ids one row stays.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    without = rows.where("doc_id is null")
    if not without.select("doc_id").isEmpty():
        name = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("name")
        numbers = written(without.select(name).distinct().withColumn("number", F.lit(1 << 62) + F.monotonically_increasing_id()))
        without = without.select("row", "text", name).join(numbers, "name").select("row", F.col("number").alias("doc_id"), "text")
        rows = rows.where("doc_id is not null").unionByName(without)
    kept = written(groups(rows).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    # The kept ids grow with the corpus: they are hashed on their side of a shuffle at any size, and texts are never sorted.
    once = rows.join(kept.where("n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select("row.*")
    if kept.where("n > 1").isEmpty():
        return once
    several = rows.join(kept.where("n > 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    return once.unionByName(several.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("text")).alias("row")).select("row.*"))
