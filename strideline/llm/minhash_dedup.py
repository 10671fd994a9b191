"""MinHash near-dedup, verified by odd sketches: documents whose sets of two-word shingles have a Jaccard of 0.8 or more.

1. ``signatures``: one narrow pass gives each row a 128-bit name of its set, ``BANDS`` keys of ``ROWS`` MinHash values,
   and an odd sketch: ``SAMPLES`` MinHash values folded into a parity bitmap of ``BITS`` bits. The XOR of two sketches has
   few ones if many values agree: 84 +- 10 at a similarity of 0.8, 141 at 0.6, 162 at 0.5.
2. Rows with equal sets are one node. Two nodes at 0.8 share no key with a chance of (1 - 0.8**ROWS)**BANDS, 5 in 10**8.
3. In a bucket, nodes whose sketches differ in ``FAR`` bits at most (5.6 deviations from the mean at 0.8) and whose sizes
   can fit are candidates. Links that span the candidates of a bucket are enough to group all nodes that may be linked.
4. Each node is in one such group, so the set of a node is shuffled once, to its group, where sets are compared in full.
   Exact links decide the components; a candidate alone links nothing.

Both kinds of buckets are handled by ``meet``: a bucket over its block size first links members to one of them, its pivot,
in as many tasks as it needs; only members that this leaves over meet all others, in blocks. So a large group of near
copies costs one comparison a member, and no pair is lost.

Null texts and texts without words have an empty set and are linked with none, not even each other; a text of one word
is one shingle. Repeated rows are nodes with equal sets. A row without an id never names a component, unless no row of
its component has an id; then component_id is null. Extra columns are unused. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import chunks, small_batches, text_bytes, texts, tidy, written
from strideline.llm.components import components, named
from strideline.llm.windows import word_tokens

BANDS, ROWS, SAMPLES, BITS, FAR = 32, 4, 256, 512, 140
#: Sizes of blocks of sketches and of sets; bytes of text that are held as sets at once; sets that come to Python at once.
SKETCHES, SETS, CHUNK, BATCH = 2048, 512, 1 << 20, 256
#: Nodes (about 120 bytes each) that are broadcast to find their texts; more are joined by a shuffle.
WANTED = 200_000
_DRAW = np.random.default_rng(11)
_ADD, _TIMES, _BAND, _FOLD = (_DRAW.integers(0, 1 << 64, SAMPLES, np.uint64) for _ in range(4))
_TIMES, _BAND, _FOLD = _TIMES | np.uint64(1), _BAND[: BANDS * ROWS] | np.uint64(1), _FOLD | np.uint64(1)


def shingle_sets(at: np.ndarray, data: bytes) -> list[np.ndarray]:
    """The set of two-word shingles of each text, as sorted hashes; a text of one word has that word, none has none."""
    t = word_tokens(at - at[0], data[at[0] : at[-1]].lower())
    both = (t.codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (t.codes[1:] + np.uint64(0x7F4A7C159E3779B9))
    both = (both ^ (both >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    first = t.first.tolist()
    return [np.unique(both[a : b - 1]) if b - a > 1 else t.codes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def minhash(members: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 256):
        least = np.minimum(least, ((members[i : i + 256, None] + _ADD) * _TIMES).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    least = least[: BANDS * ROWS]
    return ((least ^ (least >> np.uint64(29))) * _BAND).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity of the number of samples that fall on each bit."""
    mixed = (least ^ (least >> np.uint64(32))) * _FOLD
    bits = (mixed >> np.uint64(32)) % np.uint64(BITS)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=BITS) & 1).view(np.uint64)


def estimate(ones: int) -> float:
    """The similarity that so many ones in the XOR of two sketches stand for."""
    return 1 + BITS / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * ones / BITS)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, rk (a hash of id and text), digest (of the set, null if empty), n, keys and sketch of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            for lo, hi in chunks(at, CHUNK):
                sets = shingle_sets(at[lo : hi + 1], data)
                rows = [(xxhash.xxh3_128_digest(x.tobytes()), band_keys(m := minhash(x)), odd_sketch(m).tobytes()) if len(x) else (None, [], None) for x in sets]
                digest, keys, sketch = zip(*rows, strict=True)
                part = batch.slice(lo, hi - lo)
                cols = [part.column("doc_id"), part.column("rk"), pa.array(digest, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rk", "digest", "n", "keys", "sketch"])

    return _rows(docs).mapInArrow(tidy(scan), "doc_id long, rk long, digest binary, n long, keys array<long>, sketch binary")


def _rows(docs: DataFrame) -> DataFrame:
    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")


class Bucket:
    """Members of a bucket or a block: their sizes, sketches and, once candidates are known, sets."""

    def __init__(self, n: np.ndarray, sketch: list[bytes], members: list[bytes | None]):
        self.n = n
        self.sketch = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(n), -1)
        self.sets = [None if x is None else np.frombuffer(x, np.uint64) for x in members]

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are linked with member ``i``: by sketches, then, where there are sets, by sets."""
        n = self.n[others]
        # Sets whose sizes are further apart than this can't be similar enough.
        others = others[(5 * n >= 4 * self.n[i]) & (5 * self.n[i] >= 4 * n)]
        ones = np.bitwise_count(self.sketch[others] ^ self.sketch[i]).sum(axis=1)
        others = others[ones <= FAR]
        if not len(others) or self.sets[i] is None:
            return others
        mine, size = self.sets[i], self.n[others]
        flat = np.concatenate([self.sets[j] for j in others])
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
        return others[100 * both >= 80 * (self.n[i] + size - both)]

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that span the linked members: each member reached is compared with those that are not reached yet."""
        left = np.arange(len(self.n))
        while len(left):
            waiting, left = [left[0]], left[1:]
            while waiting and len(left):
                i = waiting.pop()
                found = self.near(i, left)
                yield from ((i, j) for j in found.tolist())
                waiting += found.tolist()
                left = np.setdiff1d(left, found, assume_unique=True)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node: one bucket is held at a time."""
    at, rows = None, []

    def out() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            node, n, sketch, members = zip(*rows, strict=True)
            if found := [(node[i], node[j]) for i, j in Bucket(np.array(n), list(sketch), list(members)).links()]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
            if key != at:
                yield from out()
                at, rows = key, []
            if not rows or rows[-1][0] != row[0]:  # tasks may each have sent the same node
                rows.append(row)
    yield from out()


def _to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, the pivot of the key, and whether the two are linked."""
    for batch in batches:
        linked = []
        for n, sketch, members, pivot in zip(*(batch.column(c).to_pylist() for c in ("n", "sketch", "members", "pivot")), strict=True):
            pair = Bucket(np.array([pivot["n"], n]), [pivot["sketch"], sketch], [pivot["members"], members])
            linked.append(len(pair.near(0, np.array([1]))) > 0)
        pivots = pa.array([x["node"] for x in batch.column("pivot").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), pivots, pa.array(linked)], ["key", "node", "pivot", "linked"])


def _in_blocks(judged: DataFrame, block: int) -> DataFrame:
    """node and key of groups of two blocks each, in which every member that is not linked to its pivot meets all others."""
    sizes = judged.groupBy("key").agg(*(F.ceil(F.count_if(c) / (block // 2)).cast("int").alias(k) for k, c in (("rest", ~F.col("linked")), ("whole", F.col("linked")))))
    rows = judged.join(sizes.where("rest > 0"), "key")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("whole")).otherwise(F.col("rest"))).cast("int")
    rests = F.sequence(F.lit(0), F.col("rest") - 1)
    wholes = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    with_rest = F.transform(rests, lambda j: F.struct(F.least(mine, j).alias("a"), F.greatest(mine, j).alias("b"), F.lit(False).alias("whole")))
    cross = lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.lit(True).alias("whole"))
    groups = F.when(F.col("linked"), F.transform(rests, lambda i: cross(i, mine))).otherwise(F.concat(with_rest, F.transform(wholes, lambda k: cross(mine, k))))
    return rows.select("node", F.col("key").alias("bucket"), F.explode(groups).alias("g")).select("node", F.xxhash64("bucket", "g.a", "g.b", "g.whole").alias("key"))


def meet(keyed: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """keyed: key, node of a written table. rows: the same with n, sketch, members. Links (a, b) that span the linked nodes of each bucket."""
    large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("key"))
    if large.isEmpty():
        return _met(rows)
    hot = rows.join(large, "key", "left_semi")
    pivots = written(hot.groupBy("key").agg(F.min_by(F.struct("node", "n", "sketch", "members"), F.xxhash64("node")).alias("pivot")))
    judged = written(hot.join(pivots, "key").select("key", "node", "n", "sketch", "members", "pivot").mapInArrow(tidy(_to_pivot), "key long, node long, pivot long, linked boolean"))
    found = judged.where("linked and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    # A hot node is in several hot buckets, but its payload is the same in each.
    held = hot.select("node", "n", "sketch", "members").dropDuplicates(["node"])
    rest = rows.join(large, "key", "left_anti").select(*COLUMNS).unionByName(_in_blocks(judged, block).join(held, "node").select(*COLUMNS))
    return found.unionByName(_met(rest))


COLUMNS = ("key", "node", "n", "sketch", "members")


def _met(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS).repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(_links), "a long, b long")


def buckets(nodes: DataFrame) -> DataFrame:
    """node and key of the buckets with several nodes; buckets with the same members are one."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # Most keys have one node: they are told apart by counts alone, before anything else is added up.
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    shared = written(keyed.join(several, "key"))
    named_by = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("all"))
    return shared.join(named_by, "key").select("node", F.xxhash64("all", "size").alias("key")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each node that a row was found for, once for a task: a row found by its key alone may have another set."""
    seen: set[int] = set()
    for batch in batches:
        at, data = text_bytes(batch.column("text"))
        nodes, digests = batch.column("node").to_pylist(), batch.column("digest").to_pylist()
        for lo, hi in chunks(at, CHUNK):
            members, taken = [], []
            for i, x in enumerate(shingle_sets(at[lo : hi + 1], data), lo):
                if nodes[i] not in seen and xxhash.xxh3_128_digest(x.tobytes()) == digests[i]:
                    seen.add(nodes[i])
                    taken.append(i)
                    members.append(x.tobytes())
            if taken:
                part = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in COLUMNS[:-1]), pa.array(members, pa.binary())], list(COLUMNS))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) of each row."""
    spark = docs.sparkSession
    table = written(signatures(docs))
    same = table.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()))
    keyed = written(buckets(nodes))
    held = nodes.select("node", "n", "sketch", F.lit(None).cast("binary").alias("members"))
    grouped = components(meet(keyed, keyed.join(held, "node"), SKETCHES)).withColumnRenamed("root", "key")
    wanted = written(nodes.join(grouped, "node").select("rk", "digest", *COLUMNS[:-1]))
    sought = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
    found = _rows(docs).join(sought, "rk").select("text", "digest", *COLUMNS[:-1])
    sets = written(found.mapInArrow(tidy(_sets), "key long, node long, n long, sketch binary, members binary"))
    with small_batches(spark, BATCH):
        links = written(meet(sets, sets, SETS))
    roots = components(links)
    found = named(nodes.select("node", "least").join(roots, "node", "left"))
    of_set = nodes.select("node", "digest").join(found, "node").select("digest", "component_id")
    linked = table.where("digest is not null").join(of_set, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(table.where("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
