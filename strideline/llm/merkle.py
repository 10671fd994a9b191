"""Merkle manifest of a data set: a digest for every document, a tree for every language, a tree over the languages.

A leaf is the SHA-256 of a row's fields, a parent that of its children's hex digests. Steps:

1. ``ranked``: rows are sorted over range partitions and counted by partition, so the place of a leaf needs no sort of a
   whole language in one task.
2. ``climb``, an event-driven combine by key: a partial parent gathers digests of indexed children. How many it needs
   follows from the size of its level alone. When the last one arrives, the parent becomes a child of its own parent.
   Leaves come in runs, so a task resolves whole subtrees and holds some nodes of each level.
3. Children whose parent stayed incomplete are the frontier. It is dealt by a common ancestor and combined again, until
   only the tops are left. A frontier has a few nodes for each level and task.
4. Each complete parent leaves reverse links, from a child to its siblings. ``paths`` gathers them in blocks of
   ``DEPTH`` levels from the top down and appends what is known of the block's own top, so that a block has at most
   2 ** (DEPTH + 1) links at any size.

Rows without an id come first in their language; rows with one id follow the order of their leaves, and equal rows are
as many equal leaves. Null fields, null languages and null texts have digests of their own, and an empty text is no null.
An empty table has no rows. Extra columns are neither hashed nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from math import ceil, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.common import tidy, written

#: Children of a parent, and levels whose links are gathered together.
ARITY, DEPTH = 2, 8
#: Incomplete parents that a task holds, rows it hands out at once, nodes of a frontier that meet in a group (about).
HELD, OUT, GROUP = 1 << 17, 4096, 1 << 12
#: Runs of ranks (one for each partition and tree) that are broadcast; more are shuffled.
RUNS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LINK, FRONTIER, TOP = 0, 1, 2
ABOVE, BESIDE, ASKED = 0, 1, 2
NODES = "kind int, tree string, level int, idx long, n long, digest binary"


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row; ``changed`` replaces fields."""
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256))


def leaves(docs: DataFrame, **extra: Column) -> DataFrame:
    """tree, doc_id, leaf and the columns ``extra``. A tree is a language, named so that names sort null first."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree")
    return docs.select(tree, F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), *[c.alias(k) for k, c in extra.items()])


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with a column tree: adds idx, from 0 in the given order in each tree, and n, the size of the tree."""
    # The last key only parts rows that are equal in all others.
    salted = rows.withColumn("salt", F.rand(7))
    keys = ["tree", *order, "salt"]
    table = written(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id()))
    table = table.withColumn("part", F.shiftright("at", 33))
    tree = Window.partitionBy("tree")
    runs = table.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    runs = written(runs.select("tree", "part", (F.col("first") - before).alias("shift"), F.sum("rows").over(tree).alias("n")))
    runs = F.broadcast(runs) if runs.count() <= RUNS else runs
    return table.join(runs, ["tree", "part"]).withColumn("idx", F.col("at") - F.col("shift")).drop("at", "part", "shift")


def parent_of(children: list[bytes]) -> bytes:
    return sha256("".join(x.hex() for x in children).encode()).digest()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (tree, level, idx, n, digest) to links of the complete parents, tops, and the frontier that is left."""
    held: dict[tuple[str, int, int], dict[int, bytes]] = {}
    sizes: dict[str, int] = {}
    rows: list[tuple] = []

    def put(tree: str, level: int, idx: int, digest: bytes) -> None:
        size = -(-sizes[tree] // ARITY**level)
        while size > 1:
            parent, slot = divmod(idx, ARITY)
            children = held.setdefault((tree, level, parent), {})
            children[slot] = digest
            arity = min(ARITY, size - parent * ARITY)
            if len(children) < arity:
                return
            del held[tree, level, parent]
            order = [children[i] for i in range(arity)]
            for i in range(arity):
                rows.append((LINK, tree, level, parent * ARITY + i, 0, b"".join(order[:i] + order[i + 1 :])))
            digest, level, idx, size = parent_of(order), level + 1, parent, -(-size // ARITY)
        rows.append((TOP, tree, level, 0, sizes[tree], digest))

    def let_go() -> None:
        for (tree, level, parent), children in held.items():
            rows.extend((FRONTIER, tree, level, parent * ARITY + i, sizes[tree], d) for i, d in children.items())
        held.clear()

    def out(least: int) -> Iterator[pa.RecordBatch]:
        while len(rows) >= max(1, least):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:OUT], strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "tree", "level", "idx", "n", "digest"])
            del rows[:OUT]

    for batch in batches:
        for tree, level, idx, n, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "level", "idx", "n", "digest")), strict=True):
            sizes[tree] = n
            put(tree, level, idx, digest)
            if len(held) > HELD:
                let_go()
                sizes = {tree: n}
            if len(rows) >= OUT:
                yield from out(OUT)
    let_go()
    yield from out(1)


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes: tree, idx, n, digest of all leaves. The links (tree, level, idx, siblings) and the tops (tree, level, n, digest)."""
    nodes = nodes.select("tree", F.lit(0).alias("level"), "idx", "n", "digest")
    tables, ancestor = [], 0
    while True:
        tables.append(written(nodes.mapInArrow(tidy(_combine), NODES)))
        frontier = tables[-1].where(F.col("kind") == FRONTIER)
        left, most = frontier.agg(F.count(F.lit(1)), F.max("n")).first()
        if not left:
            break
        # The level whose nodes have about GROUP of the frontier below them, and higher each time.
        ancestor = max(ancestor + 1, ceil(log(most, ARITY)) - int(log(ceil(left / GROUP), ARITY)))
        dealt = F.expr(f"idx div cast(power({ARITY}, greatest(0, {ancestor} - level)) as bigint)")
        nodes = frontier.select("tree", "level", "idx", "n", "digest").repartition("tree", dealt)
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    links = found.where(F.col("kind") == LINK).select("tree", "level", "idx", F.col("digest").alias("siblings"))
    return links, found.where(F.col("kind") == TOP).select("tree", "level", "n", "digest")


def step(slot: int, siblings: bytes) -> bytes:
    return bytes([slot, len(siblings) // 32]) + siblings


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Slot of the node and the digests of its siblings, from the leaf to the root."""
    at = 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        at += 2
        yield slot, [path[at + 32 * i : at + 32 * i + 32] for i in range(n)]
        at += 32 * n


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path give."""
    for slot, siblings in steps(path):
        digest = parent_of([*siblings[:slot], digest, *siblings[slot:]])
    return digest


def _paths(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks in order (the block's own path, its links, then the nodes asked for) to the paths of those nodes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, above, top, links = None, b"", b"", {}
        for batch in (whole.slice(i, OUT) for whole in batches for i in range(0, len(whole), OUT)):
            taken, found, tops = [], [], []
            for i, (tree, block, kind, link_level, idx, value, of) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "kind", "level", "idx", "value", "top")), strict=True)):
                if (tree, block) != at:
                    at, links = (tree, block), {}
                if kind == ABOVE:
                    above, top = value, of
                elif kind == BESIDE:
                    links[link_level, idx] = value
                else:
                    parts, node, up = [], idx, level
                    while (up, node) in links:
                        parts.append(step(node % ARITY, links[up, node]))
                        node, up = node // ARITY, up + 1
                    taken.append(i)
                    found.append(b"".join(parts) + above)
                    tops.append(top)
            if taken:
                part = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([part.column("tree"), part.column("idx"), part.column("row"), pa.array(found, pa.binary()), pa.array(tops, pa.binary())], ["tree", "idx", "row", "path", "top"])

    return scan


def paths(links: DataFrame, tops: DataFrame, above: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: tree, idx and row of leaves. Adds path and top of its tree. above: tree and path, the steps that follow a tree's own."""
    row = asked.schema["row"].dataType
    kinds = T.StructType([*(T.StructField(c, t) for c, t in (("tree", T.StringType()), ("idx", T.LongType()), ("row", row), ("path", T.BinaryType()), ("top", T.BinaryType())))])
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    deepest = tops.agg(F.max("level")).first()[0] or 0
    segment = F.greatest(F.lit(0), F.expr(f"(level - 1) div {DEPTH}"))
    own = tops.join(above, "tree").select("tree", segment.alias("segment"), F.col("digest").alias("top"), "path")
    known = None
    for s in range(max(0, deepest - 1) // DEPTH, -1, -1):
        first, last = DEPTH * s, DEPTH * (s + 1)
        block = F.expr(f"idx div cast(power({ARITY}, {last} - level) as bigint)").alias("block")
        here = links.where((F.col("level") >= first) & (F.col("level") < last))
        start = own.where(F.col("segment") == s).select("tree", zero.alias("block"), "path", "top")
        if known is not None:
            start = start.unionByName(known.select("tree", F.col("idx").alias("block"), "path", "top"))
        nodes = asked if s == 0 else here.where(F.col("level") == first).select("tree", "idx", F.lit(None).cast(row).alias("row"))
        sent = start.select("tree", "block", F.lit(ABOVE).alias("kind"), F.lit(0).alias("level"), zero.alias("idx"), F.col("path").alias("value"), "top", F.lit(None).cast(row).alias("row"))
        sent = sent.unionByName(here.select("tree", block, F.lit(BESIDE).alias("kind"), "level", "idx", F.col("siblings").alias("value"), none.alias("top"), F.lit(None).cast(row).alias("row")))
        sent = sent.unionByName(nodes.select("tree", F.expr(f"idx div {ARITY**DEPTH}").alias("block"), F.lit(ASKED).alias("kind"), F.lit(first).alias("level"), "idx", none.alias("value"), none.alias("top"), "row"))
        known = written(sent.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind").mapInArrow(tidy(_paths(first)), kinds))
    return known


def manifest(docs: DataFrame, **extra: Column) -> DataFrame:
    """doc_id, leaf, subroot, root and path (see ``steps``) of each row, all binary, with the columns ``extra``."""
    placed = ranked(written(leaves(docs, **extra)), "doc_id", "leaf")
    links, tops = climb(placed.select("tree", "idx", "n", F.col("leaf").alias("digest")))
    names = ranked(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    root_links, root = climb(names.select("tree", "idx", "n", "digest"))
    over = paths(root_links, root, docs.sparkSession.createDataFrame([("", bytearray())], "tree string, path binary"), names.select("tree", "idx", F.struct("name").alias("row")))
    above = over.select(F.col("row.name").alias("tree"), "path")
    rows = paths(links, tops, above, placed.select("tree", "idx", F.struct("doc_id", "leaf", *extra).alias("row")))
    of_all = root.select("digest").first()
    return rows.select("row.*", F.col("top").alias("subroot"), F.lit(bytes(of_all[0]) if of_all else None).cast("binary").alias("root"), "path")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proof, root = [], []
        for digest, path in zip(batch.column("shown").to_pylist(), batch.column("path").to_pylist(), strict=True):
            proof.append(sha256("".join(x.hex() for _, siblings in steps(path) for x in siblings).encode()).hexdigest())
            root.append(folded(digest, path).hex())
        keep = ("doc_id", "leaf", "subroot", "root")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(proof, pa.string()), pa.array(root, pa.string())], [*keep, "proof_sha256", "folded_root"])


def verified(rows: DataFrame, shown: str) -> DataFrame:
    """rows: a manifest with the column ``shown``, the digest that a document has now (null: its leaf). Hex digests,
    proof_sha256 (of all siblings), the root that the shown digest folds to, and whether it is the manifest's."""
    sent = rows.select("doc_id", *(F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")), F.coalesce(shown, "leaf").alias("shown"), "path")
    out = sent.mapInArrow(tidy(_folded), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
