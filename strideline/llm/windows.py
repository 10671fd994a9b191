"""Exact search for windows that several documents share, dealt out by minimiser.

A window is ``length`` consecutive tokens (bytes or words) of one document. Its minimiser is the least hash of its
``k``-token grams, so equal windows have equal minimisers. Consecutive windows with the same minimiser form a run
(a super-k-mer), which is named by its minimiser and a hash of its tokens. The steps:

1. ``runs``: one narrow pass over the texts writes a row of hashes for each run; no text is shuffled.
2. Equal runs meet in a ``groupBy`` with map-side combining, so a group of copies of any size is one row afterwards.
3. A minimiser with several different runs is contested: only there can windows be equal while their runs differ. One
   representative of each of its runs is cut from the texts again and travels as a packed string to the
   bucket of its minimiser, where a solver compares the windows.
4. A minimiser with more than ``hot`` different runs is split: its packed runs take the same steps as if they were
   documents, with the next longer gram of ``Rule.grams``. The last gram is a whole window, so a passage that very many
   documents share in different surroundings ends as equal runs of one window, which meet in step 2. No bucket grows
   with the corpus, and windows are compared by the same solver at every size.
5. Marks come back to the documents as ranges of window starts.

A row is named by 128 bits of its id and whole text, a run by its minimiser and 64 bits of its tokens; rows with the
same id and text have the same marks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import chunks, text_bytes, texts, written

#: Bytes of text that are hashed at once, and bytes of packed runs that a solver gets at once.
CHUNK, SOLVE = 1 << 20, 1 << 21
#: Different runs of one minimiser above which it is split by a longer gram.
HOT = 1500
#: Windows in a run at most, which bounds packed strings.
RUN = 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i]), 7) for i in range(256)), dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)]).cumprod() for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def spans_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes mod 2**64 of codes[start:end], from one prefix sum."""
    power, inverse = powers(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[: len(codes)])])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    padded = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[w - 1 : w - 1 + n])


@dataclass(frozen=True)
class Tokens:
    """A chunk of documents as tokens: where each document's tokens start, a code for each, and the packed bytes."""

    first: np.ndarray
    codes: np.ndarray
    data: bytes
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def packed(self, a: int, b: int) -> bytes:
        return self.data[a:b] if self.starts is None else self.data[self.starts[a] : self.ends[b - 1]]


def byte_tokens(at: np.ndarray, data: bytes) -> Tokens:
    part = data[at[0] : at[-1]]
    return Tokens(at - at[0], _TABLE[np.frombuffer(part, np.uint8)], part)


def word_tokens(at: np.ndarray, data: bytes) -> Tokens:
    """Words are split at white space and joined by one space, so equal word sequences have equal bytes."""
    docs = [b" ".join(data[a:b].split()) for a, b in zip(at[:-1], at[1:], strict=True)]
    counts = np.array([x.count(b" ") + 1 if x else 0 for x in docs], np.int64)
    joined = b" ".join(x for x in docs if x)
    first = np.concatenate([[0], np.cumsum(counts)])
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], gaps + 1])[: first[-1]]
    ends = np.concatenate([gaps, [len(raw)]])[: first[-1]]
    return Tokens(first, spans_hash(_TABLE[raw], starts, ends) if len(starts) else np.zeros(0, np.uint64), joined, starts, ends)


@dataclass(frozen=True)
class Rule:
    length: int
    #: Tokens of the grams whose least hash deals out a window, shortest first; the last is a whole window.
    grams: tuple[int, ...]
    tokens: Callable[[np.ndarray, bytes], Tokens]
    #: Whether equal windows of one document count.
    within: bool
    hot: int = HOT


def longer_grams(first: int, length: int) -> tuple[int, ...]:
    """``first`` tokens (a quarter of a window at most), then half a window, then a whole one."""
    return tuple(sorted({max(1, min(first, length // 4)), (length + 1) // 2, length}))


def grams(t: Tokens, k: int) -> np.ndarray:
    n = len(t.codes) - k + 1
    i = np.arange(max(0, n))
    return spans_hash(t.codes, i, i + k)


def find_runs(t: Tokens, rule: Rule, k: int) -> Iterator[tuple[int, int, int, int, bool, bytes]]:
    """(document in chunk, start, windows, minimiser, whether its gram occurs again in the run, packed) of each run."""
    total = len(t.codes) - rule.length + 1
    if total <= 0:
        return
    w = rule.length - k + 1
    h = grams(t, k)
    low = sliding_min(h, w)
    size = np.diff(t.first)
    doc = np.repeat(np.arange(len(size)), size)[:total]
    place = np.arange(total)
    valid = place + rule.length <= t.first[1:][doc]
    starts = np.empty(total, bool)
    starts[0] = True
    starts[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    since = np.maximum.accumulate(np.where(starts, place, 0))
    starts |= (place - since) % RUN == 0
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], total)
    keep = valid[begin]
    begin, end = begin[keep], end[keep]
    for a, b, d, m, first in zip(begin.tolist(), end.tolist(), doc[begin].tolist(), low[begin].view(np.int64).tolist(), t.first[doc[begin]].tolist(), strict=True):
        again = rule.within and b - a > 1 and np.count_nonzero(h[a : b - 1 + w] == low[a]) > 1
        yield d, a - first, b - a, m, again, t.packed(a, b - 1 + rule.length)


RUNS = "rid binary, doc_id long, mini long, ph long, start int, n int, again boolean"


def runs(docs: DataFrame, rule: Rule, k: int) -> DataFrame:
    """docs: rid, doc_id, text. A row of hashes for each run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            rid, doc_id = batch.column("rid"), batch.column("doc_id")
            for lo, hi in chunks(at, CHUNK):
                rows = [(lo + d, m, s, n, again, xxhash.xxh3_64_intdigest(p)) for d, s, n, m, again, p in find_runs(rule.tokens(at[lo : hi + 1], data), rule, k)]
                if rows:
                    d, m, s, n, again, ph = zip(*rows, strict=True)
                    d = pa.array(d, pa.int64())
                    yield pa.RecordBatch.from_arrays([rid.take(d), doc_id.take(d), pa.array(m, pa.int64()), pa.array(np.array(ph, np.uint64).view(np.int64)), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(again)], ["rid", "doc_id", "mini", "ph", "start", "n", "again"])

    return docs.select("rid", "doc_id", "text").mapInArrow(scan, RUNS)


PACKED = "mini long, ph long, doc_id long, n int, packed binary, hot boolean"


def cut(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """Packed strings of the wanted runs (rid, mini, ph, start, n, hot), cut from the texts again."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("mini", "ph", "start", "n", "hot")).alias("wanted"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            lists, ids = batch.column("wanted"), batch.column("doc_id").to_pylist()
            for lo, hi in chunks(at, CHUNK):
                t = rule.tokens(at[lo : hi + 1], data)
                rows = []
                for i in range(lo, hi):
                    first = int(t.first[i - lo])
                    rows += [(x["mini"], x["ph"], ids[i], x["n"], t.packed(first + x["start"], first + x["start"] + x["n"] - 1 + rule.length), x["hot"]) for x in lists[i].as_py()]
                for i in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 2000], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["mini", "ph", "doc_id", "n", "packed", "hot"])

    return docs.join(lists, "rid").select("doc_id", "text", "wanted").mapInArrow(scan, PACKED)


def ranges(flags: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of true values as {from, to}, ``to`` excluded."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


MARKS = "mini long, ph long, marks array<struct<from:int,to:int>>"
Solver = Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


def _marks_batch(mini: list, ph: list, flags: list[np.ndarray]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(mini, pa.int64()), pa.array(ph, pa.int64()), pa.array([ranges(f) for f in flags], kind)], ["mini", "ph", "marks"])


def solve(packed: DataFrame, solver: Solver) -> DataFrame:
    """Windows in each bucket, compared by ``solver`` over whole buckets of about SOLVE bytes together."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            mini, ph, doc_id, n, strings = zip(*rows, strict=True)
            flags = solver(list(strings), np.array(n), np.array([-1 if x is None else x for x in doc_id], np.int64))
            some = [i for i, f in enumerate(flags) if f.any()]
            if some:
                yield _marks_batch([mini[i] for i in some], [ph[i] for i in some], [flags[i] for i in some])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("mini", "ph", "doc_id", "n", "packed")), strict=True):
                if rows and size > SOLVE and rows[-1][0] != row[0]:
                    yield from out()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield from out()

    parts = packed.repartition("mini").sortWithinPartitions("mini")
    return parts.select("mini", "ph", "doc_id", "n", "packed").mapInArrow(scan, MARKS)


def marks_of(docs: DataFrame, rule: Rule, solver: Solver, level: int = 0) -> DataFrame:
    """docs: rid, doc_id, text. rid and marks (ranges of window starts to remove) of the rows that have any.

    A window is marked if it also starts elsewhere (rule.within), or else in a document with a smaller id.
    """
    last = level + 1 == len(rule.grams)
    table = written(runs(docs, rule, rule.grams[level]))
    least = F.min(F.struct("doc_id", "rid", "start", "n")).alias("rep")
    same = table.groupBy("mini", "ph").agg(F.count(F.lit(1)).alias("copies"), least, F.max("again").alias("again"))
    named = same.groupBy("mini").agg(F.count(F.lit(1)).alias("runs"), F.max("again").alias("any_again"))
    contested = named.where((F.col("runs") > 1) | F.col("any_again") if rule.within else F.col("runs") > 1)
    wanted = same.join(contested.select("mini", "runs"), "mini").select("mini", "ph", "rep.*", (F.lit(not last) & (F.col("runs") > rule.hot)).alias("hot"))
    packed = written(cut(docs, wanted, rule))
    marks = solve(packed.where("not hot"), solver)
    hot = packed.where("hot").select(F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("mini", "ph")])).alias("rid"), "doc_id", F.col("packed").alias("text"), "mini", "ph")
    if not last and not hot.isEmpty():
        split = marks_of(hot.select("rid", "doc_id", "text"), rule, solver, level + 1)
        marks = marks.unionByName(split.join(hot.select("rid", "mini", "ph"), "rid").select("mini", "ph", "marks"))
    found = same.where("copies > 1").select("mini", "ph", "copies", F.col("rep.doc_id").alias("least")).join(marks, ["mini", "ph"], "full")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to")))
    part = F.when(F.coalesce("copies", F.lit(1)) > 1 if rule.within else F.col("doc_id") > F.col("least"), whole).otherwise(F.col("marks"))
    hits = table.join(found, ["mini", "ph"]).select("rid", F.col("start"), part.alias("part")).where(F.size("part") > 0)
    shifted = F.transform("part", lambda x: F.struct((x["from"] + F.col("start")).alias("from"), (x["to"] + F.col("start")).alias("to")))
    return hits.groupBy("rid").agg(F.flatten(F.collect_list(shifted)).alias("marks"))


def with_marks(docs: DataFrame, rule: Rule, solver: Solver) -> DataFrame:
    """docs: rid, doc_id, text and more. Adds ``marks``: ranges of window starts to remove (null: none)."""
    return docs.join(marks_of(docs, rule, solver), "rid", "left")


def row_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and rid, which names a row by its id and whole text."""
    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("rid", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"))))


def covered(marks: list[dict[str, int]] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Token spans that marked windows cover: disjoint, in order, touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted((x["from"], x["to"] + length - 1) for x in marks or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]
