"""Suffix-array dedup: bytes covered by a long string that starts more than once anywhere are removed.

Windows of ``length`` bytes are dealt out by minimiser (``windows.py``). In a bucket, the packed runs become one text
whose Burrows-Wheeler transform is extended backward breadth first: level by level the intervals of all strings of
that length yield the common prefixes of that value, and the levels stop at the minimum length. Neighbours in suffix
order whose common prefix got no value by then share at least ``length`` bytes.

Null and empty texts have no bytes and lose none; a text shorter than ``length`` loses none. Repeated rows count as
separate documents, so all lose what they share. Rows keep their count; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideline.llm.common import text_bytes
from strideline.llm.windows import HOT, Rule, byte_tokens, covered, longer_grams, row_ids, with_marks

LENGTH = 400
#: Bytes of the grams whose least hash deals out a window.
GRAM = 24


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` (bytes) in order of their first ``depth`` bytes at least, by prefix doubling from seven.

    A suffix that is alone in its group keeps its place, so later rounds sort only the others.
    """
    n, span = len(codes), 7
    key = np.zeros(n, np.int64)
    for i in range(span):
        key[: n - i] |= codes[i:].astype(np.int64) << (8 * (span - 1 - i))
    order = np.argsort(key)
    key, place, rank = key[order], np.arange(n), np.empty(n, np.int64)
    held = order
    while True:
        new = np.empty(len(key), bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[held] = place[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        shared = ~(new & np.append(new[1:], True))
        held, place = held[shared], place[shared]
        if span >= depth or not len(held):
            return order
        after = held + span
        key = (rank[held] << 32) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, held = key[by], held[by]
        order[place] = held
        span *= 2


def common_prefixes(codes: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, where under ``least``; else ``least``.

    An interval of the suffixes that begin with some string, extended backward by each byte before them, is the
    interval of a string one longer. Where one ends, the common prefix has the length of the string before the
    extension, unless a shorter string's interval ended there already. An interval is read by the transform's runs of
    equal bytes, of which repeated text has few.
    """
    n = len(codes)
    bwt = codes[order - 1]  # the text is read as a circle
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    run_start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    run_end, byte = np.append(run_start[1:], n), bwt[run_start]
    run = np.repeat(np.arange(len(run_start)), run_end - run_start)
    lcp = np.full(n + 1, least, np.int32)
    lcp[0] = lcp[n] = 0
    left, right = np.array([0]), np.array([n])
    for value in range(least):
        first = run[left]
        width = run[right - 1] - first + 1
        ends = np.cumsum(width)
        each = np.repeat(np.arange(len(left)), width)
        at = np.arange(ends[-1]) + (first - ends + width)[each]
        by = np.argsort(byte[at], kind="stable")
        at, each = at[by], each[by]
        symbol = byte[at]
        edge = np.empty(len(by), bool)
        edge[0] = True
        edge[1:] = (symbol[1:] != symbol[:-1]) | (each[1:] != each[:-1])
        head = np.flatnonzero(edge)
        tail = np.append(head[1:], len(by)) - 1
        lo = back[np.maximum(run_start[at[head]], left[each[head]])]
        hi = back[np.minimum(run_end[at[tail]], right[each[tail]]) - 1] + 1
        fresh = lcp[hi] == least
        left, right = lo[fresh], hi[fresh]
        lcp[right] = value
        if not len(left):
            break
        keep = np.argsort(left)
        left, right = left[keep], right[keep]
    return lcp[:n]


def repeated_windows(strings: list[bytes], n: np.ndarray, doc_id: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each packed run, which of its windows start more than once in the bucket."""
    size = np.array([len(s) for s in strings])
    codes = np.full(int(size.sum()) + len(size), 255, np.uint8)  # after each run a byte that UTF-8 never has; no window spans it
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    for a, s in zip(first, strings, strict=True):
        codes[a : a + len(s)] = np.frombuffer(s, np.uint8)
    order = suffix_order(codes, length)
    group = np.cumsum(common_prefixes(codes, order, length) < length)
    starts = np.zeros(len(codes), bool)
    for a, k in zip(first, n, strict=True):
        starts[a : a + k] = True
    held = starts[order]
    count = np.bincount(group[held], minlength=group[-1] + 1)
    flags = np.zeros(len(codes), bool)
    flags[order] = held & (count[group] > 1)
    return [flags[a : a + k] for a, k in zip(first, n, strict=True)]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (the remaining bytes)."""
    rule = Rule(length, longer_grams(GRAM, length), byte_tokens, within=True, hot=hot)

    def solver(strings: list[bytes], n: np.ndarray, doc_id: np.ndarray) -> list[np.ndarray]:
        return repeated_windows(strings, n, doc_id, length)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            marks = batch.column("marks")
            rows = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                spans = covered(marks[i].as_py(), b - a, length)
                ends = [0, *(x for s in spans for x in s), b - a]
                kept = b"".join(data[a + x : a + y] for x, y in zip(ends[::2], ends[1::2], strict=True))
                rows.append((b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text])

    marked = with_marks(row_ids(docs), rule, solver)
    return marked.select("doc_id", "text", "marks").mapInArrow(finish, SCHEMA + ", kept binary" * keep_text)
