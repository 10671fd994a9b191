"""Substring dedup: words covered by a long word window that an earlier document also has are removed.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as one packed string to its bucket
(``windows.py``), where the windows are sorted and counted exactly.

Null and empty texts have no words. A document with fewer words than a window loses none. Rows with the same id are
one document: only a smaller id counts. A null id counts as the largest. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import text_bytes
from strideline.llm.windows import HOT, Rule, covered, longer_grams, row_ids, with_marks, word_tokens

LENGTH = 50
#: Words of the grams whose least hash deals out a window.
GRAM = 10


def window_ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for each window start, equal for equal windows, by sorting doubled prefixes."""
    rank, span = ids, 1
    while 2 * span <= length:
        rank = np.unique(rank[:-span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)[1]
        span *= 2
    if span < length:
        rest = length - span
        rank = np.unique(rank[:-rest] * (int(rank.max()) + 1) + rank[rest:], return_inverse=True)[1]
    return rank


def later_windows(strings: list[bytes], n: np.ndarray, doc_id: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each packed run, which of its windows are also in a run of a smaller document."""
    names: dict[bytes, int] = {}
    words = [[names.setdefault(w, len(names) + 1) for w in s.split(b" ")] for s in strings]
    size = np.array([len(w) for w in words])
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    rank = window_ranks(np.concatenate([np.array(w, np.int64) for w in words]), length)
    starts = np.concatenate([a + np.arange(k) for a, k in zip(first, n, strict=True)])
    owner = np.repeat(doc_id, n)
    order = np.lexsort((owner, rank[starts]))
    sorted_rank, sorted_owner = rank[starts][order], owner[order]
    new = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    flags = np.empty(len(starts), bool)
    flags[order] = sorted_owner[new][np.cumsum(new) - 1] < sorted_owner
    return np.split(flags, np.cumsum(n)[:-1])


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
LARGEST = (1 << 63) - 1


def dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, ``kept`` (the remaining words, one space between)."""
    rule = Rule(length, longer_grams(GRAM, length), word_tokens, within=False, hot=hot)

    def solver(strings: list[bytes], n: np.ndarray, doc_id: np.ndarray) -> list[np.ndarray]:
        return later_windows(strings, n, doc_id, length)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            marks = batch.column("marks")
            rows = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                words = data[a:b].split()
                spans = covered(marks[i].as_py(), len(words), length)
                ends = [0, *(x for s in spans for x in s), len(words)]
                kept = [w for x, y in zip(ends[::2], ends[1::2], strict=True) for w in words[x:y]] if spans else words
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *[joined] * keep_text))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text])

    rows = row_ids(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LARGEST)))
    marked = with_marks(rows, rule, solver).withColumn("doc_id", F.nullif("doc_id", F.lit(LARGEST)))
    return marked.select("doc_id", "text", "marks").mapInArrow(finish, SCHEMA + ", kept binary" * keep_text)
