"""Benchmark decontamination: a BM25 inverted index of test items, queried block-max WAND style by every passage.

An item is cut into units of at most ``UNIT`` words, each with BM25 weights divided by its score for itself, so that a
passage that holds the whole unit scores 1. A term has a posting list of units in order, cut into blocks at every
``BLOCK`` units, with the largest weight in each. Every document is cut into overlapping passages of ``STRIDE * SPAN``
words, so that some passage holds any unit whole, and each passage is a query. Its sum of block maxima bounds the score
of all units of a block: blocks below the threshold are passed over (for many passages at once). In the others a cursor
stands in each posting list; in the order of their units, the first cursors whose block maxima reach the threshold
together name the pivot; cursors before it move up to it, and it is scored when they have. All units at or above the
threshold are retrieved. A retrieved item is verified against the whole document: at least ``OVERLAP`` of the five-word
shingles of its question (all sentences but the last) and of its answer (the last) must occur there.

The index is sent to the executors in parts of at most ``ITEMS`` items, one narrow pass over the texts each, so what is broadcast
has a fixed bound. Null and empty texts match nothing; items without words are left out. Repeated rows match alike;
repeated items count each. Extra columns stay in ``without_leaks`` and are not returned by ``leaks``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import texts, tidy
from strideline.llm.windows import spans_hash
from strideline.llm.words import batches, words_of

UNIT, STRIDE, SPAN, BLOCK = 64, 32, 3, 8
THRESHOLD, SHINGLE, OVERLAP = 0.6, 5, 0.8
K1, B = 1.2, 0.75
#: Bounds are sums of rounded numbers: a block or pivot is passed over only if it is below the threshold by more than this.
SLACK = 1e-4
ITEMS, CHUNK = 8192, 1 << 19
#: Units in one dense part of the index, which bounds the arrays of block maxima.
PART = 1024


@dataclass(frozen=True)
class Part:
    """Terms (sorted hashes), block maxima (a last row of zeros is for other words), posting lists, items of units.

    The postings of term t are ``unit`` and ``weight`` from ``list_at[t]`` to ``list_at[t + 1]``.
    """

    terms: np.ndarray
    maxima: np.ndarray
    list_at: list[int]
    unit: list[int]
    weight: list[float]
    item: np.ndarray


@dataclass(frozen=True)
class Index:
    ids: list[int]
    shingles: list[tuple[np.ndarray, np.ndarray]]
    parts: list[Part]


def shingle_hashes(word: np.ndarray) -> np.ndarray:
    """Hashes of five-word shingles; of fewer words, of the whole sequence."""
    if not len(word):
        return word
    n = max(1, len(word) - SHINGLE + 1)
    i = np.arange(n)
    return spans_hash(word, i, np.minimum(i + SHINGLE, len(word)))


def question_and_answer(text: str) -> tuple[str, str]:
    """All sentences but the last, and the last; a single sentence is halved."""
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if re.search(r"\w", s)]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


def build(rows: list[tuple[int, str]]) -> Index:
    ids, shingles, units, item = [], [], [], []
    for item_id, text in rows:
        _, word = words_of([text])
        if not len(word):
            continue
        halves = [words_of([t])[1] for t in question_and_answer(text)]
        if min(map(len, halves)) < SHINGLE:  # too short to stand alone: both are the whole item
            halves = [word, word]
        shingles.append(tuple(shingle_hashes(h) for h in halves))
        for i in range(0, len(word), UNIT):
            units.append(word[i : i + UNIT])
            item.append(len(ids))
        ids.append(item_id)
    if not units:
        return Index([], [], [])
    terms, df = np.unique(np.concatenate([np.unique(u) for u in units]), return_counts=True)
    idf = np.log(1 + (len(units) - df + 0.5) / (df + 0.5))
    average = float(np.mean([len(u) for u in units]))
    parts = []
    for a in range(0, len(units), PART):
        own = units[a : a + PART]
        here = np.unique(np.concatenate(own))
        maxima = np.zeros((len(here) + 1, -(-len(own) // BLOCK)), np.float32)
        lists: list[list[tuple[int, float]]] = [[] for _ in here]
        for j, u in enumerate(own):
            t, tf = np.unique(u, return_counts=True)
            w = idf[np.searchsorted(terms, t)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(u) / average))
            w = (w / w.sum()).astype(np.float32)
            at = np.searchsorted(here, t)
            maxima[at, j // BLOCK] = np.maximum(maxima[at, j // BLOCK], w)
            for k, x in zip(at.tolist(), w.tolist(), strict=True):
                lists[k].append((j, x))
        flat = [x for posting in lists for x in posting]
        list_at = [0, *np.cumsum([len(x) for x in lists]).tolist()]
        parts.append(Part(here, maxima, list_at, [j for j, _ in flat], [x for _, x in flat], np.array(item[a : a + PART])))
    return Index(ids, shingles, parts)


def wand(part: Part, terms: list[int], block: int, least: float = THRESHOLD) -> Iterator[tuple[int, float]]:
    """Units of the block that score at least ``least`` for a passage of these terms, and their scores."""
    end = (block + 1) * BLOCK
    cursors = []  # [unit, place in the postings, end of the list, block maximum]
    for t in terms:
        stop = part.list_at[t + 1]
        at = bisect_left(part.unit, block * BLOCK, part.list_at[t], stop)
        if at < stop and part.unit[at] < end:
            cursors.append([part.unit[at], at, stop, float(part.maxima[t, block])])
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, None
        for unit, _, _, most in cursors:
            bound += most
            if bound >= least - SLACK:
                pivot = unit
                break
        if pivot is None:
            return
        if cursors[0][0] == pivot:
            score = sum(part.weight[at] for unit, at, _, _ in cursors if unit == pivot)
            if score >= least:
                yield pivot, score
            pivot += 1
        left = []
        for c in cursors:
            if c[0] < pivot:
                c[1] = bisect_left(part.unit, pivot, c[1], c[2])
                if c[1] == c[2] or part.unit[c[1]] >= end:
                    continue
                c[0] = part.unit[c[1]]
            left.append(c)
        cursors = left


def candidates(part: Part, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, items and scores of all passages and units at or above the threshold."""
    place = np.minimum(np.searchsorted(part.terms, word), len(part.terms) - 1)
    term = np.where(part.terms[place] == word, place, len(part.terms))
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    first = np.flatnonzero(new)
    within = np.arange(len(doc)) - first[np.cumsum(new) - 1]
    cut = np.flatnonzero(within % STRIDE == 0)  # strides never cross documents
    sums = np.add.reduceat(part.maxima[term], cut, axis=0)
    owner, bound = doc[cut], sums.copy()
    for k in range(1, SPAN):
        bound[:-k] += np.where((owner[k:] == owner[:-k])[:, None], sums[k:], 0)
    passage, block = np.nonzero(bound >= THRESHOLD - SLACK)
    ends = np.append(cut, len(doc))
    found: list[tuple[int, int, float]] = []
    held, own = -1, []
    for p, k in zip(passage.tolist(), block.tolist(), strict=True):
        if p != held:
            last = p + 1
            while last < len(cut) and last < p + SPAN and owner[last] == owner[p]:
                last += 1
            held, own = p, np.unique(term[ends[p] : ends[last]]).tolist()
            own = own[:-1] if own[-1] == len(part.terms) else own
        found += [(owner[p], part.item[unit], score) for unit, score in wand(part, own, k)]
    return tuple(np.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.int64, float), strict=True))


def matches(index: Index, docs: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
    """(document, item, score, overlap of the question, overlap of the answer) of verified matches."""
    for lo, hi in batches(docs, CHUNK):
        doc, word = words_of(docs[lo:hi])
        if not len(doc):
            continue
        best: dict[tuple[int, int], float] = {}
        for part in index.parts:
            for d, i, s in zip(*(x.tolist() for x in candidates(part, doc, word)), strict=True):
                best[d, i] = max(s, best.get((d, i), 0.0))
        held = (-1, np.zeros(0, np.uint64))
        for (d, i), s in sorted(best.items()):
            if held[0] != d:
                own = word[np.searchsorted(doc, d) : np.searchsorted(doc, d + 1)]
                sizes = {len(x) for x in index.shingles[i] if len(x)}
                held = (d, shingle_hashes(own)) if sizes else held
            overlap = [float(np.isin(x, held[1]).mean()) if len(x) else 1.0 for x in index.shingles[i]]
            if min(overlap) >= OVERLAP or _short(index.shingles[i], word[np.searchsorted(doc, d) : np.searchsorted(doc, d + 1)]):
                yield lo + d, i, s, overlap[0], overlap[1]


def _short(shingles: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> bool:
    """Whether an item of fewer words than a shingle stands in the document."""
    if len(shingles[0]) > 1:
        return False
    for n in range(1, SHINGLE):
        i = np.arange(max(0, len(own) - n + 1))
        if np.isin(shingles[0], spans_hash(own, i, i + n)).all() and len(i):
            return True
    return False


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of at most about ``ITEMS`` items each."""
    items = texts(benchmark, F.col("item_id").cast("long").alias("item_id")).where(F.length("text") > 0)
    parts = max(1, -(-items.count() // ITEMS))
    for k in range(parts):
        yield build(sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()), key=lambda r: (r[0] is None, r)))


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap."""
    own = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    out = None
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def scan(rows: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                found = list(matches(sent.value, batch.column("text").to_pylist()))
                if found:
                    d, i, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([sent.value.ids[k] for k in i], pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = own.mapInArrow(scan, LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    out = docs
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def scan(rows: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                held = {d for d, *_ in matches(sent.value, [t or "" for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([i not in held for i in range(len(batch))], pa.bool_())) if held else batch

        out = out.mapInArrow(tidy(scan), docs.schema)
    return out
