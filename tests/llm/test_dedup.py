"""SimHash groups, suffix dedup and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm import cases
from strideline.llm import simhash_dedup, substring_dedup, suffix_dedup, windows
from strideline.llm.common import documents


def fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows: list[tuple]) -> list[tuple]:
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    members: dict[int, list[int]] = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return cases.ordered((d, f"{fps[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows))


def found(df) -> list[tuple]:
    return cases.ordered((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in df.collect())


def test_simhash_of_the_corpus(spark, sf):
    docs = documents(spark, sf)
    assert found(simhash_dedup.near_groups(docs)) == groups(cases.pairs(docs))


def test_simhash_of_odd_rows(spark):
    docs = cases.odd(spark)
    assert found(simhash_dedup.near_groups(docs)) == groups(cases.odd_rows() and [(r[0], r[1]) for r in cases.odd_rows()])
    assert simhash_dedup.near_groups(cases.none(spark)).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(11) == 0 and ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids


def test_links_reach_every_pair_in_range(spark, monkeypatch):
    """Random fingerprints at 0 to 6 bits from others, with buckets split into small blocks."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:60]:
        fps += [f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(7)]
    fps += [(0xABC << 42) | rng.getrandbits(42) for _ in range(80)]
    fps = list(dict.fromkeys(fps))
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from strideline.llm.components import components

    root = {r["node"] % (1 << 64): r["root"] for r in components(simhash_dedup.links(table)).collect()}
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[a] > label[b]:
                    label[a] = label[b]
                    changed = True
    mine = {f: root.get(f, f) for f in fps}
    assert Counter(Counter(label.values()).values()) == Counter(Counter(mine.values()).values())
    assert all((label[a] == label[b]) == (mine[a] == mine[b]) for a in fps for b in fps[:80])


def suffix_brute(rows: list[tuple], length: int) -> list[tuple]:
    docs = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return cases.ordered(out)


def words_brute(rows: list[tuple], length: int) -> list[tuple]:
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    big = 1 << 70
    least: dict[tuple, int] = {}
    for d, w in docs:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            least[key] = min(least.get(key, big), big if d is None else d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < (big if d is None else d):
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return cases.ordered(out)


def test_suffix_dedup_of_the_corpus(spark, sf):
    docs = documents(spark, sf)
    assert cases.ordered(suffix_dedup.dedup(docs).collect()) == suffix_brute(cases.pairs(docs), 400)


def test_substring_dedup_of_the_corpus(spark, sf):
    docs = documents(spark, sf)
    assert cases.ordered(substring_dedup.dedup(docs).collect()) == words_brute(cases.pairs(docs), 50)


def test_dedup_of_odd_rows(spark):
    rows = [(r[0], r[1]) for r in cases.odd_rows()]
    assert cases.ordered(suffix_dedup.dedup(cases.odd(spark)).collect()) == suffix_brute(rows, 400)
    assert cases.ordered(substring_dedup.dedup(cases.odd(spark)).collect()) == words_brute(rows, 50)
    assert suffix_dedup.dedup(cases.none(spark)).count() == 0 and substring_dedup.dedup(cases.none(spark)).count() == 0


@pytest.mark.parametrize(("hot", "run"), [(1500, 1024), (2, 1024), (0, 4)])
def test_dedup_of_small_alphabets(spark, monkeypatch, hot, run):
    """Short windows over few letters: many overlaps, ties of minimisers, and (hot: 2, 0) minimisers split by longer grams."""
    monkeypatch.setattr(windows, "RUN", run)
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    texts = [*base, *(b[3:] + c[:9] for b, c in zip(base, base[1:], strict=False)), "a" * 50, "ab" * 30, "ba" * 30]
    rows = list(enumerate(texts))
    assert cases.ordered(suffix_dedup.dedup(cases.table(spark, texts), length=12, hot=hot).collect()) == suffix_brute(rows, 12)
    spaced = [" ".join(t) for t in texts]
    assert cases.ordered(substring_dedup.dedup(cases.table(spark, spaced), length=12, hot=hot).collect()) == words_brute(list(enumerate(spaced)), 12)


def test_a_passage_in_very_many_surroundings(spark):
    """Every document holds the same passage between words of its own, so its minimisers are hot at every gram but the last."""
    passage = cases.prose(70, 9)
    texts = [f"{cases.prose(3 + k % 50, 1000 + k)} {passage} {cases.prose(k % 40, 5000 + k)}" for k in range(60)]
    rows = list(enumerate(texts))
    docs = cases.table(spark, texts)
    assert cases.ordered(suffix_dedup.dedup(docs, length=150, hot=5).collect()) == suffix_brute(rows, 150)
    assert cases.ordered(substring_dedup.dedup(docs, length=40, hot=5).collect()) == words_brute(rows, 40)


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_against_sorted_suffixes(seed):
    """Common prefixes of neighbours in suffix order, below the least length, with repeats and zero bytes."""
    rng = np.random.default_rng(seed)
    part, cut = rng.integers(0, 3, 40).astype(np.uint8), np.full(1, 255, np.uint8)
    codes = np.concatenate([part, rng.integers(0, 3, 30).astype(np.uint8), cut, part, part[5:], cut] if seed else [np.zeros(50, np.uint8), cut])
    least = 12
    order = suffix_dedup.suffix_order(codes, least)
    raw = codes.tobytes()
    heads = [raw[i : i + least] for i in order]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(codes)))
    lcp = suffix_dedup.common_prefixes(codes, order, least)
    full = [i for i in range(1, len(order)) if min(order[i], order[i - 1]) + least < len(raw) and max(order[i], order[i - 1]) + least < len(raw)]
    for i in full:
        a, b = heads[i - 1], heads[i]
        assert lcp[i] == next((k for k in range(least) if a[k] != b[k]), least)
