"""Near copies of the pipeline stage against all pairs of five-word shingle sets."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from llm import cases
from strideline.llm import near_copies, simhash_dedup
from strideline.llm.common import documents


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(rows: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of rows at 0.8 or more, from counts of the shingles they share."""
    sets = [shingles(t) for _, t in rows]
    where, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            for j in where[x]:
                shared[j, i] += 1
            where[x].append(i)
    return [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]


def joined(rows: list[tuple], pairs: list[tuple[int, int]], df) -> set:
    """Components over the pairs and the SimHash groups, as sets of rows."""
    label = list(range(len(rows)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    first = {}
    by_hash = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_groups(df).collect()}
    for i, (d, _) in enumerate(rows):
        label[root(i)] = root(first.setdefault(by_hash[d], i))
    for i, j in pairs:
        label[root(i)] = root(j)
    members = defaultdict(set)
    for i, (d, _) in enumerate(rows):
        members[root(i)].add(d)
    return {(d, min(m)) for m in members.values() for d in m}


@pytest.mark.parametrize("block", [512, 4])
def test_pairs_at_the_least_similarity_are_linked(spark, monkeypatch, block):
    """Copies of 600 words with 3 to 16 of them changed, in groups; block 4 splits buckets into blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(7)
    out = []
    for g in range(20):
        base = cases.prose(600, 100 + g).split()
        out.append(" ".join(base))
        for k in (3, 6, 9, 12, 13, 16):
            copy = list(base)
            for at in rng.sample(range(len(copy)), k):
                copy[at] = f"new{rng.random()}"
            out.append(" ".join(copy))
    df = cases.table(spark, out)
    rows = cases.pairs(df)
    pairs = similar(rows)
    found = {tuple(r) for r in near_copies.near_groups(df).select("doc_id", "component_id").collect()}
    assert found == joined(rows, pairs, df)
    assert len({c for _, c in found}) < len(set(r["component_id"] for r in simhash_dedup.near_groups(df).collect()))


def test_near_copies_of_the_corpus(spark, sf):
    df = documents(spark, sf).select("doc_id", "text").dropDuplicates(["doc_id"])
    rows = cases.pairs(df)
    assert {tuple(r) for r in near_copies.near_groups(df).select("doc_id", "component_id").collect()} == joined(rows, similar(rows), df)


def test_odd_rows(spark):
    docs = cases.odd(spark)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(11) == 0 and ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids
    assert ids.count(None) == 1  # the null text without an id is a copy of document 3
    assert near_copies.keep_one(cases.none(spark)).count() == 0


@pytest.mark.parametrize("keep", [near_copies.keep_one, simhash_dedup.keep_one])
@pytest.mark.parametrize("twice", [False, True])
def test_rows_without_an_id(spark, keep, twice):
    """Copies of a row with an id go, and of copies among themselves one stays, whether or not some id occurs twice."""
    a, b = cases.prose(300, 1), cases.prose(300, 2)
    near = " ".join([*b.split()[:-2], "last", "words"])
    rows = [(1, a), (2, cases.prose(90, 3)), (None, a), (None, a), (None, b), (None, b), (None, near)] + [(2, cases.prose(90, 3))] * twice
    kept = cases.ordered(keep(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [d for d, _ in kept] == [1, 2, None] and kept[2][1] in (b, near)
