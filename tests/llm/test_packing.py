"""Packing: ids against whole-text encoding, places gapless, few sequences, and the dominance reduction against search."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from llm import cases
from strideline.llm import packing
from strideline.llm.common import documents


def expected(rows: list[tuple], capacity: int = 4096) -> list[tuple]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    out = []
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(d, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return cases.ordered(out)


def placed(rows) -> int:
    """Number of sequences, after a check of offsets."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_packing_of_the_corpus(spark, sf):
    docs = documents(spark, sf)
    rows = packing.pack(docs).collect()
    assert cases.ordered(tuple(r)[:5] for r in rows) == expected(cases.pairs(docs))
    assert placed(rows) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_of_odd_rows(spark):
    rows = packing.pack(cases.odd(spark)).collect()
    assert cases.ordered(tuple(r)[:5] for r in rows) == expected([(r[0], r[1]) for r in cases.odd_rows()])
    placed(rows)
    assert packing.pack(cases.none(spark)).count() == 0


def fewest(lengths: tuple[int, ...], capacity: int) -> int:
    """Fewest bins, by search over the bin of the longest piece."""

    @cache
    def least(left: tuple[int, ...]) -> int:
        if not left:
            return 0
        best = [99]

        def fill(rest: tuple[int, ...], at: int, room: int, out: tuple[int, ...]) -> None:
            if at == len(rest):
                best[0] = min(best[0], 1 + least(out))
                return
            if rest[at] <= room:
                fill(rest, at + 1, room - rest[at], out)
            fill(rest, at + 1, room, (*out, rest[at]))

        fill(left[1:], 0, capacity - left[0], ())
        return best[0]

    return least(tuple(sorted(lengths, reverse=True)))


def test_reduction_never_costs_a_sequence():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.randrange(6, 20)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        left = np.bincount(lengths, minlength=capacity + 1)
        fixed = packing.reduce(left, capacity)
        used = sum(times for *_, (_, times) in fixed)
        rest = [n for n in range(capacity + 1) for _ in range(left[n])]
        assert sorted(rest + [n for *p, (_, times) in fixed for n, k in p for _ in range(k * times)]) == sorted(lengths)
        assert all(sum(n for n, _ in p) <= capacity for *p, _ in fixed)
        assert used + fewest(tuple(rest), capacity) == fewest(tuple(lengths), capacity)


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for _ in range(40):
        capacity = rng.randrange(8, 60)
        counts = np.bincount([rng.randrange(1, capacity + 1) for _ in range(300)], minlength=capacity + 1)
        steps, sequences = packing.plan(counts, capacity)
        seen, load = Counter(), Counter()
        for length, lo, hi, sequence, each, _ in steps:
            seen[length] += hi - lo
            for k in range(hi - lo):
                load[sequence + k // each] += length
        assert all(seen[n] == counts[n] for n in range(capacity + 1)) and len(load) == sequences
        assert max(load.values()) <= capacity
        assert sequences <= 1.1 * -(-int((counts * np.arange(capacity + 1)).sum()) // capacity) + 1


def test_words_of_letters_need_no_whole_encoding():
    """Their ids come from the model alone; all others from the tokenizer, and both are the tokenizer's."""
    ids = packing.WordIds(packing.vocabulary())
    letters = ["the", "zqxjkv", "ouèon", "élève", "straße", "ÿçñ", "a", "t" * 300]
    others = ["Über", "œuvre", "a\u0301b", "it's", "x1", "ªº", "n×m", "日本", "<|endoftext|>a", "ab<|", "***"]
    encoder, asked = ids.encoder, []

    class Seen:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return encoder.encode_batch_fast(texts, **options)

    ids.encoder = Seen()
    for words in (letters, others, [*letters, *others]):
        for gap in (" ", "  \n"):
            text = gap.join(words)
            got, first = ids([text.encode(), b""])
            assert got.tolist() == encoder.encode(text, add_special_tokens=False).ids and first.tolist() == [0, len(got), len(got)]
        if words is letters:
            assert not asked
