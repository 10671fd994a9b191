"""op11, op12 and op13 against SQL on the tables, and against plain Python on odd rows and hard cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import compare
import numpy as np
import pytest
from llm import cases
from pyspark.sql import functions as F
from strideline.llm import merkle, minhash_dedup, queries, spelling


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare.difference(queries.QUERIES[name](spark, sf), compare.connect(sf), queries.ORACLES[name]) == ""


# op11


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset(words)


def linked(rows: list[tuple]) -> list[tuple]:
    """doc_id, size of the set and component of each row, by comparing all sets."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)] += [d] if d is not None else []
    return cases.ordered((d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows))


def near(df) -> list[tuple]:
    return cases.ordered(minhash_dedup.near_groups(df).select("doc_id", "n_shingles", "component_id").collect())


def edited(base: list[str], times: int, rng: random.Random) -> str:
    out = list(base)
    for at in rng.sample(range(len(out)), times):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize(("sketches", "sets"), [(2048, 512), (6, 4)])
def test_links_at_the_least_similarity(spark, monkeypatch, sketches, sets):
    """Groups around the threshold, of several sizes; the small blocks send every bucket by its pivot and in blocks."""
    monkeypatch.setattr(minhash_dedup, "SKETCHES", sketches)
    monkeypatch.setattr(minhash_dedup, "SETS", sets)
    rng = random.Random(3)
    out = []
    for g in range(12):
        base = cases.prose(200 + 60 * g, 50 + g).split()
        out.append(" ".join(base))
        out += [edited(base, k * len(base) // 100, rng) for k in (1, 2, 3, 4, 5, 5, 6, 7, 9)]
    out += ["one", "ONE", "two", "a b", "A  b", "b a", "", None, " \n", "x y x y", "y x y x y"]
    df = cases.table(spark, out)
    assert near(df) == linked(cases.pairs(df))


def test_chain_is_one_component(spark, monkeypatch):
    """Neighbours in a chain are linked, its ends are not; a large group hangs on one document that its pivot does not reach."""
    monkeypatch.setattr(minhash_dedup, "SETS", 4)
    words = cases.prose(400, 9).split()
    rng = random.Random(1)
    chain = [words]
    for k in range(6):
        nxt = list(chain[-1])
        for at in rng.sample(range(len(nxt)), 16):
            nxt[at] = f"c{k}{at}"
        chain.append(nxt)
    df = cases.table(spark, [" ".join(x) for x in chain] + [edited(words, 3, rng) for _ in range(12)])
    found = near(df)
    assert found == linked(cases.pairs(df)) and len({c for *_, c in found}) == 1


def test_near_groups_of_odd_rows(spark):
    df = cases.odd(spark)
    assert near(df) == linked(cases.pairs(df))
    assert near(cases.none(spark)) == []


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(5)
    for similarity in (0.95, 0.9, 0.8):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 1 << 64, round(1000 * similarity), np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 64, (1000 - len(both)) // 2, np.uint64)]) for _ in range(2))
            x, y = (minhash_dedup.odd_sketch(minhash_dedup.minhash(s)) for s in (a, b))
            ones = int(np.bitwise_count(x ^ y).sum())
            assert ones <= minhash_dedup.FAR
            errors.append(minhash_dedup.estimate(ones) - len(both) / (len(a) + len(b) - len(both)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


# op12


def grouped(rows: list[tuple]) -> list[tuple]:
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def one_apart(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        close = [x for x in words if one_apart(w, x)]
        form = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(close), form if form and words[form] >= 2 * n else None)

    def root(w: str) -> str:
        return root(out[w][2]) if out[w][2] else w

    return cases.ordered((w, f, root(w), n, near, words.get(f)) for w, (n, near, f) in out.items())


def spelled(df) -> list[tuple]:
    return cases.ordered(spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_equal_all_pairs(spark):
    rng = random.Random(4)
    letters = "abcéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    out = []
    for _ in range(60):
        words = []
        for w in rng.choices(base, weights=[2 ** (i % 8) for i in range(len(base))], k=60):
            at = rng.randrange(len(w))
            words.append(rng.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :], w.title()]))
        out.append(" ".join(words) + ", end.")
    out += ["yyyyyxw " * 4 + "yyyyyx " * 9 + "yyyyy " * 20]
    df = cases.table(spark, out)
    found = spelled(df)
    assert found == grouped(cases.pairs(df)) and any(r[1] for r in found) and any(r[1] != r[2] for r in found if r[1])


def test_variants_of_odd_rows(spark):
    df = cases.odd(spark)
    assert spelled(df.unionByName(df).unionByName(df)) == grouped(cases.pairs(df) * 3)
    assert spelled(cases.none(spark)) == [] and spelled(cases.table(spark, [None, "", "short words only"])) == []


# op13


def digest(*values) -> str:
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def climbed(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The top of a tree, and of each leaf the slot and siblings on each level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = level[at[i] // 2 * 2 : at[i] // 2 * 2 + 2]
            p.append((at[i] % 2, run[: at[i] % 2] + run[at[i] % 2 + 1 :]))
            at[i] //= 2
        level = [sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0], paths


def plain(rows: list) -> list[tuple]:
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops, inner = [], {}
    for lang in names:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, digest(*(r[c] for c in merkle.FIELDS))))
        top, inner[lang] = climbed([digest(*(r[c] for c in merkle.FIELDS)) for r in trees[lang]])
        tops.append(top)
    root, outer = climbed(tops)
    out = []
    for k, lang in enumerate(names):
        for r, path in zip(trees[lang], inner[lang], strict=True):
            leaf = digest(*(r[c] for c in merkle.FIELDS))
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            at = digest(r["doc_id"], r["source"], r["lang"], r["n_chars"] + 1, r["text"]) if hit else leaf
            for slot, others in path + outer[k]:
                at = sha256("".join([*others[:slot], at, *others[slot:]]).encode()).hexdigest()
            siblings = sha256("".join(x for _, s in path + outer[k] for x in s).encode()).hexdigest()
            out.append((r["doc_id"], leaf, tops[k], root, siblings, at, at == root))
    return cases.ordered(out)


def folded(df) -> list[tuple]:
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(hit, merkle.leaf(n_chars=F.col("n_chars") + 1))
    return cases.ordered(merkle.verified(merkle.manifest(df, tampered=tampered), "tampered").collect())


@pytest.mark.parametrize(("held", "group", "depth"), [(1 << 17, 1 << 12, 8), (3, 5, 2)])
def test_manifest_equals_plain_trees(spark, monkeypatch, held, group, depth):
    """Trees of 1 to 300 leaves; with small bounds, frontiers are let go and dealt again over several rounds."""
    monkeypatch.setattr(merkle, "HELD", held)
    monkeypatch.setattr(merkle, "GROUP", group)
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(8)
    rows = []
    for lang, n in ((None, 5), ("", 1), ("en", 300), ("ä", 2), ("z", 17), ("Z", 64), ("-", 3)):
        rows += [(i if i % 9 else None, rng.choice(["web", None]), lang, rng.choice([i, None]), rng.choice([cases.prose(5, i), "", None])) for i in rng.sample(range(10_000), n)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = folded(df)
    assert found == plain(df.collect()) and {v for *_, v in found} == {True, False}


def test_manifest_of_odd_rows(spark):
    df = cases.odd(spark)
    assert folded(df) == plain(df.collect())
    assert folded(cases.none(spark)) == []
