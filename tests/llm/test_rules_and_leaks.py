"""Quality rules and decontamination against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm import cases
from strideline.llm import decontaminate, quality_rules
from strideline.llm.common import documents
from strideline.llm.queries import benchmark

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(five)
    covered = {i + k for i, f in enumerate(five) if seen[f] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def verdicts(rows: list[tuple]) -> list[tuple]:
    """doc_id, counts, base_failed, kept of rows (doc_id, text, lang, source), with numpy."""
    counted = [(d, base(t), lang or "", source or "") for d, t, lang, source in rows]
    out, groups = [], defaultdict(list)
    for d, c, lang, source in counted:
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        if failed:
            out.append((d, *c[:5], True, False))
        else:
            groups[lang, source].append((d, c))
    parts = defaultdict(list)
    of_lang = Counter()
    for (lang, _), members in groups.items():
        of_lang[lang] += len(members) * (len(members) < quality_rules.SMALL)
    for (lang, source), members in groups.items():
        parts[(lang, source) if len(members) >= quality_rules.SMALL else (lang,) if of_lang[lang] >= quality_rules.SMALL else ()] += members
    rounded = lambda x: math.floor(abs(x) * 1000 + 0.5) / 1000 * (1 if x >= 0 else -1)
    for members in parts.values():
        if len(members) < quality_rules.SMALL:
            out += [(d, *c[:5], False, True) for d, c in members]
            continue
        x = np.array([[rounded(v) for v in (math.log(c[1] / c[0]), math.log1p(100 * c[2] / c[0]), c[3] / max(1, c[5]), c[4] / c[0])] for _, c in members])
        v = np.array([[s**2 / by for s, by in zip(quality_rules.NOISE, (c[0], c[0], max(1, c[5]), c[0]), strict=True)] for _, c in members])
        floor = np.diag(np.array(quality_rules.FLOOR) ** 2)

        def distance(mean, cov, x=x, v=v):
            u = (x - mean) * np.sqrt(np.diag(cov) / (np.diag(cov) + v))
            return np.einsum("ij,jk,ik->i", u, np.linalg.inv(cov), u)

        def of(inner, floor=floor):
            return inner.mean(axis=0), np.cov(inner.T, bias=True).reshape(4, 4) * quality_rules.FACTOR + floor

        def step(mean, cov, x=x):
            near = np.vectorize(rounded)(np.log1p(distance(mean, cov)))
            return of(x[near <= np.sort(near)[math.ceil(quality_rules.KEEP * len(x)) - 1]])

        middle = np.median(x, axis=0)
        found = [(middle, np.diag((1.4826 * np.median(np.vectorize(rounded)(np.abs(x - middle)), axis=0)) ** 2) + floor), of(x)]
        for _ in range(quality_rules.FIRST):
            found = [step(*f) for f in found]
        mean, cov = min(found, key=lambda f: np.linalg.det(f[1]))  # without the starts from samples, which rarely win
        for _ in range(quality_rules.STEPS):
            mean, cov = step(mean, cov)
        out += [(d, *c[:5], False, bool(k)) for (d, c), k in zip(members, distance(mean, cov) <= quality_rules.CUTOFF, strict=True)]
    return cases.ordered(out)


def four(df) -> list[tuple]:
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def judged(df) -> list[tuple]:
    return cases.ordered(tuple(r)[:8] for r in df.collect())


def test_rules_on_the_corpus(spark, sf):
    docs = documents(spark, sf)
    mine, brute = judged(quality_rules.judge(docs)), verdicts(four(docs))
    assert [r[:7] for r in mine] == [r[:7] for r in brute]
    assert sum(a != b for a, b in zip(mine, brute, strict=True)) <= 1  # a value on the edge of the grid


def test_the_start_with_the_least_determinant_goes_on(spark):
    """Two clusters of unlike size: the estimate is the large one's, whichever start finds it, and it is at rest."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.1, (150, 4)), rng.normal(3, 0.1, (50, 4))]).round(3)
    rows = spark.createDataFrame([("a", i, 100, 500, *map(float, r), *[0.0] * 4) for i, r in enumerate(x)], "part string, doc_id long, n_words long, word_chars long, x1 double, x2 double, x3 double, x4 double, v1 double, v2 double, v3 double, v4 double")
    every = quality_rules.starts(rows)
    assert {r["start"] for r in every.collect()} == {0, 1, 2, 3}
    best = quality_rules.estimates(rows)
    e = best.first()
    assert all(abs(e[f"m{i}"]) < 0.1 for i in range(1, 5))
    again = quality_rules.step(rows, best).first()
    assert abs(again["det"] / e["det"] - 1) <= quality_rules.STILL
    for _ in range(quality_rules.FIRST):
        every = quality_rules.step(rows, every)
    assert e["det"] <= min(r["det"] for r in every.collect()) * (1 + quality_rules.STILL)


def test_rules_reject_outliers_of_a_group(spark):
    texts = [cases.prose(60 + i % 40, i) for i in range(120)] + [" ".join(f"{w} ####" for w in cases.prose(50, i).split()) for i in range(200, 203)]
    docs = cases.table(spark, texts).selectExpr("*", "'en' lang", "'web' source")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert [kept[i] for i in range(120, 123)] == [False] * 3 and all(kept[i] for i in range(120))


def test_rules_on_odd_rows(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in cases.odd_rows()]
    assert judged(quality_rules.judge(cases.odd(spark))) == verdicts(rows)
    assert quality_rules.judge(cases.none(spark)).count() == 0


def test_native_plans(spark, sf):
    from strideline.llm import secret_scan

    docs = documents(spark, sf)
    for df in (quality_rules.judge(docs), secret_scan.findings(docs), secret_scan.redact(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def halves(text: str) -> tuple[str, str]:
    """The item without its last sentence, and its last sentence; one sentence alone is cut in the middle."""
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)", text.strip())]
    parts = [text.strip()[a:b] for a, b in zip([0, *ends], [*ends, None], strict=True)]
    parts = [p for p in parts if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    half = len(text.split()) // 2
    return " ".join(text.split()[:half]), " ".join(text.split()[half:])


def leaks_brute(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """All pairs, every passage and unit scored with words as text: no index, no bounds, no hashes."""
    rows = [(i, t) for i, t in items if plain_words(t)]
    units = [(i, plain_words(t)[k : k + 64]) for i, t in rows for k in range(0, len(plain_words(t)), 64)]
    df = Counter(w for _, u in units for w in set(u))
    average = sum(len(u) for _, u in units) / len(units)
    weights = []
    for i, u in units:
        w = {t: math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(u) / average)) for t, n in Counter(u).items()}
        weights.append((i, {t: x / sum(w.values()) for t, x in w.items()}))

    def five(word: list[str]) -> set[tuple]:
        return {tuple(word[k : k + 5]) for k in range(max(1, len(word) - 4))} if word else set()

    sides = {}
    for i, t in rows:
        q, a = map(plain_words, halves(t))
        sides[i] = (five(q), five(a)) if min(len(q), len(a)) >= 5 else (five(plain_words(t)),) * 2
    out = set()
    for d, text in docs:
        word = plain_words(text)
        own = five(word)
        for k in range(0, len(word), 32):
            here = set(word[k : k + 96])
            for i, w in weights:
                if sum(x for t, x in w.items() if t in here) >= 0.6 and all(len(s & own) >= 0.8 * len(s) for s in sides[i]):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pivots_retrieve_every_unit_at_the_threshold(seed):
    """Random items over few words: all units at several thresholds, with the scores of a plain sum."""
    rng = np.random.default_rng(seed)
    index = decontaminate.build([(k, " ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(1, 40)))) for k in range(50)])
    part = index.parts[0]
    for _ in range(40):
        terms = np.unique(rng.integers(0, len(part.terms), 20)).tolist()
        score = Counter()
        for t in terms:
            for at in range(part.list_at[t], part.list_at[t + 1]):
                score[part.unit[at]] += part.weight[at]
        for least in (0.1, 0.3, 0.6):
            found = {u: s for b in range(part.maxima.shape[1]) for u, s in decontaminate.wand(part, terms, b, least)}
            assert found == pytest.approx({u: s for u, s in score.items() if s >= least})


def test_leaks_of_the_corpus(spark, sf):
    docs, items = documents(spark, sf), benchmark(spark, sf)
    mine = decontaminate.leaks(docs, items).collect()
    brute = leaks_brute(cases.pairs(docs), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert {(r["doc_id"], r["item_id"]) for r in mine} == brute and len(mine) == len(brute) > 0
    clean = decontaminate.without_leaks(docs, items)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in cases.pairs(docs)} - {d for d, _ in brute} and clean.columns == docs.columns


def test_leaks_in_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    item = "What do the seven brown foxes eat in winter near the old mill? They eat frozen berries and roots under the snow."
    items = spark.createDataFrame([(1, item), (2, item), (3, ""), (4, None), (5, "Why? No."), (None, "?")], "item_id long, text string")
    docs = cases.odd(spark)
    held = docs.limit(1).selectExpr("100L doc_id", f"concat(text, ' ', upper('{item}'), ' ', text) text", "lang", "source", "n_chars", "rid", "marks", "key", "fp", "row", "scan", "part", "y", "score")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs.unionByName(held), items).collect()}
    assert found == {(100, 1), (100, 2)}
    assert cases.ordered(cases.pairs(decontaminate.without_leaks(docs.unionByName(held), items))) == cases.ordered(cases.pairs(docs))
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(cases.none(spark), items).count() == 0
