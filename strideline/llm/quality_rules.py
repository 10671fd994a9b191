"""Quality rules: robust multivariate outliers among the documents of a language and source, in SQL functions only.

Each document gets counts over its whole text, and a vector of four transformed shares. For every (language, source) the
minimum-covariance-determinant estimate is sought from four starts: medians and absolute deviations, the mean and
covariance of all, and those of two samples by hash. A concentration step takes the ``KEEP`` share of documents with the
least Mahalanobis distances and gives their mean and covariance. After ``FIRST`` steps the start with the least
determinant goes on, until no determinant moves by more than ``STILL``. A document is rejected if its distance under the
last estimate exceeds ``CUTOFF``. A document's own sampling noise, which falls with its number of words, is added to the
covariance, so that short documents are not outliers for being short.

A step is one pass: counts, sums and products of the vectors meet by group, start and distance (on a grid), with
map-side combining, so a group with a third of all documents is some thousands of rows after it. The inner share is
then cut from running counts over the grid. Medians are exact over values on the grid.

A covariance of four components from few documents is no estimate: groups under ``SMALL`` documents are pooled by
language, languages under it into one, and if that is under it too, none is rejected. Null texts count as empty;
documents that fail the base rules take no part in the estimates. Null language or source is a group of its own.
Repeated rows count as often as they occur; extra columns are not returned.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.common import WORD, written

KEEP, SMALL = 0.75, 50
#: Steps of every start, steps at most, and the largest move of a determinant at rest.
FIRST, STEPS, STILL = 2, 12, 0.01
#: Consistency of the covariance of the inner three quarters of four normal variables, and their 1 - 1e-6 quantile.
FACTOR, CUTOFF = 1.49, 33.4
#: Least deviation of each component, and the deviation that one word's sampling brings (for components 1, 2, 4; one line's for 3).
FLOOR = (0.05, 0.3, 0.05, 0.02)
NOISE = (0.6, 6.0, 0.5, 0.5)

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Words of windows found twice or more: starts in order, each adding what it covers beyond the one before it.
_REPEATED = """
aggregate(
  array_sort(transform(filter(sorted, (x, k) -> get(sorted, k - 1).h = x.h or get(sorted, k + 1).h = x.h), x -> x.i)),
  named_struct('last', -5, 'words', 0L),
  (a, i) -> named_struct('last', i, 'words', a.words + least(5, i - a.last)),
  a -> a.words)
"""


def counts(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(*keys, text.alias("t"))
    out = out.withColumn("w", F.expr(f"filter(split(t, r'{SPACE}+'), x -> x <> '')")).withColumn("lines", F.expr(f"filter(split(t, '\\n'), x -> x rlike r'{WORD}')"))
    out = out.select(
        *keys,
        F.size("w").cast("long").alias("n_words"),
        F.expr(r"length(translate(t, ' \t\n\u000b\u000c\r', ''))").cast("long").alias("word_chars"),
        F.expr(f"length(t) - length(translate(t, '{SYMBOLS}', ''))").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    out = out.withColumn("five", F.expr("if(n_words >= 5, transform(sequence(0, cast(n_words as int) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])), array())"))
    again = F.expr(f"element_at(transform(array(sort_array(transform(five, (h, i) -> named_struct('h', h, 'i', i)))), sorted -> {_REPEATED}), 1)")
    repeated = F.when(F.size(F.array_distinct("five")) == F.size("five"), F.lit(0)).otherwise(again)
    return out.select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"), "n_lines")


def vectors(table: DataFrame) -> DataFrame:
    """x1..x4 (on a grid of 0.001) and the variances v1..v4 that sampling brings."""
    n, lines = F.col("n_words"), F.greatest(F.col("n_lines"), F.lit(1))
    x = [F.log(F.col("word_chars") / n), F.log1p(100 * F.col("n_symbols") / n), F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n]
    by = [n, n, lines, n]
    out = table
    for i in range(4):
        out = out.withColumn(f"x{i + 1}", F.round(x[i], 3)).withColumn(f"v{i + 1}", NOISE[i] ** 2 / by[i])
    return out


def _cofactor(i: int, j: int) -> str:
    """SQL of the cofactor of c_ij in the symmetric 4 x 4 covariance c (c_kl is kept for k >= l)."""
    rows, columns = ([k for k in range(1, 5) if k != x] for x in (i, j))
    terms = []
    for order in itertools.permutations(range(3)):
        odd = sum(order[a] > order[b] for a in range(3) for b in range(a + 1, 3)) + i + j
        product = " * ".join(f"c{max(k, columns[o])}{min(k, columns[o])}" for k, o in zip(rows, order, strict=True))
        terms.append(("- " if odd % 2 else "+ ") + product)
    return f"({' '.join(terms)})"


PAIRS = [(i, j) for i in range(1, 5) for j in range(1, i + 1)]
SUMS = ["n", *[f"s{i}" for i in range(1, 5)], *[f"q{i}{j}" for i, j in PAIRS]]


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, sums and sums of products of the vectors, by keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(1, 5)], *[F.sum(F.expr(f"x{i} * x{j}")).alias(f"q{i}{j}") for i, j in PAIRS])


def from_sums(sums: DataFrame) -> DataFrame:
    """part, start, means and the covariance of the summed rows."""
    floors = {i: FLOOR[i - 1] ** 2 for i in range(1, 5)}
    return sums.select("part", "start", *[F.expr(f"s{i} / n").alias(f"m{i}") for i in range(1, 5)], *[F.expr(f"(q{i}{j} / n - s{i} * s{j} / n / n) * {FACTOR} + {floors[i] if i == j else 0}").alias(f"c{i}{j}") for i, j in PAIRS])


def inverted(estimate: DataFrame) -> DataFrame:
    """Means, variances, and the inverse covariance as cofactors over a determinant."""
    out = estimate.select("part", "start", *[f"m{i}" for i in range(1, 5)], *[f"c{i}{i}" for i in range(1, 5)], *[f"c{j}1" for j in range(2, 5)], *[F.expr(_cofactor(i, j)).alias(f"p{i}{j}") for i, j in PAIRS])
    return out.withColumn("det", F.expr("c11 * p11 + c21 * p21 + c31 * p31 + c41 * p41")).drop("c21", "c31", "c41")


def with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds start and d2, the squared Mahalanobis distance of deviations that are shrunk by the share of sampling in their variance."""
    out = rows.join(estimate, "part")
    out = out.select(*rows.columns, "start", "det", *[f"p{i}{j}" for i, j in PAIRS], *[F.expr(f"(x{i} - m{i}) * sqrt(c{i}{i} / (c{i}{i} + v{i}))").alias(f"u{i}") for i in range(1, 5)])
    terms = [f"{1 if i == j else 2} * p{i}{j} * u{i} * u{j}" for i, j in PAIRS]
    return out.select(*rows.columns, "start", F.expr(f"({' + '.join(terms)}) / det").alias("d2"))


def starts(rows: DataFrame) -> DataFrame:
    """Start 0: medians and a diagonal of squared absolute deviations. 1: all rows. 2 and 3: one row in 16 each."""
    middle = written(rows.groupBy("part").agg(*[F.expr(f"percentile(x{i}, 0.5)").alias(f"m{i}") for i in range(1, 5)]))
    spread = rows.join(middle, "part").groupBy("part").agg(
        F.lit(0).alias("start"),
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(1, 5)],
        *[F.expr(f"power(1.4826 * percentile(round(abs(x{i} - m{i}), 3), 0.5), 2) + {FLOOR[i - 1] ** 2}").alias(f"c{i}{i}") for i in range(1, 5)],
    )
    first = spread.select("*", *[F.lit(0.0).alias(f"c{i}{j}") for i, j in PAIRS if i != j])
    dealt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(16))
    every = rows.withColumn("start", F.explode(F.array_compact(F.array(F.lit(1), F.when(dealt == 0, 2), F.when(dealt == 1, 3)))))
    return inverted(first.unionByName(from_sums(summed(every, "part", "start"))))


def step(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """A concentration step of each part and start: the estimate from the ``KEEP`` share with the least distances."""
    grid = summed(with_distance(rows, estimate).withColumn("near", F.round(F.log1p("d2"), 3)), "part", "start", "near")
    before = Window.partitionBy("part", "start").orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    share = F.ceil(F.sum("n").over(Window.partitionBy("part", "start")) * KEEP)
    inner = grid.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0)) < share).where("inner")
    return inverted(from_sums(inner.groupBy("part", "start").agg(*[F.sum(c).alias(c) for c in SUMS])))


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each part: the best start, concentrated until it rests."""
    now = written(starts(rows))
    for _ in range(FIRST):
        now = written(step(rows, now), instead_of=now)
    columns = F.struct(*[c for c in now.columns if c != "part"])
    now = written(now.groupBy("part").agg(F.min_by(columns, F.struct("det", "start")).alias("best")).select("part", "best.*"), instead_of=now)
    for _ in range(FIRST, STEPS):
        was, now = now, written(step(rows, now))
        moved = now.join(was.select("part", F.col("det").alias("was")), "part").agg(F.max(F.abs(F.col("det") / F.col("was") - 1))).first()[0]
        if moved is None or moved <= STILL:
            break
    return now


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and the squared distance (null where there is no verdict)."""
    own = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    table = written(counts(own, "doc_id", "lang", "source").withColumn("base_failed", failed))
    sized = table.where("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("size"))
    # A group, else its language, else all: the first that is large enough.
    in_lang, small = Window.partitionBy("lang"), F.col("size") < SMALL
    pooled = sized.withColumn("small", small).withColumn("of_lang", F.sum(F.when(small, F.col("size"))).over(in_lang))
    part = F.when(~F.col("small"), F.to_json(F.array("lang", "source"))).when(F.col("of_lang") >= SMALL, F.to_json(F.array("lang"))).otherwise(F.lit("[]"))
    part = written(pooled.select("lang", "source", part.alias("part"), "size"))
    large = written(part.groupBy("part").agg(F.sum("size").alias("size")).where(F.col("size") >= SMALL).select("part"))
    named = written(part.join(large, "part").select("lang", "source", "part"))
    rows = written(vectors(table.where("not base_failed").join(named, ["lang", "source"])).select("part", "doc_id", *COLUMNS, *[f"{c}{i}" for c in "xv" for i in range(1, 5)]))
    judged = with_distance(rows, estimates(rows)).select("doc_id", *COLUMNS, F.lit(False).alias("base_failed"), (F.col("d2") <= CUTOFF).alias("kept"), "d2")
    rest = table.join(named.withColumn("judged", F.lit(True)), ["lang", "source"], "left").where(F.col("base_failed") | F.col("judged").isNull())
    return judged.unionByName(rest.select("doc_id", *COLUMNS, "base_failed", (~F.col("base_failed")).alias("kept"), F.lit(None).cast("double").alias("d2")))
