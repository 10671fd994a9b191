"""Groups of spelling variants without pairs: words one inserted, deleted or replaced code point apart.

1. ``vocabulary``: a narrow pass counts words in each task, so only partial sums are shuffled.
2. ``keyed``: a word has a row for each (position, prefix, suffix) wildcard, one for each distinct deletion, and one for
   itself among the deletions of others. A wildcard and a deletion with the word it gives are the groups.
3. A group keeps its size and its top two words: a word's best in a group is the first, or the second for the first
   itself. A group has at most as many words as the alphabet has letters, times the places of a deletion; so none is hot.
4. What the groups say of a word is added up; two words that differ by one code point share exactly one group.
5. ``rooted``: forms at least double the count, so chains are short; pointers are doubled until they stand still.

Null texts have no words and count as empty; a row without an id hashes as an empty id. Repeated rows count as often as
they occur. Words of equal count are ordered by code points. An empty table has no words. Extra columns are unused.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.common import chunks, text_bytes, texts, tidy, written

#: Of the runs of a document, one in EVERY (by hash) loses a code point. Words have LETTERS code points and OCCUR at least.
EVERY, LETTERS, OCCUR = 97, 5, 3
#: A form has at least so many times the occurrences of the word.
TIMES = 2
#: Text bytes that are read at once, and different words that a task counts before it hands them out.
CHUNK, HOLD = 1 << 20, 200_000
#: Stands for the replaced code point; no word has it.
WILD = "*"
_RUN = re.compile("[a-zÀ-ÿ]+")


def counted(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """Words of a text with their counts; A to Z are lower-cased, and nothing else."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.lower().decode(errors="replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        at, data = text_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for lo, hi in chunks(at, CHUNK):
            for i in range(lo, hi):
                for word, n in counted(ids[i], data[at[i] : at[i + 1]]):
                    if len(word) >= LETTERS:
                        held[word] += n
            if len(held) > HOLD:
                yield out()
    if held:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n, its occurrences in all documents."""
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    sums = rows.mapInArrow(tidy(_count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= OCCUR)


REPLACED, DELETED, ITSELF = 0, 1, 2


def keyed(words: DataFrame) -> DataFrame:
    """word, n, key and role: the groups that a word belongs to."""
    places = F.sequence(F.lit(1), F.length("word"))
    cut = lambda i, middle: F.concat(F.substring("word", F.lit(1), i - 1), F.lit(middle), F.substring("word", i + 1, F.length("word")))
    wild = F.transform(places, lambda i: cut(i, WILD))
    # A deletion must be a word, and words have LETTERS code points at least.
    short = F.when(F.length("word") > LETTERS, F.array_distinct(F.transform(places, lambda i: cut(i, "")))).otherwise(F.array().cast("array<string>"))
    rows = [words.select("word", "n", F.explode(keys).alias("key"), F.lit(role).alias("role")) for keys, role in ((wild, REPLACED), (short, DELETED))]
    return rows[0].unionByName(rows[1]).unionByName(words.select("word", "n", F.col("word").alias("key"), F.lit(ITSELF).alias("role")))


def _ranked(word: Column, n: Column) -> Column:
    """Least for the word of largest n, then of least code points."""
    return F.struct((-n).alias("minus"), word.alias("word"))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and best (minus its n, the word) of the words that have a near word."""
    own = _ranked(F.col("word"), F.col("n"))
    group = Window.partitionBy("key")
    whole = group.orderBy("role", F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = keyed(words).select(
        "word", "role", own.alias("own"),
        F.count_if(F.col("role") != ITSELF).over(group).alias("size"),
        F.first(own).over(whole).alias("top"), F.nth_value(own, 2).over(whole).alias("second"),
        F.max(F.when(F.col("role") == ITSELF, own)).over(group).alias("given"),
    )
    near = F.when(F.col("role") == REPLACED, F.col("size") - 1).when(F.col("role") == DELETED, F.col("given").isNotNull().cast("long")).otherwise(F.col("size"))
    best = F.when(F.col("role") == DELETED, F.col("given")).when((F.col("role") == REPLACED) & (F.col("top.word") == F.col("word")), F.col("second")).otherwise(F.col("top"))
    found = known.select("word", near.alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """forms: word, form. word and root, the last of the chain of forms that begins at it."""
    known = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = known.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        jumped = written(jumped)
        known = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return known


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    words = written(vocabulary(docs))
    form = F.when(-F.col("best.minus") >= TIMES * F.col("n"), F.col("best"))
    found = words.join(neighbours(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"))
    found = written(found.select("word", "n", "n_near", F.col("form.word").alias("form"), (-F.col("form.minus")).alias("form_n")))
    roots = rooted(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
