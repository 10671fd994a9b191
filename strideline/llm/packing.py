"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Lengths are at most the capacity, so the instance is a histogram of at most ``capacity`` counts, whatever the number
of documents; only that histogram comes to the driver. There ``plan`` fixes sets that provably dominate every other
set with the same longest piece (alone, an exact pair, or the largest partner where no further piece or no better pair
fits), shrinks the instance until nothing more can be fixed, and packs the rest best fit, longest first. The plan
assigns ranges of ranks within a length to ranges of sequences. Ranks are counted in Spark, salted within each length,
so a length that a third of all pieces have is no single task.

Null and empty texts are documents of the end id alone. Repeated rows are packed as often as they occur. Extra columns
are not returned.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.common import WHITE, chunks, text_bytes, texts, tidy, written

CAPACITY, END = 4096, 1
#: Text bytes that are tokenised at once, words that a worker remembers, and rows of a salted rank window.
CHUNK, REMEMBER, SALT_ROWS = 1 << 20, 250_000, 200_000
#: A special token of the vocabulary.
BETWEEN = "<|endoftext|>"


#: Words of small Latin letters, and spaces after them: neither normalised nor split, so the model alone gives their ids.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+ *")
#: The character that stands for each byte in a byte-level vocabulary.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = dict(zip(_SEEN, _SEEN, strict=True)) | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_SEEN}))}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids by white-space word. The vocabulary drops white space and no token spans it, so words are independent."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.between = self.encoder.token_to_id(BETWEEN)
        self.known: dict[bytes, int] = {}
        self.ids, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0
        self.first = np.zeros(1 << 16, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words of letters come from the model; those of many others from one encoding, in which a special token
        stands between words that cannot hold it."""
        simple = [w for w in words if LETTERS.fullmatch(w.decode())]
        if simple:
            tokens = [[t.id for t in self.model.tokenize(w.rstrip(b" ").decode("latin-1").translate(BYTES))] for w in simple]
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            self._keep(simple, np.fromiter(chain.from_iterable(tokens), np.uint32, int(size.sum())), size)
            words = sorted({*words} - {*simple})
        plain = [w for w in words if b"<|" not in w]
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            ids = np.array(self.encoder.encode_batch_fast([BETWEEN.join(w.decode() for w in part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.between)
            self._keep(part, np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        odd = [w for w in words if b"<|" in w]
        for w, e in zip(odd, self.encoder.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False), strict=True):
            self._keep([w], np.array(e.ids, np.uint32), np.array([len(e.ids)]))

    def _keep(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        k, n = len(self.known), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + n > len(self.size):
            self.size, self.first = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.first))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[k : k + n] = size
        self.first[k : k + n] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + n), strict=True))

    def __call__(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in one array, and where each document's ids start."""
        joined = b" ".join(docs) + b" "
        first = np.cumsum([0, *(len(d) + 1 for d in docs)])
        plain = b"<|" not in joined  # else a special token may be spelled out, as it is
        raw = np.frombuffer(joined.lower() if plain else joined, np.uint8)
        if plain:
            raw, first = _tails_apart(raw, first)
        white = _WHITE[raw]
        starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(docs) + 1, np.int64)
        # A word keeps the spaces after it, so that words fill the buffer without gaps.
        data = np.where(white, np.uint8(32), raw)[starts[0] :]
        offsets = np.append(starts, len(raw)) - starts[0]
        flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        words = flat.dictionary.to_pylist()
        if len(self.known) + len(words) > REMEMBER:
            self.known, self.used = {}, 0
        known = self.known
        self._learn([w for w in words if w not in known])
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[flat.indices.to_numpy(zero_copy_only=False)]
        size = self.size[code]
        before = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(before[-1]) - np.repeat(before[:-1] - self.first[code], size)
        return self.ids[place], before[np.searchsorted(starts, first)]


_WHITE, _TAIL, _ALNUM = np.zeros((3, 256), bool)
_WHITE[np.frombuffer(WHITE.encode(), np.uint8)] = True
_TAIL[np.frombuffer(b".,!?;:*$%&#|", np.uint8)] = True
_ALNUM[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def _tails_apart(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before punctuation that ends a word. The vocabulary splits there anyway, and fewer different words are left."""
    tail = _TAIL[raw]
    at = np.flatnonzero(tail[1:] & _ALNUM[raw[:-1]]) + 1
    stop = np.flatnonzero(~tail)
    at = at[_WHITE[raw[stop[np.searchsorted(stop, at)]]]]
    return np.insert(raw, at, np.uint8(32)), first + np.searchsorted(at, first)


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: each document's ids, then the end id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            at, data = text_bytes(batch.column("text"))
            doc_id = batch.column("doc_id")
            for lo, hi in chunks(at, CHUNK):
                ids, first = encode([data[a:b] for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True)])
                rows = []
                for i in range(hi - lo):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(END)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append((lo + i, k, s, len(part), zlib.crc32(part.tobytes())))
                d, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(d, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(tidy(scan), PIECES)


#: (length, first rank, end rank, first sequence, pieces of it in a sequence, offset in the sequence)
Step = tuple[int, int, int, int, int, int]


def reduce(left: np.ndarray, capacity: int) -> list[list[tuple[int, int]]]:
    """Dominance reduction: fixes sets and takes them out of ``left``. Returns [[(length, in each)...], repeated as (0, times)]."""
    fixed: list[list[tuple[int, int]]] = []
    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(left)[::-1].tolist():
            while left[a]:
                left[a] -= 1  # one is the piece in question; the others may be its partners
                here = np.flatnonzero(left)
                room = capacity - a
                fit = here[: np.searchsorted(here, room, side="right")]
                if not len(fit):  # no other piece fits: alone
                    times = int(left[a]) + 1
                    left[a] = 0
                    fixed.append([(a, 1), (0, times)])
                    changed = True
                    break
                best = int(fit[-1])
                smallest = np.repeat(fit[:3], np.minimum(left[fit[:3]], 3))[:3]
                single = best == room or len(smallest) < 2 or smallest[:2].sum() > room
                if not single and (len(smallest) < 3 or smallest.sum() > room):  # two more fit at most
                    single = best >= _best_pair(fit, left, room)
                if not single:
                    left[a] += 1
                    break
                if best == a:
                    times = (int(left[a]) + 1) // 2
                    left[a] += 1 - 2 * times
                elif best == room or 2 * smallest[0] > room:  # holds as long as both lengths last
                    times = min(int(left[a]) + 1, int(left[best]))
                    left[a] += 1 - times
                    left[best] -= times
                else:
                    times = 1
                    left[best] -= 1
                fixed.append([(a, 1), (best, 1), (0, times)])
                changed = True
    return fixed


def _best_pair(fit: np.ndarray, left: np.ndarray, room: int) -> int:
    partner = np.searchsorted(fit, room - fit, side="right") - 1
    own = (partner >= 0) & (fit[partner] == fit) & (left[fit] < 2)
    partner = np.where(own, partner - 1, partner)
    ok = partner >= 0
    return int((fit[ok] + fit[partner[ok]]).max()) if ok.any() else 0


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Where the pieces of each length go, and the number of sequences. counts[n]: pieces of length n."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    steps: list[Step] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        steps.append((length, int(used[length]), int(used[length]) + n, sequence, each, offset))
        used[length] += n

    for *parts, (_, times) in reduce(left, capacity):
        offset = 0
        for length, _ in parts:
            put(length, times, sequences, 1, offset)
            offset += length
        sequences += times
    rooms: list[int] = []  # free room of open sequences, in order; groups[room]: (first sequence, how many)
    groups: dict[int, list[tuple[int, int]]] = {}

    def opened(room: int, sequence: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
            groups.setdefault(room, []).append((sequence, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                sequence, k = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, sequence, k = capacity, sequences, -(-n // (capacity // length))
                sequences += k
            each = room // length
            full = min(k, n // each)
            if full:
                put(length, full * each, sequence, each, capacity - room)
                opened(room - each * length, sequence, full)
                n -= full * each
            rest = 0
            if full < k and n:
                rest, n = n, 0
                put(length, rest, sequence + full, rest, capacity - room)
                opened(room - rest * length, sequence + full, 1)
            opened(room, sequence + full + (rest > 0), k - full - (rest > 0))
    return steps, sequences


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = written(pieces(docs, path or vocabulary(), capacity))
    histogram = table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    steps, _ = plan(counts, capacity)
    by = sorted(steps)
    lengths, lo, _, sequence, each, offset = (np.array(x, np.int64) for x in zip(*by, strict=True)) if by else [np.zeros(0, np.int64)] * 6
    key = (lengths << 44) + lo

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            k = rank - lo[i]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[i] + k // each[i]), pa.array(offset[i] + k % each[i] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    salts = int(min(4096, max(16, counts.sum() // SALT_ROWS)))
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
