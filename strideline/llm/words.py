"""Lower-cased words (runs of letters, digits and non-ASCII characters) of many texts as arrays."""

from __future__ import annotations

import numpy as np

from strideline.llm.windows import _TABLE, spans_hash

_LETTER = np.zeros(256, bool)
_LETTER[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_LETTER[128:] = True


def words_of(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The document of each word, in order, and a 64-bit hash of each word."""
    parts = [d.lower().encode() for d in docs]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    edge = np.diff(_LETTER[raw].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    limit = np.cumsum([len(p) + 1 for p in parts])
    doc = np.searchsorted(limit, starts, side="right")
    return doc, spans_hash(_TABLE[raw], starts, ends) if len(starts) else np.zeros(0, np.uint64)


def batches(texts: list[str], most: int) -> list[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together."""
    out, i = [], 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) < most:
            size += len(texts[j])
            j += 1
        out.append((i, j))
        i = j
    return out
