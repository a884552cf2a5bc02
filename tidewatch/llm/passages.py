"""Passages of a text as vectors, for the multiple-instance classifier."""

from __future__ import annotations

import numpy as np

#: Words in a passage.
PASSAGE = 64
BUCKETS = 64
_KINDS = 12


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, 11, dtype=np.int64)  # bytes beyond ASCII
    kinds[:128] = 10  # controls and other marks
    for kind, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b".,;:", b"!?", b"#*$%&", b"|<>/\\[]{}", b"'\"()", b"-_=+@")):
        kinds[np.frombuffer(chars, dtype=np.uint8)] = kind
    return kinds


_KIND_OF = _byte_kinds()
#: Shares of byte kinds, hashed byte pairs, then: word length, different words, words seen in earlier passages as triples, fullness, no words at all.
DIMENSIONS = _KINDS + BUCKETS + 5


def encode(data: bytes, passage: int = PASSAGE) -> np.ndarray:
    """One row per passage of ``passage`` words over the whole text; a blank text is one passage without words."""
    words = data.split()
    if not words:
        blank = np.zeros((1, DIMENSIONS), dtype=np.float32)
        blank[0, -1] = 1.0
        return blank
    rows = np.zeros((-(-len(words) // passage), DIMENSIONS), dtype=np.float32)
    seen: set[int] = set()
    for i in range(len(rows)):
        part = words[i * passage : (i + 1) * passage]
        raw = np.frombuffer(b" ".join(part), dtype=np.uint8)
        row = rows[i]
        row[:_KINDS] = np.bincount(_KIND_OF[raw], minlength=_KINDS) / len(raw)
        if len(raw) > 1:
            pairs = (raw[:-1].astype(np.uint32) * 40503 + raw[1:].astype(np.uint32) * 2654435) >> 7
            row[_KINDS : _KINDS + BUCKETS] = np.sqrt(np.bincount(pairs & (BUCKETS - 1), minlength=BUCKETS) / (len(raw) - 1))
        triples = {hash(t) for t in zip(part, part[1:], part[2:], strict=False)}
        row[-5] = np.log1p((len(raw) - len(part) + 1) / len(part))
        row[-4] = len(set(part)) / len(part)
        row[-3] = len(triples & seen) / max(1, len(triples))
        row[-2] = len(part) / passage
        seen |= triples
    return rows
