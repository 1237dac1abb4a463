"""Words of a text as arrays: spans, 64-bit hashes and shingles, without a Python loop per word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Words are maximal runs of bytes other than space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_GAP = re.compile(rb"[\x20\x09-\x0D]")

_RANDOM = np.random.default_rng(20_240_901)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_PLACE = [int(x) * 2 + 1 for x in _RANDOM.integers(1, 2**62, 16)]
_MASK = 2**64 - 1
#: Most bytes that are hashed at once, so that a huge text needs no huge arrays of powers.
PIECE = 1 << 20


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 14)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(size, base & _MASK, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    space = SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = not space[0] if len(data) else False, not space[-1] if len(data) else False
    edge[1:-1] = space[1:] != space[:-1]
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, by differences of running polynomial sums."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        first = start[i]
        j = max(i + 1, int(np.searchsorted(end, first + PIECE, "right")))
        piece = data[first:end[j - 1]]
        up, down = _Powers.upto(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * up[:len(piece)], out=total[1:])
        s, e = start[i:j] - first, end[i:j] - first
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def byte_pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of whole words, so that the words of a huge text are never one list."""
    at = 0
    while at < len(raw):
        end = at + size
        gap = _GAP.search(raw, end) if end < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return hash_spans(data, *spans(data))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words in lower case.

    A text of fewer words has one shingle, of all its words; a text without words has none.
    """
    h = word_hashes(text.lower())
    if not len(h):
        return h
    wide = min(size, len(h))
    n = len(h) - wide + 1
    out = np.zeros(n, np.uint64)
    for k in range(wide):
        out += h[k:k + n] * np.uint64(_PLACE[k])
    return np.unique(mix(out))
