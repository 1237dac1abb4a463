"""Operator 13: periodic runs of words, by longest common extensions on a difference cover.

A run is a maximal stretch of words with smallest period q and at least max(6, 4 q) words.

1. A run of period p and 4 p words or more holds a pair (i, i + p) for some i of the grid
   0, 3 p, 6 p, ...; the grids of all p together have about n log(n) / 3 points. Points whose two
   words differ are no candidates, and most of the rest end within a few words to both sides.
2. Texts with points that do not end get two extension tables, of their words and of their words
   backwards. A table sorts only the suffixes that begin at positions of a difference cover
   (4 of 13 residues): whichever two positions are asked for, at most 12 words on both are in the
   cover, at the same distance. Those few words are compared, and the rest of the answer is a
   range minimum over the common prefixes of neighbours in the sorted order (sparse table).
3. Extensions to both sides give start and end of the run; of equal stretches the smallest
   period stays.

Words are numbered exactly, by a dictionary of the texts at hand, so nothing depends on hashes.
A task works on some texts at a time (about ``WORDS_AT_ONCE`` words, or one longer text), and
nothing is shuffled.

Defined results: a null or empty text, or one of white space only, has no words, no runs and an
empty collapsed text; repeated rows have equal results each; null ids stay null and are never
edited; of runs of equal exponent none is preferred here; an empty table gives no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantwatch.llm.arrow import map_arrow
from plantwatch.llm.words import byte_pieces

#: A perfect difference set: every distance modulo 13 lies between two of its elements.
COVER = (0, 1, 3, 9)
CYCLE = 13
LEAST_WORDS = 6
LEAST_PERIODS = 4
WORDS_AT_ONCE = 100_000

_RANK = np.full(CYCLE, -1)
_RANK[list(COVER)] = np.arange(len(COVER))
_PLACES = np.array(COVER)
_SHIFT = np.array([[next(d for d in range(CYCLE) if (i + d) % CYCLE in COVER and (j + d) % CYCLE in COVER)
                    for j in range(CYCLE)] for i in range(CYCLE)])

#: Gives (first, period) for an id and a number of words: from ``first`` on, words repeat with that period. Or None.
Edit = Callable[[int | None, int], tuple[int, int] | None]


class Extensions:
    """Lengths of the longest common prefixes of suffixes of one sequence of numbers (0 and up)."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.ids = np.concatenate([ids, np.full(CYCLE, -1, ids.dtype)])
        every = np.arange(self.n)
        self.at = every[_RANK[every % CYCLE] >= 0]
        m = len(self.at)
        levels = [self._first_ranks()]
        while m and levels[-1].max() < m:
            later = len(COVER) << (len(levels) - 1)
            beyond = np.zeros(m, np.int64)
            beyond[:max(0, m - later)] = levels[-1][later:]
            _, ranks = np.unique(levels[-1] * (m + 1) + beyond, return_inverse=True)
            levels.append(ranks + 1)
        self.rank = (levels[-1] - 1).astype(np.int32) if m else np.zeros(0, np.int32)
        self.lows = self._minima(self._neighbours([x.astype(np.int32) for x in levels]))

    def _first_ranks(self) -> np.ndarray:
        """Ranks (from 1) of sampled suffixes by their first 13 words, packed into few numbers."""
        bits = int(self.ids.max(initial=0) + 1).bit_length()
        each = 62 // bits
        packed = []
        for k in range(0, CYCLE, each):
            value = np.zeros(len(self.at), np.int64)
            for d in range(k, min(k + each, CYCLE)):
                value = (value << bits) | (self.ids[self.at + d].astype(np.int64) + 1)
            packed.append(value)
        order = np.lexsort(packed[::-1])
        new = np.zeros(len(order), bool)
        for value in packed:
            new[1:] |= value[order[1:]] != value[order[:-1]]
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(new) + 1
        return ranks

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sampled suffix with the next one in sorted order."""
        m = len(self.at)
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            step = len(COVER) << k
            inside = np.maximum(a, b) < m
            same = inside.copy()
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            a, b = a + same * step, b + same * step
            common += (same * (CYCLE << k)).astype(np.int32)
        x, y = self.at[order[:-1]] + common, self.at[order[1:]] + common
        live = np.arange(len(common))
        for d in range(CYCLE):
            live = live[self.ids[np.minimum(x[live] + d, self.n)] == self.ids[np.minimum(y[live] + d, self.n)]]
            common[live] += 1
        return common

    @staticmethod
    def _minima(common: np.ndarray) -> list[np.ndarray]:
        """Sparse table: minima of all ranges of 1, 2, 4, ... neighbours."""
        lows, wide = [common], 1
        while 2 * wide <= len(common):
            lows.append(np.minimum(lows[-1][:-wide], lows[-1][wide:]))
            wide *= 2
        return lows

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at i and j (i < j, j may be the end)."""
        shift = _SHIFT[i % CYCLE, j % CYCLE]
        out = np.zeros(len(i), np.int64)
        live = np.ones(len(i), bool)
        for d in range(int(shift.max(initial=0))):
            ask = np.flatnonzero(live & (shift > d))
            same = self.ids[i[ask] + d] == self.ids[j[ask] + d]
            out[ask[same]] += 1
            live[ask[~same]] = False
        x, y = i + shift, j + shift
        ask = np.flatnonzero(live & (np.maximum(x, y) < self.n))
        x, y = x[ask], y[ask]
        a, b = (self.rank[z // CYCLE * len(COVER) + _RANK[z % CYCLE]] for z in (x, y))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        depth = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(depth):
            mine = depth == k
            row = self.lows[k]
            out[ask[mine]] += np.minimum(row[lo[mine]], row[hi[mine] - (1 << k)])
        return out


def grid_points(ids: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, p) of all grids with equal words at i and i + p in one text that is long enough for period p."""
    points, periods = [], []
    n = len(ids)
    for p in range(1, int(sizes.max(initial=0)) // LEAST_PERIODS + 1):
        step = (LEAST_PERIODS - 1) * p
        i = np.flatnonzero(ids[0:n - p:step] == ids[p:n:step]) * step
        i = i[(owner[i] == owner[i + p]) & (sizes[owner[i]] >= LEAST_PERIODS * p)]
        if len(i):
            points.append(i)
            periods.append(np.full(len(i), p))
    if not points:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(points), np.concatenate(periods)


def _near(ids: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words from i and j on in one direction, at most 13, and whether they end before that."""
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    for d in range(CYCLE):
        a, b = i[live] + d * step, j[live] + d * step
        inside = (a >= 0) & (b < len(ids))
        live = live[inside]
        live = live[ids[a[inside]] == ids[b[inside]]]
        out[live] += 1
    return out, out < CYCLE


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of sequences of word numbers, in this order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids, owner = _joined(texts), np.repeat(np.arange(len(texts)), sizes + 1)
    i, p = grid_points(ids, owner, sizes)
    ahead, ends = _near(ids, i, i + p, 1)
    back, begins = _near(ids, i - 1, i + p - 1, -1)
    known = ends & begins
    far = ~known
    if far.any():
        # Tables of the texts with open points only.
        mine = np.unique(owner[i[far]])
        part = _joined([texts[k] for k in mine])
        moved = np.zeros(len(texts), np.int64)
        moved[mine] = np.concatenate([[0], np.cumsum(sizes[mine] + 1)])[:-1]
        x = i[far] - first[owner[i[far]]] + moved[owner[i[far]]]
        y = x + p[far]
        ahead[far] = Extensions(part)(x, y)
        back[far] = Extensions(part[::-1])(len(part) - y, len(part) - x)
    length = p + ahead + back
    take = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
    start, length, p, text = (i - back)[take], length[take], p[take], owner[i[take]]
    order = np.lexsort([p, length, start])
    start, length, p, text = start[order], length[order], p[order], text[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p, text = start[new], length[new], p[new], text[new]
    order = np.lexsort([p, start])
    return text[order], (start - first[text])[order], length[order], p[order]


def _joined(texts: list[np.ndarray]) -> np.ndarray:
    """All sequences, a number of its own after each."""
    most = max((int(t.max(initial=-1)) for t in texts), default=-1) + 1
    return np.concatenate([x for k, t in enumerate(texts) for x in (t, [most + k])]).astype(np.int32)


def number_words(raw: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    parts = [np.array([numbers.setdefault(w, len(numbers)) for w in piece.split()], np.int32) for piece in byte_pieces(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def keep_words(raw: bytes, keep: np.ndarray, edited: tuple[int, int] | None = None) -> str:
    """The kept words, one space between them."""
    out, loop, at = [], [], 0
    first, period = edited or (len(keep), 0)
    for piece in byte_pieces(raw):
        words = piece.split()
        out += compress(words[:max(0, first - at)], keep[at:at + len(words)])
        loop += words[max(0, first - at):max(0, first + period - at)]
        at += len(words)
    out += [loop[k] for k in np.flatnonzero(keep[first:]) % period] if period else []
    return b" ".join(out).decode("utf-8", "replace")


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None) -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period) and collapsed, the text without the
    repetitions: words of a run after its first period go.

    ``edit`` changes the words of a text before it is searched (see ``Edit``).
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))

    def solve(held: list[tuple]) -> pa.RecordBatch:
        text, start, length, period = runs_of([h[2] for h in held])
        bounds = np.searchsorted(text, np.arange(len(held) + 1))
        collapsed = []
        for k, (_, raw, words, edited) in enumerate(held):
            keep = np.ones(len(words), bool)
            for r in range(bounds[k], bounds[k + 1]):
                keep[start[r] + period[r]:start[r] + length[r]] = False
            collapsed.append(keep_words(raw, keep, edited))
        runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array([len(h[2]) for h in held], pa.int64()),
             pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(collapsed, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            held, words, numbers = [], 0, {}
            for doc, raw in zip(b.column("_id"), b.column("_text")):
                doc, raw = doc.as_py(), raw.as_py() or b""
                ids = number_words(raw, numbers)
                edited = edit(doc, len(ids)) if edit else None
                if edited:
                    first, period = edited
                    ids[first:] = ids[first + np.arange(len(ids) - first) % period]
                held.append((doc, raw, ids, edited))
                words += len(ids)
                if words >= WORDS_AT_ONCE:
                    yield solve(held)
                    held, words, numbers = [], 0, {}
            if held:
                yield solve(held)

    return map_arrow(source, run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
