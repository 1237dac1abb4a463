"""Operator 10: quality rules by line labelling.

The lines of a text are a sequence; a linear-chain conditional random field labels each as
content or boilerplate, and Viterbi decoding finds the best labelling of the whole sequence.
The share of words that stand in content lines decides whether the text stays.

Features of a line are yes/no questions about its characters, its words and whether it repeats an
earlier line. Weights are learned by gradient ascent on the conditional likelihood, with line
labels taken from document labels: every line of a bad document is boilerplate, and lines of a
good one are content unless they repeat an earlier line. At most ``FIT_ROWS`` labelled documents
are used for fitting; every line of every text is decoded.

Base rules count words, symbols, repeated lines and repeated three-word windows; texts that fail
them go whatever the labels say.

Defined results: a null text is empty; a text without words has no lines to label, content share 0,
and fails the base rules; repeated rows are judged each; null ids stay null; an empty table gives no
rows; without labelled documents all lines are content.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plantwatch.llm.arrow import map_arrow, texts
from plantwatch.llm.quality import training_rows
from plantwatch.llm.words import PIECE, SPACE, hash_spans, mix, spans

FIT_ROWS = 1_200
LEAST_SHARE = 0.5
LINES_AT_ONCE = 1 << 16
# The base rules.
LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

FEATURES = ("always", "symbols > 2 %", "symbols > 8 %", "capitals > 30 %", "capitals > 70 %", "digits > 10 %", "digits > 40 %",
            "bars >= 2", "exclamations >= 2", "1-3 words", "4-8 words", "> 80 words", "ends a sentence", "repeats a line",
            "repeats windows", "address or mail", "rights or license")
MARKS = (b"http://", b"https://", b"www.", b"@")
NOTICES = (b"copyright", b"license", b"licence", b"rights reserved", b"cookie", "©".encode())


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_COUNTED = np.stack([_flags(SYMBOLS), _flags(bytes(range(65, 91))), _flags(b"0123456789"), _flags(b"|"), _flags(b"!"),
                     (~SPACE).astype(np.uint8)])


#: Bytes that begin a character of a word: not white space, no later byte of a character.
_FIRST_BYTES = ((~SPACE) & ((np.arange(256) & 0xC0) != 0x80)).astype(np.uint8)


@dataclass
class Sheet:
    """Counts of a text and the features and words of its lines that have a word."""
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray
    words: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEAT_PERCENT * self.n_words


def repeated_words(hashes: np.ndarray) -> np.ndarray:
    """Which words lie in a three-word window that occurs twice or more."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < 4:
        return out
    window = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
    ordered = np.sort(window)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    again = np.zeros(len(window), bool)
    if len(twice):
        for i in range(0, len(window), PIECE):
            part = window[i:i + PIECE]
            again[i:i + PIECE] = twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part
    out[:-2] |= again
    out[1:-1] |= again
    out[2:] |= again
    return out


def _line_sums(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes of each counted kind from each line's first byte to the next one's, some lines at a time."""
    out = np.zeros((len(_COUNTED), len(first)), np.int64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + PIECE, "right")) - 1)
        stop = first[j] if j < len(first) else len(data)
        if stop - first[i] <= 2 * PIECE:
            part = data[first[i]:stop]
            for k, flags in enumerate(_COUNTED):
                out[k, i:j] = np.add.reduceat(flags[part], first[i:j] - first[i], dtype=np.int64)
        else:
            # One line (j = i + 1, or short ones before a huge one): count it byte by byte value.
            for line in range(i, j):
                end = first[line + 1] if line + 1 < len(first) else len(data)
                values = sum((np.bincount(data[a:min(a + PIECE, end)], minlength=256) for a in range(first[line], end, PIECE)), np.zeros(256, np.int64))
                out[:, line] = _COUNTED @ values
        i = j
    return out


def sheet(text: str) -> Sheet:
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    start, end = spans(data)
    repeats = repeated_words(hash_spans(data, start, end))
    # Bytes of words that begin a character.
    word_chars = sum(int(_FIRST_BYTES[data[i:i + PIECE]].sum(dtype=np.int64)) for i in range(0, len(data), PIECE))
    cuts = np.flatnonzero(data == 10)
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
    words = np.searchsorted(start, last) - np.searchsorted(start, first)
    full = np.flatnonzero(words)
    again = np.zeros(len(words), bool)
    seen: set[bytes] = set()
    for i in full:
        line = raw[first[i]:last[i]]
        # Long lines are told apart by a digest.
        key = line if len(line) <= 64 else hashlib.blake2b(line, digest_size=16).digest() + b"\n"
        if key in seen:
            again[i] = True
        else:
            seen.add(key)
    del seen
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    inside = _line_sums(data, first[full])
    size = np.maximum(1, inside[5])
    share = inside[:3] / size
    covered = np.concatenate([[0], np.cumsum(repeats)])
    word_first = np.searchsorted(start, first[full])
    in_windows = (covered[word_first + words[full]] - covered[word_first]) / words[full] if len(full) else np.zeros(0)
    tail = data[end[word_first + words[full] - 1] - 1] if len(full) else np.zeros(0, np.uint8)
    low = raw.lower()
    marked, noticed = np.zeros(len(full), bool), np.zeros(len(full), bool)
    for out, needles in ((marked, MARKS), (noticed, NOTICES)):
        for needle in needles:
            at = low.find(needle)
            while at >= 0:
                line = int(np.searchsorted(first, at, "right")) - 1
                out[np.searchsorted(full, line)] = True
                at = low.find(needle, int(last[line]))
    n = words[full]
    features = np.stack([np.ones(len(full), bool), share[0] > .02, share[0] > .08, share[1] > .3, share[1] > .7, share[2] > .1, share[2] > .4,
                         inside[3] >= 2, inside[4] >= 2, n <= 3, (n >= 4) & (n <= 8), n > 80, np.isin(tail, list(b".!?:;")), again[full],
                         in_windows > .5, marked, noticed], axis=1)
    return Sheet(len(start), word_chars, n_symbols, int(again.sum()), int(repeats.sum()), features, n)


@dataclass
class Field:
    """Weights of the random field; label 1 is content."""
    line: np.ndarray
    step: np.ndarray


def viterbi(field: Field, features: np.ndarray) -> np.ndarray:
    """Best labels of a sequence of lines."""
    n = len(features)
    if not n:
        return np.zeros(0, bool)
    (s00, s01), (s10, s11) = field.step.tolist()
    back0, back1 = bytearray(), bytearray()
    a = b = None
    for i in range(0, n, LINES_AT_ONCE):
        # No matrix product: what it rounds may depend on the number of lines.
        for x, y in (features[i:i + LINES_AT_ONCE, :, None] * field.line).sum(axis=1).tolist():
            if a is None:
                a, b = x, y
                continue
            to0, to1 = a + s00 < b + s10, a + s01 < b + s11
            back0.append(to0)
            back1.append(to1)
            a, b = (b + s10 if to0 else a + s00) + x, (b + s11 if to1 else a + s01) + y
    out = np.zeros(n, bool)
    label = out[-1] = a < b
    for i in range(n - 2, -1, -1):
        label = out[i] = bool(back1[i] if label else back0[i])
    return out


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(field: Field, features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of a labelled sequence, by forward and backward sums."""
    scores, n = features @ field.line, len(labels)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = scores[0]
    for t in range(1, n):
        ahead[t] = scores[t] + _log_add(ahead[t - 1][:, None] + field.step, 0)
    for t in range(n - 2, -1, -1):
        behind[t] = _log_add(field.step + (scores[t + 1] + behind[t + 1])[None, :], 1)
    total = _log_add(ahead[-1], 0)
    chance = np.exp(ahead + behind - total)
    truth = np.zeros((n, 2))
    truth[np.arange(n), labels] = 1
    line = features.T @ (truth - chance)
    step = np.zeros((2, 2))
    if n > 1:
        pair = ahead[:-1, :, None] + field.step[None] + (scores[1:] + behind[1:])[:, None, :] - total
        step -= np.exp(pair).sum(axis=0)
        np.add.at(step, (labels[:-1], labels[1:]), 1)
    return line, step


def fit(rows: list[tuple[str, int]], epochs: int = 4, rate: float = 0.5, shrink: float = 1e-3, seed: int = 3) -> Field:
    """Stochastic gradient ascent, one text a step, its gradient divided by its number of lines."""
    field = Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    if not rows:
        field.line[0, 1] = 1.0
        return field
    sheets = [(s, y) for t, y in rows if len((s := sheet(t)).words)]
    rng = np.random.default_rng(seed)
    steps, done = epochs * len(sheets), 0
    for _ in range(epochs):
        for i in rng.permutation(len(sheets)):
            s, y = sheets[i]
            labels = np.full(len(s.words), y)
            labels[s.features[:, FEATURES.index("repeats a line")] > 0] = 0
            line, step = gradient(field, s.features, labels)
            speed = rate * (1 - done / steps) / len(labels)
            done += 1
            field.line += speed * line - rate * shrink * field.line
            field.step += speed * step - rate * shrink * field.step
    return field


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = FIT_ROWS) -> Field:
    return fit(training_rows(docs, labels, label_col, most_rows=most_rows))


def content_share(field: Field, s: Sheet) -> float:
    return float(s.words[viterbi(field, s.features)].sum()) / s.n_words if s.n_words else 0.0


RULES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
         "content_share double, kept boolean")


def apply_rules(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """Per row: id, counts, base_failed, content_share and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in RULES.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 256):
                for text in texts(b.column(text_col).slice(i, 256)):
                    s = sheet(text)
                    share = content_share(shared.value, s)
                    out.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed, share,
                                not s.base_failed and share >= least_share))
            c = list(zip(*out)) or [[]] * 8
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *[pa.array(x, k) for x, k in zip(c, kinds)]], names=[id_col, *names])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {RULES}")
