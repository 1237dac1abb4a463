"""Operator 7: token counts of a unigram tokenizer by dynamic programming on a trie.

Words (runs between white space, led by the word mark) go into a trie, once each. The forward
score of a prefix is the best log-probability of any way to cut it into pieces of the
vocabulary; it depends on the prefix alone, so words that share a prefix share its scores.
Nodes where a word ends store the number of pieces of the best cut.

A task keeps its trie and word counts from batch to batch and drops them when they reach a
bound, so memory does not grow with the input; nothing is shuffled. A word of more than
``LONGEST_IN_TRIE`` characters shares no more than its head with others: it is scored by the same
rule in a window as wide as the longest piece, without nodes, and its count is not kept.

The vocabulary is that of a tokenizer file. Piece probabilities are fixed by rank
(probability falls as 1 / (rank + 1)); nothing is learned. Characters no piece covers cost their
UTF-8 bytes as byte pieces, each as unlikely as the rarest piece. Equal scores go to fewer pieces.

Defined results: a null or empty text, or one of white space only, has 0 tokens and words;
repeated rows are counted each; null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from plantwatch.llm.arrow import map_arrow, texts

MARK = "▁"
MOST_NODES = 1_000_000
MOST_WORDS = 400_000
LONGEST_IN_TRIE = 4096
#: Most characters of the words whose counts a task keeps.
MOST_CHARACTERS = 30_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Log-probabilities of pieces and of one byte piece, and the ends of all pieces."""
    pieces: dict[str, float]
    byte: float
    tails: frozenset[str]


def rank_vocabulary(pieces: list[str]) -> Vocabulary:
    """Probabilities from ranks: pieces in order of rank."""
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
    scores = {p: -math.log(r + 1) - norm for r, p in reversed(list(enumerate(pieces)))}
    return Vocabulary(scores, -math.log(len(pieces) + 1) - norm, frozenset(p[i:] for p in pieces for i in range(len(p))))


def load_vocabulary(path: str) -> Vocabulary:
    """Ordinary pieces of a sentencepiece model file, in order of its scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return rank_vocabulary([model.id_to_piece(i) for i in ids])


class Trie:
    """Forward scores of prefixes. A node: parent, character, best score, piece count, children."""

    def __init__(self, vocabulary: Vocabulary, most_nodes: int = MOST_NODES):
        self.vocabulary, self.most = vocabulary, most_nodes
        self.clear()

    def clear(self) -> None:
        self.parent, self.char, self.score, self.count = [-1], [""], [0.0], [0]
        self.child: list[dict[str, int] | None] = [None]
        self.scored = getattr(self, "scored", 0)

    def _grow(self, at: int, char: str) -> int:
        """New node below ``at``: the best last piece among all suffixes of its prefix."""
        v = self.vocabulary
        self.parent.append(at)
        self.char.append(char)
        self.child.append(None)
        bytes_ = len(char.encode("utf-8", "surrogatepass"))
        best, fewest = self.score[at] + bytes_ * v.byte, self.count[at] + bytes_
        piece, back = "", len(self.parent) - 1
        while True:
            piece = self.char[back] + piece
            if piece not in v.tails:
                break
            back = self.parent[back]
            p = v.pieces.get(piece)
            if p is not None:
                score = self.score[back] + p
                if score > best or score == best and self.count[back] + 1 < fewest:
                    best, fewest = score, self.count[back] + 1
            if back == 0:
                break
        self.score.append(best)
        self.count.append(fewest)
        self.scored += 1
        return len(self.score) - 1

    def tokens(self, word: str) -> int:
        """Pieces of the best cut of a word; walks known prefixes and grows the rest."""
        if len(self.score) > self.most:
            self.clear()
        at = 0
        for c in MARK + word:
            below = self.child[at]
            if below is None:
                below = self.child[at] = {}
            node = below.get(c)
            if node is None:
                node = below[c] = self._grow(at, c)
            at = node
        return self.count[at]


def windowed_tokens(vocabulary: Vocabulary, word: str) -> int:
    """Pieces of the best cut of a word, as a trie finds it, keeping scores for one longest piece only."""
    v, text = vocabulary, MARK + word
    wide = max((len(p) for p in v.tails), default=1) + 1
    score, count = [0.0] * wide, [0] * wide
    for end in range(1, len(text) + 1):
        char = text[end - 1]
        bytes_, last = len(char.encode("utf-8", "surrogatepass")), (end - 1) % wide
        best, fewest = score[last] + bytes_ * v.byte, count[last] + bytes_
        for start in range(end - 1, max(-1, end - wide), -1):
            piece = text[start:end]
            if piece not in v.tails:
                break
            p = v.pieces.get(piece)
            if p is not None:
                at = start % wide
                if score[at] + p > best or score[at] + p == best and count[at] + 1 < fewest:
                    best, fewest = score[at] + p, count[at] + 1
        score[end % wide], count[end % wide] = best, fewest
    return count[len(text) % wide]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_tokens."""
    # Some 32,000 pieces; the size is fixed by the file, not by the data.
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        trie, known, held = Trie(shared.value), {}, 0
        for b in batches:
            words, tokens = [], []
            for i in range(0, b.num_rows, 256):
                for text in texts(b.column(text_col).slice(i, 256)):
                    seen, total = Counter(text.encode().split()), 0
                    for w, n in seen.items():
                        got = known.get(w)
                        if got is None:
                            if len(w) > LONGEST_IN_TRIE:
                                got = windowed_tokens(shared.value, w.decode())
                            else:
                                if len(known) > MOST_WORDS or held > MOST_CHARACTERS:
                                    known.clear()
                                    held = 0
                                got = known[w] = trie.tokens(w.decode())
                                held += len(w)
                        total += n * got
                    words.append(seen.total())
                    tokens.append(total)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=[id_col, "n_words", "n_tokens"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words long, n_tokens long")
