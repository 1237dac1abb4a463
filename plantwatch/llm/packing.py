"""Operator 1: vector bin packing of examples into training sequences.

An example asks for three things at once: tokens, a segment, and loss-bearing tokens. A
sequence has a capacity for each. An open sequence takes, from a bounded pool of waiting
pieces, the piece that fits in every dimension and has the largest dot product of its demand
with what the sequence still has room for. When none fits and cutting is allowed, the piece
with the largest dot product is cut to what is left.

Every task packs its own rows, so nothing is shuffled, no row waits for another task, and a
repeated task gives the same sequences. What is left at the end of a task goes into
sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is an example of its end token alone; repeated rows are
packed again, each as its own example; null ids stay null; an empty table gives no rows;
columns other than the two that are named are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plantwatch.llm.arrow import map_arrow, texts

#: A whole number whose bits above these are the number of the task.
SEQUENCES_PER_TASK = 1 << 32
#: Words of one generation of the cache; a worker keeps two.
CACHED_WORDS = 400_000


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Piece:
    """Part of an example: ids[start:end], loss-bearing tokens before each position in ``before``."""
    key: object
    ids: np.ndarray
    before: np.ndarray | None
    start: int
    end: int

    @property
    def tokens(self) -> int:
        return self.end - self.start

    def loss(self, tokens: int | None = None) -> int:
        end = self.end if tokens is None else self.start + tokens
        return end - self.start if self.before is None else int(self.before[end] - self.before[self.start])

    def most(self, tokens: int, loss: int) -> int:
        """Longest head of at most so many tokens and loss-bearing tokens."""
        tokens = min(tokens, self.tokens)
        if self.before is None:
            return min(tokens, loss)
        stop = np.searchsorted(self.before, self.before[self.start] + loss, "right") - 1
        return max(0, min(tokens, int(stop) - self.start))

    def split(self, tokens: int) -> tuple[Piece, Piece]:
        at = self.start + tokens
        return Piece(self.key, self.ids, self.before, self.start, at), Piece(self.key, self.ids, self.before, at, self.end)


class Packer:
    """Packs a stream of examples; yields sequences, each a list of pieces in order."""

    def __init__(self, capacity: Capacity = Capacity(), pool: int = 256, cut: bool = True, tail_powers: bool = True):
        self.capacity, self.cut, self.tail_powers = capacity, cut, tail_powers
        self.most = pool
        self.pool: list[Piece] = []
        self.demand = np.zeros((2 * pool + 2, 3))
        self.scale = 1 / np.array([capacity.tokens, capacity.segments, capacity.loss], float)

    def _wait(self, piece: Piece) -> None:
        if len(self.pool) == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.pool)] = piece.tokens, 1, piece.loss()
        self.pool.append(piece)

    def _take(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i] = last
            self.demand[i] = self.demand[len(self.pool)]
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        cap = self.capacity
        if not self.cut and (piece.tokens > cap.tokens or piece.loss() > cap.loss):
            raise ValueError("an example is larger than a sequence and may not be cut")
        while piece.tokens >= cap.tokens and piece.most(cap.tokens, cap.loss) == cap.tokens:
            head, piece = piece.split(cap.tokens)
            yield [head]
        while piece.loss() > cap.loss or piece.tokens > cap.tokens:
            head, piece = piece.split(max(1, piece.most(cap.tokens, cap.loss)))
            self._wait(head)
        if piece.tokens:
            self._wait(piece)
        if len(self.pool) >= self.most:
            while len(self.pool) > self.most // 2:
                yield self._fill(cap.tokens)

    def _fill(self, tokens: int) -> list[Piece]:
        room = np.array([tokens, self.capacity.segments, self.capacity.loss], float)
        out: list[Piece] = []
        while self.pool and room[0] and room[1]:
            demand = self.demand[:len(self.pool)]
            match = (demand * self.scale) @ (room * self.scale)
            fits = (demand <= room).all(axis=1)
            if fits.any():
                piece = self._take(int(np.where(fits, match, -1).argmax()))
            else:
                i = int(match.argmax())
                head = self.pool[i].most(int(room[0]), int(room[2])) if self.cut else 0
                if not head:
                    break
                piece, rest = self._take(i).split(head)
                if rest.tokens:
                    self._wait(rest)
            room -= piece.tokens, 1, piece.loss()
            out.append(piece)
        return out

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool:
            tokens = self.capacity.tokens
            left = sum(p.tokens for p in self.pool)
            if self.tail_powers and self.cut and left < tokens:
                tokens = 1 << (left.bit_length() - 1)
            yield self._fill(tokens)


#: The steps before the model of a tokenizer whose plain words can skip them.
LOWERING = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters, which NFC leaves alone, then ASCII marks.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Words that are encoded in one call.
ENCODED_AT_ONCE = 20_000


def plain_model(tokenizer):
    """The model of a tokenizer for words of lower-case Latin letters, without the steps that leave these alone.

    It shares the model's memory. None if the steps are not the ones that ``PLAIN_WORD`` was written for.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    steps, cuts = (json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    steps, cuts = steps.get("normalizers", []), cuts.get("pretokenizers", [])
    if ([s["type"] for s in steps] != LOWERING or [c["type"] for c in cuts] != ["Split", "ByteLevel"]
            or cuts[0]["pattern"].get("Regex") != WORD_PATTERN or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]):
        return None
    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return plain


def word_encoder(tokenizer_json: str, cached_words: int = CACHED_WORDS) -> Callable[[list[str]], list[bytes]]:
    """Ids of whole texts as little-endian 32-bit bytes, by one look-up per word.

    For tokenizers that drop white space, so that the ids of a text are those of its
    words; a word is encoded once as long as it stays in one of two generations of
    ``cached_words`` words (and those of one batch). Most new words are letters
    and marks after them: the tokenizer would cut there and lower the letters, so such a word is
    its lowered letters, which many words share and which go straight to the model, and its marks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    plain = plain_model(tokenizer)
    #: Words met lately, and those of the generation before: a frequent word moves on and is not encoded again.
    known: dict[bytes, bytes] = {b"": b""}
    older: dict[bytes, bytes] = {}

    def learn_letters(new: list[str]) -> None:
        for i in range(0, len(new), ENCODED_AT_ONCE):
            part = new[i:i + ENCODED_AT_ONCE]
            found = plain.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            at = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(part) + 1))).tolist()
            known.update(zip(map(str.encode, part), map(ids.__getitem__, map(slice, at, at[1:]))))

    def learn(new: list[str]) -> None:
        for i in range(0, len(new), ENCODED_AT_ONCE):
            part = new[i:i + ENCODED_AT_ONCE]
            for w, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False)):
                known[w.encode()] = np.array(e.ids, "<u4").tobytes()

    def recall(words: set[bytes]) -> set[bytes]:
        """Words that neither generation knows; those of the older one move to the younger."""
        words = words.difference(known)
        again = [w for w in words if w in older]
        known.update(zip(again, map(older.__getitem__, again)))
        return words.difference(again)

    def meet(new: set[bytes]) -> None:
        whole, joined, parts = [], [], set()
        for w, word in zip(new, b"\n".join(new).decode().split("\n")):
            if plain and (m := PLAIN_WORD.fullmatch(word)):
                low, marks = m[1].lower().encode(), m[2].encode()
                parts.add(low)
                if w != low:
                    parts.add(marks)
                    joined.append((w, low, marks))
            else:
                whole.append(word)
        letters = []
        for w in recall(parts):
            word = w.decode()
            (letters if PLAIN_WORD.match(word) else whole).append(word)
        learn(whole)
        learn_letters(letters)
        for w, low, marks in joined:
            known[w] = known[low] + known[marks]

    def encode(batch: list[str]) -> list[bytes]:
        nonlocal known, older
        split = [text.encode().split() for text in batch]
        if len(known) >= cached_words:
            known, older = {b"": b""}, known
        meet(recall(set().union(*split)))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    return encode


_ENCODERS: dict[int, Callable] = {}


def _encoder(broadcast) -> Callable[[list[str]], list[bytes]]:
    """One encoder per worker process and tokenizer, kept between tasks."""
    key = hash(broadcast.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = word_encoder(broadcast.value)
    return _ENCODERS[key]


PACKED = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 1, capacity: Capacity = Capacity(), pool: int = 256) -> DataFrame:
    """Pieces of documents with their token ids and their place in a sequence.

    ``ids`` holds little-endian unsigned 32-bit ids. The tokenizer file (a few MB) is read by the
    driver and broadcast, so executors need no copy of it. Every token of a document bears loss;
    ``Packer`` itself takes any loss mask.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = _encoder(vocabulary)
        packer = Packer(capacity, pool)
        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        done, rows, held = 0, [], 0

        def place(sequences):
            nonlocal done, held
            for pieces in sequences:
                at = 0
                for p in pieces:
                    rows.append((p.key, p.start, p.tokens, p.ids[p.start:p.end].tobytes(), len(p.ids), first + done, at, p.loss()))
                    at += p.tokens
                held += at
                done += 1

        def flush():
            nonlocal held
            columns = list(zip(*rows)) or [[] for _ in range(8)]
            rows.clear()
            held = 0
            longs = [pa.array(c, pa.int64()) for c in (columns[1], columns[2], columns[4], columns[5], columns[6], columns[7])]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), longs[0], longs[1], pa.array(columns[3], pa.binary()), *longs[2:]],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        id_type = pa.null()
        for batch in batches:
            keys = batch.column(id_col)
            id_type = keys.type
            bodies = batch.column(text_col)
            for i in range(0, batch.num_rows, 64):
                part = encode(texts(bodies.slice(i, 64)))
                for key, ids in zip(keys.slice(i, 64).to_pylist(), part):
                    place(packer.add(Piece(key, array := np.frombuffer(ids + end, "<u4"), None, 0, len(array))))
                if held >= 1 << 21:
                    yield flush()
        place(packer.finish())
        if rows:
            yield flush()

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {PACKED}")
