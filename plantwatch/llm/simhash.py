"""Operator 11: near copies by SimHash, with an inverted index of byte positions and a count filter.

A fingerprint has a bit for each of 64 places: 1 if more than half of the text's shingle hashes
have it. Fingerprints that differ in at most 3 bits are linked, and components follow the links.

1. Equal fingerprints are one node. Three differing bits touch at most three of the eight bytes,
   so linked nodes share at least five bytes in their positions.
2. The index is asked for three positional bytes of one half at a time (eight lists per node): of
   five shared bytes one half holds three or more. Lists of one byte would hold 1/256 of all nodes
   each, and pairs of them would grow with the square of the corpus.
3. In a list the positional bytes that two nodes share are tallied; pairs below the guaranteed
   five go, the rest is verified by its differing bits. A task keeps a spanning forest of the
   verified links, so no pair is emitted.
4. A list of more than ``MOST_TOGETHER`` nodes is asked for two more positional bytes (of its five
   open bytes two are shared at least), and one that is still longer is cut into blocks, of
   which all pairs are compared. Nothing is capped.

Defined results: a null or empty text has fingerprint zero and is linked like any other; fewer
words than a shingle are one shingle; repeated rows and exact copies have one fingerprint and one
component; a component is named by its smallest id, null if no member has one; an empty table
gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plantwatch.llm.arrow import map_arrow
from plantwatch.llm.components import components
from plantwatch.llm.words import byte_pieces, mix
from plantwatch.session import materialise

BYTES = 8
DISTANCE = 3
SHARED = BYTES - DISTANCE
WORDS = 3
SEED = 42
#: Positions of the eight lists: three of the four bytes of a half.
LISTS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
MOST_TOGETHER = 2048
HASHES_AT_ONCE = 200_000
ROWS_AT_ONCE = 65_536

_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes, size: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text in UTF-8, A-Z in lower case, repeats included, piece by piece."""
    held: list[bytes] = []
    whole = True
    digest = xxhash.xxh64_digest
    for piece in byte_pieces(raw):
        held += piece.lower().split()
        if len(held) >= size:
            grams = zip(*(held[k:] for k in range(size)))
            yield np.frombuffer(b"".join([digest(b" ".join(g), SEED) for g in grams]), ">u8").astype(np.uint64)
            held, whole = held[len(held) - size + 1:], False
    if whole and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each of several consecutive groups of hashes, of these sizes.

    Eight bits are counted at a time, one per byte of a 64-bit number; a byte counts up to 255.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    parts = -(-n // 255)
    first_part = np.concatenate([[0], np.cumsum(parts)])[:-1]
    within = np.arange(parts.sum()) - np.repeat(first_part, parts)
    starts = np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], parts) + within * 255
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _ONES, starts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, BYTES).astype(np.int64), first_part, axis=0)
        for byte in range(BYTES):
            out[full] |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (64 bits as a long) and node, a shuffled name of the fingerprint."""
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))

    def run(batches):
        for b in batches:
            marks, held, counts, total = [], [], [], 0
            for raw in b.column("_text"):
                mine = 0
                for h in shingle_hashes(raw.as_py() or b""):
                    held.append(h)
                    mine += len(h)
                counts.append(mine)
                total += mine
                if total >= HASHES_AT_ONCE:
                    marks.append(majorities(np.concatenate(held), np.array(counts)))
                    held, counts, total = [], [], 0
            if counts:
                marks.append(majorities(np.concatenate(held) if held else np.zeros(0, np.uint64), np.array(counts)))
            marks = np.concatenate(marks) if marks else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(marks.view(np.int64)), pa.array(mix(marks).view(np.int64))],
                                             names=["doc_id", "fingerprint", "node"])

    return map_arrow(source, run, "doc_id long, fingerprint long, node long")


def _byte(k: int) -> Column:
    return F.shiftrightunsigned("fingerprint", 8 * k).bitwiseAND(F.lit(255))


def _packed(high: Column, positions: tuple[int, ...]) -> Column:
    return reduce(lambda a, k: F.shiftleft(a, 8).bitwiseOR(_byte(k)), positions, high)


def _index(nodes: DataFrame) -> DataFrame:
    """Eight entries per node: (number of the list, its three bytes) in one number."""
    keys = F.array(*[_packed(F.lit(n).cast("long"), c) for n, c in enumerate(LISTS)])
    return nodes.select("node", "fingerprint", F.explode(keys).alias("key"))


def _finer(entries: DataFrame) -> DataFrame:
    """Ten entries per entry: two more bytes out of those that its list leaves open."""
    which = F.shiftright("key", 24)
    out = None
    for n, c in enumerate(LISTS):
        open_ = [k for k in range(BYTES) if k not in c]
        keys = F.array(*[_packed(F.shiftleft("key", 4).bitwiseOR(F.lit(m)), pair) for m, pair in enumerate(combinations(open_, 2))])
        out = F.when(which == n, keys) if out is None else out.when(which == n, keys)
    return entries.select("node", "fingerprint", F.explode(out).alias("key"))


def _divide(entries: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Entries of lists with at most ``most`` nodes, and those of longer ones with ``_n``, their nodes."""
    long_ = materialise(entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most), "long-lists")
    if long_.isEmpty():
        return entries, None
    return entries.join(long_, "key", "left_anti"), entries.join(long_, "key")


def _units(nodes: DataFrame, most: int) -> DataFrame:
    """(key, unit, fingerprint): all nodes of one unit are compared with each other, at most ``most`` of them or so."""
    short, rest = _divide(_index(nodes), most)
    parts = [short.select("key", F.lit(0).cast("long").alias("unit"), "fingerprint")]
    if rest is not None:
        # Keys of finer lists have 20 bits more; one more bit keeps them apart from the first kind.
        finer = _finer(rest.drop("_n")).withColumn("key", F.col("key").bitwiseOR(F.lit(1 << 50)))
        short, rest = _divide(finer, most)
        parts.append(short.select("key", F.lit(0).cast("long").alias("unit"), "fingerprint"))
        if rest is not None:
            blocks = F.ceil(2 * F.col("_n") / F.lit(most))
            own = F.pmod(F.xxhash64("node"), F.col("_k"))
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))
            parts.append(rest.withColumn("_k", blocks).withColumn("_own", own).withColumn("_x", other).select(
                "key", (F.least("_own", "_x") * F.col("_k") + F.greatest("_own", "_x")).alias("unit"), "fingerprint"))
    return reduce(DataFrame.unionByName, parts)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of equal bytes in equal positions."""
    x = a ^ b
    for k in (4, 2, 1):
        x |= x >> np.uint64(k)
    return BYTES - np.bitwise_count(x & _ONES)


def forest(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For consecutive lists of fingerprints (``ends``: where the list of each ends), the first one each is tied to."""
    root = np.arange(len(marks))
    live, d = np.arange(len(marks)), 1
    while True:
        live = live[live + d < ends[live]]
        if not len(live):
            return root
        a = live[shared_bytes(marks[live], marks[live + d]) >= SHARED]
        a = a[np.bitwise_count(marks[a] ^ marks[a + d]) <= DISTANCE]
        b = a + d
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        d += 1


def links(nodes: DataFrame, most: int = MOST_TOGETHER) -> DataFrame:
    """(a, b): links between nodes that connect what fingerprints within the distance connect."""
    units = _units(nodes, most).repartition("key", "unit").sortWithinPartitions("key", "unit")

    def solve(key, unit, marks):
        new = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(key)]])
        root = forest(marks, np.repeat(bounds[1:], np.diff(bounds)))
        tied = np.flatnonzero(root != np.arange(len(root)))
        names = mix(marks).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[root[tied]])], names=["a", "b"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "unit", "fingerprint")]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= ROWS_AT_ONCE:
                # The last list may go on in the next batch.
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield solve(held[0][:cut], held[1][:cut], held[2][:cut].view(np.uint64))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield solve(held[0], held[1], held[2].view(np.uint64))

    return map_arrow(units, run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TOGETHER) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest id of its component."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(rows.groupBy("node").agg(F.min("fingerprint").alias("fingerprint"), F.min("doc_id").alias("_first")), "nodes")
    place = components(links(nodes, most))
    placed = nodes.join(place, "node", "left").select("node", "_first", F.coalesce("component", "node").alias("_component"))
    named = placed.groupBy("_component").agg(F.min("_first").alias("component_id"))
    ids = placed.join(named, "_component").select("node", "component_id")
    return rows.join(ids, "node").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
