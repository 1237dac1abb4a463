"""Operator 6: n-gram Jaccard join by MinHash banding.

A document is its set of five-word shingles (hashes of 64 bits); two documents are linked
when the Jaccard similarity of their sets is 0.8 or more. Documents with equal sets are one
node of the graph, so exact copies are never paired with each other.

1. Every node gets MinHash values, cut into bands; rows and bands are chosen for the target
   recall at the threshold (``choose_bands``). Band hashes are shuffled; a bucket ties its
   nodes to its smallest one, and ties make candidate families by connected components.
2. The texts of families of two and more nodes, and only those, are turned into full sets. In a
   family of one block (``ONE_BLOCK`` nodes) all pairs are verified on the full sets. A bigger one,
   often a chain or texts around a common passage, is cut into blocks of about 2 * sqrt(nodes);
   pairs of blocks are the units of work, blocks whose set sizes rule out a link are not paired, and
   in a unit the pairs that share a band hash are verified, no others. A task emits link counts and
   one edge per node, never the pairs.
3. Classes are the connected components of the verified links.

Any two linked nodes that share one band are in one family and are verified, so the miss rate is
that of the bands at most. No bucket, family or number of partners is capped.

Defined results: a null or empty text has no shingles, is linked to nothing and is a class of
its own; a text of fewer than five words has one shingle; repeated rows are exact copies; a
class is named by its smallest doc_id, null if it has none; rows without an id are joined like any
other, their texts are found again by hash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantwatch.llm.arrow import map_arrow, texts
from plantwatch.llm.components import components
from plantwatch.llm.words import mix, shingles
from plantwatch.session import materialise, ship_package

THRESHOLD = 0.8
WORDS = 5
RECALL = 0.9999
MOST_HASHES = 192
#: Verifying one pair by itself costs about as much as this many pairs of a matrix product.
PAIR_COST = 40
#: Families of at most this many nodes are one block.
ONE_BLOCK = 160


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall at the threshold."""
    best = None
    for rows in range(1, 65):
        bands = max(1, math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("this recall needs more hash functions than allowed")
    return best


class BandHasher:
    """One 64-bit hash per band of the MinHash values of a set of shingle hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.flip = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        self.times = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.place = rng.integers(0, 2**62, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, sets: np.ndarray, piece: int = 2048) -> np.ndarray:
        low = np.full(len(self.flip), 2**32 - 1, np.uint32)
        small = (sets >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(small), piece):
            values = (small[i:i + piece][None, :] ^ self.flip[:, None]) * self.times[:, None]
            np.minimum(low, values.min(axis=1), out=low)
        values = mix(low.astype(np.uint64).reshape(self.place.shape))
        return mix((values * self.place).sum(axis=1, dtype=np.uint64) + self.place[:, 0]).view(np.int64)


SIGNED = "_doc long, _text_key binary, _node binary, _size long, _bands array<long>"


def _node(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """Per row its id, hash of text, node (hash of its set), set size and band hashes; no node without words."""
    source = docs.select(F.col(id_col).cast("long").alias("_doc"), F.unhex(F.md5(F.col(text_col))).alias("_text_key"),
                         F.col(text_col).alias("_text"))

    def run(batches):
        hasher = BandHasher(bands, rows)
        last = None
        for b in batches:
            nodes, sizes, keys, first = [], [], [], [0]
            for i in range(0, b.num_rows, 256):
                for text in texts(b.column("_text").slice(i, 256)):
                    if last is None or text != last[0]:
                        s = shingles(text, WORDS)
                        last = text, len(s), _node(s) if len(s) else None, hasher(s) if len(s) else None
                    nodes.append(last[2])
                    sizes.append(last[1])
                    if last[3] is not None:
                        keys.append(last[3])
                    first.append(first[-1] + (bands if last[3] is not None else 0))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("_doc"), b.column("_text_key"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(first, pa.int32()), flat)],
                names=["_doc", "_text_key", "_node", "_size", "_bands"])

    return map_arrow(source, run, SIGNED)


def sharing(bands: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a < b) that have a band hash in common, each once; of different sides if given."""
    n = len(bands)
    found = []
    for column in bands.T:
        order = np.argsort(column, kind="stable")
        _, first, counts = np.unique(column[order], return_index=True, return_counts=True)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        end = np.repeat(first + counts, counts)
        live, d = np.arange(n), 1
        while True:
            live = live[live + d < end[live]]
            if not len(live):
                break
            x, y = order[live], order[live + d]
            if side is not None:
                other = side[x] != side[y]
                x, y = x[other], y[other]
            found.append(np.minimum(x, y) * n + np.maximum(x, y))
            d += 1
        if sum(map(len, found)) > n * n:
            found = [np.unique(np.concatenate(found))]
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return every // n, every % n


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the shingles that occur twice
    or more, some thousands of columns at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    found, which, counts = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    use = shared[which]
    owner, which = owner[use], number[which[use]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    common = np.zeros((n, n), np.int64)
    total, columns = int(shared.sum()), max(256, 2_000_000 // n)
    for start in range(0, total, columns):
        lo, hi = np.searchsorted(which, [start, start + columns])
        part = np.zeros((n, min(columns, total - start)), np.float32)
        part[owner[lo:hi], which[lo:hi] - start] = 1
        common += (part @ part.T).astype(np.int64)
    return common


LINKS = "node binary, links long, docs long, root binary"


def verify(group: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links inside a block or between the two blocks of a pair, on full shingle sets.

    Where rows bring their band hashes, only pairs that share one are verified: one by one if
    they are few of all pairs, else by the products that give all of them.
    """
    rows = group.drop_duplicates("node")
    one = group.iloc[0]
    cross = (one["ab"], one["ax"]) != (one["bb"], one["bx"])
    if len(rows) < 2 or cross and rows["side"].nunique() < 2:
        return pd.DataFrame({"node": [], "links": [], "docs": [], "root": []})
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    side = rows["side"].to_numpy()
    n = len(sets)
    whole = np.array([len(s) for s in sets], np.int64)
    asked = None if rows["bands"].iloc[0] is None else sharing(np.stack(rows["bands"].to_numpy()), side if cross else None)
    # common / union >= p / q in whole numbers, so that exact ties are links.
    ratio = Fraction(str(threshold)).limit_denominator(10**8)
    p, q = ratio.numerator, ratio.denominator
    if asked is not None and len(asked[0]) * PAIR_COST < n * n:
        a, b = asked
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
        hit = common * (p + q) >= p * (whole[a] + whole[b])
        linked = np.zeros((n, n), bool)
        linked[a[hit], b[hit]] = linked[b[hit], a[hit]] = True
    else:
        linked = common_counts(sets) * (p + q) >= p * (whole[:, None] + whole[None, :])
        if asked is not None:
            mask = np.zeros((n, n), bool)
            mask[asked[0], asked[1]] = mask[asked[1], asked[0]] = True
            linked &= mask
    np.fill_diagonal(linked, False)
    if cross:
        linked &= side[:, None] != side[None, :]
    copies = rows["copies"].to_numpy()
    links = linked.sum(axis=1)
    root = np.arange(n)
    while True:  # smallest row that can be reached inside the group
        low = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == root).all():
            break
        root = low
    names = rows["node"].to_numpy()
    take = links > 0
    return pd.DataFrame({"node": names[take], "links": links[take].astype(np.int64),
                         "docs": (linked @ copies)[take].astype(np.int64), "root": names[root[take]]})


def _blocks(nodes: Column, shingle_total: Column) -> Column:
    """Number of hash blocks of a family: about 2 * sqrt(nodes) nodes each, and a bounded number of shingles."""
    by_nodes = F.when(nodes <= ONE_BLOCK, F.lit(1)).otherwise(F.ceil(nodes / F.greatest(F.lit(96.0), 2 * F.sqrt(nodes))))
    return F.greatest(by_nodes, F.ceil(shingle_total / F.lit(4_000_000))).cast("int")


def _units() -> Column:
    """Units of work a node takes part in: its own block, and its block paired with each other
    block of its band of set sizes and of the two bands next to it. A unit is named by its two
    blocks (band and block each); ``side`` says which of them the node is in."""
    band, block = F.col("_band"), F.col("_block")

    def unit(ab, ax, bb, bx, side):
        return F.struct(ab.alias("ab"), ax.alias("ax"), bb.alias("bb"), bx.alias("bx"), F.lit(side).alias("side"))

    every = F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1)
    above = F.filter(every, lambda x: F.array_contains("_present", F.col("_band") + 1))
    below = F.filter(every, lambda x: F.array_contains("_present", F.col("_band") - 1))
    own = F.array(unit(band, block, band, block, 0))
    return F.when(F.col("_k").isNull(), own).otherwise(F.concat(
        own,
        F.transform(F.filter(every, lambda x: x > F.col("_block")), lambda x: unit(band, block, band, x, 0)),
        F.transform(F.filter(every, lambda x: x < F.col("_block")), lambda x: unit(band, x, band, block, 1)),
        F.transform(above, lambda x: unit(band, block, band + 1, x, 0)),
        F.transform(below, lambda x: unit(band - 1, x, band, block, 1))))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
            recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): a row per document with its node, and a row per node.

    nodes: _node, _rep (smallest id), _copies, links (other nodes), linked_docs, _class (a node of the class).
    """
    spark = docs.sparkSession
    ship_package(spark)
    bands, rows = choose_bands(threshold, recall, most_hashes)
    signed = materialise(signatures(docs, id_col, text_col, bands, rows), "signatures")
    # Rows of one node have equal bands and set sizes; any copy of them will do.
    nodes = materialise(
        signed.filter(F.col("_node").isNotNull()).groupBy("_node")
        .agg(F.min(F.struct(F.col("_doc").isNull().alias("_none"), "_doc", "_text_key")).alias("_first"),
             F.count(F.lit(1)).alias("_copies"), F.first("_size").alias("_size"), F.first("_bands").alias("_bands"))
        .select("_node", F.col("_first._doc").alias("_rep"), F.col("_first._text_key").alias("_text_key"), "_copies", "_size", "_bands"),
        "nodes")
    # A band's number is part of its hash, so the hash alone is the key of a bucket.
    keys = nodes.select("_node", F.explode("_bands").alias("_key"))
    buckets = (keys.groupBy("_key").agg(F.min("_node").alias("_low"), F.count(F.lit(1)).alias("_n"))
               .filter("_n > 1").drop("_n"))
    ties = keys.join(buckets, "_key").filter("_node <> _low").select(F.col("_node").alias("a"), F.col("_low").alias("b"))
    family = components(ties)
    # Families and their blocks.
    member = materialise(family.join(nodes, F.col("node") == F.col("_node"))
                         .select("component", "node", "_rep", "_text_key", "_copies", "_size", "_bands",
                                 F.floor(F.log(F.col("_size").cast("double")) / F.lit(-math.log(threshold))).cast("int").alias("_band")),
                         "members")
    big = (member.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"),
                                           F.collect_set("_band").alias("_present"))
           .withColumn("_k", _blocks(F.col("_n"), F.col("_s"))).filter("_k > 1").select("component", "_k", "_present"))
    placed = member.join(big, "component", "left").withColumn(
        "_block", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")))
    placed = placed.withColumn("_band", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.col("_band")))
    units = placed.withColumn("_unit", F.explode(_units()))

    # Full sets, once per node, from the texts of family members.
    wanted = member.filter(F.col("_rep").isNotNull()).select(F.col("_rep").alias("_doc"), F.col("_text_key").alias("_want"), F.col("node").alias("_name"))
    bodies = docs.select(F.col(id_col).cast("long").alias("_doc"), F.unhex(F.md5(F.col(text_col))).alias("_text_key"), F.col(text_col).alias("_text"))
    # The list grows with the corpus, so it is never broadcast; texts move once, by the same plan at every size.
    chosen = bodies.join(wanted.hint("merge"), (bodies["_doc"] == wanted["_doc"]) & (bodies["_text_key"] == wanted["_want"])).select("_name", "_text")

    unnamed = member.filter(F.col("_rep").isNull()).select(F.col("_text_key").alias("_want"), F.col("node").alias("_name"))
    if not unnamed.isEmpty():
        # Many rows may have one of these texts; copies go before the shuffle.
        without = bodies.filter(F.col("_doc").isNull()).groupBy("_text_key").agg(F.first("_text").alias("_text"))
        chosen = chosen.unionByName(without.join(unnamed.hint("merge"), without["_text_key"] == unnamed["_want"]).select("_name", "_text"))

    def full_sets(batches):
        for b in batches:
            made = [shingles(t, WORDS).tobytes() for i in range(0, b.num_rows, 256) for t in texts(b.column("_text").slice(i, 256))]
            yield pa.RecordBatch.from_arrays([b.column("_name"), pa.array(made, pa.binary())], names=["_name", "shingles"])

    sets = map_arrow(chosen, full_sets, "_name binary, shingles binary")
    work = units.join(sets, units["node"] == sets["_name"]).select(
        "component", "_unit.ab", "_unit.ax", "_unit.bb", "_unit.bx", "_unit.side", "node", F.col("_copies").alias("copies"),
        F.when(F.col("_k").isNotNull(), F.col("_bands")).alias("bands"), "shingles")
    verified = materialise(
        work.groupBy("component", "ab", "ax", "bb", "bx").applyInPandas(lambda g: verify(g, threshold), LINKS),
        "verified")
    classes = components(verified.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("docs").alias("linked_docs"))
    joined = counts.join(classes, "node", "left")
    plain = nodes.drop("_bands", "_text_key")
    out = materialise(plain.join(joined, plain["_node"] == joined["node"], "left").select(
        "_node", "_rep", "_copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"),
        F.coalesce("component", "_node").alias("_class")), "classes")
    return signed.select("_doc", "_text_key", "_node"), out


def classes_of_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with ``class_id``, the smallest doc_id of their class. Minima combine before the shuffle."""
    named = nodes.groupBy("_class").agg(F.min("_rep").alias("class_id"))
    return nodes.join(named, "_class")


def join_documents(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id, copy_id (smallest id with the same shingles), n_links (other
    documents at the threshold or above, copies included), n_linked_texts (other shingle sets)."""
    rows, nodes = similar(docs, **options)
    info = classes_of_nodes(nodes)
    out = rows.join(info, "_node", "left")
    return out.select(F.col("_doc").alias("doc_id"), F.coalesce("class_id", F.when(F.col("_node").isNull(), F.col("_doc"))).alias("class_id"),
                      F.coalesce("_rep", F.when(F.col("_node").isNull(), F.col("_doc"))).alias("copy_id"),
                      F.coalesce(F.col("linked_docs") + F.col("_copies") - 1, F.lit(0)).alias("n_links"),
                      F.coalesce("links", F.lit(0)).alias("n_linked_texts"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, of each class only the document with the smallest id.

    Texts are not shuffled for the decision; the keys (id and hash of text) to drop are joined
    against the rows. Rows without words stay; of repeated rows (same id and text) one stays; a row
    without an id stays only in a class without ids, there the one with the smallest hash.
    """
    rows, nodes = similar(docs, id_col, text_col, **options)
    keys = (rows.filter(F.col("_node").isNotNull()).groupBy("_doc", "_text_key", "_node").agg(F.count(F.lit(1)).alias("_n"))
            .join(nodes.select("_node", "_class"), "_node"))
    order = F.struct(F.col("_doc").isNull().alias("_none"), "_doc", "_text_key")
    first = keys.groupBy("_class").agg(F.min(order).alias("_stays"))
    judged = materialise(keys.join(first, "_class").select("_doc", "_text_key", (F.col("_doc").eqNullSafe(F.col("_stays._doc")) & (F.col("_text_key") == F.col("_stays._text_key"))).alias("_stay"), "_n"), "judged")
    drop = judged.filter(~F.col("_stay"))
    twice = judged.filter(F.col("_stay") & (F.col("_n") > 1)).select("_doc", "_text_key", F.lit(True).alias("_again"))
    rows_ = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.unhex(F.md5(F.col(text_col))).alias("_key"))

    def same(other: DataFrame) -> Column:
        return rows_["_id"].eqNullSafe(other["_doc"]) & rows_["_key"].eqNullSafe(other["_text_key"])

    left = rows_.join(drop.hint("merge"), same(drop), "left_anti")
    if twice.isEmpty():
        return left.select("_row.*")
    marked = left.join(twice.hint("merge"), same(twice), "left")
    single = marked.filter(F.col("_again").isNull()).select("_row")
    again = marked.filter(F.col("_again")).dropDuplicates(["_id", "_key"]).select("_row")
    return single.unionByName(again).select("_row.*")
