"""Operator 12: prefix trie of conversations by ROLLUP over positional turn-id columns.

Every sequence of first turns that some conversation begins with is a node. Turns become ids (120
bits of their md5), and a conversation becomes rows of ``BLOCK`` positional id columns: one row for
its first turns, one for the next ones, and so on. ROLLUP over (prior, t0, t1, ...) aggregates all
prefixes of all blocks in one job; ``grouping_id`` tells the depth, and ``prior`` is the node where
the block before ended. Its name comes from running sums of hashes of (place, turn), so a block
needs no other block and conversations of any length take the same number of jobs.

Sums over the subtree of a node come from the same ROLLUP, since a subtree is the set of the
node's members. The smallest member owns a node, and the nodes a conversation owns are the end of
its path. A member that is not the owner of a node shares S bytes with smaller ones, up to the first
node it owns, so S less the bytes above the node is what it saves inside the subtree. Leaves are
counted by their owners.

Groups are conversations by block (at most ``BLOCK`` turns) and partial aggregates; positions and
running sums are worked out in slots where a conversation is very long (``operators.ordering``).

Defined results: rows without conv_id belong to no conversation; null roles and texts are empty;
turns of equal number are ordered by the md5 of role and text, repeated rows are turns of their own;
an empty table has no nodes. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantwatch.llm.arrow import map_arrow
from plantwatch.operators.ordering import ordered_index, running_totals
from plantwatch.session import materialise

BLOCK = 8
#: Ids of the members that end at a node are joined to text in ranges of this width.
ID_RANGE = 4096
#: Most turns that the contract's rebuilding takes over from another conversation.
MOST_TAKEN = 8

_LANES = ("p0", "p1", "p2", "p3")


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, n): turns in order; a and b are the turn's id, n the UTF-8 bytes of its text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))

    def number(start: int) -> Column:
        return F.conv(F.substring("_md5", start, 15), 16, 10).cast("long")

    turns = materialise(
        conversations.filter(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("_md5"),
                F.octet_length(text).cast("long").alias("n"))
        .select("conv_id", "turn", number(1).alias("a"), number(16).alias("b"), "n"), "turns")
    # Missing turn numbers come first, in the slots of very long conversations too.
    by = F.coalesce(F.col("turn").cast("double"), F.lit(-1e300))
    return ordered_index(turns, ["conv_id"], [F.asc_nulls_first("turn"), "a", "b"], "pos", by=by).drop("turn")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: (turns with ``total``, conversations with ``total``).

    Conversation c takes the first h turns of conversation c - c % 5 (as many as it has) and goes on with its own
    turns after its first h; h = crc32(decimal c) % 9.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("_had"))
    plans = materialise(
        sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 9).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
        .join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("_had", F.lit(0)).cast("long")))
        .select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")),
        "plans")
    heads = turns.filter(F.col("pos") < MOST_TAKEN).withColumnRenamed("conv_id", "base").join(plans, "base").filter("pos < h")
    tails = turns.join(plans, "conv_id").filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "a", "b", "n", "total"]
    return materialise(heads.select(columns).unionByName(tails.select(columns)), "rebuilt"), plans.select("conv_id", "total")


def _blocks(turns: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """A row per conversation and block: t0.. (id and bytes of its turns), lanes of the prefix
    before it (p0..) and after it (e0.., full blocks only), bytes before it."""
    halves = [F.xxhash64("pos", "a", "b"), F.xxhash64("b", "a", "pos")]
    lanes = {}
    for k, h in enumerate(halves):
        lanes[_LANES[2 * k]] = h.bitwiseAND(F.lit(2**32 - 1))
        lanes[_LANES[2 * k + 1]] = F.shiftrightunsigned(h, 32)
    sums = running_totals(turns.withColumns(lanes), ["conv_id"], "pos", {**{f"s_{x}": x for x in _LANES}, "s_n": "n"})
    place = F.pmod("pos", F.lit(width))

    def at(k: int, value) -> Column:
        return F.max(F.when(place == k, value))

    rows = sums.groupBy("conv_id", F.floor(F.col("pos") / F.lit(width)).alias("block")).agg(
        F.max("total").alias("total"), F.count(F.lit(1)).alias("here"),
        *[at(k, F.col(c)).alias(f"_{c}{k}") for k in range(width) for c in ("a", "b", "n")],
        *[at(0, F.col(f"s_{x}") - F.col(x)).alias(x) for x in _LANES], at(0, F.col("s_n") - F.col("n")).alias("before"),
        *[at(width - 1, F.col(f"s_{x}")).alias(f"e{x[1:]}") for x in _LANES])
    ids = [F.when(F.col(f"_n{k}").isNotNull(), F.struct(*[F.col(f"_{c}{k}").alias(c) for c in ("a", "b", "n")])).alias(f"t{k}")
           for k in range(width)]
    rows = rows.select("conv_id", "block", "total", "here", "before", *_LANES, *[f"e{k}" for k in range(len(_LANES))], *ids)
    zero = F.lit(0).cast("long")
    none = sizes.filter("total = 0").select(
        "conv_id", zero.alias("block"), "total", zero.alias("here"), zero.alias("before"), *[zero.alias(x) for x in _LANES],
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c[0] in "et" and c[1:].isdigit()])
    prior = _digest("block", *_LANES)
    return materialise(rows.unionByName(none).withColumn("prior", prior).drop(*_LANES), "blocks")


def _digest(*columns) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *[c if isinstance(c, Column) else F.col(c).cast("string") for c in columns])))


def _node_key(level: Column, width: int) -> Column:
    """Name of the node at a level of a block row or group."""
    steps = [c for k in range(width) for c in (f"t{k}.a", f"t{k}.b")]
    out = F.when(level == 0, F.col("prior")).when(
        level == width, _digest((F.col("block") + 1).cast("string"), *[f"e{k}" for k in range(len(_LANES))]))
    for k in range(1, width):
        out = out.when(level == k, _digest(F.hex("prior"), *steps[:2 * k]))
    return out


def _picked(values: list[Column], level: Column) -> Column:
    return F.element_at(F.array(*values), level.cast("int") + 1)


def _rolled(blocks: DataFrame, width: int, **sums: Column) -> DataFrame:
    """A row per node: _level, depth, conv_id (smallest member), key columns and the aggregates."""
    names = [f"t{k}" for k in range(width)]
    rolled = blocks.rollup("prior", *names).agg(
        F.grouping_id().alias("_gid"), F.min("conv_id").alias("conv_id"), F.min("block").alias("block"),
        *[F.min(f"e{k}").alias(f"e{k}") for k in range(len(_LANES))], *[v.alias(k) for k, v in sums.items()])
    # A prefix of j turns leaves the last width - j columns out: grouping_id is 2 ** (width - j) - 1.
    level = F.lit(None).cast("long")
    present = F.lit(False)
    for j in range(width + 1):
        here = F.col("_gid") == 2 ** (width - j) - 1
        level = F.when(here, F.lit(j).cast("long")).otherwise(level)
        # The head of a later block is the end of the one before; groups without their last turn are shorter prefixes.
        present = F.when(here, F.col(f"t{j - 1}").isNotNull() if j else F.col("block") == 0).otherwise(present)
    return rolled.filter(present).withColumn("_level", level).withColumn("depth", F.col("block") * width + F.col("_level"))


def build_trie(turns: DataFrame, sizes: DataFrame, width: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations given as turns (conv_id, pos, a, b, n, total) and sizes (conv_id, total).

    nodes: key, parent (key), depth, conv_id (smallest member), n_convs, n_leaves, saved (see the module).
    ends: key of the node where each conversation ends.
    """
    blocks = _blocks(turns, sizes, width)
    bytes_ = [F.coalesce(F.col(f"t{k}.n"), F.lit(0)) for k in range(width)]
    upto = [F.lit(0).cast("long")]
    for x in bytes_:
        upto.append(upto[-1] + x)
    level = F.col("_level")
    # First pass: who owns the nodes.
    owned = _rolled(blocks, width, deepest=F.max("total"), before=F.min("before")).select(
        "conv_id", F.when(level == 0, F.lit(0)).otherwise(F.col("before") + _picked([upto[0], *upto[:-1]], level)).alias("shared"),
        (F.col("deepest") == F.col("depth")).cast("int").alias("leaf"))
    owners = owned.groupBy("conv_id").agg(F.min("shared").alias("shared"), F.max("leaf").alias("leaf"))
    wholes = blocks.groupBy("conv_id").agg(F.max(F.col("before") + upto[-1]).alias("whole"))
    known = materialise(wholes.join(owners, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "whole").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "owners")
    # Second pass: sums over subtrees.
    full = blocks.join(known, "conv_id")
    gains = [F.col("shared"), *[F.greatest(F.lit(0).cast("long"), F.col("shared") - F.col("before") - above) for above in upto[:-1]]]
    rolled = _rolled(full, width, n_convs=F.count(F.lit(1)), n_leaves=F.sum("leaf"), **{f"v{k}": F.sum(g) for k, g in enumerate(gains)})
    nodes = materialise(rolled.select(
        _node_key(level, width).alias("key"), F.when(level > 0, _node_key(level - 1, width)).alias("parent"), "depth", "conv_id",
        "n_convs", "n_leaves", _picked([F.col(f"v{k}") for k in range(width + 1)], level).alias("saved")), "trie")
    ends = blocks.filter(F.col("block") * width + F.col("here") == F.col("total")).select(
        _node_key(F.col("here"), width).alias("key"), "conv_id")
    return nodes, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids that end at a node, ascending and comma-joined.

    Ids are joined to text by ranges of ids first, so the one task that reads the ids of a node in
    order reads a row per range, and keeps no more than the state of the hash.
    """
    ranges = (ends.groupBy("key", F.floor(F.col("conv_id") / F.lit(ID_RANGE)).alias("_range"))
              .agg(F.array_sort(F.collect_list("conv_id")).alias("_ids"))
              .select("key", "_range", F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",").alias("_text")))

    def run(batches):
        last, state = None, None
        for b in batches:
            keys, digests = [], []
            for key, text in zip(b.column("key").to_pylist(), b.column("_text").to_pylist()):
                if key == last:
                    state.update(b",")
                else:
                    if state is not None:
                        keys.append(last)
                        digests.append(state.hexdigest())
                    last, state = key, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return map_arrow(ranges.repartition("key").sortWithinPartitions("key", "_range"), run, "key binary, ends_sha256 string")


def describe(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with parent_conv_id, n_children and ends_sha256."""
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("key").alias("_above"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, "key", "left").join(end_digests(ends), "key", "left")
    out = out.join(above, out["parent"] == above["_above"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
