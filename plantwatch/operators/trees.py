"""Tree ensembles on binned rows: boosting with second-order gains, and forests of balanced bootstraps.

Features become small integers once, by cut points of one quantile pass, and rows are kept as
blocks of bins (``binned``). A split is chosen from sums of gradient and Hessian per bin. Rows that
agree in all bins, the label and the fold are one entry with its number of rows: no tree can tell
them apart, so the sums stay the same, and a sample draws how many of them it takes.

* A table whose entries fit one task (``spark.plantwatch.rowsPerTask``) is fitted model by model: the
  blocks go to as many tasks as there are groups of models, and a task grows its models on them.
  The histogram of the larger of two siblings is the parent's less the smaller one's.
* A bigger table stays where it is. Every level of a tree is one job for all models together:
  tasks add up histograms of their own blocks per (model, node), these are summed per key, and only
  the chosen splits reach the driver. Margins are written to the shared folder after every tree,
  so a lost executor costs one tree. Of a forest some trees grow side by side, as many as
  ``SIDE_BY_SIDE`` allows, and are written before the next ones begin.

Both ways sample rows and columns by the same hashes and draws, so they grow the same trees up to rounding;
what a forest adds up are whole numbers, so its splits agree in every bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantwatch.session import fresh_path, materialise, rows_per_task, ship_package

MAX_BINS = 64
#: Most numbers of one level's histograms that a task holds at once.
MAX_CELLS = 6_000_000
#: A model of more nodes stays in the shared folder, and its trees are dealt to tasks.
MAX_LOCAL_NODES = 300_000
#: Most nodes that one task holds of such a model, but for a single tree.
GROUP_NODES = 500_000
#: Least entries, and most cells, of columns that are counted together.
JOINT_ROWS = 1 << 15
JOINT_CELLS = 1 << 11
#: Blocks of rows, or sums of trees over a block, in one file.
FILE_SUMS = 8
#: Trees of a forest in one file, which a task reads at once.
FILE_TREES = 2
#: Most cells (nodes x columns x bins), or entries x columns, that a forest weighs at once.
PRESENT_CELLS = 1 << 17
#: Most entries x trees of a forest that grow side by side beyond one task.
SIDE_BY_SIDE = 8_000_000
#: Different rows of one block that is scored by such a model.
BLOCK_ROWS = 1 << 17
_EPS = 1e-9


@dataclass(frozen=True)
class Spec:
    """How one model is grown. ``fold``: rows of this fold take no part in the fit."""

    kind: str = "boosted"
    n_estimators: int = 300
    max_depth: int | None = 8
    learning_rate: float = 0.08
    min_child_weight: float = 4
    subsample: float = 1.0
    colsample_bytree: float = 0.9
    gamma: float = 0.5
    reg_lambda: float = 1.0
    reg_alpha: float = 0.5
    min_leaf: int = 1
    pos_weight: float = 1.0
    seed: int = 42
    fold: int | None = None
    #: Number of the first tree: a forest may be grown in parts.
    first_tree: int = 0


@dataclass
class TreeModel:
    """Flat nodes of all trees; a leaf points to itself. Rows with x <= cut go left."""

    kind: str
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    depth: int = field(default=0)

    NODES = "tree int, id int, left int, right int, feature int, cut double, value double, cover double"

    def frame(self) -> pd.DataFrame:
        """A row per node, ids inside each tree; leaves have no children (-1)."""
        sizes = np.diff(np.append(self.roots, len(self.feature)))
        first = np.repeat(self.roots, sizes)
        every = np.arange(len(self.feature))
        leaf = self.left == every
        return pd.DataFrame({
            "tree": np.repeat(np.arange(len(self.roots)), sizes), "id": every - first,
            "left": np.where(leaf, -1, self.left - first), "right": np.where(leaf, -1, self.right - first),
            "feature": np.where(leaf, -1, self.feature), "cut": self.cut, "value": self.value, "cover": self.cover})

    @classmethod
    def from_frame(cls, kind: str, nodes: pd.DataFrame) -> "TreeModel":
        nodes = nodes.sort_values(["tree", "id"], ignore_index=True)
        roots = np.flatnonzero(nodes["id"].to_numpy() == 0)
        first = np.repeat(roots, np.diff(np.append(roots, len(nodes))))
        every = np.arange(len(nodes))
        leaf = nodes["left"].to_numpy() < 0
        model = cls(kind, roots, np.where(leaf, 0, nodes["feature"]), nodes["cut"].to_numpy(float),
                    np.where(leaf, every, nodes["left"] + first), np.where(leaf, every, nodes["right"] + first),
                    nodes["value"].to_numpy(float), nodes["cover"].to_numpy(float))
        level, model.depth = np.array(roots), 0
        while True:
            level = level[~leaf[level]]
            if not len(level):
                return model
            level = np.concatenate([model.left[level], model.right[level]])
            model.depth += 1

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of each row."""
        out = np.zeros(len(x))
        flat = np.ascontiguousarray(x).ravel()
        base = np.arange(len(x)) * x.shape[1]
        for root in self.roots:
            at = np.full(len(x), root)
            live = np.arange(len(x))
            while True:
                here = at[live]
                live = live[self.left[here] != here]
                if not len(live):
                    break
                here = at[live]
                at[live] = np.where(flat[base[live] + self.feature[here]] <= self.cut[here], self.left[here], self.right[here])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(raw, 0, 1) if self.kind == "forest" else 1 / (1 + np.exp(-raw))

    def add_scores(self, df: DataFrame, features: str, name: str) -> DataFrame:
        """``name``: P(positive class) of the vector column ``features``."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.probability(np.vstack(x.to_numpy())) if len(x) else np.zeros(0))

        return df.withColumn(name, score(vector_to_array(features)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.frame(), self.NODES).coalesce(1).write.mode("overwrite").parquet(path)


TREE = "model int, tree int, nodes long, feature binary, bin binary, left binary, value binary, cover binary"


def _pack(model: int, tree: int, b: TreeBuilder, scale: float) -> dict:
    """One tree as flat arrays in bytes; the right child follows the left one."""
    return {"model": model, "tree": tree, "nodes": len(b.feature), "feature": np.array(b.feature, np.int16).tobytes(),
            "bin": np.maximum(b.bin, 0).astype(np.uint8).tobytes(), "left": np.array(b.left, np.int32).tobytes(),
            "value": (np.array(b.value) * scale).tobytes(), "cover": np.array(b.cover, float).tobytes()}


def _unpack(kind: str, trees: pd.DataFrame, cuts: list[np.ndarray] | None) -> TreeModel:
    """Some trees side by side; without ``cuts`` they are for rows of bins."""
    trees = trees.sort_values("tree")
    sizes = trees["nodes"].to_numpy(np.int64)
    roots = np.cumsum(sizes) - sizes
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in trees[name]])
    feature, left, bin_ = read("feature", np.int16), read("left", np.int32), read("bin", np.uint8)
    every, leaf = np.arange(len(left)), left < 0
    first = np.where(leaf, every, left + np.repeat(roots, sizes))
    feature = np.where(leaf, 0, feature)
    cut = bin_
    if cuts is not None:
        start = np.cumsum([0, *map(len, cuts)])
        cut = np.zeros(len(left))
        cut[~leaf] = np.concatenate(cuts)[start[feature[~leaf]] + bin_[~leaf]]
    return TreeModel(kind, roots, feature, cut, first, np.where(leaf, every, first + 1), read("value", float), read("cover", float))


@dataclass
class StoredTrees:
    """A model of too many nodes for the driver: a row per tree in the shared folder.

    Blocks of rows meet groups of trees in tasks, and what the groups give is added up per block.
    """

    kind: str
    rows: DataFrame
    cuts: list[np.ndarray]
    sizes: dict[int, int]

    def local(self) -> TreeModel:
        """The whole model in this process."""
        rows = self.rows.toPandas()
        model = _unpack(self.kind, rows, self.cuts)
        return TreeModel.from_frame(self.kind, model.frame())

    def over_blocks(self, blocks: DataFrame, n_blocks: int, give, whole_cuts: bool) -> DataFrame:
        """(block, total): sum over all trees of ``give(block's row, some trees)``; blocks are numbered from 0."""
        spark = blocks.sparkSession
        ship_package(spark)
        least = min(len(self.sizes), -(-4 * spark.sparkContext.defaultParallelism // n_blocks))
        most = min(GROUP_NODES, max(1, sum(self.sizes.values()) // least))
        group, held, numbers = 0, 0, []
        for tree, nodes in sorted(self.sizes.items()):
            if held and held + nodes > most:
                group, held = group + 1, 0
            held += nodes
            numbers.append((tree, group))
        dealt = F.broadcast(spark.createDataFrame(numbers, "tree int, _group int"))
        trees = self.rows.join(dealt, "tree").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        copies = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(group))))
        kind, cuts = self.kind, self.cuts if whole_cuts else None

        def meet(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            if not len(block):
                return pd.DataFrame({"block": [], "_group": [], "total": []})
            total = give(block.iloc[0], _unpack(kind, some, cuts))
            return pd.DataFrame({"block": [block["block"].iloc[0]], "_group": [block["_group"].iloc[0]], "total": [total.astype(float).tobytes()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in pdf.sort_values("_group")["total"])
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "total": [total.tobytes()]})

        parts = copies.groupBy("block", "_group").cogroup(trees.groupBy("block", "_group")).applyInPandas(meet, "block long, _group int, total binary")
        return materialise(parts, "tree-sums", file_rows=FILE_SUMS).groupBy("block").applyInPandas(add, "block long, total binary")

    def add_scores(self, df: DataFrame, features: str, name: str) -> DataFrame:
        """``name``: P(positive class) of the vector column ``features``; rows that agree in all bins are scored once."""
        ship_package(df.sparkSession)
        cuts, width, forest = self.cuts, len(self.cuts), self.kind == "forest"

        @F.pandas_udf("binary")
        def code(x: pd.Series) -> pd.Series:
            return _packed(_codes(np.vstack(x.to_numpy()), cuts)) if len(x) else pd.Series([], dtype=object)

        keyed = df.withColumn("_bins", code(vector_to_array(features)))
        different = materialise(keyed.select("_bins").distinct(), "patterns")
        n_blocks = max(1, -(-different.count() // BLOCK_ROWS))

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bins": [b"".join(pdf["_bins"])]})

        def score(row: pd.Series, trees: TreeModel) -> np.ndarray:
            return trees.raw(np.frombuffer(row["bins"], np.uint8).reshape(-1, width))

        def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for bins, total in zip(pdf["bins"], pdf["total"]):
                    raw = np.frombuffer(total)
                    yield pd.DataFrame({"_bins": _packed(np.frombuffer(bins, np.uint8).reshape(-1, width)),
                                        name: np.clip(raw, 0, 1) if forest else 1 / (1 + np.exp(-raw))})

        blocks = materialise(_in_blocks(different, "_bins", n_blocks).applyInPandas(block, "block long, bins binary"), "pattern-blocks", file_rows=FILE_SUMS)
        totals = self.over_blocks(blocks, n_blocks, score, False)
        scores = materialise(blocks.join(totals, "block").mapInPandas(spread, f"_bins binary, `{name}` double"), "pattern-scores")
        return keyed.join(scores, "_bins").drop("_bins")

    def save(self, spark: SparkSession, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.cuts)], "feature int, cuts array<double>").coalesce(
            1).write.mode("overwrite").parquet(f"{path}-cuts")


def _in_blocks(df: DataFrame, key: str, n_blocks: int):
    """Rows grouped into blocks 0, 1, ... by a hash of their key."""
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long")).groupBy("block")


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["tree"]: r["nodes"] for r in rows.select("tree", "nodes").collect()}


def load_trees(spark: SparkSession, kind: str, path: str) -> TreeModel | StoredTrees:
    stored = spark.read.parquet(path)
    if "nodes" not in stored.columns:
        return TreeModel.from_frame(kind, stored.toPandas())
    cuts = spark.read.parquet(f"{path}-cuts").orderBy("feature").collect()
    return StoredTrees(kind, stored, [np.array(r["cuts"], float) for r in cuts], _sizes(stored))


# --- Bins -----------------------------------------------------------------------------------

def quantile_cuts(df: DataFrame, features: str, n: int, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cut points of every position of a vector column, in one pass."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    x = vector_to_array(features)
    row = df.select(x.alias("_x")).agg(*[F.percentile_approx(F.col("_x")[k], shares, F.lit(bins * 50)).alias(f"c{k}") for k in range(n)]).first()
    # The largest value is no cut: nothing lies above it.
    return [np.unique(np.array(row[f"c{k}"] or [], float)) for k in range(n)]


BLOCK = "block long, n int, bins binary, y binary, fold binary, count binary, extra binary"


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins (one byte per row and feature) of a block of vectors."""
    return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1).astype(np.uint8)


def _packed(codes: np.ndarray) -> pd.Series:
    """The bins of each row as bytes."""
    width = codes.shape[1]
    raw = np.ascontiguousarray(codes).tobytes()
    return pd.Series([raw[i:i + width] for i in range(0, len(raw), width)], dtype=object)


def binned(df: DataFrame, features: str, n: int, label: str, cuts: list[np.ndarray], fold: str | None = None) -> DataFrame:
    """Blocks of entries: bins (one byte per feature and entry, by feature), labels, folds and numbers of equal rows."""
    cols = [vector_to_array(features).alias("_x"), F.col(label).cast("int").alias("_y"),
            (F.col(fold) if fold else F.lit(255)).cast("int").alias("_f")]

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (f for f in frames if len(f)):
            yield pd.DataFrame({"p": _packed(_codes(np.vstack(pdf["_x"].to_numpy()), cuts)), "y": pdf["_y"], "f": pdf["_f"]})

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for k, pdf in enumerate(f for f in frames if len(f)):
            bins = np.frombuffer(b"".join(pdf["p"]), np.uint8).reshape(len(pdf), n).T
            yield pd.DataFrame({"block": [(part << 32) + k], "n": [len(pdf)], "bins": [bins.tobytes()],
                                "y": [pdf["y"].to_numpy(np.uint8).tobytes()], "fold": [pdf["f"].to_numpy(np.uint8).tobytes()],
                                "count": [pdf["c"].to_numpy(np.int64).tobytes()], "extra": [b""]})

    spark = df.sparkSession
    ship_package(spark)
    entries = df.select(*cols).mapInPandas(code, "p binary, y int, f int").groupBy("p", "y", "f").agg(F.count(F.lit(1)).alias("c"))
    # A stated number of tasks and an order inside them: the same blocks, hence the same samples, in every run.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return entries.repartition(tasks, "p").sortWithinPartitions("p", "y", "f").mapInPandas(block, BLOCK)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _row_keys(block: int, n: int) -> np.ndarray:
    return _mix(_mix(np.full(n, block, np.uint64)) + np.arange(n, dtype=np.uint64))


def _uniform(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """One number from [0, 1) per row and tree, the same in every attempt."""
    return (_mix(keys ^ _mix(np.array([seed * 1_000_003 + tree], np.uint64))) >> np.uint64(11)) * 2.0**-53


#: Shares of a Poisson variable of mean 1 below 1, 2, 3, ...
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))
_POISSON_SHARES = np.diff(np.append(np.append(0.0, _POISSON[:-1]), 1.0))


def tree_columns(spec: Spec, tree: int, n: int) -> np.ndarray:
    k = max(1, int(spec.colsample_bytree * n))
    if spec.kind == "forest" or k == n:
        return np.arange(n)
    return np.sort(np.random.default_rng((spec.seed, tree)).permutation(n)[:k])


def _drawn(spec: Spec, tree: int, keys: np.ndarray, count: np.ndarray | None, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry how often its rows are drawn, and how many of them at least once; ``p``: shares of 0, 1, 2, ... draws of a row.

    An entry of one row goes by its hash. Of more rows, one multinomial draw per entry tells how many rows are
    drawn 0, 1, 2, ... times, seeded by the block that the entries lie in.
    """
    drawn = lambda keys: np.searchsorted(np.cumsum(p)[:-1], _uniform(keys, spec.seed, tree), "right")
    if count is None or not len(many := np.flatnonzero(count > 1)):
        times = drawn(keys).astype(float)
        return times, (times > 0).astype(float)
    times = np.zeros(len(keys))
    one = np.flatnonzero(count <= 1)
    times[one] = drawn(keys[one])
    seen = (times > 0).astype(float)
    state = _mix(keys[:1] ^ _mix(np.array([spec.seed * 1_000_003 + tree], np.uint64)))
    rng = np.random.default_rng(state)
    if len(p) == 2:
        # The same draws, without a table of two columns.
        times[many] = seen[many] = count[many] - rng.binomial(count[many], p[0])
    else:
        cells = rng.multinomial(count[many], p)
        times[many] = cells @ np.arange(len(p))
        seen[many] = count[many] - cells[:, 0]
    return times, seen


def _used(spec: Spec, tree: int, keys: np.ndarray, y: np.ndarray, fold: np.ndarray, count: np.ndarray | None,
          blocks: list[slice] | None) -> tuple[np.ndarray, np.ndarray]:
    """How often the rows of every entry are used in a tree, and how many of them take part."""
    use = np.ones(len(y)) if count is None else count.astype(float)
    seen = use
    share = _POISSON_SHARES if spec.kind == "forest" else np.array([1 - spec.subsample, spec.subsample])
    if spec.kind == "forest" or spec.subsample < 1:
        parts = [_drawn(spec, spec.first_tree + tree, keys[b], None if count is None else count[b], share)
                 for b in blocks or [slice(None)] if len(keys[b])]
        use, seen = (np.concatenate(x) if parts else use for x in (list(zip(*parts)) or [(), ()]))
    if spec.fold is not None:
        use, seen = use * (fold != spec.fold), seen * (fold != spec.fold)
    return use, seen


def _class_weights(spec: Spec, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weight of a row of each class; a forest balances the classes of its bootstrap."""
    if spec.kind == "forest":
        return use.sum() / (2 * np.maximum(np.bincount(y, use, 2), 1))
    return np.array([1.0, spec.pos_weight])


def _weights(spec: Spec, tree: int, keys: np.ndarray, y: np.ndarray, fold: np.ndarray, count: np.ndarray | None,
             blocks: list[slice] | None) -> tuple[np.ndarray, np.ndarray]:
    """Weight of every entry in a tree, and its rows that take part."""
    use, seen = _used(spec, tree, keys, y, fold, count, blocks)
    return use * _class_weights(spec, y, use)[y], seen


def row_weights(spec: Spec, tree: int, keys: np.ndarray, y: np.ndarray, fold: np.ndarray, count: np.ndarray | None = None,
                blocks: list[slice] | None = None) -> np.ndarray:
    """Weight of every entry in a tree: number of rows, sampling, fold and class balance.

    A forest draws Poisson counts and balances the classes of that bootstrap.
    """
    return _weights(spec, tree, keys, y, fold, count, blocks)[0]


# --- Splits ---------------------------------------------------------------------------------

def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0) if alpha else g


def leaf_value(g, h, spec: Spec):
    if spec.kind == "forest":
        return -g / np.maximum(h, 1e-300)
    return -_shrunk(g, spec.reg_alpha) / (h + spec.reg_lambda) * spec.learning_rate


def best_splits(hist: np.ndarray, spec: Spec) -> dict[str, np.ndarray]:
    """Best (column, bin) per node from sums (nodes, columns, bins, 2 or 3): gradient, Hessian, rows."""
    total = hist[:, :1].sum(axis=2, keepdims=True)
    below = np.cumsum(hist, axis=2)[:, :, :-1]
    above = total - below
    lam, alpha = (0.0, 0.0) if spec.kind == "forest" else (spec.reg_lambda, spec.reg_alpha)

    def worth(s):
        g = _shrunk(s[..., 0], alpha)
        return g * g / np.maximum(s[..., 1] + lam, 1e-300)

    gain = worth(below) + worth(above) - worth(total)
    if spec.kind == "forest":
        ok = (below[..., 2] >= spec.min_leaf) & (above[..., 2] >= spec.min_leaf)
        gain = np.where(ok & (gain > _EPS), gain, -np.inf)
    else:
        least = max(spec.min_child_weight, _EPS)
        ok = (below[..., 1] >= least) & (above[..., 1] >= least)
        gain = np.where(ok & (gain > max(spec.gamma, _EPS)), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    col, cut = np.divmod(at, gain.shape[2])
    every = np.arange(len(gain))
    found = np.isfinite(flat[every, at])
    return {"split": found, "col": col, "bin": cut, "g": total[:, 0, 0, 0], "h": total[:, 0, 0, 1],
            "small": below[every, col, cut, 1] <= above[every, col, cut, 1]}


class TreeBuilder:
    """Nodes of one tree as it grows level by level."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right = (np.zeros(0, np.int32) for _ in range(4))
        self.value, self.cover = np.zeros(0), np.zeros(0)
        self.level = self._more(1)

    def _more(self, n: int) -> np.ndarray:
        first = len(self.feature)
        for name in ("feature", "bin", "left", "right", "value", "cover"):
            held = getattr(self, name)
            setattr(self, name, np.concatenate([held, np.full(n, 0 if held.dtype == float else -1, held.dtype)]))
        return np.arange(first, first + n)

    def add(self, s: dict[str, np.ndarray], columns: np.ndarray, spec: Spec, last: bool) -> np.ndarray:
        """Take the splits of the current level; returns per node its left child's place in the next level, or -1."""
        values = leaf_value(s["g"], s["h"], spec)
        split = s["split"] & (not last)
        place = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        following = self._more(2 * int(split.sum()))
        # The nodes of a level follow each other.
        here = slice(int(self.level[0]), int(self.level[-1]) + 1)
        first = int(following[0]) if len(following) else 0
        self.cover[here] = s["h"]
        self.value[here] = np.where(split, 0.0, values)
        for x, v in ((self.feature, columns[s["col"]]), (self.bin, s["bin"]), (self.left, first + place), (self.right, first + place + 1)):
            x[here] = np.where(split, v, -1)
        self.level = following
        return place

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.bin, self.left, self.right))


def finish(kind: str, trees: list[TreeBuilder], cuts: list[np.ndarray], scale: float = 1.0) -> pd.DataFrame:
    """Node table of a model. Values of a forest are divided by its number of trees (``scale``)."""
    parts = []
    for t, b in enumerate(trees):
        f, bin_ = np.array(b.feature), np.array(b.bin)
        cut = np.array([cuts[i][j] if i >= 0 else 0.0 for i, j in zip(f, bin_)])
        parts.append(pd.DataFrame({"tree": t, "id": np.arange(len(f)), "left": b.left, "right": b.right, "feature": f, "cut": cut,
                                   "value": np.array(b.value) * scale, "cover": b.cover}))
    return pd.concat(parts, ignore_index=True)


# --- One model in one task ------------------------------------------------------------------

@dataclass
class Rows:
    """Entries of some blocks side by side; without ``count`` each is one row."""

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    keys: np.ndarray
    count: np.ndarray | None = None
    blocks: list[slice] | None = None
    #: Columns of few bins, their numbers of bins and the cell that each entry has in all of them together.
    joint: tuple[list[int], list[int], np.ndarray] | None = None

    def weights(self, spec: "Spec", tree: int) -> tuple[np.ndarray, np.ndarray]:
        return _weights(spec, tree, self.keys, self.y, self.fold, self.count, self.blocks)

    @classmethod
    def of(cls, blocks: pd.DataFrame) -> "Rows":
        blocks = blocks.sort_values("block")
        read = lambda name: [np.frombuffer(x, np.uint8) for x in blocks[name]]
        bins = [x.reshape(-1, n) for x, n in zip(read("bins"), blocks["n"])]
        return cls(np.ascontiguousarray(np.concatenate(bins, axis=1)), np.concatenate(read("y")), np.concatenate(read("fold")),
                   np.concatenate([_row_keys(b, n) for b, n in zip(blocks["block"], blocks["n"])]),
                   np.concatenate([np.frombuffer(x, np.int64) for x in blocks["count"]]),
                   [slice(e - n, e) for e, n in zip(np.cumsum(blocks["n"]), blocks["n"])])


def _without_folds(rows: Rows) -> tuple[Rows, np.ndarray]:
    """Entries that differ in their fold only as one, for sums and margins, and the first of each; as they are where that saves little.

    They lie side by side in a block. Columns of few bins get cells in common.
    """
    other = (rows.bins[:, 1:] != rows.bins[:, :-1]).any(axis=0) | (rows.y[1:] != rows.y[:-1])
    first = np.flatnonzero(np.append(True, other)[:len(rows.y)])
    if 4 * len(first) > 3 * len(rows.y):
        first = np.arange(len(rows.y))
    else:
        rows = Rows(np.ascontiguousarray(rows.bins[:, first]), rows.y[first], rows.fold[first], rows.keys[first])
    if len(first) < JOINT_ROWS:
        return rows, first
    wide = [int(x.max()) + 1 for x in rows.bins]
    some, cells = [], 1
    for f in sorted(range(len(wide)), key=lambda f: wide[f]):
        if cells * wide[f] <= JOINT_CELLS:
            some.append(f)
            cells *= wide[f]
    code = np.zeros(len(first), np.int32)
    for f in some:
        code = code * wide[f] + rows.bins[f]
    return replace(rows, joint=(some, [wide[f] for f in some], code)), first


def _histogram(rows: Rows, columns: np.ndarray, at: np.ndarray, node: np.ndarray, nodes: int, bins: int, sums: list[np.ndarray]) -> np.ndarray:
    """Sums per (node, column, bin) of rows ``at`` that lie in ``node``."""
    out = np.empty((nodes, len(columns), bins, len(sums)))
    base = node * bins
    whole = len(at) == len(rows.y)
    parts = sums if whole else [s[at] for s in sums]
    shared = []
    if rows.joint and len(at) >= max(JOINT_ROWS, 4 * nodes * int(np.prod(rows.joint[1]))):
        # One count for all columns of few bins; each column adds up the cells of the others.
        some, wide, code = rows.joint
        cells = int(np.prod(wide))
        index = node * cells + (code if whole else code[at])
        shared = [f for f in columns if f in some]
        for j, s in enumerate(parts):
            held = np.bincount(index, s, nodes * cells).reshape(nodes, *wide)
            for k, f in enumerate(columns):
                if f in some:
                    axis = some.index(f)
                    out[:, k, wide[axis]:, j] = 0
                    out[:, k, :wide[axis], j] = held.sum(axis=tuple(a + 1 for a in range(len(some)) if a != axis))
    for k, f in enumerate(columns):
        if f in shared:
            continue
        index = base + (rows.bins[f] if whole else rows.bins[f][at])
        for j, s in enumerate(parts):
            out[:, k, :, j] = np.bincount(index, s, nodes * bins).reshape(nodes, bins)
    return out


def _advance(rows: Rows, s: dict, place: np.ndarray, columns: np.ndarray, at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that go on, and their nodes in the next level."""
    if (place < 0).any():
        stay = place[node] >= 0
        at, node = at[stay], node[stay]
    right = rows.bins.ravel()[(columns[s["col"]] * rows.bins.shape[1])[node] + at] > s["bin"][node].astype(np.uint8)
    return at, place[node] + right


def _by_nodes(at: np.ndarray, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of the children they have come to, when they were in the order of the parents: what is counted per node lies close by."""
    right = (node & 1).astype(bool)
    size = np.bincount(node, minlength=nodes)
    # Rows of the same side before a row, less those of earlier parents: its place in its child.
    start = np.cumsum(size) - size
    for side in (0, 1):
        start[side::2] -= np.cumsum(size[side::2]) - size[side::2]
    lefts = np.cumsum(~right)
    place = start[node] + np.where(right, np.arange(len(node)) - lefts, lefts - 1)
    out = np.empty_like(at)
    out[place] = at
    return out, np.repeat(np.arange(nodes), size)


def _side_by_side(parts: list[np.ndarray]) -> tuple[list[np.ndarray], list[list[tuple[int, int]]]]:
    """Whole numbers side by side in as few doubles as hold their sums exactly, and (shift, bits) of each one."""
    packs, places, used = [], [], 53
    for x in parts:
        bits = int(x.sum()).bit_length() + 1
        if used + bits > 52:
            packs.append(x)
            places.append([(0, bits)])
            used = bits
        else:
            packs[-1] = packs[-1] + x * 2.0**used
            places[-1].append((used, bits))
            used += bits
    return packs, places


def _taken_apart(packs: list[np.ndarray], places: list[list[tuple[int, int]]]) -> np.ndarray:
    out = []
    for x, some in zip(packs, places):
        x = x.astype(np.int64)
        out += [((x >> shift) & ((1 << bits) - 1)).astype(float) for shift, bits in some]
    return np.stack(out)


def _worth(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    g = weights[1] * x[1]
    return g * g / np.maximum(weights[0] * x[0] + g, 1e-300)


def _best_cells(cell: np.ndarray, held: np.ndarray, total: np.ndarray, mine: np.ndarray, bins: int, spec: Spec,
                weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, column and bin of the best cut of every node, the first one of equals, from the sums ``held`` of the cells that occur.

    Cells are numbered by (node, place in ``mine``, bin), in this order; each node has one.
    """
    nodes, width = mine.shape
    run = cell // bins
    of = run // width
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    below = np.cumsum(held, axis=1)
    before = np.concatenate([np.zeros((3, 1)), below], axis=1)[:, first]
    below -= np.repeat(before, np.diff(np.append(first, len(run))), axis=1)
    above = total[:, of] - below
    gain = _worth(below, weights) + _worth(above, weights) - _worth(total, weights)[of]
    gain[(below[2] < spec.min_leaf) | (above[2] < spec.min_leaf) | (gain <= _EPS)] = -np.inf
    most = np.maximum.reduceat(gain, np.searchsorted(of, np.arange(nodes)))
    best = np.flatnonzero(gain == most[of])
    best = best[np.append(True, np.diff(of[best]) > 0)]
    return most, mine[np.arange(nodes), run[best] % width], cell[best] % bins


def _present_splits(rows: Rows, spec: Spec, columns: np.ndarray, at: np.ndarray, node: np.ndarray, mine: np.ndarray, bins: int,
                    sums: list[np.ndarray], weights: np.ndarray) -> dict[str, np.ndarray]:
    """Best split of every node of a forest over its own columns ``mine`` (nodes x columns); each node holds an entry.

    ``sums``: used rows of class 0 and of class 1, and rows that take part: whole numbers, so their sums are exact.
    Deep nodes hold few entries, so only the bins that occur in a node are weighed; a cut at any other bin equals one of these.
    """
    nodes = len(mine)
    flat, n = rows.bins.ravel(), rows.bins.shape[1]
    # Of the rows that take part it only matters whether they are ``min_leaf``.
    packs, places = _side_by_side([sums[0][at], sums[1][at], np.minimum(sums[2][at], max(1, spec.min_leaf))])
    total = _taken_apart([np.bincount(node, x, nodes) for x in packs], places)
    best, col, cut = np.full(nodes, -np.inf), np.zeros(nodes, int), np.zeros(nodes, int)
    base = node * bins
    width = max(1, PRESENT_CELLS // max(len(at), nodes * bins, 1))
    for k in range(0, mine.shape[1], width):
        some = mine[:, k:k + width]
        index = [base + flat[(columns[some[:, j]] * n)[node] + at] for j in range(some.shape[1])]
        held = [np.stack([np.bincount(i, x, nodes * bins).reshape(nodes, bins) for i in index], axis=1).ravel() for x in packs]
        cell = np.flatnonzero(held[-1])
        gain, column, bin_ = _best_cells(cell, _taken_apart([x[cell] for x in held], places), total, some, bins, spec, weights)
        better = gain > best
        best[better], col[better], cut[better] = gain[better], column[better], bin_[better]
    g = weights[1] * total[1]
    return {"split": np.isfinite(best), "col": col, "bin": cut, "g": -g, "h": weights[0] * total[0] + g}


def _tried_columns(columns: int, tried: int, nodes: int, rng: np.random.Generator) -> np.ndarray:
    """The columns (nodes x tried) that the nodes of a level may be split by."""
    if tried >= columns:
        return np.tile(np.arange(columns), (nodes, 1))
    return rng.random((nodes, columns)).argpartition(tried, axis=1)[:, :tried]


def _undecided(s: dict[str, np.ndarray]) -> np.ndarray:
    """Nodes of both classes that no tried column splits."""
    return np.flatnonzero(~s["split"] & (s["g"] < 0) & (s["h"] + s["g"] > _EPS))


def _tried_splits(rows: Rows, spec: Spec, columns: np.ndarray, at: np.ndarray, node: np.ndarray, nodes: int, bins: int,
                  sums: list[np.ndarray], weights: np.ndarray, tried: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Best splits over ``tried`` random columns per node, over all columns where those allow none."""
    mine = _tried_columns(len(columns), tried, nodes, rng)
    s = _present_splits(rows, spec, columns, at, node, mine, bins, sums, weights)
    again = _undecided(s) if tried < len(columns) else []
    if len(again):
        slot = np.full(nodes, -1)
        slot[again] = np.arange(len(again))
        use = slot[node] >= 0
        full = _present_splits(rows, spec, columns, at[use], slot[node[use]], np.tile(np.arange(len(columns)), (len(again), 1)), bins, sums, weights)
        for name in s:
            s[name][again] = full[name]
    return s


def _grow(rows: Rows, spec: Spec, tree: int, g: np.ndarray, h: np.ndarray, bins: int,
          drawn: tuple[list[np.ndarray], np.ndarray] | None = None) -> tuple[TreeBuilder, np.ndarray]:
    """One tree, and its value for every entry; entries of weight 0 are carried along.

    ``drawn``: for a forest the whole numbers that ``_present_splits`` adds up, and the weights of the classes.
    """
    n = len(rows.y)
    b, out = TreeBuilder(), np.zeros(n)
    columns = tree_columns(spec, tree, len(rows.bins))
    forest = spec.kind == "forest"
    sums = [g, h]
    rng = np.random.default_rng((spec.seed, spec.first_tree + tree))
    wanted = max(1, int(np.sqrt(len(columns))))
    live = h > 0
    at = np.flatnonzero(live)
    node = np.zeros(len(at), np.int64)
    idle = np.flatnonzero(~live) if not forest else np.zeros(0, np.int64)
    idle_node = np.zeros(len(idle), np.int64)
    hist, depth = None, 0
    while len(b.level):
        if forest and not len(at):
            b.add({"split": np.zeros(1, bool), "col": np.zeros(1, int), "bin": np.zeros(1, int), "g": np.zeros(1), "h": np.zeros(1)}, columns, spec, True)
            break
        nodes = len(b.level)
        last = spec.max_depth is not None and depth == spec.max_depth
        cells = nodes * len(columns) * bins
        if last:
            tot = [np.bincount(node, x[at], nodes) for x in sums[:2]]
            s = {"split": np.zeros(nodes, bool), "col": np.zeros(nodes, int), "bin": np.zeros(nodes, int), "g": tot[0], "h": tot[1]}
            hist = None
        elif cells <= MAX_CELLS and not forest:
            if hist is None or len(hist) != nodes:
                hist = _histogram(rows, columns, at, node, nodes, bins, sums)
            s = best_splits(hist, spec)
        else:
            # Some nodes at a time.
            hist = None
            step = max(1, PRESENT_CELLS // (min(wanted, len(columns)) * bins) if forest else MAX_CELLS // (len(columns) * bins * 2))
            # The rows of a forest are in the order of their nodes.
            order = np.arange(len(at)) if forest else np.argsort(node, kind="stable")
            bound = np.searchsorted(node if forest else node[order], np.arange(0, nodes + step, step))
            made = []
            for k, first in enumerate(range(0, nodes, step)):
                mine = order[bound[k]:bound[k + 1]]
                some = min(step, nodes - first)
                if forest:
                    made.append(_tried_splits(rows, spec, columns, at[mine], node[mine] - first, some, bins, *drawn, wanted, rng))
                else:
                    made.append(best_splits(_histogram(rows, columns, at[mine], node[mine] - first, some, bins, sums), spec))
            s = {name: np.concatenate([m[name] for m in made]) for name in made[0]}
        first_id = b.level
        place = b.add(s, columns, spec, last)
        ended = place < 0
        if ended.any() and not forest:
            values = b.value[first_id]
            for some, where in ((at, node), (idle, idle_node)):
                if ended.all():
                    out[some] = values[where]
                else:
                    over = ended[where]
                    out[some[over]] = values[where[over]]
        at, node_next = _advance(rows, s, place, columns, at, node)
        idle, idle_node = _advance(rows, s, place, columns, idle, idle_node)
        node = node_next
        if forest:
            at, node = _by_nodes(at, node, len(b.level))
        depth += 1
        following = len(b.level)
        if hist is not None and following and not (spec.max_depth is not None and depth == spec.max_depth) and following * len(columns) * bins <= MAX_CELLS:
            # The smaller child is counted, its sibling is the parent less it.
            kept = place >= 0
            parents, small = hist[kept], s["small"][kept]
            child = 2 * np.arange(len(parents)) + ~small
            slot = np.full(following, -1)
            slot[child] = np.arange(len(parents))
            mine = slot[node] >= 0
            counted = _histogram(rows, columns, at[mine], slot[node[mine]], len(parents), bins, sums)
            hist = np.empty((following, *parents.shape[1:]))
            hist[child] = counted
            hist[child ^ 1] = parents - counted
        else:
            hist = None
    return b, out


def grow_forest(rows: Rows, spec: Spec, bins: int) -> Iterator[TreeBuilder]:
    """The trees of a forest one after the other."""
    y = rows.y.astype(float)
    for t in range(spec.n_estimators):
        use, seen = _used(spec, t, rows.keys, rows.y, rows.fold, rows.count, rows.blocks)
        weights = _class_weights(spec, rows.y, use)
        w = use * weights[rows.y]
        yield _grow(rows, spec, t, -w * y, w, bins, ([use * (1 - y), use * y, seen], weights))[0]


def fit_here(rows: Rows, spec: Spec, bins: int, keep: bool = True) -> tuple[list[TreeBuilder], np.ndarray]:
    """Trees of one model (none if they are not kept), and the margin of every entry (also of entries outside the fit)."""
    trees = []
    if spec.kind == "forest":
        return list(grow_forest(rows, spec, bins)), np.zeros(len(rows.y))
    every, (rows, first) = rows, _without_folds(rows)
    margin, y = np.zeros(len(rows.y)), rows.y.astype(float)
    whole = None
    for t in range(spec.n_estimators):
        if whole is None or spec.subsample < 1:
            whole = every.weights(spec, t)[0]
            whole = np.add.reduceat(whole, first) if len(first) < len(whole) else whole
        p = 1 / (1 + np.exp(-margin))
        b, step = _grow(rows, spec, t, whole * (p - y), whole * np.maximum(p * (1 - p), 1e-16), bins)
        margin += step
        if keep:
            trees.append(b)
    return trees, np.repeat(margin, np.diff(np.append(first, len(every.y))))


NODES = "model int, " + TreeModel.NODES
SCORES = "model int, y int, outside boolean, score double, n long"


def _score_table(model: int, rows: Rows, spec: Spec, margin: np.ndarray) -> pd.DataFrame:
    """The scores of one model, equal ones as one row with their number."""
    score = 1 / (1 + np.exp(-margin))
    kind = 2 * rows.y.astype(np.int8) + (rows.fold == spec.fold)
    order = np.lexsort((score, kind))
    score, kind = score[order], kind[order]
    first = np.flatnonzero(np.append(True, (score[1:] != score[:-1]) | (kind[1:] != kind[:-1]))[:len(score)])
    n = np.ones(len(score), np.int64) if rows.count is None else rows.count[order]
    return pd.DataFrame({"model": np.int32(model), "y": (kind[first] // 2).astype(np.int32), "outside": kind[first] % 2 == 1,
                         "score": score[first], "n": np.add.reduceat(n, first) if len(first) else n})


def _fit_in_tasks(blocks: DataFrame, specs: list[Spec], cuts: list[np.ndarray], scores: bool) -> DataFrame:
    """Models as groups: nodes of all models, or scores of all rows under each."""
    spark = blocks.sparkSession
    bins = max(len(c) for c in cuts) + 1
    # Long fits first; a model per task, which holds the trees or scores of no other.
    order = sorted(range(len(specs)), key=lambda i: -specs[i].n_estimators * (specs[i].max_depth or 20))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i = order[key[0]]
        rows, spec = Rows.of(pdf), specs[i]
        trees, margin = fit_here(rows, spec, bins, keep=not scores)
        out = _score_table(i, rows, spec, margin) if scores else finish(spec.kind, trees, cuts).assign(model=i)
        return out[[c.split()[0] for c in (SCORES if scores else NODES).split(", ")]]

    ship_package(spark)
    copies = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(len(specs) - 1))))
    # A partition per group: no task gets two groups by chance while another has none.
    spread = copies.repartitionByRange(len(specs), "_group") if len(specs) > 1 else copies
    return spread.groupBy("_group").applyInPandas(run, SCORES if scores else NODES)


# --- All models level by level over many tasks ----------------------------------------------

def _route(bins: np.ndarray, arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """Node of a growing tree that each row has come to."""
    feature, bin_, left, right = arrays
    at = np.zeros(bins.shape[1], np.int64)
    live = np.arange(len(at))
    while True:
        live = live[left[at[live]] >= 0]
        if not len(live):
            return at
        here = at[live]
        at[live] = np.where(bins[feature[here], live] <= bin_[here], left[here], right[here])


def _blocks_of(pdf: pd.DataFrame, models: int) -> Iterator[tuple[Rows, np.ndarray, dict]]:
    for r in pdf.to_dict("records"):
        rows = Rows.of(pd.DataFrame([r]))
        margin = np.frombuffer(r["extra"], np.float64).reshape(models, -1) if r["extra"] else np.zeros((models, len(rows.y)))
        yield rows, margin, r


SPLITS = "model int, node int, split boolean, col int, bin int, g double, h double"


def _fit_by_levels(blocks: DataFrame, specs: list[Spec], cuts: list[np.ndarray]) -> tuple[list[list[TreeBuilder]], DataFrame]:
    """Trees of boosted models, and the blocks with the margins of all of them."""
    spark = blocks.sparkSession
    ship_package(spark)
    n, bins = len(cuts), max(len(c) for c in cuts) + 1
    done: list[list[TreeBuilder]] = [[] for _ in specs]
    state = blocks
    for t in range(max(s.n_estimators for s in specs)):
        growing = {m: TreeBuilder() for m, s in enumerate(specs) if t < s.n_estimators}
        columns = {m: tree_columns(specs[m], t, n) for m in growing}
        depth = 0
        while any(len(b.level) for b in growing.values()):
            asked = {m: (b.arrays(), b.level) for m, b in growing.items() if len(b.level)}

            def count(frames, asked=asked, t=t, columns=columns):
                sums: dict[int, np.ndarray] = {}
                for pdf in frames:
                    for rows, margin, _ in _blocks_of(pdf, len(specs)):
                        for m, (arrays, level) in asked.items():
                            w = rows.weights(specs[m], t)[0]
                            p = 1 / (1 + np.exp(-margin[m]))
                            g, h = w * (p - rows.y), w * np.maximum(p * (1 - p), 1e-16)
                            slot = np.full(len(arrays[0]), -1)
                            slot[level] = np.arange(len(level))
                            node = slot[_route(rows.bins, arrays)]
                            at = np.flatnonzero((node >= 0) & (w > 0))
                            hist = _histogram(rows, columns[m], at, node[at], len(level), bins, [g, h])
                            sums[m] = sums[m] + hist if m in sums else hist
                for m, hist in sums.items():
                    yield pd.DataFrame({"model": m, "node": np.arange(len(hist)), "hist": [x.tobytes() for x in hist]})

            def choose(pdf):
                m, k = int(pdf["model"].iloc[0]), int(pdf["node"].iloc[0])
                hist = sum(np.frombuffer(x).reshape(1, len(columns[m]), bins, 2) for x in pdf["hist"])
                s = best_splits(hist, specs[m])
                return pd.DataFrame({"model": [m], "node": [k], **{c: s[c] for c in ("split", "col", "bin", "g", "h")}})

            found = (state.mapInPandas(count, "model int, node int, hist binary").groupBy("model", "node")
                     .applyInPandas(choose, SPLITS).toPandas())
            for m in asked:
                part = found[found["model"] == m].sort_values("node")
                s = {c: part[c].to_numpy() for c in ("split", "col", "bin", "g", "h")}
                growing[m].add(s, columns[m], specs[m], depth == specs[m].max_depth)
            depth += 1
        steps = {m: (b.arrays(), np.array(b.value)) for m, b in growing.items()}

        def move(frames, steps=steps):
            for pdf in frames:
                out = []
                for rows, margin, r in _blocks_of(pdf, len(specs)):
                    margin = margin.copy()
                    for m, (arrays, values) in steps.items():
                        margin[m] += values[_route(rows.bins, arrays)]
                    out.append({**r, "extra": margin.tobytes()})
                yield pd.DataFrame(out)

        state = materialise(state.mapInPandas(move, BLOCK), "margins")
        for m, b in growing.items():
            done[m].append(b)
    return done, state


def _level_scores(state: DataFrame, specs: list[Spec]) -> DataFrame:
    def run(frames):
        for pdf in frames:
            for rows, margin, _ in _blocks_of(pdf, len(specs)):
                for m, s in enumerate(specs):
                    yield _score_table(m, rows, s, margin[m])

    return state.mapInPandas(run, SCORES)


# --- Calls ----------------------------------------------------------------------------------

def _one_table(df: DataFrame, features: str, n: int, label: str, fold: str | None) -> tuple[DataFrame, list[np.ndarray], bool]:
    cuts = quantile_cuts(df, features, n)
    blocks = materialise(binned(df, features, n, label, cuts, fold), "bins")
    entries = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return blocks, cuts, entries <= rows_per_task(df.sparkSession)


def fit_models(df: DataFrame, features: str, n: int, label: str, specs: list[Spec]) -> list[TreeModel]:
    """Boosted models on the vectors ``features`` of n positions."""
    blocks, cuts, small = _one_table(df, features, n, label, None)
    if small:
        nodes = _fit_in_tasks(blocks, specs, cuts, scores=False).toPandas()
        return [TreeModel.from_frame(s.kind, nodes[nodes["model"] == m].drop(columns="model")) for m, s in enumerate(specs)]
    trees, _ = _fit_by_levels(blocks, specs, cuts)
    return [TreeModel.from_frame(s.kind, finish(s.kind, t, cuts)) for s, t in zip(specs, trees)]


def cross_scores(df: DataFrame, features: str, n: int, label: str, fold: str, specs: list[Spec]) -> DataFrame:
    """(model, y, outside, score, n): all rows under every model, n of equal score; ``outside`` marks the fold a model did not see."""
    blocks, cuts, small = _one_table(df, features, n, label, fold)
    return materialise(_fit_in_tasks(blocks, specs, cuts, scores=True) if small
                       else _level_scores(_fit_by_levels(blocks, specs, cuts)[1], specs), "scores")


def _forests_in_tasks(blocks: DataFrame, parts: list[tuple[int, Spec]], cuts: list[np.ndarray], scale: list[float]) -> DataFrame:
    """Trees of forests, a row each; a task grows one part of a forest and hands over every tree as soon as it is grown."""
    spark = blocks.sparkSession
    bins = max(len(c) for c in cuts) + 1

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, spec = parts[key[0]]
        rows = Rows.of(pd.concat(list(frames)))
        for t, b in enumerate(grow_forest(rows, spec, bins)):
            yield pd.DataFrame([_pack(model, spec.first_tree + t, b, scale[model])])

    ship_package(spark)
    copies = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))))
    return copies.repartitionByRange(len(parts), "_group").groupBy("_group").applyInPandas(run, TREE)


CELLS = "tree int, bucket long, cell long, zeros double, ones double, seen double"
NODE_SPLITS = "tree int, node long, split boolean, col int, bin int, zeros double, ones double"


def _forest_splits(blocks: DataFrame, growing: list[tuple[int, Spec, int]], asked: dict[int, tuple], weights: np.ndarray,
                   bins: int) -> dict[int, dict[str, np.ndarray]]:
    """Best split of the nodes ``asked`` of every growing tree: (arrays of the tree, nodes, columns that each node may be split by).

    Tasks add up the cells of their own blocks; the cells of some nodes meet in one task, which chooses.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((asked, growing, weights))
    bucket = {i: max(1, PRESENT_CELLS // (mine.shape[1] * bins)) for i, (_, _, mine) in asked.items()}
    dense = {i for i, (_, _, mine) in asked.items() if mine.size * bins * len(asked) <= PRESENT_CELLS}

    def cells(i: int, cell: np.ndarray, held: np.ndarray) -> pd.DataFrame:
        a_node = shared.value[0][i][2].shape[1] * bins
        return pd.DataFrame({"tree": np.int32(i), "bucket": cell // a_node // bucket[i], "cell": cell, "zeros": held[0], "ones": held[1], "seen": held[2]})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, growing, _ = shared.value
        sums: dict[int, np.ndarray] = {}
        slots = {}
        for i, (arrays, nodes, _) in asked.items():
            slots[i] = np.full(len(arrays[0]), -1)
            slots[i][nodes] = np.arange(len(nodes))
        for pdf in frames:
            for rows, _, _ in _blocks_of(pdf, 1):
                for i, (arrays, nodes, mine) in asked.items():
                    _, spec, t = growing[i]
                    use, seen = _used(spec, t, rows.keys, rows.y, rows.fold, rows.count, rows.blocks)
                    node = slots[i][_route(rows.bins, arrays)]
                    at = np.flatnonzero((node >= 0) & (use > 0))
                    node, ones = node[at], use[at] * rows.y[at]
                    width = mine.shape[1]
                    index = ((node[:, None] * width + np.arange(width)) * bins + rows.bins[mine[node], at[:, None]]).ravel()
                    parts = [np.repeat(x, width) for x in (use[at] - ones, ones, np.minimum(seen[at], max(1, spec.min_leaf)))]
                    if i in dense:
                        held = np.stack([np.bincount(index, x, mine.size * bins) for x in parts])
                        sums[i] = sums[i] + held if i in sums else held
                    elif len(index):
                        cell, place = np.unique(index, return_inverse=True)
                        yield cells(i, cell, np.stack([np.bincount(place, x, len(cell)) for x in parts]))
        for i, held in sums.items():
            cell = np.flatnonzero(held[2])
            yield cells(i, cell, held[:, cell])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, growing, weights = shared.value
        i, first = int(pdf["tree"].iloc[0]), int(pdf["bucket"].iloc[0]) * bucket[int(pdf["tree"].iloc[0])]
        mine = asked[i][2][first:first + bucket[i]]
        index = pdf["cell"].to_numpy() - first * mine.shape[1] * bins
        held = np.stack([np.bincount(index, pdf[c], mine.size * bins) for c in ("zeros", "ones", "seen")])
        total = held.reshape(3, len(mine), mine.shape[1], bins)[:, :, 0].sum(axis=2)
        cell = np.flatnonzero(held[2])
        gain, col, cut = _best_cells(cell, held[:, cell], total, mine, bins, growing[i][1], weights[i])
        return pd.DataFrame({"tree": np.int32(i), "node": first + np.arange(len(mine)), "split": np.isfinite(gain), "col": col.astype(np.int32),
                             "bin": cut.astype(np.int32), "zeros": total[0], "ones": total[1]})

    found = blocks.mapInPandas(count, CELLS).groupBy("tree", "bucket").applyInPandas(choose, NODE_SPLITS).toPandas()
    shared.unpersist()
    out = {}
    for i, part in found.groupby("tree"):
        part = part.sort_values("node")
        g = weights[i][1] * part["ones"].to_numpy()
        out[i] = {**{c: part[c].to_numpy() for c in ("split", "col", "bin")}, "g": -g, "h": weights[i][0] * part["zeros"].to_numpy() + g}
    return out


def _forests_by_levels(blocks: DataFrame, specs: list[Spec], cuts: list[np.ndarray], scale: list[float]) -> DataFrame:
    """Trees of forests, a row each, for blocks of more entries than one task takes; the same trees as ``_forests_in_tasks``.

    The driver holds the nodes of the trees that grow side by side, and draws the columns of their nodes level by level, as a task does.
    """
    spark = blocks.sparkSession
    ship_package(spark)
    n, bins = len(cuts), max(len(c) for c in cuts) + 1
    tried = max(1, int(np.sqrt(n)))
    entries = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(1, SIDE_BY_SIDE // max(1, entries))
    every = [(m, s, t) for m, s in enumerate(specs) for t in range(s.n_estimators)]
    path = fresh_path(spark, "trees")
    for first in range(0, len(every), most):
        growing = every[first:first + most]

        def classes(frames: Iterator[pd.DataFrame], growing=growing) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for rows, _, _ in _blocks_of(pdf, 1):
                    used = [np.bincount(rows.y, _used(s, t, rows.keys, rows.y, rows.fold, rows.count, rows.blocks)[0], 2) for _, s, t in growing]
                    yield pd.DataFrame({"tree": np.arange(len(used)), "zeros": [u[0] for u in used], "ones": [u[1] for u in used]})

        totals = blocks.mapInPandas(classes, "tree int, zeros double, ones double").groupBy("tree").agg(F.sum("zeros"), F.sum("ones")).collect()
        weights = np.zeros((len(growing), 2))
        for i, *used in totals:
            weights[i] = sum(used) / (2 * np.maximum(used, 1))
        trees = [TreeBuilder() for _ in growing]
        draws = [np.random.default_rng((s.seed, s.first_tree + t)) for _, s, t in growing]
        depth = 0
        while any(len(b.level) for b in trees):
            asked = {i: (b.arrays(), b.level, _tried_columns(n, tried, len(b.level), draws[i])) for i, b in enumerate(trees) if len(b.level)}
            found = _forest_splits(blocks, growing, asked, weights, bins)
            more = {}
            for i, s in found.items():
                again = _undecided(s) if tried < n and depth != growing[i][1].max_depth else []
                if len(again):
                    more[i] = again
            if more:
                full = _forest_splits(blocks, growing, {i: (asked[i][0], asked[i][1][again], np.tile(np.arange(n), (len(again), 1)))
                                                        for i, again in more.items()}, weights, bins)
                for i, again in more.items():
                    for name in found[i]:
                        found[i][name][again] = full[i][name]
            # No row of a bootstrap: one leaf of nothing.
            nothing = {"split": np.zeros(1, bool), **{c: np.zeros(1, int) for c in ("col", "bin")}, **{c: np.zeros(1) for c in ("g", "h")}}
            for i in asked:
                spec = growing[i][1]
                trees[i].add(found.get(i, nothing), np.arange(n), spec, depth == spec.max_depth)
            depth += 1
        packed = [_pack(m, s.first_tree + t, b, scale[m]) for (m, s, t), b in zip(growing, trees)]
        spark.createDataFrame(pd.DataFrame(packed), TREE).write.mode("append").option("maxRecordsPerFile", FILE_TREES).parquet(path)
    return spark.read.parquet(path)


def fit_forest_trees(df: DataFrame, features: str, n: int, label: str, specs: list[Spec]) -> list[TreeModel | StoredTrees]:
    """Forests; where the entries fit one task, groups of the trees of all of them are grown side by side."""
    blocks, cuts, small = _one_table(df, features, n, label, None)
    scale = [1 / s.n_estimators for s in specs]
    if small:
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = []
        for m, spec in enumerate(specs):
            groups = max(1, min(spec.n_estimators, -(-cores // len(specs))))
            ends = [spec.n_estimators * k // groups for k in range(groups + 1)]
            for a, b in zip(ends, ends[1:]):
                parts.append((m, Spec(**{**spec.__dict__, "n_estimators": b - a, "first_tree": a})))
        trees = materialise(_forests_in_tasks(blocks, parts, cuts, scale), "trees", file_rows=FILE_TREES)
    else:
        trees = _forests_by_levels(blocks, specs, cuts, scale)
    sizes: dict[int, dict[int, int]] = {m: {} for m in range(len(specs))}
    for r in trees.select("model", "tree", "nodes").collect():
        sizes[r["model"]][r["tree"]] = r["nodes"]
    models = [StoredTrees("forest", trees.filter(F.col("model") == m), cuts, sizes[m]) for m in range(len(specs))]
    return [m.local() if sum(m.sizes.values()) <= MAX_LOCAL_NODES else m for m in models]
