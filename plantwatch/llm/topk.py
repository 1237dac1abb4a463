"""Operator 9: exact top-k search by inner product with dual-tree cover trees.

Queries and data are indexed alike: a node covers its points by a centre and a covering
radius, and its children cover them by smaller ones. Pairs of nodes are visited best first. No
score of a pair can exceed

    <cq, cd> + |cq| rd + |cd| rq + rq rd

so a pair is dropped when this is below the worst k-th score in the query node. The rest is
scored in blocks, on whole numbers.

The queries (a stated set) are indexed on the driver and broadcast, ``QUERIES_PER_JOB`` at a
time; more queries mean more passes, whose results are written as they come. A data task
reads its rows in blocks, indexes each and keeps its k best per query; these are merged by a
window that keeps k rows per query before and after the shuffle.

Defined results: vectors that are null, empty, or hold a null or non-finite component, and rows
without an id, take no part; a query meets vectors of its own length only; rows with the
query's id are the query's own; repeated rows of another id are candidates each; ties go to the
smaller id; scores beyond 64 bits stop at their ends; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantwatch.llm.arrow import map_arrow
from plantwatch.session import fresh_path

LEAF = 96
QUERY_LEAF = 24
CHILDREN = 12
BLOCK_ROWS = 8_192
QUERIES_PER_JOB = 20_000
LOW = np.iinfo(np.int64).min


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    points: np.ndarray
    norm: float = 0.0
    children: list["Node"] = field(default_factory=list)
    parent: "Node | None" = field(default=None, repr=False)
    worst: int = LOW


def cover_tree(vectors: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree of the rows; a node's children halve its radius, or have CHILDREN centres at most."""

    def node(points: np.ndarray, centre: np.ndarray, distance: np.ndarray) -> Node:
        return Node(centre, float(distance.max(initial=0.0)) * (1 + 1e-9), points, float(np.linalg.norm(centre)))

    x = vectors.astype(np.float64)
    mean = x.mean(axis=0)
    root = node(np.arange(len(x)), mean, np.linalg.norm(x - mean, axis=1))
    open_nodes = [root]
    while open_nodes:
        n = open_nodes.pop()
        if len(n.points) <= leaf or n.radius == 0:
            continue
        own = x[n.points]
        nearest = np.linalg.norm(own - own[0], axis=1)
        part, centres = np.zeros(len(own), int), [0]
        for c in range(1, CHILDREN):
            # Far points give separated centres; every third is an ordinary one, so that outliers do not use them up.
            pick = int(nearest.argmax()) if c % 3 else (c * len(own)) // CHILDREN
            if nearest[pick] == 0:
                continue
            d = np.linalg.norm(own - own[pick], axis=1)
            closer = d < nearest
            part[closer] = len(centres)
            nearest = np.where(closer, d, nearest)
            centres.append(pick)
            if nearest.max() <= n.radius / 2:
                break
        for c, at in enumerate(centres):
            mine = part == c
            if mine.any():
                n.children.append(node(n.points[mine], own[at], nearest[mine]))
                n.children[-1].parent = n
        open_nodes += n.children
    return root


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


class Search:
    """The k best rows so far for each query of one vector length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.tree = cover_tree(vectors, QUERY_LEAF)
        self.best = np.full((len(ids), k), LOW)
        self.best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scored = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        data = cover_tree(vectors)
        count, heap = 0, [(-self._bound(self.tree, data), 0, self.tree, data)]
        while heap:
            bound, _, q, d = heapq.heappop(heap)
            if -bound < q.worst - 1e-6 * (1 + abs(bound)):
                continue
            if not q.children and not d.children:
                self._score(q, d.points, ids, vectors)
                continue
            pairs = [(c, d) for c in q.children] if q.children and (not d.children or q.radius > d.radius) else [(q, c) for c in d.children]
            for a, b in pairs:
                limit = self._bound(a, b)
                if limit >= a.worst - 1e-6 * (1 + abs(limit)):
                    count += 1
                    heapq.heappush(heap, (-limit, count, a, b))

    @staticmethod
    def _bound(q: Node, d: Node) -> float:
        return float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius

    def _score(self, q: Node, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        mine, theirs = q.points, ids[rows]
        scores = products(self.vectors[mine], vectors[rows])
        self.scored += scores.size
        own = theirs[None, :] == self.ids[mine][:, None]
        use = (scores >= self.best[mine, -1][:, None]) & ~own
        some = use.any(axis=1)
        if some.any():
            at = mine[some]
            s = np.concatenate([self.best[at], np.where(use[some], scores[some], LOW)], axis=1)
            i = np.concatenate([self.best_ids[at], np.where(use[some], theirs[None, :], np.iinfo(np.int64).max)], axis=1)
            order = np.lexsort((i, -np.maximum(s, LOW + 1)), axis=1)[:, :self.k]
            self.best[at], self.best_ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            q.worst = int(self.best[mine, -1].min())
            while q.parent:  # carry the worst score up the query tree
                q = q.parent
                q.worst = min(c.worst for c in q.children)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.best_ids != np.iinfo(np.int64).max
        who = np.broadcast_to(self.ids[:, None], found.shape)
        return who[found], self.best_ids[found], self.best[found]


def _arrays(b: pa.RecordBatch):
    """(ids, vectors) of a batch by vector length."""
    lists = b.column("_vector")
    lengths = np.diff(np.asarray(lists.offsets))
    ids = np.asarray(b.column("_id"))
    flat = np.asarray(lists.flatten())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), ids[at], flat[starts[at][:, None] + np.arange(n)]


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding", queries_per_job: int = QUERIES_PER_JOB) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``vectors`` for every row of ``queries``."""
    spark = vectors.sparkSession
    if k < 1:
        raise ValueError("k must be 1 at least")

    def usable(df: DataFrame) -> DataFrame:
        good = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        return df.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & good).select(
            F.col(id_col).cast("long").alias("_id"), whole_numbers(F.col(vector_col), scale).alias("_vector"))

    asked, data = usable(queries), usable(vectors)
    jobs = max(1, -(-asked.count() // queries_per_job))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    path = None

    def one(part: int) -> DataFrame:
        rows = asked if jobs == 1 else asked.filter(F.pmod(F.xxhash64("_id"), F.lit(jobs)) == part)
        table = rows.dropDuplicates(["_id"]).toArrow().combine_chunks()
        stated = [x for b in table.to_batches() for x in _arrays(b)]
        shared = spark.sparkContext.broadcast(stated)

        def run(batches):
            searches = {n: Search(ids, v, k) for n, ids, v in shared.value}
            waiting: dict[int, list] = {n: [] for n in searches}

            def index(n):
                parts = waiting[n]
                if parts:
                    searches[n].add(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    parts.clear()

            for b in batches:
                for n, ids, v in _arrays(b):
                    if n in waiting:
                        waiting[n].append((ids, v))
                        if sum(len(p[0]) for p in waiting[n]) >= BLOCK_ROWS:
                            index(n)
            for n, search in searches.items():
                index(n)
                columns = search.results()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        found = map_arrow(data, run, "query_id long, vec_id long, score long")
        return (found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    if jobs == 1:
        return one(0)
    path = fresh_path(spark, "topk")
    for part in range(jobs):
        one(part).write.mode("append").parquet(path)
    return spark.read.parquet(path)
