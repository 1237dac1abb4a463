"""Connected components by repeated contraction, for graphs whose nodes are hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwatch.session import materialise

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by one of its nodes.

    In a round every node points to the smallest of itself and its neighbours, and edges move
    to where their ends point; edges inside one node go. Nodes are hashes, so their order is
    random and a round removes a large part of them. Minima are combined before the shuffle, so
    a node with very many edges is no hot group; joins may be split by Spark. Every round is
    written to the shared folder, so a lost executor costs one round.
    """
    live = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    place = None
    for _ in range(MOST_ROUNDS):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialise(both.groupBy("a").agg(F.min("b").alias("_m"))
                            .select(F.col("a").alias("node"), F.least("a", "_m").alias("to")), "points")
        if place is None:
            place = point.select("node", F.col("to").alias("component"))
        else:
            step = point.select(F.col("node").alias("component"), F.col("to"))
            place = materialise(place.join(step, "component", "left")
                                .select("node", F.coalesce("to", "component").alias("component")), "places")
        left = point.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = point.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        live = materialise(live.join(left, "a").join(right, "b").filter("_a <> _b")
                           .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if place is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return place
