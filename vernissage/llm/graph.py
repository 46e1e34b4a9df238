"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.session import land


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected `edges`; component is its smallest node.

    In each round every node picks, of itself and its neighbours, the one with
    the smallest hash under a fresh seed, and the graph is contracted along the
    picks; loops and repeated edges go. The expected number of nodes falls by a
    constant factor whatever the shape of the graph, so the number of rounds is
    logarithmic, and a round costs two joins and two grouped aggregates that
    combine before the shuffle. Each round is written to the shared folder.
    Node values must not be null; edges from a node to itself are ignored.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    graph = land(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not graph.isEmpty():
        seed = F.lit(len(steps))
        ends = graph.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(graph.select(F.col("b").alias("n"), F.col("a").alias("m")))
        ranked = ends.groupBy("n").agg(F.min(F.struct(F.xxhash64(seed, "m").alias("h"), F.col("m"))).alias("near"))
        own = F.struct(F.xxhash64(seed, "n").alias("h"), F.col("n").alias("m"))
        picks = land(ranked.select("n", F.least(own, "near")["m"].alias("to")), "picks")
        steps.append(picks)
        left = graph.join(picks.select(F.col("n").alias("a"), F.col("to").alias("x")), "a")
        moved = left.join(picks.select(F.col("n").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        graph = land(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return both.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    found = steps[0].select(F.col("n").alias("node"), "to")
    for picks in steps[1:]:
        later = picks.select(F.col("n").alias("to"), F.col("to").alias("next"))
        found = land(found.join(later, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "found")
    smallest = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(smallest, "to").select("node", "component")
