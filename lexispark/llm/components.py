"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.scratch import materialize


def _jump(parents: DataFrame) -> DataFrame:
    """Every parent replaced by its own, until none has one."""
    while True:
        up = parents.select(F.col("x").alias("y"), F.col("y").alias("z"))
        moved = materialize(parents.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")))
        parents = moved.select("x", "y")
        if moved.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that is not its component's least; links has columns a and b.

    Each round hooks every node to its least smaller neighbour, follows the hooks to
    their ends, and contracts the links to those ends. A node is a row's key only in
    joins that Spark may split and in aggregations that combine before the shuffle.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x > y").distinct())
    out = None
    while not edges.isEmpty():
        hooks = _jump(edges.groupBy("x").agg(F.min("y").alias("y")))
        if out is None:
            out = hooks
        else:
            next_up = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
            out = materialize(out.join(next_up, "y", "left").select("x", F.coalesce("z", "y").alias("y")).unionByName(hooks))
        end = hooks.select(F.col("x").alias("node"), F.col("y").alias("end"))
        half = edges.join(end, edges["x"] == end["node"]).select(F.col("end").alias("p"), "y")
        both = half.join(end, half["y"] == end["node"], "left").select("p", F.coalesce("end", "y").alias("q"))
        edges = materialize(both.where("p <> q").select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y")).distinct())
    if out is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return out.select(F.col("x").alias("node"), F.col("y").alias("component"))
