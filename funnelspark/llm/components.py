"""Connected components of a large edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.workspace import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a long, b long); comp is the component's smallest node.

    Each round maps a node to the smallest of itself and its neighbours and contracts
    the edges along that map, which at least halves the nodes that still have edges;
    rounds end when no edge joins two nodes. Nothing but a row count reaches the driver.
    """
    edges = work.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while edges.take(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = work.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"), "map")
        maps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        last, edges = edges, work.write(moved.filter("a <> b").distinct(), "edges")
        work.drop(last)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("comp"))
    out = maps[0].select("node", F.col("to").alias("comp"))
    for to in maps[1:]:
        step = to.select(F.col("node").alias("comp"), "to")
        out = out.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return out
