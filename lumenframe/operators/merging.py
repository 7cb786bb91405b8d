"""Regions merged along the least differences between neighbours: a minimum spanning forest of the region graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.graph import cut_lineage
from lumenframe.operators.watershed import jumped


def spanning_forest(edges: DataFrame, by: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(forest, components) of edges (by, a, b, weight; a < b, each once). forest: by, a, b, weight, round of the minimum spanning
    forest, ties by a and b. components: by, label, merged (the smallest node of the component) of the nodes that have edges.

    Borůvka's rounds: every component takes its least edge to another one, and the components joined so are contracted by
    pointer jumping. The number of rounds grows with the logarithm of the nodes.
    """
    edges = cut_lineage(edges.select(by, "a", "b", "weight"))
    nodes = edges.select(by, F.explode(F.array("a", "b")).alias("label")).distinct().withColumn("root", F.col("label"))
    left, forest, k = edges.withColumns({"ca": F.col("a"), "cb": F.col("b")}), edges.withColumn("round", F.lit(0)).where("false"), 0
    while not left.isEmpty():
        k += 1
        edge = F.struct("weight", "a", "b")
        ends = left.select(by, F.explode(F.array(F.struct(F.col("ca").alias("p"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("p"), F.col("ca").alias("to")))).alias("e"), edge.alias("edge"))
        least = cut_lineage(ends.groupBy(by, "e.p").agg(F.min(F.struct("edge", "e.to")).alias("m")).select(by, "p", "m.to", "m.edge"))
        forest = forest.unionByName(least.select(by, "edge.a", "edge.b", "edge.weight").distinct().withColumn("round", F.lit(k)))
        # Of two components that chose each other the smaller becomes the root; all other pointers lead to such a pair.
        back = least.select(by, F.col("p").alias("to"), F.col("to").alias("back"))
        own = F.when((F.col("back") == F.col("p")) & (F.col("p") < F.col("to")), F.col("p")).otherwise(F.col("to"))
        roots = jumped(least.join(back, [by, "to"], "left").select(F.col(by).alias("image_id"), "p", own.alias("to")))
        side = lambda c: roots.select(F.col("image_id").alias(by), F.col("p").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        moved = left.join(side("ca"), [by, "ca"]).join(side("cb"), [by, "cb"]).where("root_ca <> root_cb")
        left = cut_lineage(moved.select(by, "a", "b", "weight", F.col("root_ca").alias("ca"), F.col("root_cb").alias("cb")))
        # Components that have no edge left are whole.
        nodes = nodes.join(side("root"), [by, "root"], "left").select(by, "label", F.coalesce("root_root", "root").alias("root"))
    names = nodes.groupBy(by, "root").agg(F.min("label").alias("merged"))
    return forest, nodes.join(names, [by, "root"]).select(by, "label", "merged")


def merged(nodes: DataFrame, edges: DataFrame, below: float, by: str = "image_id") -> DataFrame:
    """by, label, merged: each node's smallest node among those that edges (by, a, b, weight) lighter than `below` join."""
    edges = cut_lineage(edges)  # else the filter would be written out through all the steps of the weights
    _, found = spanning_forest(edges.where(F.col("weight") < below), by)
    return nodes.select(by, "label").join(found, [by, "label"], "left").select(by, "label", F.coalesce("merged", "label").alias("merged"))
