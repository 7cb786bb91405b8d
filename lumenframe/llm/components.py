"""Connected components of a table of links, as a loop of joins in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.session import checkpointed


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(doc_id, component_id) of every id in links (a, b); component_id is the smallest id reachable.

    Alternates the large-star and small-star steps, each of which joins the neighbours of an id to the
    smallest of them, until the links no longer change; the number of rounds grows with the logarithm of the size.
    Links are counted per id by aggregation, never gathered in one row or on the driver.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
        moved = both.join(least, "a")
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(most_rounds):
        edges = checkpointed(star(star(edges, True), False))
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id")).unionByName(edges.select(F.col("b").alias("doc_id"), F.col("b").alias("component_id")).distinct())
