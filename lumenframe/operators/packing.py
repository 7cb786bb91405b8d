"""Points packed so that no two are near: a maximal independent set by rounds of hash priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.graph import cut_lineage


def near_pairs(df: DataFrame, limit: int, by: str = "image_id") -> DataFrame:
    """by, p, q: points (by, id, x, y) closer than `limit`, in both directions: an equi-join on cells as wide as that."""
    cell = lambda c: F.floor(F.col(c) / limit)
    here = df.select(by, F.col("id").alias("p"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("c")
    there = here.select(by, F.col("p").alias("q"), F.col("x").alias("u"), F.col("y").alias("v"), around).select(by, "q", "u", "v", "c.cx", "c.cy")
    pairs = here.join(there, [by, "cx", "cy"]).where("p <> q")
    return pairs.where((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2 < limit * limit).select(by, "p", "q")


def packed(df: DataFrame, limit: int, by: str = "image_id") -> DataFrame:
    """The points (by, id, x, y; ids differ within a set) that are chosen, with the round: no two are closer than `limit`, every other
    point is closer to a chosen one.

    In each round a point is chosen whose priority (a hash of its set and id) is below those of all undecided ones near it, and the
    ones near it drop out. The result is that of taking points by priority one after another, in a number of rounds
    that grows with the logarithm of the points. A pair is kept once, with the point that waits and the one of lower priority that it waits
    for, and goes as soon as one of them is out; priorities aren't needed after that.
    """
    rank = lambda c: F.struct(F.unhex(F.md5(F.concat_ws(":", F.col(by).cast("string"), F.col(c).cast("string")))), F.col(c))
    left = cut_lineage(df.select(by, "id"))
    pairs = cut_lineage(near_pairs(df, limit, by).where(rank("q") < rank("p")))
    chosen, k = None, 0
    while not left.isEmpty():
        k += 1
        new = cut_lineage(left.join(pairs.select(by, F.col("p").alias("id")).distinct(), [by, "id"], "left_anti").withColumn("round", F.lit(k)))
        picked = new.select(by, F.col("id").alias("q"))
        out = cut_lineage(pairs.join(picked, [by, "q"], "left_semi").select(by, F.col("p").alias("id")).distinct())
        left = cut_lineage(left.join(new, [by, "id"], "left_anti").join(out, [by, "id"], "left_anti"))
        gone = out.select(by, F.col("id").alias("p"))
        pairs = cut_lineage(pairs.join(gone, [by, "p"], "left_anti").join(gone.withColumnRenamed("p", "q"), [by, "q"], "left_anti"))
        chosen = new if chosen is None else chosen.unionByName(new)
    return df.join(chosen, [by, "id"]) if chosen is not None else df.withColumn("round", F.lit(0)).where("false")
