"""Robust fits: hypotheses from minimal samples as rows, scored by all points of their set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import series

#: Points of a set from which samples are drawn (those with the smallest hashes of their keys), and samples a set.
POOL, SAMPLES = 64, 24


def _draw(h: Column, step: int, n: Column) -> Column:
    """A place in a pool of n points for sample h: strides that differ between the three points of a sample."""
    return ((h * (2 * step + 1) + step * (h + 3)) % n).cast("int")


def parabola_hypotheses(df: DataFrame, by: str, key: list[str], x: str = "x", y: str = "y", pool: int = POOL, samples: int = SAMPLES) -> DataFrame:
    """by, h, a, b, c: parabolas y = a x^2 + b x + c through three points of the pool with different x, several a set.

    Pools have a bounded size and come from a top-n per set; rows that repeat a key are ordered by x and y.
    """
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in (by, *key)])), x, y)
    few = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= pool)
    listed = few.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("p"))
    three = listed.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("n", F.size("p"))
    three = three.select(by, "h", *[F.get("p", _draw(F.col("h"), k, F.col("n"))).alias(f"s{k}") for k in range(3)])
    three = three.where("s0.x <> s1.x AND s1.x <> s2.x AND s0.x <> s2.x")
    first, second = "((s1.y - s0.y) / (s1.x - s0.x))", "((s2.y - s1.y) / (s2.x - s1.x))"
    three = three.withColumn("a", F.expr(f"({second} - {first}) / (s2.x - s0.x)"))
    return three.select(by, "h", "a", F.expr(f"{first} - a * (s0.x + s1.x)").alias("b"), F.expr(f"s0.y - s0.x * ({first} - a * s1.x)").alias("c"))


def robust_parabola(df: DataFrame, by: str, key: list[str], within: float, x: str = "x", y: str = "y", pool: int = POOL, samples: int = SAMPLES) -> DataFrame:
    """by, h, n, inliers, a, b, c: of the parabolas through samples the one that most points of the set are near (vertical distance
    at most `within`; ties by sample), and the least-squares parabola of these points. a, b, c are null where the points
    have fewer than three different x; sets without a valid sample are left out.

    The hypotheses of a set are one row of bounded size that meets each point of it; all points count.
    """
    found = parabola_hypotheses(df, by, key, x, y, pool, samples)
    listed = found.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("h", "a", "b", "c"))).alias("hs"))
    met = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).join(listed, by)
    near = lambda s: F.abs(F.col("y") - (s["a"] * F.col("x") * F.col("x") + s["b"] * F.col("x") + s["c"])) <= within
    votes = met.select(by, F.explode("hs").alias("s"), "x", "y").groupBy(by, "s.h").agg(F.count("*").alias("n"), F.sum(near(F.col("s")).cast("long")).alias("inliers"))
    best = votes.groupBy(by).agg(F.max(F.struct("inliers", (-F.col("h")).alias("low"), "n")).alias("m")).select(by, (-F.col("m.low")).alias("h"), F.col("m.n").alias("n"), F.col("m.inliers").alias("inliers"))
    kept = met.join(best, by).withColumn("s", F.expr("filter(hs, s -> s.h = h)[0]")).where(near(F.col("s"))).select(by, "x", "y")
    return best.join(series.parabola_fit(kept, "x", "y", by), by, "left")
