"""Corners of curves across scales: curvature maxima above a threshold of each scale, followed from the coarsest scale down."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import filters
from lumenframe.operators.graph import cut_lineage

#: Bins of the histogram of curvatures, up to twice their third quartile.
BINS = 16


def thresholds(curvatures: DataFrame, by: str = "curve_id") -> DataFrame:
    """by, q3, low: the first minimum after the first peak of the histogram of |k|, as the middle of its bin."""
    q3 = curvatures.groupBy(by).agg(F.percentile("k", F.lit(0.75)).alias("q3"))
    binned = curvatures.join(q3, by).withColumn("bin", F.floor(F.col("k") / F.nullif(F.col("q3") * 2, F.lit(0.0)) * BINS))
    h = binned.groupBy(by).agg(F.first("q3").alias("q3"), F.array(*[F.count(F.when(F.col("bin") == b, 1)) for b in range(BINS)]).alias("h"))
    peak = f"coalesce(get(filter(sequence(0, {BINS - 2}), b -> h[b] > h[b + 1]), 0), {BINS - 1})"
    h = h.withColumn("peak", F.expr(peak)).withColumn("least", F.expr(f"coalesce(get(filter(sequence(0, {BINS - 2}), b -> b > peak AND h[b] < h[b + 1]), 0), {BINS - 1})"))
    return h.select(by, "q3", F.expr(f"(least + 0.5D) * 2 * q3 / {BINS}").alias("low"))


def candidates(curves: DataFrame, sigma: float, factor: float = 2.0, by: str = "curve_id", order: str = "pos") -> DataFrame:
    """by, order, k: where |curvature| at this blur has a maximum that reaches the curve's threshold and exceeds `factor` times the
    minimum before or after it (both ends of the curve count as no minimum)."""
    k = cut_lineage(filters.curvature(curves, sigma, by, order).select(by, order, F.abs("k").alias("k")))  # read three times
    w = Window.partitionBy(by).orderBy(order)
    before, after = F.lag("k").over(w), F.lead("k").over(w)
    kind = F.when((F.col("k") > before) & (F.col("k") > after), 1).when((F.col("k") < before) & (F.col("k") < after), 0)
    ends = k.withColumn("kind", kind).where("kind IS NOT NULL")
    sides = [F.when(f("kind").over(w) == 0, f("k").over(w)) for f in (F.lag, F.lead)]
    ends = ends.withColumns({"_before": sides[0], "_after": sides[1]}).where("kind = 1").join(thresholds(k, by), by)
    clear = F.coalesce(F.col("k") > factor * F.col("_before"), F.lit(False)) | F.coalesce(F.col("k") > factor * F.col("_after"), F.lit(False)) | (F.col("_before").isNull() & F.col("_after").isNull())
    return ends.where((F.col("k") >= F.col("low")) & clear).select(by, order, "k")


def tracked(curves: DataFrame, sigmas: tuple[float, ...], factor: float = 2.0, by: str = "curve_id", order: str = "pos") -> DataFrame:
    """by, corner, pos, k, lost: the corners of the coarsest scale (its position as `corner`), each moved at every finer scale to the nearest candidate
    within the coarser blur (ties to the earlier one). Where there is none it stays, and `lost` counts that; k is its
    curvature where it was last seen.

    A fold of range joins, each an equi-join on stretches of the curve as long as the reach; a corner's row carries what it keeps, so that no
    scale is computed again for the next one.
    """
    sigmas = tuple(sorted(sigmas, reverse=True))
    now = candidates(curves, sigmas[0], factor, by, order).select(by, F.col(order).alias("corner"), F.col(order).alias("pos"), "k", F.lit(0).alias("lost"))
    for coarse, fine in zip(sigmas, sigmas[1:], strict=False):
        reach = math.ceil(coarse)
        spot = candidates(curves, fine, factor, by, order).select(by, F.col(order).alias("to"), F.col("k").alias("to_k"), F.floor(F.col(order) / reach).alias("cell"))
        asks = now.withColumn("cell", F.explode(F.array(*[F.floor(F.col("pos") / reach) + d for d in (-1, 0, 1)])))
        met = asks.join(spot, [by, "cell"], "left").withColumn("d", F.abs(F.col("to") - F.col("pos")))
        best = met.groupBy(by, "corner").agg(F.min(F.when(F.col("d") <= reach, F.struct("d", "to", "to_k"))).alias("m"), *[F.first(c).alias(c) for c in ("pos", "k", "lost")])
        now = best.select(by, "corner", F.coalesce("m.to", "pos").alias("pos"), F.coalesce("m.to_k", "k").alias("k"), (F.col("lost") + F.col("m").isNull().cast("int")).alias("lost"))
    return now
