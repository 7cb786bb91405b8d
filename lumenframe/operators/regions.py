"""Label rasters and window histograms: neighbourhood predicates, integral histograms, merging, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.raster import AROUND, neighbours


def near_border(df: DataFrame, width: int, height: int, margin: int) -> DataFrame:
    """Pixels or keypoints that aren't within the margin of the image's edge."""
    return df.where((F.col("x") >= margin) & (F.col("y") >= margin) & (F.col("x") < width - margin) & (F.col("y") < height - margin))


def neighbour_counts(df: DataFrame, value: str = "v") -> DataFrame:
    """Adds `around`, the number of set 8-neighbours, and `turns`, the changes from unset to set on the way around."""
    near = neighbours(df, value)
    ring = [F.coalesce(F.col(c), F.lit(0)) for c in ("n", "ne", "e", "se", "s", "sw", "w", "nw")]
    turns = sum((F.when((a == 0) & (b > 0), 1).otherwise(0) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)), F.lit(0))
    around = sum((F.when(c > 0, 1).otherwise(0) for c in ring), F.lit(0))
    return near.withColumns({"around": around, "turns": turns}).drop(*AROUND)


def would_disconnect(df: DataFrame, value: str = "v") -> DataFrame:
    """Set pixels whose removal parts their set neighbours: more than one run of them around the pixel."""
    return neighbour_counts(df, value).where((F.col(value) > 0) & (F.col("turns") > 1))


def window_histogram(df: DataFrame, half: int, bins: int, most: int = 256, value: str = "v") -> DataFrame:
    """Per pixel the histogram of its window as an array, by two separable window sums of each bin's indicator."""
    width = most // bins
    rows = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-half, half)
    columns = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-half, half)
    which = F.when(F.col(value).isNotNull(), F.least(F.floor(F.col(value) / width), F.lit(bins - 1)))
    df = df.withColumns({f"_b{k}": F.sum(F.when(which == k, 1).otherwise(0)).over(rows) for k in range(bins)})
    df = df.withColumns({f"_c{k}": F.sum(f"_b{k}").over(columns) for k in range(bins)})
    return df.withColumn("hist", F.array(*[f"_c{k}" for k in range(bins)])).drop(*[f"_b{k}" for k in range(bins)], *[f"_c{k}" for k in range(bins)])


def merged_by_difference(edges: DataFrame, labels: DataFrame, limit: float) -> DataFrame:
    """(image_id, label, merged): labels of one image joined along edges (a, b, d) with d below the limit, named by the smallest.

    Smallest names spread along edges until they settle; a region graph has few nodes an image.
    """
    from lumenframe.operators.graph import cut_lineage

    links = edges.where(F.col("d") < limit).select("image_id", "a", "b")
    both = cut_lineage(links.unionByName(links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    names, last = labels.select("image_id", "label", F.col("label").alias("merged")), None
    while True:
        low = both.join(names.select("image_id", F.col("label").alias("b"), F.col("merged").alias("other")), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("label")).agg(F.min("other").alias("other"))
        names = names.join(low, ["image_id", "label"], "left").select("image_id", "label", F.least("merged", F.coalesce("other", "merged")).alias("merged"))
        jump = names.select("image_id", F.col("label").alias("merged"), F.col("merged").alias("next"))
        names = cut_lineage(names.join(jump, ["image_id", "merged"]).select("image_id", "label", F.col("next").alias("merged")))
        now = names.agg(F.sum(F.col("merged").cast("long"))).first()[0]
        if now == last:
            return names
        last = now


def sorted_sample(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """A random subset by seeded hash: each row is in or out by itself, the same at each run."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))


def moments_ellipse(area: Column, m10: Column, m01: Column, m20: Column, m11: Column, m02: Column) -> dict[str, Column]:
    """Half axes and direction in degrees of the ellipse with a region's moments."""
    cx, cy = m10 / area, m01 / area
    a, b, c = m20 / area - cx * cx, m11 / area - cx * cy, m02 / area - cy * cy
    mean, half = (a + c) / 2, F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
    return {"major": 2 * F.sqrt(mean + half), "minor": 2 * F.sqrt(F.greatest(mean - half, F.lit(0.0))), "direction": F.degrees(0.5 * F.atan2(2 * b, a - c))}
