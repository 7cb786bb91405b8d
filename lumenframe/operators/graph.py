"""Connected pixels, region graphs and one-dimensional clusters."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once into spark.checkpoint.dir (a temporary folder where none is set, on a single machine only)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)


#: Pixels of a side of the tiles in which connected_values cuts images.
TILE = 256


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 0 on that are equal where values are: nulls are equal, and so are NaNs."""
    if not pa.types.is_floating(values.type):
        return values.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    there = values.is_valid().to_numpy()
    return np.where(there, np.unique(values.fill_null(0).to_numpy(), return_inverse=True)[1] + 1, 0)


def connected_values(df: DataFrame, value: str, eight: bool = False, minimum: int = 1, tile: int = TILE) -> DataFrame:
    """(image_id, x, y, value, component, size): components of equal neighbouring values, named by their smallest y * 2^20 + x.

    Images are cut into tiles, which are the largest unit of a task; components of a tile are found at once. Those that touch
    across a border of tiles are joined by pointer jumping, in rounds that grow with the logarithm of the longest chain of them; where
    none do there are no rounds. Groups below `minimum` pixels go, and pixels without a place.
    """
    from lumenframe.operators.images import components
    from lumenframe.operators.watershed import joined, met

    rows = df.select("image_id", "x", "y", value).where("x IS NOT NULL AND y IS NOT NULL")
    schema = StructType([*rows.schema, StructField("component", LongType()), StructField("size", LongType())])

    def run(pixels: pa.Table) -> pa.Table:
        x, y = (pixels[c].to_numpy().astype(np.int64) for c in "xy")
        at = (y - y.min(), x - x.min())
        a = np.full((at[0].max() + 1, at[1].max() + 1), -1)  # absent pixels
        a[at] = _codes(pixels[value])
        root = components(a, eight)[at]
        name = (root // a.shape[1] + y.min()) * (1 << 20) + root % a.shape[1] + x.min()
        return pixels.append_column("component", pa.array(name)).append_column("size", pa.array(np.bincount(root)[root]))

    tiles = [F.floor(F.col(c) / tile).alias(f"_t{c}") for c in "xy"]
    out = rows.groupBy("image_id", *tiles).applyInArrow(run, schema)
    # Pairs of equal neighbours in different tiles. A struct keeps pixels without an image together.
    image = F.struct("image_id").alias("image_id")
    place = (F.col("y").cast("long") * (1 << 20) + F.col("x")).alias("p")
    last, border = [f"pmod({c}, {tile}) = {tile - 1}" for c in "xy"], " OR ".join(f"pmod({c}, {tile}) IN (0, {tile - 1})" for c in "xy")
    slant = (-1, 0, 1) if eight else (0,)
    asks = [(last[0], [(1, d) for d in slant]), (last[1], [(d, 1) for d in slant])]
    asks = [rows.where(where).select(image, place, F.col(value).alias("_v"), F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])).alias("c")) for where, steps in asks]
    asked = asks[0].unionByName(asks[1]).select("image_id", "p", "_v", "c.x", "c.y")
    other = rows.where(border).select(image, "x", "y", place.alias("q"), value)
    pairs = cut_lineage(met(asked, other, ["image_id", "x", "y"]).where(F.col("_v").eqNullSafe(F.col(value))).select("image_id", "p", "q"))
    if not pairs.isEmpty():
        out = cut_lineage(out)
        pieces = out.where(border).select(image, place, "component", "size")
        side = lambda c: pieces.select("image_id", F.col("p").alias(c), F.col("component").alias(f"_{c}"))
        links = met(met(pairs, side("p"), ["image_id", "p"]), side("q"), ["image_id", "q"]).select("image_id", F.col("_p").alias("p"), F.col("_q").alias("q")).distinct()
        links = cut_lineage(links.unionByName(links.select("image_id", F.col("q").alias("p"), F.col("p").alias("q"))))
        roots = joined(cut_lineage(links.select("image_id", "p").distinct()), links)
        sized = met(roots, pieces.select("image_id", F.col("component").alias("p"), "size").distinct(), ["image_id", "p"])
        whole = met(roots, sized.groupBy("image_id", "root").agg(F.sum("size").alias("whole")), ["image_id", "root"]).select(F.col("image_id").alias("_i"), F.col("p").alias("component"), "root", "whole")
        out = met(out.withColumn("_i", image), whole, ["_i", "component"], "left")
        out = out.withColumns({"component": F.coalesce("root", "component"), "size": F.coalesce("whole", "size")})
    return out.where(F.col("size") >= minimum).select("image_id", "x", "y", value, "component", "size")


def connected_per_image(df: DataFrame, value: str, eight: bool = False, minimum: int = 1) -> DataFrame:
    """The same as connected_values with each image in one task: one shuffle, for images that fit a task."""
    import pandas as pd

    from lumenframe.operators.images import components

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        a = np.full((y.max() + 1, x.max() + 1), np.nan)  # absent pixels are joined to nothing
        a[y, x] = pdf[value]
        root = components(a, eight)[y, x]
        name = root // a.shape[1] * (1 << 20) + root % a.shape[1]
        size = np.bincount(root, minlength=a.size)[root]
        out = pd.DataFrame({"image_id": pdf["image_id"], "x": x, "y": y, value: pdf[value], "component": name, "size": size})
        return out[size >= minimum]

    return df.select("image_id", "x", "y", value).groupBy("image_id").applyInPandas(run, f"image_id long, x int, y int, {value} {dict(df.dtypes)[value]}, component long, size long")


def region_weights(adjacent: DataFrame, means: DataFrame, sigma: float) -> DataFrame:
    """Edge weights exp(-d^2 / sigma) of adjacent regions (image_id, a, b) by the distance of their mean colours."""
    side = lambda s: means.select("image_id", F.col("label").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("mr", "mg", "mb")])
    j = adjacent.join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"])
    d2 = sum((F.pow(F.col(f"{c}_a") - F.col(f"{c}_b"), 2) for c in ("mg", "mb")), F.pow(F.col("mr_a") - F.col("mr_b"), 2))
    return j.withColumn("d2", d2).withColumn("weight", F.exp(-F.col("d2") / sigma)).select("image_id", "a", "b", "d2", "weight")


def kmeans_1d(df: DataFrame, k: int, value: str = "v", by: str = "image_id", rounds: int = 20) -> DataFrame:
    """Per group, centers of k clusters of a small-integer value after Lloyd's rounds from evenly ranked seeds.

    Works on the histogram (one row per distinct value), so a round's cost doesn't depend on the number of rows.
    (by, cluster, center, n); a cluster without members keeps its center.
    """
    hist = cut_lineage(df.groupBy(by, value).agg(F.count("*").alias("n")))
    w = Window.partitionBy(by).orderBy(value)
    rank = F.floor((F.row_number().over(w) - 1) * k / F.count("*").over(Window.partitionBy(by))).alias("cluster")
    centers = hist.select(by, value, rank).groupBy(by, "cluster").agg(F.avg(value).alias("center"))
    for _ in range(rounds):
        listed = centers.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("center", "cluster"))).alias("c"))  # k structs a group
        nearest = F.array_min(F.transform("c", lambda c: F.struct(F.abs(F.col(value) - c["center"]).alias("d"), c["cluster"].alias("cluster"))))["cluster"]
        assigned = hist.join(listed, by).withColumn("cluster", nearest)
        new = assigned.groupBy(by, "cluster").agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
        centers = cut_lineage(centers.select(by, "cluster", "center").join(new, [by, "cluster"], "left").select(by, "cluster", F.coalesce("mean", "center").alias("center"), F.coalesce("n", F.lit(0)).alias("n")))
    return centers


def border_pixels(df: DataFrame, label: str = "label") -> DataFrame:
    """Pixels of a region with a 4-neighbour of another region, or at the raster's edge."""
    cols, rows = Window.partitionBy("image_id", "x").orderBy("y"), Window.partitionBy("image_id", "y").orderBy("x")
    four = [F.lag(label).over(cols), F.lead(label).over(cols), F.lag(label).over(rows), F.lead(label).over(rows)]
    inner = four[0].eqNullSafe(F.col(label)) & four[1].eqNullSafe(F.col(label)) & four[2].eqNullSafe(F.col(label)) & four[3].eqNullSafe(F.col(label))
    return df.withColumn("_inner", inner).where("NOT _inner").drop("_inner")


def largest_difference_weights(adjacent: DataFrame, means: DataFrame, sigma: float) -> DataFrame:
    """Edge weights exp(-d^2 / sigma) of adjacent regions, d being the largest difference of their mean channels."""
    side = lambda s: means.select("image_id", F.col("label").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("mr", "mg", "mb")])
    d = F.greatest(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in ("mr", "mg", "mb")])
    return adjacent.join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"]).select("image_id", "a", "b", d.alias("d"), F.exp(-d * d / sigma).alias("weight"))
