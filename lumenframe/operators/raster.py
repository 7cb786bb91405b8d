"""Rasters as rows (image_id, x, y, ...): slicing, arithmetic, extremes, rescaling, grey levels and box filters.

Everything partitions by image (and row or column of an image); no window runs over a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pixel_index(df: DataFrame, width: int) -> DataFrame:
    """Adds idx = y * width + x and the column and row that idx gives back."""
    return df.withColumn("idx", F.col("y") * width + F.col("x")).withColumn("col_", F.col("idx") % width).withColumn("row_", F.floor(F.col("idx") / width).cast("int"))


def crop(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels of the window (ends inclusive), moved to its origin."""
    return df.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def paste(df: DataFrame, dx: int, dy: int) -> DataFrame:
    """A crop back in its full frame."""
    return df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def arithmetic(a: DataFrame, b: DataFrame, value: str = "v") -> DataFrame:
    """Sum, difference and product of two rasters of the same image and size."""
    other = b.select("image_id", "x", "y", F.col(value).alias("other"))
    return a.join(other, ["image_id", "x", "y"]).withColumns({"added": F.col(value) + F.col("other"), "subtracted": F.col(value) - F.col("other"), "multiplied": F.col(value) * F.col("other")})


def clipped(df: DataFrame, value: str = "v", low: int = 0, high: int = 255) -> DataFrame:
    return df.withColumn(value, F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))))


def extremes(df: DataFrame, value: str = "v") -> DataFrame:
    """Per image: size, smallest and largest value, and the first index (row-major) of each."""
    at = F.struct(F.col(value), -F.col("y"), -F.col("x"))
    low = F.min(F.struct(value, "y", "x"))
    high = F.max(at)
    return df.groupBy("image_id").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high")).select("image_id", "n", F.col(f"low.{value}").alias("vmin"), F.col("low.x").alias("xmin"), F.col("low.y").alias("ymin"), F.col(f"high.{value}").alias("vmax"), (-F.col("high.col3")).alias("xmax"), (-F.col("high.col2")).alias("ymax"))


def rescaled(df: DataFrame, low: float = 0, high: float = 255, value: str = "v") -> DataFrame:
    """Per image, min to `low` and max to `high`; a constant image becomes `low`. Two passes of one shuffle by image."""
    image = Window.partitionBy("image_id")
    spread = F.max(value).over(image) - F.min(value).over(image)
    return df.withColumn("scaled", F.when(spread == 0, F.lit(float(low))).otherwise(low + (F.col(value) - F.min(value).over(image)) * (high - low) / F.nullif(spread, F.lit(0))))


def normalised_to_max(df: DataFrame, value: str = "v", most: int = 255) -> DataFrame:
    image = Window.partitionBy("image_id")
    return df.withColumn("norm", F.floor(F.col(value) * most / F.nullif(F.max(value).over(image), F.lit(0))))


def filled(df: DataFrame, value: str) -> DataFrame:
    """df with a row (null value) for each absent pixel of the images' bounding boxes, row by row."""
    extent = df.groupBy("image_id").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    grid = df.select("image_id", "y").distinct().join(extent, "image_id").select("image_id", "y", F.explode(F.sequence("_x0", "_x1")).alias("x"))
    return grid.join(df, ["image_id", "x", "y"], "left")


def box(df: DataFrame, half: int, value: str = "v", squares: bool = False, complete: bool = False) -> DataFrame:
    """Adds box_n, box_sum, box_min, box_max (and box_sum2) over the window of half-width `half`, clipped at the edges.

    Separable: along rows, then along columns. complete=True says that no raster lacks pixels, which saves a shuffle;
    else absent pixels are filled in first, and not counted.
    """
    if not complete:
        return box(filled(df, value), half, value, squares, True).where(F.col(value).isNotNull())
    rows = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-half, half)
    columns = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-half, half)
    first = {"_n": F.count(value).over(rows), "_s": F.sum(value).over(rows), "_lo": F.min(value).over(rows), "_hi": F.max(value).over(rows)}
    second = {"box_n": F.sum("_n").over(columns), "box_sum": F.sum("_s").over(columns), "box_min": F.min("_lo").over(columns), "box_max": F.max("_hi").over(columns)}
    if squares:
        first["_q"], second["box_sum2"] = F.sum(F.col(value) * F.col(value)).over(rows), F.sum("_q").over(columns)
    return df.withColumns(first).withColumns(second).drop("_n", "_s", "_lo", "_hi", "_q")


def adaptive_threshold(df: DataFrame, half: int, k: float = 0.2, value: str = "v") -> DataFrame:
    """Adds t = mean * (1 + k * (deviation / R - 1)) of the window; R is the middle of the image's values.

    The deviation averages squares of each pixel against its own local mean.
    """
    b = box(df, half, value).withColumn("_m", F.col("box_sum") / F.col("box_n")).drop("box_n", "box_sum", "box_min", "box_max")
    b = box(b.withColumn("_m2", F.expr(f"({value} - _m) * ({value} - _m)")), half, "_m2").withColumn("_s", F.sqrt(F.col("box_sum") / F.col("box_n")))
    image = Window.partitionBy("image_id")
    b = b.withColumn("_r", (F.max(value).over(image) + F.min(value).over(image)) / 2.0)
    return b.withColumn("t", F.expr(f"_m * (1 + {k!r}D * (_s / nullif(_r, 0D) - 1))")).drop("_m", "_m2", "_s", "_r", "box_n", "box_sum", "box_min", "box_max")


def integral(df: DataFrame, value: str = "v") -> DataFrame:
    """Summed-area table: sat = sum over all pixels with smaller or equal x and y. Columns, then rows."""
    up = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    left = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_col", F.sum(value).over(up)).withColumn("sat", F.sum("_col").over(left)).drop("_col")


def column_sums(df: DataFrame, value: str = "v") -> DataFrame:
    """Running sums down each column."""
    return df.withColumn("col_sum", F.sum(value).over(Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)))


def shifted(df: DataFrame, value: str, dx: int, dy: int, name: str) -> DataFrame:
    """Adds the value at (x + dx, y + dy) as `name` (null outside) by lead or lag within rows or columns."""
    if dx and dy:
        raise ValueError("one axis at a time")
    by, order = (["image_id", "y"], "x") if dx else (["image_id", "x"], "y")
    return df.withColumn(name, F.lead(value, dx or dy).over(Window.partitionBy(*by).orderBy(order)))


def neighbours(df: DataFrame, value: str = "v", complete: bool = False) -> DataFrame:
    """Adds the 3 x 3 neighbourhood as nw, n, ne, w, e, sw, s, se; null outside the raster. One shuffle per axis.

    complete=True says that no raster lacks pixels; else absent pixels are filled in first, and left out again.
    """
    if not complete:
        return neighbours(filled(df, value), value, True).where(F.col(value).isNotNull())
    columns = Window.partitionBy("image_id", "x").orderBy("y")
    rows = Window.partitionBy("image_id", "y").orderBy("x")
    df = df.withColumns({"n": F.lag(value).over(columns), "s": F.lead(value).over(columns)})
    return df.withColumns({"w": F.lag(value).over(rows), "e": F.lead(value).over(rows), "nw": F.lag("n").over(rows), "ne": F.lead("n").over(rows), "sw": F.lag("s").over(rows), "se": F.lead("s").over(rows)})


AROUND = ["nw", "n", "ne", "w", "e", "sw", "s", "se"]


def morphology(df: DataFrame, dilate: bool, value: str = "v") -> DataFrame:
    """Binary 3 x 3 dilation (any neighbour or self > 0) or erosion (self and all present neighbours > 0)."""
    near = neighbours(df, value)
    every = [F.col(value), *map(F.col, AROUND)]
    out = F.greatest(*[F.coalesce(c, F.lit(0)) for c in every]) if dilate else F.least(*[F.coalesce(c, F.lit(1)) for c in every])
    return near.withColumn(value, F.when(out > 0, 1).otherwise(0)).drop(*AROUND)


def without_single_pixels(df: DataFrame, value: str = "v") -> DataFrame:
    """A pixel that differs from all its neighbours while those agree takes their value."""
    near = neighbours(df, value)
    low, high = F.least(*map(F.col, AROUND)), F.greatest(*map(F.col, AROUND))
    return near.withColumn("filtered", F.when((low == high) & (low != F.col(value)), low).otherwise(F.col(value))).drop(*AROUND)


def binned(df: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Down-sampling: the mean of factor x factor pixels, rounded half up; part bins at the edges average what they have."""
    return df.groupBy("image_id", F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")).agg(F.floor(F.avg(value) + 0.5).cast("int").alias(value))


def unbinned(df: DataFrame, factor: int) -> DataFrame:
    """Up-sampling: every pixel becomes factor x factor pixels."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    return df.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step)).withColumns({"x": F.col("x") * factor + F.col("_dx"), "y": F.col("y") * factor + F.col("_dy")}).drop("_dx", "_dy")
