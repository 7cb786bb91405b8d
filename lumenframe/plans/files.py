"""Queries of image and curve sources and sinks, and of drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.plans.registry import query
from lumenframe.sources import images
from lumenframe.sources.derived import LABELS_SQL, PIXELS_SQL, POINTS_SQL, labelled, pixels
from lumenframe.sources.derived import points as point_table

# A file holds a whole rectangle: pixels that an image lacks are 0 in it.
_GRID = f"""WITH px AS ({PIXELS_SQL}), s AS (SELECT image_id, max(x) AS w, max(y) AS h FROM px GROUP BY image_id),
    g AS (SELECT image_id, gx::INTEGER AS x, gy::INTEGER AS y FROM s, generate_series(0, 31) a(gx), generate_series(0, 31) b(gy) WHERE gx <= w AND gy <= h)
    SELECT g.image_id, g.x, g.y, {{}} FROM g LEFT JOIN px ON px.image_id = g.image_id AND px.x = g.x AND px.y = g.y"""


@query("io_png_round_trip", _GRID.format("coalesce(r, 0) AS r, coalesce(px.g, 0) AS g, coalesce(b, 0) AS b"))
def png_round_trip(spark, sf_dir):
    """Colour images encoded in the tasks and read again."""
    return images.from_png(images.to_png(pixels(spark, sf_dir)))


@query("io_png_grey_round_trip", _GRID.format("coalesce(v, 0) AS v"))
def png_grey_round_trip(spark, sf_dir):
    return images.from_png(images.to_png(pixels(spark, sf_dir), ("v",))).select("image_id", "x", "y", F.col("r").alias("v"))


@query("io_grey_modes", f"SELECT image_id, x, y, (r + g + b) // 3 AS mean, floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 0.5::DOUBLE)::INTEGER AS luma, r AS red, g AS green, b AS blue, (r > 0 OR g > 0 OR b > 0)::INTEGER AS bits FROM ({PIXELS_SQL})")
def grey_modes(spark, sf_dir):
    """The ways to read an image in grey, side by side."""
    modes = {"mean": "mean", "luma": "luma", "red": "r", "green": "g", "blue": "b", "bits": "binary"}
    return pixels(spark, sf_dir).select("image_id", "x", "y", *[images.grey_value(mode).alias(name) for name, mode in modes.items()])


@query("io_scaled_to_range", f"WITH m AS (SELECT image_id, min(v) AS low, max(v) AS high FROM ({PIXELS_SQL}) GROUP BY image_id) SELECT image_id, x, y, CASE WHEN high = low THEN 0 ELSE floor((v - low) * 255::DOUBLE / (high - low))::INTEGER END AS v FROM ({PIXELS_SQL}) JOIN m USING (image_id)")
def scaled(spark, sf_dir):
    """Grey values stretched over 0..255, image by image, as before writing."""
    return images.stretched(pixels(spark, sf_dir).select("image_id", "x", "y", "v"))


@query("io_overlay_points", f"WITH px AS ({PIXELS_SQL}), m AS (SELECT DISTINCT p.image_id, p.x, p.y FROM px p JOIN px q ON p.image_id = q.image_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 WHERE q.v >= 250) SELECT px.image_id, px.x, px.y, CASE WHEN m.x IS NULL THEN r ELSE 255 END AS r, CASE WHEN m.x IS NULL THEN g ELSE 0 END AS g, CASE WHEN m.x IS NULL THEN b ELSE 0 END AS b FROM px LEFT JOIN m ON px.image_id = m.image_id AND px.x = m.x AND px.y = m.y")
def overlay(spark, sf_dir):
    """Bright pixels marked by red squares."""
    p = pixels(spark, sf_dir)
    return images.overlay(p, p.where("v >= 250").selectExpr("image_id", "x", "y", "255 AS r", "0 AS g", "0 AS b"), half=1)


_SEGMENTS = "SELECT DISTINCT image_id, image_id % 3 AS line_id, CAST(image_id % 7 AS INTEGER) AS x0, CAST(image_id % 5 AS INTEGER) AS y0, CAST(20 + image_id % 9 AS INTEGER) AS x1, CAST(28 - image_id % 11 AS INTEGER) AS y1"
_STEPS = f"WITH s AS ({_SEGMENTS} FROM ({PIXELS_SQL})), n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM s), k AS (SELECT *, unnest(generate_series(0, n)) AS k FROM n) SELECT DISTINCT image_id, line_id, floor(x0 + (x1 - x0) * k::DOUBLE / greatest(n, 1) + 0.5::DOUBLE)::INTEGER AS x, floor(y0 + (y1 - y0) * k::DOUBLE / greatest(n, 1) + 0.5::DOUBLE)::INTEGER AS y FROM k"


def _segments(spark, sf_dir):
    return pixels(spark, sf_dir).selectExpr(*_SEGMENTS.removeprefix("SELECT DISTINCT ").replace("INTEGER", "INT").split(", ")).distinct()


@query("io_lines", _STEPS)
def lines(spark, sf_dir):
    return images.lines(_segments(spark, sf_dir))


@query("io_dashed_lines", f"{_STEPS} WHERE k // 3 % 2 = 0")
def dashed(spark, sf_dir):
    return images.lines(_segments(spark, sf_dir), dash=3)


@query("io_alternating_colors", f"SELECT image_id, x, y, label, ([255, 0, 0, 255, 0, 255])[label % 6 + 1] AS r, ([0, 255, 0, 255, 255, 0])[label % 6 + 1] AS g, ([0, 0, 255, 0, 255, 255])[label % 6 + 1] AS b FROM ({LABELS_SQL})")
def alternating(spark, sf_dir):
    """Groups of pixels in alternating colours."""
    return labelled(spark, sf_dir).select("image_id", "x", "y", "label", *images.palette("label"))


@query("io_curve_lines", f"SELECT set_id AS origin, (row_number() OVER (PARTITION BY set_id ORDER BY point_id) - 1)::INTEGER AS pos, x::DOUBLE AS x, y::DOUBLE AS y FROM ({POINTS_SQL})")
def curve_lines(spark, sf_dir):
    """Curves written as lines of text and read again, in their order."""
    p = point_table(spark, sf_dir)
    written = p.groupBy("set_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("point_id", "x", "y"))), lambda r: F.concat_ws(",", r["x"], r["y"]))).alias("value"))
    return images.curves_of(written.select(F.col("set_id").alias("origin"), "value"))
