"""The data model (pixels, curves, points, descriptors) read out of the given tables.

Rasters: every 1024 orders are an image of 32 x 32 pixels. Curves: a user's event values by event id.
Points: the parts of a brand as (size, price) grid points. Descriptors: the embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = HEIGHT = 32

PIXELS_SQL = """SELECT CAST(o_orderkey // 1024 AS BIGINT) AS image_id, CAST(o_orderkey % 32 AS INTEGER) AS x, CAST((o_orderkey % 1024) // 32 AS INTEGER) AS y,
    CAST((o_custkey * 37) % 256 AS INTEGER) AS v, CAST(o_custkey % 256 AS INTEGER) AS r, CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INTEGER) AS g, CAST((o_orderkey * 7) % 256 AS INTEGER) AS b FROM orders"""
CURVES_SQL = "SELECT user_id AS curve_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, value AS v FROM events"
POINTS_SQL = "SELECT p_brand AS set_id, p_partkey AS point_id, p_size AS x, CAST((p_partkey * 13) % 61 AS INTEGER) AS y FROM part"
LABELS_SQL = f"SELECT image_id, x, y, r, g, b, v, CAST((x // 5) + 7 * (y // 6) + (v // 128) AS INTEGER) AS label FROM ({PIXELS_SQL})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, v (grey) and r, g, b, all 0..255."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 1024 AS image_id", "CAST(o_orderkey % 32 AS INT) AS x", "CAST((o_orderkey % 1024) div 32 AS INT) AS y", "CAST((o_custkey * 37) % 256 AS INT) AS v",
        "CAST(o_custkey % 256 AS INT) AS r", "CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT) AS g", "CAST((o_orderkey * 7) % 256 AS INT) AS b",
    )


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curve_id, pos, v."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS curve_id", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos", "value AS v")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id, point_id, x, y."""
    return table(spark, sf_dir, "part").selectExpr("p_brand AS set_id", "p_partkey AS point_id", "p_size AS x", "CAST((p_partkey * 13) % 61 AS INT) AS y")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a label: grid cells of 5 x 6, split by grey value."""
    return pixels(spark, sf_dir).withColumn("label", F.expr("CAST((x div 5) + 7 * (y div 6) + (v div 128) AS INT)")).select("image_id", "x", "y", "r", "g", "b", "v", "label")
