"""Watersheds of images that are cut into tiles, against spreading pixel by pixel, and how many jobs they take."""

import random

from lumenframe.operators import watershed
from tests.test_tables_of_pixels import plain_watershed

SCHEMA = "image_id long, x int, y int, v double"


def test_watershed_across_tiles(spark):
    """Random hills, one plateau through all tiles, a slope along many of them, absent pixels and places below 0."""
    draw = random.Random(5)
    images = {1: {(x, y): draw.randint(0, 3) for x in range(-3, 8) for y in range(-2, 7) if draw.random() < 0.85}}
    images[2] = {(x, y): 1 for x in range(9) for y in range(7) if y % 2 == 0 or x == 8 * (y // 2 % 2 == 0)} | {(-1, 0): 0}
    images[3] = {(x, y): abs(x - 4) + y for x in range(9) for y in range(3)}
    rows = [(k, x, y, float(v)) for k, points in images.items() for (x, y), v in points.items()]
    got = watershed.watershed(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=4).collect()
    want = {(k, *p): w for k, points in images.items() for p, w in plain_watershed(points).items()}
    assert {(r.image_id, r.x, r.y): (r.dist, r.label, r.ridge) for r in got} == want and len(got) == len(rows)
    assert max(r.dist for r in got if r.image_id == 2) > 30


def test_watershed_of_odd_pixels(spark):
    """NaNs are equal and above all; a null is lower than none and stands alone; pixels without a place have no basin."""
    nan = float("nan")
    rows = [(1, 0, 0, 2.0), (1, 1, 0, nan), (1, 2, 0, nan), (1, 3, 0, None), (1, 4, 0, None), (None, 0, 0, 1.0), (1, None, 0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.x, r.dist, r.basin, r.ridge) for r in watershed.watershed(df).collect()} == {(0, 0, 0, False), (1, 1, 0, False), (2, 2, 0, False), (3, 0, 3, False), (4, 0, 4, False)}
    assert sorted((r.image_id or 0, -1 if r.p is None else r.p, r.dist) for r in watershed.lower_complete(df).collect()) == [(0, 0, 0), (1, -1, 0), (1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 0), (1, 4, 0)]


def test_rounds_do_not_grow_within_a_tile(spark, monkeypatch):
    """A plateau 60 pixels long takes as few tables as one of two pixels."""
    made, cut = [], watershed.cut_lineage
    monkeypatch.setattr(watershed, "cut_lineage", lambda df: made.append(1) or cut(df))
    df = spark.createDataFrame([(1, x, 0, float(x > 0)) for x in range(60)], SCHEMA)
    assert watershed.watershed(df).agg({"dist": "max"}).first()[0] == 59
    assert len(made) == 8
