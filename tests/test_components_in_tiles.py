"""Components of images that are cut into tiles, against spreading pixel by pixel."""

import random

import pytest

from lumenframe.operators import graph


def plain_components(pixels, eight):
    """(image, x, y) -> (smallest name, size), by spreading; pixels: (image, x, y) -> value."""
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (eight or not (dx and dy))]
    out = {}
    for start in pixels:
        if start in out:
            continue
        found, todo = {start}, [start]
        while todo:
            i, x, y = todo.pop()
            for dx, dy in around:
                q = (i, x + dx, y + dy)
                if q in pixels and q not in found and pixels[q] == pixels[start]:
                    found.add(q)
                    todo.append(q)
        out |= dict.fromkeys(found, (min(y * (1 << 20) + x for _, x, y in found), len(found)))
    return out


@pytest.mark.parametrize("eight", [False, True])
def test_components_across_tiles(spark, eight):
    """A spiral through all tiles, two values, nulls, absent pixels, places below 0, and pixels of no image."""
    draw = random.Random(4)
    pixels = {(k, x, y): draw.choice([0, 1, None]) if k == 2 else draw.choice([0, 1]) for k in (1, 2, None) for x in range(-7, 14) for y in range(-6, 9) if draw.random() < 0.9}
    x, y, path = 0, 0, [(0, 0)]
    for n in range(12):  # arms two pixels apart
        dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[n % 4]
        for _ in range(2 * (n // 2 + 1)):
            x, y = x + dx, y + dy
            path.append((x, y))
    pixels |= {(9, *p): 5 for p in path}
    rows = [(k, x, y, v) for (k, x, y), v in pixels.items()]
    got = graph.connected_values(spark.createDataFrame(rows, "image_id long, x int, y int, v int").repartition(3), "v", eight, tile=4).collect()
    assert {(r.image_id, r.x, r.y): (r.component, r.size) for r in got} == plain_components(pixels, eight) and len(got) == len(rows)
    assert {r.v for r in got if r.image_id == 9} == {5} and len({r.component for r in got if r.image_id == 9}) == 1
    large = graph.connected_values(spark.createDataFrame(rows, "image_id long, x int, y int, v int"), "v", eight, 6, tile=5).collect()
    assert {(r.image_id, r.x, r.y) for r in large} == {p for p, (_, n) in plain_components(pixels, eight).items() if n >= 6}


def test_components_of_other_values(spark):
    nan, big = float("nan"), (1 << 53) + 1
    rows = [(1, 0, 0, 0.0, big), (1, 1, 0, -0.0, big), (1, 2, 0, nan, big - 1), (1, 3, 0, nan, None), (1, 4, 0, None, None), (1, None, 0, nan, big)]
    df = spark.createDataFrame(rows, "image_id int, x int, y int, d double, n long")
    assert sorted((r.x, r.component) for r in graph.connected_values(df, "d").collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]
    assert sorted((r.x, r.component, r.n) for r in graph.connected_values(df, "n", tile=2).collect() if r.n) == [(0, 0, big), (1, 0, big), (2, 2, big - 1)]
    assert graph.connected_values(df.where("false"), "n").collect() == []


def test_components_of_small_images_take_no_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: made.append(1) or df.localCheckpoint())
    df = spark.createDataFrame([(k, x, y, (x * y) % 2) for k in range(3) for x in range(20) for y in range(20)], "image_id long, x int, y int, v int")
    assert graph.connected_values(df, "v").count() == 1200
    assert len(made) == 1
