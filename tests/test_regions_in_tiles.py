"""Regions in frames of their own, over images of several tiles with gaps, nulls and repeated pixels."""

import pytest

from lumenframe.functions.steps import applied
from lumenframe.operators import canonical
from pyspark.sql import functions as F


def test_cells_are_those_of_the_pixels_around_them(spark):
    rows = [(i, x, y, None if (x * y + i) % 31 == 0 else (x * 7 + y * 13 + i) % 256, x // 40 + 3 * (y // 30)) for i in (1, 2) for x in range(140) for y in range(70) if (x + y * i) % 5]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, v int, label int")
    framed = canonical.frames(df)
    side = F.sequence(F.lit(0), F.lit(canonical.CELLS - 1))
    cells = applied(framed.withColumn("cu", F.explode(side)).withColumn("cv", F.explode(side)), canonical.PLACE)
    pixels = {}
    for i, x, y, v, _ in rows:
        pixels.setdefault((i, x, y), []).append(v)
    want = {}
    for c in cells.collect():
        total = whole = 0.0
        seen = False
        for x in (int(c.sx // 1), int(c.sx // 1) + 1):
            for y in (int(c.sy // 1), int(c.sy // 1) + 1):
                w = (1 - abs(c.sx - x)) * (1 - abs(c.sy - y))
                for v in pixels.get((c.image_id, x, y), []) if w > 0 else []:
                    whole += w
                    if v is not None:
                        total, seen = total + w * v, True
        if whole:
            want[c.image_id, c.label, c.cu, c.cv] = total / whole if seen else None
    made = canonical.resampled(framed, df)
    got = {(r.image_id, r.label, r.cu, r.cv): r.value for r in made.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())
    plan = canonical.block_histograms(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
