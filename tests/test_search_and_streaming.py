import functools

import numpy as np
import pytest

from lumenframe.functions import search
from lumenframe.operators import descriptors
from lumenframe.streaming import series


def test_minimisers():
    f = lambda x: float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2)
    x, value = search.multi_start(f, np.array([-2.0, -2.0]), np.array([2.0, 2.0]), 4)
    assert x == pytest.approx([1, 1], abs=1e-3) and value < 1e-6
    assert search.halton(5, 2) == pytest.approx([0.625, 7 / 9])


def test_alignment():
    yy, xx = np.mgrid[0:40, 0:40].astype(float)
    scene = lambda y, x: 50 * np.sin(x / 5) + 40 * np.cos(y / 6) + x
    warp, error = search.align(scene(yy, xx)[8:32, 8:32], scene(yy + 8 - 1.3, xx + 8 + 0.7))
    assert warp[:, 2] == pytest.approx([-0.7, 1.3], abs=0.05) and error < 0.5
    turned, _ = search.align(scene(yy, xx)[8:32, 8:32], scene(yy + 8 - 0.02 * xx, xx + 8), affine=True)
    assert turned[1] == pytest.approx([0.02, 1, 0], abs=0.02)


def test_distances_and_corners():
    mask = np.zeros((9, 15), int)
    mask[2:7, 2:13] = 1
    d = search.distance_transform(mask)
    inside, outside = np.argwhere(mask), np.argwhere(np.pad(mask, 1) == 0) - 1
    for y, x in inside:
        assert d[y, x] == pytest.approx(np.sqrt(((outside - (y, x)) ** 2).sum(axis=1).min()))
    axis = search.medial_axis(mask)
    assert axis[4, 5:10].all() and not axis[2, 5:10].any()
    side = np.linspace(0, 1, 30, endpoint=False)
    square = np.concatenate([np.column_stack([side, 0 * side]), np.column_stack([0 * side + 1, side]), np.column_stack([1 - side, 0 * side + 1]), np.column_stack([0 * side, 1 - side])])
    got = search.curve_corners(square * 100)
    assert len(got) == 4 and all(min(abs(g - c) for c in (0, 30, 60, 90, 120)) <= 2 for g in got)


def test_stream_matches_batch(spark, tmp_path):
    rows = [(k % 3, f"2024-01-01 00:{k // 4:02d}:00", float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "user_id int, t string, value double").selectExpr("user_id", "cast(t as timestamp) ts", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = series.windowed_summary(stream, "ts", "value", "user_id").writeStream.outputMode("complete").format("memory").queryName("got").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.start): (r.n, r.mean) for r in spark.sql("SELECT * FROM got").collect()}
    want = {(r.user_id, r.start): (r.n, r.mean) for r in series.windowed_summary(df, "ts", "value", "user_id").collect()}
    assert got == want and len(got) == 15


def test_nearest_vectors_in_blocks_against_brute_force(spark):
    """Ties, copies and vectors far from the origin; what tasks hand on are k rows a query and block, not all pairs."""
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(150, 6)), rng.integers(0, 2, (150, 6)), 1e6 + rng.integers(0, 2, (60, 6)) / 8])
    rows = [(int(i) // 3, int(i) % 3, v.tolist()) for i, v in enumerate(vectors)]
    base = spark.createDataFrame(rows, "grp long, id int, vector array<double>").repartition(3)
    found = descriptors.nearest_vectors(base, base.where("grp % 10 = 0"), 4)
    want = set()
    for g, s, q in rows:
        if g % 10 == 0:
            near = sorted((functools.reduce(lambda s, p: s + (p[0] - p[1]) * (p[0] - p[1]), zip(b, q), 0.0), h, t) for h, t, b in rows if h != g)[:4]
            want |= {(g, s, h, t, d, k + 1) for k, (d, h, t) in enumerate(near)}
    assert {tuple(r) for r in found.select("qgrp", "qid", "grp", "id", "d2", "k").collect()} == want
