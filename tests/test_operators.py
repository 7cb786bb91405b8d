import numpy as np
import pytest

from lumenframe.operators import descriptors, filters, graph, histogram, images, points, raster, series


def raster_of(spark, a, image=0):
    return spark.createDataFrame([(image, x, y, int(v)) for (y, x), v in np.ndenumerate(np.array(a))], "image_id long, x int, y int, v int")


def array_of(df, name):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r[name]
    return out


RNG = np.random.default_rng(0)
IMG = RNG.integers(0, 256, (9, 11))


def test_boxcar_and_bins(spark):
    y = [2, 3, 4, 3, 2, 4, 4, 4, 4, 4]
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(y)], "curve_id long, pos int, v double")
    got = [r.boxcar_rounded for r in series.boxcar(df, 3).orderBy("pos").collect()]
    assert got == [2, 3, 3, 3, 3, 3, 3, 4, 4, 4]
    assert [r.mean for r in series.bin_average(df, 4).orderBy("bin").collect()] == [3.0, 3.5, 2.0]
    med = series.running_median(df, 3).orderBy("pos").collect()
    assert [r.median for r in med] == [sorted(y[k - 2 : k + 1])[1] for k in range(2, 10)]


def test_box_counts_ragged_images(spark):
    df = raster_of(spark, IMG).where("y < 8 OR x < 4")
    rows = {(r.x, r.y): (r.box_n, r.box_sum, r.box_max) for r in raster.box(df, 2).collect()}
    cells = {(x, y): int(v) for (y, x), v in np.ndenumerate(IMG) if y < 8 or x < 4}
    for (x, y), got in rows.items():
        near = [v for (p, q), v in cells.items() if abs(p - x) <= 2 and abs(q - y) <= 2]
        assert got == (len(near), sum(near), max(near))


def test_integral_and_morphology(spark):
    assert array_of(raster.integral(raster_of(spark, IMG)), "sat") == pytest.approx(IMG.cumsum(0).cumsum(1))
    binary = (IMG > 140).astype(int)
    wide = np.pad(binary, 1)
    want = np.max([wide[1 + a : 10 + a, 1 + b : 12 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
    assert array_of(raster.morphology(raster_of(spark, binary), True), "v") == pytest.approx(want)


def test_convolution_reflects_and_wraps(spark):
    k = filters.gaussian(1.0)
    got = array_of(filters.separable(raster_of(spark, IMG), k, k), "out")
    assert got == pytest.approx(images.blurred(IMG, 1.0))
    df = spark.createDataFrame([(0, i, float(i * i)) for i in range(6)], "curve_id long, pos int, v double")
    closed = [r.o for r in filters.convolve(df, [0.25, 0.5, 0.25], ["curve_id"], "pos", "v", "o", True).orderBy("pos").collect()]
    v = np.arange(6.0) ** 2
    assert closed == pytest.approx((np.roll(v, 1) + 2 * v + np.roll(v, -1)) / 4)
    assert sum(filters.gaussian(2.0)) == pytest.approx(1) and sum(filters.gaussian(2.0, 1)) == pytest.approx(0)


def test_a_trous_adds_up(spark):
    rows = filters.a_trous(raster_of(spark, IMG), 2).collect()
    assert all(r.w_1 + r.w_2 + r.c_2 == pytest.approx(r.v) for r in rows)


def test_equalisation_and_otsu(spark):
    df = raster_of(spark, IMG)
    counts = np.bincount(IMG.reshape(-1), minlength=256)
    cdf = counts.cumsum()
    low = cdf[1:][cdf[1:] > 0][0]
    for r in histogram.equalised(df).collect():
        assert r.equalised == (0 if r.v == 0 else int(np.floor((cdf[r.v] - low) * 254 / (99 - low) + 0.5)) + 1)
    flat = IMG.reshape(-1)
    score = [(len(flat[flat <= t]) * len(flat[flat > t]) * (flat[flat <= t].mean() - flat[flat > t].mean()) ** 2 if (flat <= t).any() and (flat > t).any() else 0) for t in range(256)]
    assert histogram.otsu(df).first().threshold == int(np.argmax(score))


def test_components_agree(spark):
    a = (IMG > 110).astype(int)
    for eight in (False, True):
        got = array_of(graph.connected_values(raster_of(spark, a), "v", eight), "component")
        mine = images.components(a, eight)
        seen = {}
        for k, v in zip(got.reshape(-1), mine.reshape(-1), strict=True):
            assert seen.setdefault(k, v) == v
        assert len(seen) == len(np.unique(mine))


def test_kmeans_on_clear_groups(spark):
    a = np.repeat([25, 100, 150, 180], 9).reshape(6, 6) + RNG.integers(-2, 3, (6, 6))
    got = sorted(r.center for r in graph.kmeans_1d(raster_of(spark, a), 4).collect())
    assert got == pytest.approx([25, 100, 150, 180], abs=2)


def test_point_joins(spark):
    p = RNG.integers(0, 30, (80, 2))
    df = spark.createDataFrame([(0, i, int(x), int(y)) for i, (x, y) in enumerate(p)], "set_id long, point_id long, x int, y int")
    got = {(r.id1, r.id2) for r in points.radius_join(df, df, 4).collect()}
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    assert got == {(int(i), int(j)) for i, j in np.argwhere(d2 <= 16)}
    edges = spark.createDataFrame([(0, 0, 0, 10, 0), (0, 10, 0, 10, 10), (0, 10, 10, 0, 10), (0, 0, 10, 0, 0)], "poly_id int, x0 int, y0 int, x1 int, y1 int")
    inside = points.in_polygon(df.selectExpr("0 AS poly_id", "point_id", "x", "y"), edges).collect()
    assert all(r.inside == (r.x <= 10 and r.y <= 10) for r in inside)


def test_descriptors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    rows = df.select(descriptors.ssd("a", "b").alias("s"), descriptors.cosine("a", "b").alias("c")).collect()
    assert [r.s for r in rows] == [2.0, 2.0] and [r.c for r in rows] == pytest.approx([0, 1])
    box = spark.createDataFrame([(0, 0, 9, 9, 5, 5, 14, 14), (0, 0, 1, 1, 5, 5, 6, 6)], "ax0 int, ay0 int, ax1 int, ay1 int, bx0 int, by0 int, bx1 int, by1 int")
    assert [r.iou for r in descriptors.box_iou(box).collect()] == pytest.approx([25 / 175, 0])


def test_images():
    periodic, smooth = images.periodic_and_smooth(IMG.astype(float))
    assert periodic + smooth == pytest.approx(IMG)
    assert sum(images.multiscale_median(IMG, 2)) == pytest.approx(IMG)
    assert images.bilinear(IMG, 9, 11) == pytest.approx(IMG)
    step = np.zeros((16, 16))
    step[:, 8:] = 200
    edge = images.canny(step)
    assert edge[4:12, 6:10].any(axis=1).all() and not edge[:, :5].any() and not edge[:, 12:].any()
    pc = images.phase_congruency(step)["strength"]
    assert pc[8, 7:9].max() > 2 * pc[8, 2:5].max()
    bar = np.zeros((9, 15), int)
    bar[3:6, 2:13] = 1
    thin = images.zhang_suen(bar)
    assert thin.sum(axis=0).max() == 1 and thin.sum() >= 7
    hills = np.minimum(np.abs(np.arange(20) - 4), np.abs(np.arange(20) - 14))[None].repeat(6, 0)
    basins = images.watershed(hills)
    assert set(np.unique(basins)) == {1, 2} and basins[0, 2] != basins[0, 17]
    assert len(np.unique(images.slic([step, step, step], 4))) >= 4
    square = np.zeros((8, 8), int)
    square[2:6, 2:6] = 1
    assert len(images.outline(square)) == 12
    dot = np.zeros((5, 5), int)
    dot[2, 2] = 1
    assert images.outline(dot) == [(2, 2)]
    img = np.full((21, 21), 50)
    img[8:13, 8:13] = 10
    found = [r for r in images.stable_regions(img) if r[1] == 25]
    assert found and found[0][3:5] == pytest.approx((10, 10))
    assert images.ellipse(4.0, 0.0, 1.0) == pytest.approx((4, 2, 0))
    corner = np.zeros((15, 15))
    corner[7:, 7:] = 100
    assert images.fast_corners(corner)[7, 7] > 0 and images.fast_corners(corner)[3, 3] == 0
    yy, xx = np.mgrid[0:28, 0:28]
    a = np.sin(xx / 3) + np.cos(yy / 4)
    b = np.sin((xx - 0.3) / 3) + np.cos(yy / 4)
    flow = np.array(images.lucas_kanade(a, b, 14))
    assert np.median(flow[:, 2]) == pytest.approx(0.3, abs=0.05)
    u, _ = images.horn_schunck(a, b, 0.1, 200)
    assert np.median(u) == pytest.approx(0.3, abs=0.1)
    w = np.zeros((8, 8))
    w[:4, :4] = w[4:, 4:] = 1
    w[3, 4] = w[4, 3] = 0.01
    assert len(np.unique(images.normalized_cut(w))) == 2
