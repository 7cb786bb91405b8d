"""The index of vectors, robust fits, corners across scales, eigenvectors and clusters: plain versions and planted data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import clusters, corners, fits, shapes, spectra, vector_index


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, grp long, vector array<double>").repartition(4)


def plain_nearest(rows, queries, k):
    out = {}
    for q, g, v in queries:
        found = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, h, w in rows if h != g)
        out[q] = [i for _, i in found[:k]]
    return out


@pytest.mark.parametrize("share", [7, vector_index.SHARE])
def test_index_is_exact_and_quick_search_finds_most(spark, share):
    draw = np.random.default_rng(4)
    centers = draw.normal(0, 4, (12, 6))
    rows = [(k, k // 3, (centers[k % 12] + draw.normal(0, 1, 6)).tolist()) for k in range(900)]
    rows += [(1000 + k, 500, [1.0] * 6) for k in range(60)]  # copies of one group
    df = vectors(spark, rows)
    index = vector_index.build(df, vector_index.fit(df, cells=16), share)
    asked = [r for r in rows if r[0] % 50 == 0]
    want = plain_nearest(rows, asked, 5)
    for exact in (True, False):
        got = {}
        for r in vector_index.nearest(index, vectors(spark, asked), 5, probes=3, exact=exact).orderBy("k").collect():
            got.setdefault(r.qid, []).append(r.id)
        if exact:
            assert got == want
        else:
            assert sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_index_of_few_and_no_vectors(spark):
    few = vectors(spark, [(1, 1, [0.0, 1.0]), (2, 2, [0.0, 1.0]), (3, 3, [2.0, 2.0])])
    index = vector_index.build(few, vector_index.fit(few))
    got = vector_index.nearest(index, few.where("id = 1"), 5).orderBy("k").collect()
    assert [(r.id, r.d2) for r in got] == [(2, 0.0), (3, 5.0)]
    none = few.where("false")
    assert vector_index.nearest(vector_index.build(none, vector_index.fit(none)), none, 3).collect() == []


def outline(kind, turn=0.0, n=96):
    t = 2 * np.pi * np.arange(n) / n
    r = 1 + sum(a * np.cos(k * t + p) for k, a, p in kind)
    return np.column_stack([r * np.cos(t + turn), r * np.sin(t + turn)])


def test_runs_of_chord_angles_find_turned_outlines(spark):
    shown = {100: [(5, 0.4, 0)], 1: [(5, 0.4, 0)], 200: [(2, 0.5, 0.3), (3, 0.2, 1)], 2: [(2, 0.5, 0.3), (3, 0.2, 1)], 3: [(7, 0.3, 0.5)], 4: []}
    rows = [(c, k, float(x), float(y)) for c, kind in shown.items() for k, (x, y) in enumerate(outline(kind, c / 50))]
    curves = spark.createDataFrame([*rows, (9, 0, 0.0, 0.0), (9, 1, 1.0, 0.0)], "curve_id long, pos int, x double, y double").repartition(4)
    asked = curves.where("curve_id % 100 = 0").select("curve_id")
    best = {r.query_id: (r.curve_id, r.len) for r in shapes.nearest_runs(curves, asked, 3).where("k = 1").collect()}
    assert {q: c for q, (c, _) in best.items()} == {100: 1, 200: 2}
    assert shapes.lengths(16, 4) == [16, 12, 8, 4] and shapes.lengths(24, 8) == [24, 18, 12]
    row = next(r for r in shapes.chord_rows(curves).collect() if r.curve_id == 4 and r.start == 0)
    assert row.vector[0] == 0 and np.allclose(np.diff(row.vector[1:]), math.pi / 24, atol=1e-6) or len(row.vector) == 24


# Fits --------------------------------------------------------------------------------------------------------


def test_robust_parabola_ignores_outliers(spark):
    draw = random.Random(6)
    rows = [(1, k, float(x := k % 23 - 9), 0.5 * x * x - 2.0 * x + 3.0 + draw.uniform(-0.05, 0.05)) for k in range(200)]
    rows += [(1, 1000 + k, float(k % 23 - 9), draw.uniform(100, 900)) for k in range(60)]
    rows += [(2, k, 1.0, float(k)) for k in range(5)]  # one x only: no sample
    df = spark.createDataFrame(rows, "set_id long, id long, x double, y double").repartition(3)
    (r,) = fits.robust_parabola(df, "set_id", ["id"], 0.5).collect()
    assert r.set_id == 1 and r.n == 260 and r.inliers == 200
    assert (r.a, r.b, r.c) == (pytest.approx(0.5, abs=0.01), pytest.approx(-2.0, abs=0.02), pytest.approx(3.0, abs=0.05))
    made = {x.h: (x.a, x.b, x.c) for x in fits.parabola_hypotheses(df, "set_id", ["id"]).collect()}
    assert 10 < len(made) <= fits.SAMPLES
    again = fits.robust_parabola(df.repartition(5), "set_id", ["id"], 0.5).first()
    assert again.h == r.h and again.a == pytest.approx(r.a)


# Corners -----------------------------------------------------------------------------------------------------


def test_corners_of_a_step_are_tracked(spark):
    """A path with two right angles: the corners of the coarse scale end up at the true places."""
    path = [(float(x), 0.0) for x in range(40)] + [(39.0, float(y)) for y in range(1, 30)] + [(39.0 + k, 29.0) for k in range(1, 40)]
    rows = [(1, k, x, y) for k, (x, y) in enumerate(path)] + [(2, k, float(k), 0.0) for k in range(60)]
    curves = spark.createDataFrame(rows, "curve_id long, pos int, x double, y double").repartition(3)
    got = corners.tracked(curves, (4.0, 2.8, 2.0, 1.4)).where("curve_id = 1 AND lost = 0").collect()
    assert sorted(r.pos for r in got if r.k > 0.1) == [39, 68]
    assert corners.tracked(curves.where("false"), (4.0, 2.0)).collect() == []


# Spectra -----------------------------------------------------------------------------------------------------


def entries(spark, a):
    return spark.createDataFrame([(i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(a) if v], "i long, j long, v double")


def test_leading_pairs_against_numpy(spark):
    draw = np.random.default_rng(9)
    b = draw.normal(size=(40, 12))
    a = b.T @ b
    values, found = spectra.leading(entries(spark, a), 3)
    want, vectors_ = np.linalg.eigh(a)
    assert np.allclose(values, want[::-1][:3], rtol=1e-6)
    x = np.zeros((12, 3))
    for r in found.collect():
        x[r.i - 1, r.c] = r.x
    for c in range(3):
        assert abs(x[:, c] @ vectors_[:, 11 - c]) == pytest.approx(1, abs=1e-6)
    assert max(r.residual for r in spectra.residuals(entries(spark, a), values, found).collect()) < 1e-4 * values[0]


def test_null_space_of_a_planted_matrix(spark):
    draw = np.random.default_rng(1)
    b = draw.normal(size=(30, 5))
    b = np.column_stack([b, b[:, 0] + b[:, 1], b[:, 2] - 2 * b[:, 3]])
    a = b.T @ b
    x = np.zeros((7, 7))
    for r in spectra.null_space(entries(spark, a), 4).collect():
        x[r.i - 1, r.c] = r.x
    x = x[:, np.abs(x).sum(axis=0) > 0]
    assert x.shape[1] == 2 and np.abs(b @ x).max() < 1e-5 and np.allclose(x.T @ x, np.eye(2), atol=1e-6)
    full = spectra.null_space(entries(spark, np.diag([1.0, 2.0, 3.0])), 2)
    assert full.collect() == []


# Clusters ----------------------------------------------------------------------------------------------------


def test_kmeans_finds_planted_groups(spark):
    draw = np.random.default_rng(5)
    centers = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0], [0, 0, 20.0]])
    rows = [(k, (centers[k % 4] + draw.normal(0, 1, 3)).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    found, inertia = clusters.kmeans(df, 4)
    assert all(a >= b - 1e-9 for a, b in zip(inertia, inertia[1:])) and inertia[-1] < 400 * 4
    assert sorted(np.round(found / 20).astype(int).tolist()) == sorted((centers / 20).astype(int).tolist())
    again, _ = clusters.kmeans(df.repartition(2), 4)
    assert np.allclose(np.sort(found, axis=0), np.sort(again, axis=0))
    groups = clusters.assigned(df, found).groupBy("cluster").agg(F.countDistinct(F.col("id") % 4).alias("n"), F.count("*").alias("m")).collect()
    assert all(g.n == 1 and g.m == 100 for g in groups)
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, vector array<double>")
    assert len(clusters.kmeans(few, 4)[0]) == 1 and len(clusters.seeds(few.where("false"), 3)) == 0


# Reconstruction ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("missing", [0, 5])
def test_affine_reconstruction_puts_points_back(spark, missing):
    from lumenframe.operators import reconstruction

    draw = np.random.default_rng(7)
    space, cameras = draw.normal(0, 3, (60, 3)), draw.normal(size=(5, 2, 4))
    rows = []
    for v in range(5):
        for k in range(60):
            if not missing or (k + v) % missing:
                x, y = cameras[v, :, :3] @ space[k] + cameras[v, :, 3]
                rows.append((v, k, float(x), float(y)))
    if missing:  # points that all views see
        more = draw.normal(0, 3, (8, 3))
        rows += [(v, 1000 + k, *map(float, cameras[v, :, :3] @ p + cameras[v, :, 3])) for v in range(5) for k, p in enumerate(more)]
    seen = spark.createDataFrame(rows, "view int, point long, x double, y double").repartition(3)
    motion, points = reconstruction.affine(seen)
    got = reconstruction.errors(reconstruction.reprojected(seen, motion, points)).collect()
    assert len(got) == 5 and max(r.worst for r in got) < (1e-5 if not missing else 1e-2)
    # The points are the planted ones but for an affine change of space.
    made = {r.point: r.s for r in points.collect()}
    a = np.array([[*made[k], 1.0] for k in range(60)])
    fitted = a @ np.linalg.lstsq(a, space, rcond=None)[0]
    assert np.abs(fitted - space).max() < (1e-4 if not missing else 5e-2)


# Canonical frames --------------------------------------------------------------------------------------------


def test_frames_of_turned_regions_agree(spark):
    """A long bar with a ramp along it, upright and lying: the same cells but for the frame's direction."""
    from lumenframe.operators import canonical

    lying = [(1, 0, x, y, 10 * x) for x in range(24) for y in range(6)]
    upright = [(2, 0, x, y, 10 * y) for x in range(6) for y in range(24)]
    df = spark.createDataFrame(lying + upright + [(3, 0, 0, 0, 5)], "image_id long, label int, x int, y int, v int").repartition(3)
    found = {r.image_id: r for r in canonical.frames(df).collect()}
    assert set(found) == {1, 2} and found[1].theta == pytest.approx(0) and found[2].theta == pytest.approx(math.pi / 2)
    assert found[1].a == pytest.approx(found[2].a) == pytest.approx(2 * math.sqrt((24**2 - 1) / 12))
    cells = {}
    for r in canonical.resampled(canonical.frames(df), df).collect():
        cells.setdefault(r.image_id, {})[r.cu, r.cv] = r.value
    assert set(cells[1]) == set(cells[2]) and all(v == pytest.approx(cells[2][k]) for k, v in cells[1].items())
    blocks = canonical.block_histograms(canonical.resampled(canonical.frames(df), df)).collect()
    assert {(r.image_id, r.block, r.bin) for r in blocks} == {(i, b, 0) for i in (1, 2) for b in range(4)} and all(r.share == 1 for r in blocks)


def test_sum_xor_equals_its_sql_on_edges(spark, tmp_path):
    """Floats whose hundredfold rounds up to a whole number, nulls, and vectors of fewer than two components."""
    import duckdb

    import __spark_entry__ as entry

    file = tmp_path / "embeddings.parquet"
    vectors = "[0.29, 1.0], 1), ([0.57, 0.58, -0.29], 1), ([NULL, 2.0, 3.0], 2), ([1.0, NULL], 3), ([4.0], 4), ([]::FLOAT[], 4), (NULL, 4), ([1.0, 2.0], 4), ([5.0], 5"
    duckdb.connect().execute(f"COPY (SELECT row_number() OVER () AS vec_id, v::FLOAT[] AS embedding, label FROM (VALUES ({vectors})) t(v, label)) TO '{file}' (FORMAT parquet)")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{file}'")
    want = db.execute(entry.oracle_sql()["sum_xor"]).fetchall()
    found = entry.queries()["sum_xor"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(want) and dict(want)[1] == (29 ^ 100) + (57 ^ 58) + (58 ^ -29)


def test_tracking_computes_each_scale_once(spark):
    curves = spark.createDataFrame([(1, k, float(k), float(k * k % 7)) for k in range(50)], "curve_id long, pos int, x double, y double")
    plan = corners.tracked(curves, (4.0, 2.8, 2.0, 1.4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ExistingRDD") + plan.count("LogicalRDD") <= 4 * 3  # a scale's maxima and its threshold, with and without the quartile


@pytest.mark.parametrize("closed", [False, True])
def test_curvature_is_that_of_the_convolutions(spark, closed):
    from lumenframe.operators import filters

    rows = [(c, k, float(k), None if (c, k) == (2, 5) else float(k * k % 7)) for c, n in ((1, 3), (2, 50), (3, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "curve_id long, pos int, x double, y double")
    want = df
    for c in "xy":
        for d in (1, 2):
            want = filters.convolve(want, [(-1) ** d * w for w in filters.gaussian(1.4, d)], ["curve_id"], "pos", c, f"_{c}{d}", closed)
    want = want.selectExpr("curve_id", "pos", "coalesce((_x1 * _y2 - _y1 * _x2) / nullif(pow(_x1 * _x1 + _y1 * _y1, 1.5D), 0D), 0D) AS k")
    got = filters.curvature(df, 1.4, closed=closed).select("curve_id", "pos", "k")
    assert sorted(got.collect()) == sorted(want.collect())
