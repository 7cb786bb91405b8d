"""Gradients, pyramids, holes and thresholds against plain loops; sparse matrices against numpy; transformations and rotations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry, rotations
from lumenframe.functions.steps import applied
from lumenframe.operators import edges, matrices, points
from lumenframe.plans.matrices import displacement, zxy

RNG = np.random.default_rng(5)


def image_rows(a, absent=()):
    return [(0, x, y, int(v)) for (y, x), v in np.ndenumerate(a) if (x, y) not in absent]


def table(spark, rows, schema="image_id long, x int, y int, v int"):
    return spark.createDataFrame(rows, schema)


def test_hue_steps_go_round_the_circle(spark):
    a = np.array([[0, 0, 0, 0], [5, 9, 250, 3], [0, 0, 0, 0]])
    got = {(r.x, r.y): r.step for r in edges.hue_steps(table(spark, image_rows(a)), 12).collect()}
    # 5 against 250 is 10 round the circle of 255; 9 against 3 is 6.
    assert set(got.values()) == {0}
    got = {(r.x, r.y): r.step for r in edges.hue_steps(table(spark, image_rows(a)), 10).collect()}
    assert [k for k, v in got.items() if v] == [(1, 1)]


@pytest.mark.parametrize("shape", [(8, 8), (7, 5), (3, 6), (1, 1)])
def test_median_pyramid_is_exact_and_has_the_medians(spark, shape):
    a = RNG.integers(0, 256, shape)
    absent = {(1, 2), (0, 0)} if shape == (7, 5) else set()
    df = table(spark, image_rows(a, absent))
    parts, smooth = edges.median_pyramid(df, 2)
    back = {(r.x, r.y): r.v for r in edges.pyramid_rebuilt(parts, smooth).collect()}
    assert back == {(x, y): v for _, x, y, v in image_rows(a, absent)}
    now = {(x, y): v for _, x, y, v in image_rows(a, absent)}
    median = {}
    for x, y in now:
        near = sorted(now[p] for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (p := (x + dx, y + dy)) in now)
        median[x, y] = near[len(near) // 2]
    for r in parts[0].collect():
        part = [median[p] for dx in (0, 1) for dy in (0, 1) if (p := (r.x // 2 * 2 + dx, r.y // 2 * 2 + dy)) in median]
        assert now[r.x, r.y] - r.w == math.floor(sum(part) / len(part) + 0.5)


def test_holes_by_flooding(spark):
    for _ in range(5):
        a = (RNG.random((9, 11)) < 0.55).astype(int)
        ys, xs = np.nonzero(a)
        x0, x1, y0, y1 = xs.min() - 1, xs.max() + 1, ys.min() - 1, ys.max() + 1
        seen, todo = set(), [(x0, y0)]
        while todo:
            x, y = todo.pop()
            if (x, y) in seen or not (x0 <= x <= x1 and y0 <= y <= y1) or (0 <= y < 9 and 0 <= x < 11 and a[y, x]):
                continue
            seen.add((x, y))
            todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        want = {(x, y) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1) if 0 <= y < 9 and 0 <= x < 11 and not a[y, x] and (x, y) not in seen}
        assert {(r.x, r.y) for r in edges.holes(table(spark, image_rows(a))).collect()} == want


def test_holes_of_an_empty_table_and_of_full_images(spark):
    assert edges.holes(table(spark, [])).collect() == []
    assert edges.holes(table(spark, image_rows(np.ones((3, 3), int)))).collect() == []
    assert edges.holes(table(spark, image_rows(np.zeros((3, 3), int)))).collect() == []


def test_two_dimensional_threshold_by_trying_all_bins(spark):
    a = np.where(RNG.random((12, 12)) < 0.4, 40, 200) + RNG.integers(-30, 30, (12, 12))
    bins, lo, size = 8, a.min(), a.max() - a.min() + 1
    pairs = []
    for (y, x), v in np.ndenumerate(a):
        near = a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
        pairs.append(((v - lo) * bins // size, int(near.sum() - lo * near.size) * bins // (near.size * size)))
    p = np.array(pairs)
    whole, best = p.mean(0), None
    for s, t in sorted(set(map(tuple, pairs))):
        low = p[(p[:, 0] <= max(s - 1, 0)) & (p[:, 1] <= max(t - 1, 0))]
        high = p[(p[:, 0] >= s) & (p[:, 1] >= t)]
        trace = round(sum(len(c) / len(p) * ((c.mean(0) - whole) ** 2).sum() * len(p) / len(p) for c in (low, high) if len(c)), 6)
        if best is None or trace > best[0]:
            best = (trace, s, t)
    got = edges.otsu_2d(table(spark, image_rows(a)), bins).collect()
    assert [(r.s, r.t) for r in got] == [best[1:]]
    assert got[0].threshold == pytest.approx(lo + (best[1] + 0.5) * size / bins)


def test_a_constant_image_has_a_threshold_and_no_contrast(spark):
    df = table(spark, image_rows(np.full((4, 4), 7)))
    assert [(r.s, r.t) for r in edges.otsu_2d(df, 8).collect()] == [(0, 0)]
    assert {r.contrast for r in edges.contrasted(df, 2).collect()} == {0}
    assert {r.ratio for r in edges.divided_by_blur(df, 1.0).collect()} == {100}
    assert {r.contrast for r in edges.contrasted(table(spark, image_rows(np.zeros((3, 3)))), 2).collect()} == {0}


def test_single_labels_take_the_nearest_colour(spark):
    rows = [(0, 0, 0, 200, 0, 0, 1), (0, 1, 0, 10, 10, 10, 2), (0, 2, 0, 12, 10, 10, 3), (0, 3, 0, 12, 10, 10, 3)]
    df = table(spark, rows, "image_id long, x int, y int, r int, g int, b int, label int")
    assert {r.x: r.relabelled for r in edges.without_single_labels(df).collect()} == {0: 2, 1: 3, 2: 3, 3: 3}
    assert [r.relabelled for r in edges.without_single_labels(df.limit(1)).collect()] == [1]  # without any neighbour


def test_bilinear_places(spark):
    a = np.array([[0, 10], [20, 30]])
    places = table(spark, [(0, 1, 0.0, 0.0), (0, 2, 0.5, 0.0), (0, 3, 0.25, 0.5), (0, 4, 1.0, 1.0), (0, 5, 1.5, 0.0)], "image_id long, place_id long, x double, y double")
    assert {r.place_id: r.v for r in edges.bilinear_at(table(spark, image_rows(a)), places).collect()} == {1: 0.0, 2: 5.0, 3: 12.5, 4: 30.0}


@pytest.mark.parametrize("n,want", [([1, 3, 5, 4, 2, 2, 6], (2, 6)), ([5, 4, 3], (0, 0)), ([1, 2, 3], (-1, 0)), ([2, 2, 1, 1, 3, 1, 4], (1, 4))])
def test_first_peak_and_minimum(spark, n, want):
    hist = table(spark, [(0, k, v) for k, v in enumerate(n)], "image_id long, bin int, n long")
    assert [(r.peak, r.after) for r in edges.first_peak_and_minimum(hist).collect()] == [want]


def sparse(spark, a):
    return spark.createDataFrame([(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(a) if v], "i int, j int, v long")


def dense(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        assert out[r.i, r.j] == 0
        out[r.i, r.j] = r.v
    return out


def test_sparse_matrices(spark):
    a, b = (np.where(RNG.random((5, 6)) < 0.4, RNG.integers(-4, 5, (5, 6)), 0) for _ in range(2))
    sa, sb = sparse(spark, a), sparse(spark, b)
    assert (dense(matrices.subtracted(sa, sb), (5, 6)) == a - b).all()
    assert (dense(matrices.multiplied(sa, matrices.transposed(sb)), (5, 5)) == a @ b.T).all()
    assert (dense(matrices.pointwise(sa, sb), (5, 6)) == a * b).all()
    assert (dense(matrices.row_repeated(sa, 2, 3, 2, 6), (3, 12)) == np.tile(a[2], (3, 2))).all()
    got = matrices.summary(sa).first()
    assert (got.nodes, got.trace) == ((a != 0).sum(), np.trace(a)) and got.norm == pytest.approx(np.linalg.norm(a))
    assert matrices.subtracted(sa, sa).count() == 0
    assert tuple(matrices.equal_within(sa, sb, 100).first()) == (True, abs(a - b).max())
    none = sparse(spark, np.zeros((2, 2), int))
    assert tuple(matrices.equal_within(none, none, 0).first()) == (True, 0.0)
    assert tuple(matrices.summary(none).first()) == (0, 0.0, 0.0)


def test_inverse_and_reversed_bits(spark):
    m = RNG.normal(size=(3, 3))
    names = [f"m{i}{j}" for i in range(3) for j in range(3)]
    df = spark.createDataFrame([tuple(map(float, m.ravel())), (1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0)], ", ".join(f"{n} double" for n in names))
    got = applied(df, matrices.inverse3()).select([f"n{i}{j}" for i in range(3) for j in range(3)]).collect()
    assert np.allclose(np.array(got[0]).reshape(3, 3), np.linalg.inv(m)) and set(got[1]) == {None}
    bits = spark.createDataFrame([(0,), (1,), (6,), (65536 + 5,)], "v long").select(matrices.reversed_bits(F.col("v"), 16).alias("r")).collect()
    assert [r.r for r in bits] == [0, 32768, 0b0110000000000000, 0b1010000000000000]


def test_rotations_against_numpy(spark):
    a, b, c = 0.4, -0.7, 1.1
    v = np.array([0.3, -0.2, 0.5])
    row = spark.createDataFrame([(a, b, c, *map(float, v))], "a double, b double, c double, vx double, vy double, vz double")
    rx = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    ry = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    rz = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    got = applied(row, zxy()).first()
    assert np.allclose([[got[f"m{i}{j}"] for j in range(3)] for i in range(3)], rz @ rx @ ry) and np.allclose([got.za, got.zb, got.zc], [a, b, c])
    turn = np.linalg.norm(v)
    k = np.cross(v / turn, np.eye(3)).T  # k @ w is the axis crossed with w
    r = np.eye(3) + np.sin(turn) * k + (1 - np.cos(turn)) * k @ k
    got = applied(row, [*rotations.xyz(), *rotations.rodrigues(m="r"), *displacement()]).first()
    found = np.array([[got[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose(found, r)
    m = np.array([[got[f"m{i}{j}"] for j in range(3)] for i in range(3)])
    assert got.displacement == pytest.approx(np.linalg.norm(np.eye(3) - m @ found))


def test_similar_transformations_by_all_pairs(spark):
    rows = [("s", k, float(s), int(t)) for k, (s, t) in enumerate(zip(RNG.uniform(0.3, 4, 120), RNG.integers(0, 360, 120), strict=True))]
    rows += [("s", 200, 1.1, 359), ("s", 201, 0.9, 19), ("s", 202, 0.9, 20), ("t", 1, 1.0, 5)]
    got = {(r.set_id, r.point_id): r.likes for r in points.similar_transformations(spark.createDataFrame(rows, "set_id string, point_id long, scale double, turn int"), "scale", "turn").collect()}
    alike = lambda p, q: abs(p[2] - q[2]) <= 0.1 * (p[2] + q[2]) + 1e-9 and min(abs(p[3] - q[3]), 360 - abs(p[3] - q[3])) <= 20
    assert got == {p[:2]: sum(q[0] == p[0] and q[1] != p[1] and alike(p, q) for q in rows) for p in rows}


def test_average_across_the_start_of_the_circle(spark):
    rows = [("s", 1, 1.0, 350, 0, 0), ("s", 2, 2.0, 20, 2, 4), ("t", 3, 1.0, 90, 1, 1)]
    got = {r.set_id: r for r in points.average_transformation(spark.createDataFrame(rows, "set_id string, point_id long, scale double, turn int, tx int, ty int")).collect()}
    assert (got["s"].turn, got["s"].scale, got["s"].tx, got["s"].ty) == (5.0, 1.5, 1.0, 2.0)
    assert got["t"].turn == 90 and got["t"].turn_sd is None


def test_circles_are_contiguous(spark):
    rows = points.circle(spark.createDataFrame([(1,), (2,), (5,), (17,)], "radius int")).orderBy("radius", "pos").collect()
    for radius in (1, 2, 5, 17):
        ring = [(r.x, r.y) for r in rows if r.radius == radius]
        assert ring[0] == (radius, 0) and len(set(ring)) == len(ring)
        assert all(abs(math.hypot(*p) - radius) < 0.75 for p in ring)
        if radius > 1:
            assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 2 for p, q in zip(ring, ring[1:] + ring[:1], strict=True))


def test_cameras_and_planes():
    f = np.cross(np.eye(3), [0.2, -0.4, 1.0]) @ RNG.normal(size=(3, 3))
    p = geometry.cameras_of_fundamental(f)
    again = np.cross(np.eye(3), p[:, 3]).T @ p[:, :3]
    ratio = again / np.linalg.norm(again) * np.linalg.norm(f)
    assert np.allclose(ratio, f) or np.allclose(ratio, -f)
    q = geometry.plane_of([[1, 0, 2, 1], [0, 4, 4, 2], [5, 5, 10, 5], [3, -1, 2, 1]])
    assert np.allclose(q / q[2], [0, 0, 1, -2])
