import numpy as np
import pytest

from lumenframe.functions import color, geometry, scalars
from lumenframe.functions.steps import applied

# Published CIEDE2000 pairs: L1 a1 b1 L2 a2 b2 difference.
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615), (50.0, 2.8361, -74.0200, 50.0, 0.0, -82.7485, 3.4412),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_delta_e_2000_published_pairs(spark):
    df = spark.createDataFrame(PAIRS, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for r in applied(df, color.delta_e_2000()).collect():
        assert r.de2000 == pytest.approx(r.want, abs=1e-4)


def test_lab_of_known_colours(spark):
    df = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0)], "r int, g int, b int")
    white, black, red = applied(df, color.lab()).collect()
    assert (white.lab_l, white.lab_a, white.lab_b) == pytest.approx((100, 0, 0), abs=0.02)
    assert (black.lab_l, black.lab_a, black.lab_b) == pytest.approx((0, 0, 0), abs=1e-9)
    assert (red.lab_l, red.lab_a, red.lab_b) == pytest.approx((53.24, 80.09, 67.20), abs=0.05)


def test_rgb_survives_the_way_through_xyz(spark):
    df = spark.createDataFrame([(r, g, b) for r in (0, 17, 128, 255) for g in (0, 99, 255) for b in (3, 200)], "r int, g int, b int")
    for r in applied(df, [*color.xyz_srgb(), *color.xyz_to_rgb()]).collect():
        assert (r.or_, r.og_, r.ob_) == (r.r, r.g, r.b)


def test_numbers(spark):
    df = spark.createDataFrame([(137.0,), (0.0,), (-0.02,)], "p double").selectExpr("p", f"{scalars.power_of_ten('p')} AS e", f"{scalars.round_down_by_power('p')} AS d", f"{scalars.round_up_by_power('p')} AS u", f"{scalars.real_cube_root('p')} AS c")
    a, b, c = df.collect()
    assert (a.e, a.d, a.u) == (2, 100, 200) and a.c == pytest.approx(137 ** (1 / 3))
    assert (b.e, c.e) == (0, -2) and c.c == pytest.approx(-(0.02 ** (1 / 3)))
    h = spark.range(5).selectExpr(f"{scalars.radical_inverse('id', 2)} AS h").collect()
    assert [r.h for r in h] == [0, 0.5, 0.25, 0.75, 0.125]
    t = spark.createDataFrame([(0.95,), (0.5,), (1.0,)], "w double").selectExpr(f"{scalars.ransac_trials('w', 7)} AS t").collect()
    assert [r.t for r in t] == [3, 382, 1]


def test_rotations_agree():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.uniform(-1.4, 1.4, 3)
        assert geometry.angles_zyx(geometry.rotation_zyx(*a)) == pytest.approx(tuple(a))
        assert geometry.angles_xyz(geometry.rotation_xyz(*a)) == pytest.approx(tuple(a))
        r, q = geometry.rodrigues(a), geometry.quaternion(a)
        assert geometry.rotation_vector(r) == pytest.approx(a)
        assert geometry.quaternion_rotation(q) == pytest.approx(r)
        v = rng.normal(size=3)
        assert geometry.rotate(q, v) == pytest.approx(r @ v)
        p = geometry.quaternion(rng.uniform(-1, 1, 3))
        assert geometry.quaternion_rotation(geometry.multiply(p, q)) == pytest.approx(geometry.quaternion_rotation(p) @ r)
        assert geometry.geodesic(p, geometry.slerp(p, q, 0.25)) == pytest.approx(0.25 * geometry.geodesic(p, q))
        x = rng.normal(size=(3, 8))
        assert geometry.procrustes(x, r @ x) == pytest.approx(r)
        assert geometry.orthonormal(r + 1e-9) == pytest.approx(r, abs=1e-6)
        c = geometry.cayley(a)
        assert c @ c.T == pytest.approx(np.eye(3))
        assert geometry.between(v, r @ v) @ v == pytest.approx(r @ v)
        assert geometry.scalar_first(geometry.scalar_last(q)) == pytest.approx(q)
    assert geometry.rotation_vector(geometry.rodrigues(np.array([np.pi, 0, 0])))[0] == pytest.approx(np.pi)


def scene(n=40, seed=0):
    rng = np.random.default_rng(seed)
    world = np.column_stack([rng.uniform(-3, 3, (n, 2)), rng.uniform(8, 14, n)])
    k = geometry.intrinsic(500, 320, 240, 1.1, 0.5)
    r, t = geometry.rotation_zyx(0.05, -0.1, 0.08), np.array([-1.0, 0.2, 0.3])
    return world, k, r, t, geometry.project(k, np.eye(3), np.zeros(3), world), geometry.project(k, r, t, world)


def test_cameras():
    world, k, r, t, a, b = scene()
    m = geometry.resection(world, b)
    k2, r2, t2 = geometry.decomposed(m)
    assert k2 == pytest.approx(k, abs=1e-5) and r2 == pytest.approx(r, abs=1e-8) and t2 == pytest.approx(t, abs=1e-6)
    p1, p2 = geometry.camera(k, np.eye(3), np.zeros(3)), geometry.camera(k, r, t)
    for w, x, y in zip(world, a, b, strict=True):
        assert geometry.triangulate([p1, p2], [x, y]) == pytest.approx(w)
    bent = geometry.project(k, r, t, world, (0.05, 0.01))
    c = world @ r.T + t
    assert geometry.to_camera(k, bent, (0.05, 0.01)) == pytest.approx(c[:, :2] / c[:, 2:], abs=1e-6)


def test_planar_calibration_and_pose():
    k = geometry.intrinsic(480, 310, 250, 1.05, 0.2)
    plane = np.array([(x, y) for x in range(5) for y in range(4)], float)
    flat, hs, poses = np.column_stack([plane, np.zeros(20)]), [], []
    for angles in ((0.3, 0.1, 0.2), (-0.2, 0.4, 0), (0.1, -0.3, 0.5), (0.5, 0.2, -0.3)):
        r, t = geometry.rotation_zyx(*angles), np.array([-2.0, -1.5, 12])
        hs.append(geometry.homography(plane, geometry.project(k, r, t, flat)))
        poses.append((r, t))
    assert geometry.planar_calibration(hs) == pytest.approx(k, abs=1e-4)
    for h, (r, t) in zip(hs, poses, strict=True):
        got_r, got_t = geometry.planar_pose(k, h)
        assert got_r == pytest.approx(r, abs=1e-6) and got_t == pytest.approx(t, abs=1e-5)


def test_two_views():
    world, k, r, t, a, b = scene()
    f = geometry.fundamental_8(a, b)
    assert geometry.sampson(f, a, b).max() < 1e-12
    assert min(geometry.sampson(g, a, b).max() for g in geometry.fundamental_7(a[:7], b[:7])) < 1e-9
    r2, t2 = geometry.pose_from_essential(geometry.essential(f, k, k), geometry.to_camera(k, a), geometry.to_camera(k, b))
    assert r2 == pytest.approx(r, abs=1e-6) and t2 == pytest.approx(t / np.linalg.norm(t), abs=1e-6)
    e1, e2 = geometry.epipoles(f)
    assert f @ e1 == pytest.approx(np.zeros(3), abs=1e-12) and f.T @ e2 == pytest.approx(np.zeros(3), abs=1e-12)
    h1, h2 = geometry.rectify(f, 480, 640)
    for h, e in ((h1, e1), (h2, e2)):
        assert abs((h @ e)[1:] / (h @ e)[0]) == pytest.approx([0, 0], abs=1e-9)
    bad = b.copy()
    bad[::3] += 40
    g, good = geometry.ransac_fundamental(a, bad, 0.5)
    assert set(np.flatnonzero(~good)) <= set(range(0, 40, 3)) and good.sum() >= 26
    assert geometry.sampson(g, a[1::3], b[1::3]).max() < 1e-6


def test_bundle_adjustment_falls_to_no_error():
    world, k, r, t, a, b = scene(15)
    poses = np.array([[0, 0, 0, 0, 0, 0], [*geometry.rotation_vector(r), *t]], float)
    seen = [(c, p, *xy) for c, view in enumerate((a, b)) for p, xy in enumerate(view)]
    rng = np.random.default_rng(1)
    start = poses.copy()
    start[1] += rng.normal(0, 0.01, 6)
    _, _, error = geometry.bundle_adjust(k, start, world + rng.normal(0, 0.05, world.shape), seen, 40)
    assert error < 1e-3


def test_assignment_against_all_permutations():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = rng.integers(1, 5, 2)
        cost = rng.integers(0, 20, (n, m)).astype(float)
        pairs = geometry.assignment(cost)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert len(pairs) == min(n, m) and sum(cost[i, j] for i, j in pairs) == best


def test_shapes():
    t = np.arange(60) * 2 * np.pi / 60
    circle = np.column_stack([np.cos(t), np.sin(t)])
    assert geometry.inflections(circle, [1, 2]) == []
    star = circle * (1 + 0.4 * np.cos(5 * t))[:, None]
    assert len([1 for s, _ in geometry.inflections(star, [1.0])]) == 10
    a = geometry.chord_angles(geometry.resampled(star, 30))
    turned = geometry.chord_angles(np.roll(geometry.resampled(star @ np.array([[0, 2], [-2, 0]]), 30), 4, axis=0))
    value, start, turn, length = geometry.partial_match(a, turned, 10)
    assert value < 1e-6 and length == 30
    assert geometry.cubic_roots(1, -6, 11, -6) == pytest.approx([1, 2, 3])
    scale, angle, d = geometry.similarity(circle, 2 * circle @ np.array([[0.8, 0.6], [-0.6, 0.8]]) + (1, 2))
    assert (scale, angle) == pytest.approx((2, np.arctan2(0.6, 0.8))) and d == pytest.approx([1, 2])


def test_bundle_adjustment_of_many_points():
    """Several blocks of points, not all seen by all cameras; the work grows with the points, not with their square."""
    import time

    rng = np.random.default_rng(3)
    k = geometry.intrinsic(500, 320, 240)
    world = rng.uniform(-2, 2, (9000, 3)) + (0, 0, 10)
    poses = np.array([[0, 0, 0, 0, 0, 0], [0.02, 0.1, 0.03, -1.0, 0.1, 0.2], [-0.05, 0.2, 0.0, -2.0, 0.0, 0.3]])
    seen = [(c, i, *xy) for c, p in enumerate(poses) for i, xy in enumerate(geometry.project(k, geometry.rodrigues(p[:3]), p[3:], world)) if (i + c) % 5]
    began = time.process_time()
    _, _, error = geometry.bundle_adjust(k, poses + 0.01 * np.array([[0], [1], [-1]]), world + 0.02 * np.sin(np.arange(world.size)).reshape(world.shape), seen[::-1], 8)
    assert error < 1e-4 and time.process_time() - began < 20
