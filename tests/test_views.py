"""Native rotation and camera expressions against the numpy functions, and the sources and searches that queries use."""

import math

import numpy as np
import pytest

from lumenframe.functions import geometry, rotations
from lumenframe.functions.steps import applied
from lumenframe.operators import descriptors, points
from lumenframe.sources import images

RNG = np.random.default_rng(11)


def rows(spark, names, n=20, low=-1.2, high=1.2):
    values = RNG.uniform(low, high, (n, len(names)))
    return spark.createDataFrame([tuple(map(float, v)) for v in values], ", ".join(f"{c} double" for c in names))


def matrix(r, m):
    return np.array([[r[f"{m}{i}{j}"] for j in range(3)] for i in range(3)])


def test_rotations_about_axes(spark):
    for r in applied(rows(spark, ["a", "b", "c"]), [*rotations.elementary(), *rotations.xyz(), *rotations.angular_rates()]).collect():
        assert (r.roll12, r.roll21, r.roll11) == pytest.approx((geometry.roll(r.a)[1, 2], geometry.roll(r.a)[2, 1], geometry.roll(r.a)[1, 1]))
        assert (r.pitch02, r.pitch20) == pytest.approx((geometry.pitch(r.b)[0, 2], geometry.pitch(r.b)[2, 0]))
        assert (r.yaw01, r.yaw10) == pytest.approx((geometry.yaw(r.c)[0, 1], geometry.yaw(r.c)[1, 0]))
        assert matrix(r, "m") == pytest.approx(geometry.rotation_xyz(r.a, r.b, r.c))
        assert (r.xa, r.xb, r.xc) == pytest.approx((r.a, r.b, r.c))
        rates = geometry.angular_rate_matrix(r.a, r.b, r.c)
        assert (r.j00, r.j01, r.j10, r.j11, r.j20, r.j22) == pytest.approx((rates[0, 0], rates[0, 1], rates[1, 0], rates[1, 1], rates[2, 0], rates[2, 2]))


def test_rotation_vectors_and_quaternions(spark):
    df = rows(spark, ["vx", "vy", "vz", "ux", "uy", "uz", "share"])
    steps = [*rotations.rodrigues(), *rotations.rotation_vector(), *rotations.quaternion("vx", "vy", "vz"), *rotations.quaternion_matrix(), *rotations.turned("n", "ux", "uy", "uz", "h"), *rotations.compound()]
    steps += [*rotations.quaternion("ux", "uy", "uz", "p"), *rotations.slerp("p", "q"), *rotations.cayley(), *rotations.between()]
    for r in applied(df, steps).collect():
        v, u = np.array([r.vx, r.vy, r.vz]), np.array([r.ux, r.uy, r.uz])
        assert matrix(r, "m") == pytest.approx(geometry.rodrigues(v))
        assert [r.wx, r.wy, r.wz] == pytest.approx(v)
        q, p = geometry.quaternion(v), geometry.quaternion(u)
        assert [r.qw, r.qx, r.qy, r.qz] == pytest.approx(q)
        assert matrix(r, "n") == pytest.approx(geometry.rodrigues(v))
        assert [r.hx, r.hy, r.hz] == pytest.approx(geometry.rotate(q, u))
        left, right = (np.array([[r[f"{n}{i}{j}"] for j in range(4)] for i in range(4)]) for n in "lr")
        assert left @ p == pytest.approx(geometry.multiply(q, p)) and right @ p == pytest.approx(geometry.multiply(p, q))
        assert [r.sw, r.sx, r.sy, r.sz] == pytest.approx(geometry.slerp(p, q, r.share))
        assert r.geodesic == pytest.approx(geometry.geodesic(p, q))
        assert matrix(r, "y") == pytest.approx(geometry.cayley(v))
        assert matrix(r, "d") == pytest.approx(geometry.between(u, v))


def test_cameras_and_epipolar_lines(spark):
    df = rows(spark, ["fx", "fy", "ox", "oy", "skewness", "u", "v"], low=100, high=600).selectExpr("*", "1e-2 AS k1", "1e-3 AS k2", "0e0 AS x0")
    for r in applied(df, [*rotations.intrinsics(), *rotations.undistorted(25)]).collect():
        k = np.array([[r.fx, r.skewness, r.ox], [0, r.fy, r.oy], [0, 0, 1]])
        assert np.array([[r.i00, r.i01, r.i02], [0, r.i11, r.i12], [0, 0, 1]]) == pytest.approx(np.linalg.inv(k))
        assert [r.cu, r.cv] == pytest.approx((np.linalg.inv(k) @ [r.u, r.v, 1])[:2])
        if math.hypot(r.cu, r.cv) < 2:
            assert [r.nu, r.nv] == pytest.approx(geometry.to_camera(k, np.array([[r.u, r.v]]), (r.k1, r.k2), 25)[0])
    names = [f"f{i}{j}" for i in range(3) for j in range(3)]
    df = rows(spark, [*names, "x1", "y1", "x2", "y2"]).selectExpr("*", "500e0 AS fx", "510e0 AS fy", "320e0 AS ox", "240e0 AS oy")
    for r in applied(df, [*rotations.epipolar_lines(), *rotations.essential()]).collect():
        f, a, b = matrix(r, "f"), np.array([r.x1, r.y1, 1]), np.array([r.x2, r.y2, 1])
        assert [r.s0, r.s1, r.s2] == pytest.approx(f @ a) and [r.t0, r.t1, r.t2] == pytest.approx(f.T @ b)
        assert r.second_distance == pytest.approx(abs(b @ f @ a) / np.hypot(*(f @ a)[:2]))
        k = np.array([[500, 0, 320], [0, 510, 240], [0, 0, 1.0]])
        assert matrix(r, "e") == pytest.approx(geometry.essential(f, k, k))
        assert matrix(r, "b") == pytest.approx(f, abs=1e-6)


def test_nearest_and_closest_without_a_radius(spark):
    rng = np.random.default_rng(2)
    data = [(f"s{k % 3}", k, float(rng.integers(0, 10 ** (1 + k % 3))), float(rng.integers(0, 1000))) for k in range(60)] + [("alone", 100, 1.0, 2.0), ("two", 101, 0.0, 0.0), ("two", 102, 9e5, 0.0)]
    df = spark.createDataFrame(data, "set_id string, point_id long, x double, y double")
    gap = lambda p, q: ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2, q[1])
    want = {p[1]: min(gap(p, q) for q in data if q[0] == p[0] and q[1] != p[1]) for p in data if p[0] != "alone"}
    assert {r.id1: (r.d2, r.id2) for r in points.nearest(df, 3).collect()} == want
    pairs = {s: min((gap(p, q)[0], p[1], q[1]) for p in data for q in data if p[0] == q[0] == s and p[1] < q[1]) for s in ("s0", "s1", "s2", "two")}
    assert {r.set_id: (r.d2, r.id1, r.id2) for r in points.closest_pair(df, 3).collect()} == pairs
    assert points.nearest(df.where("false"), 3).count() == points.closest_pair(df.where("false"), 3).count() == 0


def test_codes_and_gram_of_whole_vectors(spark):
    vectors = RNG.normal(size=(30, 130))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, v array<double>").repartition(3)
    coded = descriptors.sign_codes(df, "v", 60)
    both = coded.selectExpr("id AS i", "code AS ci").crossJoin(coded.selectExpr("id AS j", "code AS cj")).select("i", "j", descriptors.hamming("ci", "cj").alias("d")).collect()
    assert {(r.i, r.j): r.d for r in both} == {(i, j): int(((vectors[i] > 0) != (vectors[j] > 0)).sum()) for i in range(30) for j in range(30)}
    got = {(r.i, r.j): r.g for r in descriptors.gram(df, "v").collect()}
    want = vectors.T @ vectors
    assert len(got) == 130 * 131 // 2
    assert all(g == pytest.approx(want[i - 1, j - 1]) for (i, j), g in got.items())


def test_png_files_with_every_filter(spark):
    import struct
    import zlib

    a = RNG.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    flat = np.concatenate([np.zeros((1, 18), np.uint8), a.reshape(5, 18)])
    body = b""
    for y in range(5):  # filter y of the format, written plainly
        line, above = flat[y + 1].astype(int), flat[y].astype(int)
        left, corner = np.concatenate([np.zeros(3, int), line[:-3]]), np.concatenate([np.zeros(3, int), above[:-3]])
        guess = left + above - corner
        paeth = [min(((abs(g - p), k), p) for k, p in enumerate(z))[1] for g, z in zip(guess, zip(left, above, corner, strict=True), strict=True)]
        body += bytes([y]) + bytes(((line - [0 * line, left, above, (left + above) // 2, np.array(paeth)][y]) % 256).astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(body)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")
    assert (images.decoded(data) == a).all()
    got = images.from_png(spark.createDataFrame([(7, bytearray(data))], "image_id long, png binary")).collect()
    assert {(r.x, r.y): (r.r, r.g, r.b) for r in got} == {(x, y): tuple(a[y, x].tolist()) for x in range(6) for y in range(5)}


def test_curve_files_keep_their_order(spark, tmp_path):
    (tmp_path / "c.txt").write_text("x,y\n3.5,1\n\n-2,4e1\n0,7\n")
    got = images.read_curves(spark, str(tmp_path / "c.txt")).orderBy("pos").collect()
    assert [(r.pos, r.x, r.y) for r in got] == [(0, 3.5, 1), (1, -2, 40), (2, 0, 7)]


def peak_of(f):
    """The result of f and the most megabytes that its arrays took."""
    import tracemalloc

    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def scene(n):
    """n points before two cameras, their pixels in each, and the second camera's pose."""
    world = np.random.default_rng(3).uniform(-20, 20, (n, 3))
    r, t = geometry.rotation_zyx(0.1, -0.2, 0.3), np.array([1.5, -0.5, 90.0])
    k = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]])
    return world, geometry.project(k, np.eye(3), np.array([0, 0, 80.0]), world), geometry.project(k, r, t, world), k, r, t


def test_fundamental_matrix_and_pose_of_many_points_in_little_memory():
    world, a, b, k, r, t = scene(3000)
    f, most = peak_of(lambda: geometry.fundamental_8(a, b))
    assert most < 20  # a square matrix of 3,000 rows takes 72
    assert np.sqrt(geometry.sampson(f, a, b)).max() < 1e-6
    (found, step), most = peak_of(lambda: geometry.pose_from_essential(geometry.essential(f, k, k), geometry.to_camera(k, a), geometry.to_camera(k, b)))
    want = t - r @ np.array([0, 0, 80.0])
    assert most < 20 and found == pytest.approx(r, abs=1e-6) and step == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    cameras = [geometry.camera(k, np.eye(3), np.array([0, 0, 80.0])), geometry.camera(k, r, t)]
    assert geometry.triangulate_all(cameras, [a, b]) == pytest.approx(world, abs=1e-6)
    assert np.abs(geometry.sampson(geometry.fundamental_8(a[:8], b[:8]), a[:8], b[:8])).max() < 1e-9


def test_plane_of_many_points_in_little_memory():
    xy = np.random.default_rng(4).uniform(-1, 1, (6000, 2))
    p = np.column_stack([xy, 2 - xy @ [0.5, -1.5], np.ones(6000)]) * np.arange(1, 6001)[:, None]
    plane, most = peak_of(lambda: geometry.plane_of(p))
    assert most < 20 and plane / plane[2] == pytest.approx([0.5, -1.5, 1, -2])
    assert np.abs(p[:3] @ geometry.plane_of(p[:3])).max() < 1e-9


def test_camera_of_many_points_in_little_memory():
    world, _, b, k, r, t = scene(3000)
    camera, most = peak_of(lambda: geometry.resection(world, b))
    found = geometry.decomposed(camera)
    assert most < 40 and found[0] == pytest.approx(k, abs=1e-4) and found[1] == pytest.approx(r, abs=1e-6) and found[2] == pytest.approx(t, abs=1e-4)


def test_homography_of_many_points_in_little_memory():
    p, h = np.random.default_rng(5).uniform(0, 50, (3000, 2)), np.array([[1.1, 0.2, 5], [-0.1, 0.9, 3], [1e-3, 2e-3, 1]])
    found, most = peak_of(lambda: geometry.homography(p, geometry.apply(h, p)))
    assert most < 40 and found == pytest.approx(h, abs=1e-7)
    assert geometry.homography(p[:4], geometry.apply(h, p[:4])) == pytest.approx(h, abs=1e-6)
