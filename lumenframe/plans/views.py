"""Queries of rotations, cameras and views of points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenframe.functions import geometry, rotations
from lumenframe.functions.steps import Steps
from lumenframe.plans.registry import query
from lumenframe.plans.structures import ANGLES, scalar
from lumenframe.sources.derived import POINTS_SQL
from lumenframe.sources.derived import points as point_table

VECTOR: Steps = [("vx", "(i % 30) * 5e-2 + 1e-1"), ("vy", "(s % 20) * 4e-2 + 5e-2"), ("vz", "(i % 13) * 5e-2 - 3e-1")]
OTHER: Steps = [("ux", "(i % 11) * 1e-1 + 2e-1"), ("uy", "(s % 9) * 1e-1 - 3e-1"), ("uz", "(i % 5) * 2e-1 + 1e-1")]
_NINE = [f"{i}{j}" for i in range(3) for j in range(3)]
_names = lambda letter, which=_NINE: [f"{letter}{k}" for k in which]

scalar("rotation_elementary", [*ANGLES, *rotations.elementary()], [n for n, _ in rotations.elementary()])
scalar("rotation_xyz_roundtrip", [*ANGLES, *rotations.xyz()], [*_names("m"), "xa", "xb", "xc"])
scalar("rotation_rodrigues", [*VECTOR, *rotations.rodrigues(), *rotations.rotation_vector()], [*_names("m"), "wx", "wy", "wz"])
scalar("rotation_quaternion", [*VECTOR, *rotations.quaternion("vx", "vy", "vz"), *rotations.quaternion_matrix(), *rotations.turned("n", "ar", "ai", "br", "h")], ["qw", "qx", "qy", "qz", *_names("n"), "hx", "hy", "hz"])
scalar("rotation_compound", [*VECTOR, *rotations.quaternion("vx", "vy", "vz"), *rotations.compound()], [n for n, _ in rotations.compound()])
scalar("rotation_slerp", [*VECTOR, *OTHER, ("share", "(i % 10) * 1e-1"), *rotations.quaternion("vx", "vy", "vz", "p"), *rotations.quaternion("ux", "uy", "uz"), *rotations.slerp()], ["sw", "sx", "sy", "sz", "geodesic"])
scalar("rotation_cayley", [*VECTOR, *rotations.cayley()], _names("y"))
scalar("rotation_angular_rates", [*ANGLES, *rotations.angular_rates()], [n for n, _ in rotations.angular_rates()])
scalar("rotation_between_directions", [*VECTOR, *OTHER, *rotations.between()], _names("d"))
_LENS: Steps = [("fx", "500e0"), ("fy", "510e0"), ("ox", "320e0"), ("oy", "240e0")]
LENS: Steps = [*_LENS, ("skewness", "2e0"), ("k1", "1e-2"), ("k2", "1e-3"), ("u", "(i % 640) * 1e0"), ("v", "(s % 480) * 1e0 + 50")]
scalar("camera_pixel_to_normalized", [*LENS, *rotations.intrinsics(), *rotations.undistorted()], ["i00", "i01", "i02", "i11", "i12", "cu", "cv", "nu", "nv"])
scalar("camera_to_world", [*ANGLES, *rotations.xyz(), *[(f"c{i}{j}", f"m{j}{i}") for i in range(3) for j in range(3)], *rotations.turned("c", "ar - 1e-1", "ai - 2e-1", "br - 30e0", "world_")], ["world_x", "world_y", "world_z"])
FUNDAMENTAL: Steps = [(f"f{k // 3}{k % 3}", f"({v!r}e0)") for k, v in enumerate((0.0, -0.4, 1.2, 0.5, 0.0, -2.0, -1.0, 1.8, 0.3))]
scalar("epipolar_lines", [*FUNDAMENTAL, ("x1", "ar"), ("y1", "ai"), ("x2", "br"), ("y2", "bi"), *rotations.epipolar_lines()], ["s0", "s1", "s2", "t0", "t1", "t2", "second_distance", "first_distance"])
scalar("epipolar_essential", [*_LENS, *[(n, f"{e} + (i % 7) * 1e-2") for n, e in FUNDAMENTAL], *rotations.essential()], [*_names("e"), *_names("b")], places=4)


# Views of the sets' points by known cameras: what is found from the pixels must be what they were made with, so the SQL
# states the known figures. Sets of fewer than LEAST points are left out.
LEAST = 12
K = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]])
TURN, SHIFT = (0.1, -0.2, 0.3), (1.5, -0.5, 90.0)
VIEWS = [((0.0, 0.0, 0.0), (0.0, 0.0, 80.0)), (TURN, SHIFT), ((-0.2, 0.15, 0.1), (2.0, 1.0, 95.0)), ((0.25, 0.2, -0.2), (-3.0, 2.0, 85.0))]
H = np.array([[1.1, 0.2, 5], [-0.1, 0.9, 3], [1e-3, 2e-3, 1]])
_SETS = f"SELECT set_id FROM ({POINTS_SQL}) GROUP BY set_id HAVING count(*) >= {LEAST}"


def world(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([pdf["x"] - 25.0, pdf["y"] - 30.0, pdf["point_id"] % 17 - 8.0])


def seen(points: np.ndarray, view: int) -> np.ndarray:
    angles, shift = VIEWS[view]
    return geometry.project(K, geometry.rotation_zyx(*angles), np.array(shift), points)


def _view(name: str, f: Callable[[pd.DataFrame], dict[str, float]], known: dict[str, float], places: int) -> None:
    """Figures of each set found by f, against the known ones."""
    shown = ", ".join(f"round({v!r}::DOUBLE, {places}) + 0e0 AS {k}" for k, v in known.items())

    @query(name, f"SELECT set_id, {shown} FROM ({_SETS})")
    def run(spark, sf_dir):
        def each(pdf: pd.DataFrame) -> pd.DataFrame:
            got = f(pdf.sort_values("point_id"))
            return pd.DataFrame({"set_id": [pdf["set_id"].iloc[0]], **{k: [float(got[k])] for k in known}})

        schema = "set_id string, " + ", ".join(f"{k} double" for k in known)
        p = point_table(spark, sf_dir)
        large = p.groupBy("set_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("set_id")
        return p.join(large, "set_id", "left_semi").groupBy("set_id").applyInPandas(each, schema).selectExpr("set_id", *[f"round({k}, {places}) + 0e0 AS {k}" for k in known])


def _entries(letter: str, m: np.ndarray) -> dict[str, float]:
    return {f"{letter}{i}{j}": float(m[i, j]) for i, j in np.ndindex(*m.shape)}


def _lens(k: np.ndarray) -> dict[str, float]:
    return {"fx": float(k[0, 0]), "fy": float(k[1, 1]), "ox": float(k[0, 2]), "oy": float(k[1, 2])}


def _pose(r: np.ndarray, t: np.ndarray) -> dict[str, float]:
    return dict(zip(("a", "b", "c", "tx", "ty", "tz"), (*map(float, geometry.angles_zyx(r)), *map(float, t)), strict=True))


def plane_homography(view: int) -> np.ndarray:
    """Of the plane z = 0, from a grid of its points."""
    grid = np.array([(x, y) for x in range(-20, 21, 8) for y in range(-24, 25, 8)], float)
    return geometry.homography(grid, seen(np.column_stack([grid, np.zeros(len(grid))]), view))


def _homography(pdf: pd.DataFrame) -> dict[str, float]:
    p = pdf[["x", "y"]].to_numpy(float)
    return _entries("h", geometry.homography(p, geometry.apply(H, p)))


def _resection(pdf: pd.DataFrame) -> dict[str, float]:
    w = world(pdf)
    k, r, t = geometry.decomposed(geometry.resection(w, seen(w, 1)))
    return _lens(k) | _pose(r, t)


def _plane_points(pdf: pd.DataFrame, view: int) -> np.ndarray:
    p = world(pdf)[:, :2]
    return geometry.homography(p, seen(np.column_stack([p, np.zeros(len(p))]), view))


def _calibration(pdf: pd.DataFrame) -> dict[str, float]:
    return _lens(geometry.planar_calibration([_plane_points(pdf, v) for v in range(len(VIEWS))]))


def _planar_pose(pdf: pd.DataFrame) -> dict[str, float]:
    return _pose(*geometry.planar_pose(K, _plane_points(pdf, 1)))


#: The pose of the second view relative to the first, with a shift of length 1.
_RELATIVE = geometry.rotation_zyx(*VIEWS[1][0]) @ geometry.rotation_zyx(*VIEWS[0][0]).T
_STEP = np.array(VIEWS[1][1]) - _RELATIVE @ np.array(VIEWS[0][1])
_STEP = _STEP / np.linalg.norm(_STEP)
_F = np.linalg.inv(K).T @ geometry.skew(_STEP) @ _RELATIVE @ np.linalg.inv(K)


def _signed(m: np.ndarray) -> np.ndarray:
    """Of unit norm, the largest entry positive."""
    m = m / np.linalg.norm(m)
    return m * np.sign(m.reshape(-1)[np.abs(m).argmax()])


def _fundamental(pdf: pd.DataFrame) -> dict[str, float]:
    w = world(pdf)
    f = geometry.fundamental_8(seen(w, 0), seen(w, 1))
    e1, e2 = (e / e[2] for e in geometry.epipoles(f))
    return {"gap": np.abs(_signed(f) - _signed(_F)).max(), "det": np.linalg.det(f), "e1x": e1[0], "e1y": e1[1], "e2x": e2[0], "e2y": e2[1]}


def _of_seven(pdf: pd.DataFrame) -> dict[str, float]:
    w = world(pdf)
    a, b = seen(w, 0), seen(w, 1)
    return {"gap": min(np.abs(_signed(f) - _signed(_F)).max() for f in geometry.fundamental_7(a[:7], b[:7]))}


def _essential_pose(pdf: pd.DataFrame) -> dict[str, float]:
    w = world(pdf)
    a, b = seen(w, 0), seen(w, 1)
    e = geometry.essential(geometry.fundamental_8(a, b), K, K)
    return _pose(*geometry.pose_from_essential(e, geometry.to_camera(K, a), geometry.to_camera(K, b)))


def _rectified(pdf: pd.DataFrame) -> dict[str, float]:
    """The epipoles after rectification, of length 1: along x."""
    w = world(pdf)
    f = geometry.fundamental_8(seen(w, 0), seen(w, 1))
    h1, h2 = geometry.rectify(f, 480, 640)
    e1, e2 = (h @ e / np.linalg.norm(h @ e) for h, e in zip((h1, h2), geometry.epipoles(f), strict=True))
    return {"x1": abs(e1[0]), "y1": abs(e1[1]), "z1": abs(e1[2]), "x2": abs(e2[0]), "y2": abs(e2[1]), "z2": abs(e2[2])}


def _canonical_cameras(pdf: pd.DataFrame) -> dict[str, float]:
    """F again from the camera pair made of F."""
    w = world(pdf)
    f = geometry.fundamental_8(seen(w, 0), seen(w, 1))
    p = geometry.cameras_of_fundamental(f)
    again = np.cross(np.eye(3), p[:, 3]).T @ p[:, :3]
    return {"gap": np.abs(_signed(again) - _signed(f)).max(), "epipole": np.abs(p[:, 3] @ f).max()}


_PLANE = np.array([0.3, -0.5, 0.8, -2.0])


def _plane(pdf: pd.DataFrame) -> dict[str, float]:
    """The plane of the points lifted into it, in homogeneous coordinates of any scale."""
    xy = pdf[["x", "y"]].to_numpy(float) / 30
    z = -(xy @ _PLANE[:2] + _PLANE[3]) / _PLANE[2]
    scale = (pdf["point_id"] % 5 + 1).to_numpy(float)[:, None]
    p = geometry.plane_of(np.column_stack([xy, z, np.ones(len(xy))]) * scale)
    return dict(zip("abcd", map(float, p * np.sign(p[2])), strict=True))


_view("view_homography", _homography, _entries("h", H), 5)
_view("view_resection", _resection, _lens(K) | _pose(geometry.rotation_zyx(*TURN), np.array(SHIFT)), 3)
_view("view_planar_calibration", _calibration, _lens(K), 2)
_view("view_planar_pose", _planar_pose, _pose(geometry.rotation_zyx(*TURN), np.array(SHIFT)), 4)
_EPIPOLES = [e / e[2] for e in (K @ _RELATIVE.T @ -_STEP, K @ _STEP)]
_view("view_fundamental_8", _fundamental, {"gap": 0.0, "det": 0.0, "e1x": _EPIPOLES[0][0].item(), "e1y": _EPIPOLES[0][1].item(), "e2x": _EPIPOLES[1][0].item(), "e2y": _EPIPOLES[1][1].item()}, 2)
_view("view_fundamental_7", _of_seven, {"gap": 0.0}, 4)
_view("view_canonical_cameras", _canonical_cameras, {"gap": 0.0, "epipole": 0.0}, 4)
_view("view_plane", _plane, dict(zip("abcd", (float(v) for v in _PLANE / np.linalg.norm(_PLANE)), strict=True)), 5)
_view("view_essential_pose", _essential_pose, _pose(_RELATIVE, _STEP), 4)
_view("view_rectification", _rectified, {"x1": 1.0, "y1": 0.0, "z1": 0.0, "x2": 1.0, "y2": 0.0, "z2": 0.0}, 4)


@query("view_triangulation", f"SELECT set_id, point_id, x - 25e0 AS wx, y - 30e0 AS wy, point_id % 17 - 8e0 AS wz FROM ({POINTS_SQL})")
def triangulation(spark, sf_dir):
    """World points from their pixels in three views."""

    def run(batches):
        for pdf in batches:
            w = world(pdf)
            cameras = [geometry.camera(K, geometry.rotation_zyx(*a), np.array(t)) for a, t in VIEWS[:3]]
            views = [seen(w, v) for v in range(3)]
            found = np.array([geometry.triangulate(cameras, [v[k] for v in views]) for k in range(len(w))]).reshape(-1, 3)
            yield pdf[["set_id", "point_id"]].assign(wx=found[:, 0], wy=found[:, 1], wz=found[:, 2])

    found = point_table(spark, sf_dir).mapInPandas(run, "set_id string, point_id long, wx double, wy double, wz double")
    return found.select("set_id", "point_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("wx", "wy", "wz")])


@query("epipolar_normalization", f"WITH m AS (SELECT set_id, avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM ({POINTS_SQL}) GROUP BY set_id) SELECT set_id, point_id, round((x - mx) / sx, 5) + 0e0 AS nx, round((y - my) / sy, 5) + 0e0 AS ny, round(1 / sx, 6) AS t00, round(-mx / sx, 5) AS t02, round(1 / sy, 6) AS t11, round(-my / sy, 5) AS t12 FROM ({POINTS_SQL}) JOIN m USING (set_id)")
def normalization(spark, sf_dir):
    """Points with mean 0 and deviation 1 in each set, and the entries of the transformation: figures by aggregation, then a join."""
    p = point_table(spark, sf_dir)
    m = p.groupBy("set_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    return p.join(m, "set_id").selectExpr("set_id", "point_id", "round((x - mx) / sx, 5) + 0e0 AS nx", "round((y - my) / sy, 5) + 0e0 AS ny", "round(1 / sx, 6) AS t00", "round(-mx / sx, 5) AS t02", "round(1 / sy, 6) AS t11", "round(-my / sy, 5) AS t12")
