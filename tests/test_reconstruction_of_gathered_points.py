"""Affine reconstruction in passes over points: odd observations, and how often tables are gathered."""

import random

import numpy as np
import pytest

from lumenframe.operators import reconstruction

COLUMNS = "view int, point long, x double, y double"


def scene(views=5, points=60, seed=7):
    draw = np.random.default_rng(seed)
    space, cameras = draw.normal(0, 9, (points, 3)), draw.normal(0, 1, (views, 2, 4))
    return [(v * 3 + 1, p, *map(float, cameras[v, :, :3] @ space[p] + cameras[v, :, 3] * 1000)) for v in range(views) for p in range(points)]


def worst(placed):
    return max(max(abs(r.px - r.x), abs(r.py - r.y)) for r in placed.where("x IS NOT NULL AND y IS NOT NULL").collect())


def plain_worst(rows, rounds=30, within=1e-9):
    """The same by loops over observations."""
    rows = [(v, p, a, w) for v, p, *xy in rows if v is not None and p is not None for a, w in enumerate(xy) if w is not None and w == w]
    views, points = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    whole = [p for p in points if len({(v, a) for v, q, a, _ in rows if q == p}) == 2 * len(views)]
    keys = [(v, a) for v in views for a in (0, 1)]
    mean = {k: np.mean([w for v, p, a, w in rows if (v, a) == k and p in whole]) for k in keys}
    g = np.array([[sum(w - mean[k] for v, q, a, w in rows if (v, a) == k and q == p) for p in whole] for k in keys])
    lead = np.linalg.svd(g)[0][:, :3]
    motion, last = {k: np.append(lead[i], mean[k]) for i, k in enumerate(keys)}, None
    for _ in range(rounds):
        place = {}
        for p in points:
            own = [(motion[v, a], w) for v, q, a, w in rows if q == p]
            place[p] = np.append(np.linalg.lstsq(np.array([m[:3] for m, _ in own]), np.array([w - m[3] for m, w in own]), rcond=1e-6)[0], 1)
        motion = {k: np.linalg.lstsq(np.array([place[p] for v, p, a, _ in rows if (v, a) == k]), np.array([w for v, _, a, w in rows if (v, a) == k]), rcond=1e-6)[0] for k in keys}
        errors = [motion[v, a] @ place[p] - w for v, p, a, w in rows]
        now = sum(e * e for e in errors)
        if last is not None and last - now <= within * last:
            break
        last = now
    return max(map(abs, errors))


def test_missing_null_and_repeated_observations(spark):
    rows = scene()
    random.Random(2).shuffle(rows)
    kept = [r for r in rows if (r[0] + r[1]) % 7]  # most points are missing from a view
    kept += kept[:20] + [(1, None, 5.0, 5.0), (None, 3, 5.0, 5.0), (4, 900, 1.0, 2.0)]
    kept = [(v, p, None if k == 9 else x, float("nan") if k == 17 else y) for k, (v, p, x, y) in enumerate(kept)]
    seen = spark.createDataFrame(kept, COLUMNS).repartition(3)
    motion, points = reconstruction.affine(seen)
    assert motion.count() == 10 and points.count() == 61
    assert worst(reconstruction.reprojected(seen, motion, points).where("NOT isnan(x) AND NOT isnan(y)")) == pytest.approx(plain_worst(kept), rel=1e-5)


def test_no_point_in_all_views_and_no_points(spark):
    for rows in ([(v, v * 10 + k, 1.0 * k, 2.0) for v in range(3) for k in range(4)], []):
        seen = spark.createDataFrame(rows, COLUMNS)
        motion, points = reconstruction.affine(seen)
        assert motion.count() == 0 and points.count() == 0 and reconstruction.reprojected(seen, motion, points).count() == 0


def test_observations_are_gathered_once(spark, monkeypatch):
    """However many rounds there are, no round writes tables or shuffles observations."""
    made, cut = [], reconstruction.cut_lineage
    monkeypatch.setattr(reconstruction, "cut_lineage", lambda df: made.append(1) or cut(df))
    draw = np.random.default_rng(4)
    rows = [(v, p, x + draw.normal(0, 0.1), y) for v, p, x, y in scene() if (v + p) % 5]
    rows += [(v, 1000 + p, x, y) for v, p, x, y in scene()]
    motion, points = reconstruction.affine(spark.createDataFrame(rows, COLUMNS))
    assert points.count() == 120 and len(made) == 1
    assert "Exchange" not in points._jdf.queryExecution().executedPlan().toString()
