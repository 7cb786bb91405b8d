"""Queries of reconstruction from many views, and of regions in frames of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions.steps import as_sql
from lumenframe.operators import canonical, reconstruction
from lumenframe.plans.registry import query
from lumenframe.sources.derived import LABELS_SQL, labelled, table

# Parts as points of space (size, two numbers of the key), seen by four affine cameras, with a small error by rule of the key.
_SPACE = ["p_partkey AS point", "p_size * 1e0 AS x0", "(p_partkey * 13) % 61 * 1e0 AS x1", "(p_partkey * 29) % 47 * 1e0 AS x2"]
_CAMERAS = ((0.9, 0.1, 0.3, 5.0, -0.2, 1.1, 0.4, 2.0), (0.7, -0.5, 0.2, 1.0, 0.3, 0.8, -0.6, 9.0), (0.4, 0.6, -0.9, 7.0, 0.5, -0.3, 0.7, 3.0), (-0.1, 0.9, 0.5, 4.0, 0.8, 0.2, 0.3, 6.0))
_SEEN = ["point", "view", "m0 * x0 + m1 * x1 + m2 * x2 + m3 + ((point * 7 + view * 3) % 11 - 5) * 0.02e0 AS x", "n0 * x0 + n1 * x1 + n2 * x2 + n3 + ((point * 5 + view * 11) % 13 - 6) * 0.02e0 AS y"]
_ROWS = ", ".join(f"({k}, {', '.join(f'{v!r}e0' for v in c)})" for k, c in enumerate(_CAMERAS))
_OBSERVED_SQL = f"obs AS MATERIALIZED (SELECT {', '.join(_SEEN)} FROM (SELECT {', '.join(_SPACE)} FROM part) CROSS JOIN (VALUES {_ROWS}) c(view, m0, m1, m2, m3, n0, n1, n2, n3))"


def _planes_sql(squarings: int = 10) -> str:
    """The projection on the three leading eigenvectors of the coordinates' products: by squaring, and taking each off for the next."""
    steps = [_OBSERVED_SQL, "axes AS (SELECT view * 2 AS i, point, x AS w FROM obs UNION ALL SELECT view * 2 + 1, point, y FROM obs)", "mean AS MATERIALIZED (SELECT i, avg(w) AS t FROM axes GROUP BY i)",
             "cen AS MATERIALIZED (SELECT i, point, w - t AS w FROM axes JOIN mean USING (i))", "g0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.w * b.w) AS v FROM cen a JOIN cen b USING (point) GROUP BY a.i, b.i)"]
    for c in range(3):
        steps.append(f"p{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM g{c}) AS v FROM g{c})")
        for s in range(squarings):
            steps.append(f"r{c}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{c}_{s} a JOIN p{c}_{s} b ON a.j = b.i GROUP BY a.i, b.j)")
            steps.append(f"p{c}_{s + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM r{c}_{s}) AS v FROM r{c}_{s})")
        steps.append(f"x{c} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS x FROM p{c}_{squarings} WHERE j = (SELECT arg_max(i, v) FROM p{c}_{squarings} WHERE i = j))")
        steps.append(f"l{c} AS MATERIALIZED (SELECT sum(a.x * g.v * b.x) AS value FROM g{c} g JOIN x{c} a ON a.i = g.i JOIN x{c} b ON b.i = g.j)")
        steps.append(f"g{c + 1} AS MATERIALIZED (SELECT g.i, g.j, g.v - l.value * a.x * b.x AS v FROM g{c} g JOIN x{c} a ON a.i = g.i JOIN x{c} b ON b.i = g.j CROSS JOIN l{c} l)")
    steps.append("proj AS MATERIALIZED (SELECT a.i, b.i AS j, a.x * b.x + c.x * d.x + e.x * f.x AS v FROM x0 a CROSS JOIN x0 b JOIN x1 c ON c.i = a.i JOIN x1 d ON d.i = b.i JOIN x2 e ON e.i = a.i JOIN x2 f ON f.i = b.i)")
    steps.append("put AS MATERIALIZED (SELECT p.i, point, any_value(t) + sum(v * w) AS w FROM proj p JOIN cen ON cen.i = p.j JOIN mean ON mean.i = p.i GROUP BY p.i, point)")
    steps.append("placed AS (SELECT o.view, o.point, o.x, o.y, a.w AS px, b.w AS py FROM obs o JOIN put a ON a.i = o.view * 2 AND a.point = o.point JOIN put b ON b.i = o.view * 2 + 1 AND b.point = o.point)")
    return ", ".join(steps)


def observed(spark, sf_dir):
    cameras = spark.createDataFrame([(k, *c) for k, c in enumerate(_CAMERAS)], "view int, " + ", ".join(f"{a}{k} double" for a in "mn" for k in range(4)))
    return table(spark, sf_dir, "part").selectExpr(*_SPACE).crossJoin(F.broadcast(cameras)).selectExpr(*_SEEN)


@query("reconstruct_affine_views", f"WITH {_planes_sql()} SELECT view, count(*) AS n, round(sqrt(avg(pow(px - x, 2) + pow(py - y, 2))), 5) AS rms, round(sqrt(max(pow(px - x, 2) + pow(py - y, 2))), 5) AS worst FROM placed GROUP BY view")
def affine_views(spark, sf_dir):
    """How far the reconstruction's points lie from those seen, by view."""
    o = observed(spark, sf_dir)
    made = reconstruction.errors(reconstruction.reprojected(o, *reconstruction.affine(o)))
    return made.select("view", "n", F.round("rms", 5).alias("rms"), F.round("worst", 5).alias("worst"))


@query("reconstruct_affine_reprojections", f"WITH {_planes_sql()} SELECT view, point, round(px, 3) + 0e0 AS px, round(py, 3) + 0e0 AS py FROM placed")
def affine_reprojections(spark, sf_dir):
    o = observed(spark, sf_dir)
    return reconstruction.reprojected(o, *reconstruction.affine(o)).select("view", "point", *[F.expr(f"round({c}, 3) + 0D AS {c}") for c in ("px", "py")])


@query("reconstruct_affine_missing")
def affine_missing(spark, sf_dir):
    """The same where each view misses one point in nine."""
    o = observed(spark, sf_dir).where("(point + view) % 9 <> 0")
    return reconstruction.errors(reconstruction.reprojected(o, *reconstruction.affine(o)))


# Regions ----------------------------------------------------------------------------------------------------
_MOMENTS_SQL = "SELECT image_id, label, count(*) AS n, avg(x::DOUBLE) AS cx, avg(y::DOUBLE) AS cy, avg(x::DOUBLE * x) - avg(x::DOUBLE) * avg(x::DOUBLE) AS mxx, avg(y::DOUBLE * y) - avg(y::DOUBLE) * avg(y::DOUBLE) AS myy, avg(x::DOUBLE * y) - avg(x::DOUBLE) * avg(y::DOUBLE) AS mxy FROM lb GROUP BY image_id, label HAVING count(*) >= 6"
_FRAMES_SQL = f"lb AS MATERIALIZED ({LABELS_SQL}), frames AS MATERIALIZED ({as_sql(_MOMENTS_SQL, canonical.FRAME, 'image_id, label, n, cx, cy, theta, a, b')})"
_CELLS_SQL = f"""{_FRAMES_SQL}, spots AS MATERIALIZED ({as_sql(f"SELECT * FROM frames CROSS JOIN range({canonical.CELLS}) q(cu) CROSS JOIN range({canonical.CELLS}) r(cv)", canonical.PLACE, "image_id, label, cu, cv, sx, sy")}),
    near AS (SELECT s.*, floor(sx)::BIGINT + dx AS x, floor(sy)::BIGINT + dy AS y FROM spots s CROSS JOIN range(2) d(dx) CROSS JOIN range(2) e(dy)),
    weighed AS (SELECT *, (1 - abs(sx - x)) * (1 - abs(sy - y)) AS weight FROM near),
    cells AS MATERIALIZED (SELECT w.image_id, w.label, cu, cv, sum(weight * v) / sum(weight) AS value FROM weighed w JOIN lb ON lb.image_id = w.image_id AND lb.x = w.x AND lb.y = w.y WHERE weight > 0 GROUP BY w.image_id, w.label, cu, cv)"""
_BLOCKS_SQL = f"""{_CELLS_SQL}, grads AS (SELECT c.image_id, c.label, c.cu, c.cv, round(CASE WHEN l.value IS NOT NULL AND r.value IS NOT NULL THEN (r.value - l.value) / 2 ELSE coalesce(r.value - c.value, c.value - l.value) END, 6) AS gx,
        round(CASE WHEN u.value IS NOT NULL AND d.value IS NOT NULL THEN (d.value - u.value) / 2 ELSE coalesce(d.value - c.value, c.value - u.value) END, 6) AS gy
        FROM cells c LEFT JOIN cells l ON l.image_id = c.image_id AND l.label = c.label AND l.cv = c.cv AND l.cu = c.cu - 1 LEFT JOIN cells r ON r.image_id = c.image_id AND r.label = c.label AND r.cv = c.cv AND r.cu = c.cu + 1
        LEFT JOIN cells u ON u.image_id = c.image_id AND u.label = c.label AND u.cu = c.cu AND u.cv = c.cv - 1 LEFT JOIN cells d ON d.image_id = c.image_id AND d.label = c.label AND d.cu = c.cu AND d.cv = c.cv + 1),
    turned AS (SELECT *, atan2(gy, gx) + 1e-9 AS t FROM grads WHERE gx IS NOT NULL AND gy IS NOT NULL AND (gx <> 0 OR gy <> 0)),
    binned AS (SELECT image_id, label, ((cv // {canonical.BLOCK}) * {canonical.CELLS // canonical.BLOCK} + cu // {canonical.BLOCK})::INTEGER AS block, least(floor((t - floor(t / pi()) * pi()) / pi() * {canonical.BINS}), {canonical.BINS - 1})::INTEGER AS bin, sum(sqrt(gx * gx + gy * gy)) AS size FROM turned GROUP BY ALL)"""


@query("region_frames", f"WITH {_FRAMES_SQL} SELECT image_id, label, n, round(cx, 5) AS cx, round(cy, 5) AS cy, round(theta, 5) + 0e0 AS theta, round(a, 5) AS a, round(b, 5) AS b FROM frames")
def region_frames(spark, sf_dir):
    """Ellipses of the labelled regions."""
    made = canonical.frames(labelled(spark, sf_dir))
    return made.select("image_id", "label", "n", *[F.expr(f"round({c}, 5) + 0D AS {c}") for c in ("cx", "cy", "theta", "a", "b")])


@query("region_canonical", f"WITH {_CELLS_SQL} SELECT image_id, label, cu::INTEGER AS cu, cv::INTEGER AS cv, round(value, 4) AS value FROM cells")
def region_canonical(spark, sf_dir):
    """Grey values of the regions' frames, as 8 x 8 cells."""
    l = labelled(spark, sf_dir)  # noqa: E741
    return canonical.resampled(canonical.frames(l), l).withColumn("value", F.round("value", 4))


@query("region_block_histograms", f"WITH {_BLOCKS_SQL} SELECT image_id, label, block, bin, round(size / sqrt(sum(size * size) OVER (PARTITION BY image_id, label, block)), 4) AS share FROM binned")
def region_blocks(spark, sf_dir):
    """Histograms of gradients of four blocks of each frame."""
    l = labelled(spark, sf_dir)  # noqa: E741
    return canonical.block_histograms(canonical.resampled(canonical.frames(l), l)).withColumn("share", F.round("share", 4))
