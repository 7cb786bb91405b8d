"""Queries of filters, curves and point sets."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions.steps import applied, num
from lumenframe.operators import filters, points, series
from lumenframe.plans.registry import query
from lumenframe.sources.derived import CURVES_SQL, PIXELS_SQL, POINTS_SQL, curves, pixels
from lumenframe.sources.derived import points as point_table

PX, CV, PT = f"px AS ({PIXELS_SQL})", f"cv AS ({CURVES_SQL})", f"pt AS ({POINTS_SQL})"


def _reflect(at: str, n: str) -> str:
    return f"(CASE WHEN (({at}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({at}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({at}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END)"


def _conv_sql(src: str, kernel: list[float], by: str, order: str, value: str, name: str, keep: str, closed: bool = False, offset: int = 1) -> str:
    """A kernel join: the value at the reflected (or wrapped) place of each tap, summed."""
    half = len(kernel) // 2
    taps = ", ".join(f"({(i - half) * offset}, {num(w)})" for i, w in enumerate(kernel))
    at = f"p.{order} + k.d"
    place = f"((({at}) % n.n + n.n) % n.n)" if closed else _reflect(at, "n.n")
    match = " AND ".join(f"q.{c} = p.{c}" for c in by.split(", "))
    count = " AND ".join(f"n.{c} = p.{c}" for c in by.split(", "))
    kept = ", ".join(f"p.{c}" for c in keep.split(", "))
    return f"(SELECT {kept}, sum(k.w * q.{value}) AS {name} FROM {src} p JOIN (SELECT {by}, count(*) AS n FROM {src} GROUP BY {by}) n ON {count} CROSS JOIN (VALUES {taps}) k(d, w) JOIN {src} q ON {match} AND q.{order} = {place} GROUP BY {kept})"


def _separable_sql(src: str, kx: list[float], ky: list[float], name: str = "o", offset: int = 1, value: str = "v") -> str:
    rows = _conv_sql(src, kx, "image_id, y", "x", value, "v", "image_id, x, y", offset=offset)
    return _conv_sql(rows, ky, "image_id, x", "y", "v", name, "image_id, x, y", offset=offset)


def _image_filter(name: str, kx: list[float], ky: list[float], offset: int = 1) -> None:
    @query(name, f"WITH {PX} SELECT image_id, x, y, round(o, 5) + 0e0 AS o FROM {_separable_sql('px', kx, ky, offset=offset)}")
    def run(spark, sf_dir):
        return filters.separable(pixels(spark, sf_dir).select("image_id", "x", "y", "v"), kx, ky, name="o", offset=offset).selectExpr("image_id", "x", "y", "round(o, 5) + 0e0 AS o")


_image_filter("filter_gaussian_blur", filters.gaussian(1.0), filters.gaussian(1.0))
_image_filter("filter_gaussian_dx", filters.gaussian(0.7, 1), filters.gaussian(0.7))
_image_filter("filter_gaussian_dyy", filters.gaussian(0.7), filters.gaussian(0.7, 2))
_image_filter("filter_binomial_blur", filters.binomial(4), filters.binomial(4))
_image_filter("filter_sobel_x", filters.SOBEL_DIFF, filters.SOBEL_SMOOTH)
_image_filter("filter_sobel_y", filters.SOBEL_SMOOTH, filters.SOBEL_DIFF)
_image_filter("filter_b3_spline", filters.B3_SPLINE, filters.B3_SPLINE)
_image_filter("filter_triangle_level2", filters.TRIANGLE, filters.TRIANGLE, offset=2)
_image_filter("texture_e5e5", [v / 6 for v in filters.LAWS["E5"]], [v / 6 for v in filters.LAWS["E5"]])
_image_filter("texture_s5s5", [v / 4 for v in filters.LAWS["S5"]], [v / 4 for v in filters.LAWS["S5"]])
_image_filter("texture_r5r5", [v / 16 for v in filters.LAWS["R5"]], [v / 16 for v in filters.LAWS["R5"]])
_image_filter("texture_l5e5", [v / 16 for v in filters.LAWS["L5"]], [v / 6 for v in filters.LAWS["E5"]])

_GRAD_SQL = "SELECT image_id, x, y, v, CASE WHEN lf IS NULL AND rt IS NULL THEN 0 WHEN lf IS NULL THEN rt - v WHEN rt IS NULL THEN v - lf ELSE (rt - lf) / 2.0 END::DOUBLE AS gx, CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2.0 END::DOUBLE AS gy FROM (SELECT *, lag(v) OVER a AS lf, lead(v) OVER a AS rt, lag(v) OVER b AS u, lead(v) OVER b AS d FROM px WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y))"
_ANGLES = filters.angles()


@query("gradient_central", f"WITH {PX} {_GRAD_SQL}".replace("x, y, v, CASE", "x, y, CASE", 1))
def central(spark, sf_dir):
    return filters.central_gradients(pixels(spark, sf_dir)).select("image_id", "x", "y", "gx", "gy")


@query("gradient_angles", f"WITH {PX}, g AS ({_GRAD_SQL}) SELECT image_id, x, y, " + ", ".join(f"round({e}, 5) AS {n}" for n, e in _ANGLES) + " FROM g")
def gradient_angles(spark, sf_dir):
    return applied(filters.central_gradients(pixels(spark, sf_dir)), _ANGLES).selectExpr("image_id", "x", "y", *[f"round({n}, 5) AS {n}" for n, _ in _ANGLES])


@query("gradient_laplacian", f"WITH {PX} SELECT p.image_id, p.x, p.y, (sum(q.v) - 4 * any_value(p.v))::BIGINT AS lap FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY p.image_id, p.x, p.y HAVING count(*) = 4")
def laplacian(spark, sf_dir):
    from lumenframe.operators.raster import neighbours

    return neighbours(pixels(spark, sf_dir).select("image_id", "x", "y", "v")).where("n IS NOT NULL AND s IS NOT NULL AND w IS NOT NULL AND e IS NOT NULL").selectExpr("image_id", "x", "y", "CAST(n + s + w + e - 4 * v AS BIGINT) AS lap")


def _structure(spark, sf_dir):
    g = filters.central_gradients(pixels(spark, sf_dir)).selectExpr("image_id", "x", "y", "gx * gx AS xx", "gx * gy AS xy", "gy * gy AS yy")
    k = filters.binomial(2)
    for c in ("xx", "xy", "yy"):
        g = filters.separable(g, k, k, c, f"s{c}")
    return g


_K2 = filters.binomial(2)
_STRUCT_SQL = f"WITH {PX}, g AS ({_GRAD_SQL}), t AS (SELECT image_id, x, y, gx * gx AS xx, gx * gy AS xy, gy * gy AS yy FROM g), a AS (SELECT * FROM {_separable_sql('t', _K2, _K2, 'sxx', value='xx')}), b AS (SELECT * FROM {_separable_sql('t', _K2, _K2, 'sxy', value='xy')}), c AS (SELECT * FROM {_separable_sql('t', _K2, _K2, 'syy', value='yy')}), s AS (SELECT * FROM a JOIN b USING (image_id, x, y) JOIN c USING (image_id, x, y))"
_HARRIS = "sxx * syy - sxy * sxy - 0.04e0 * (sxx + syy) * (sxx + syy)"
_SHI = "((sxx + syy) - sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)) / 2"


@query("structure_tensor", f"{_STRUCT_SQL} SELECT image_id, x, y, round(sxx * syy - sxy * sxy, 4) AS det, round(sxx + syy, 4) AS trace FROM s")
def structure(spark, sf_dir):
    return _structure(spark, sf_dir).selectExpr("image_id", "x", "y", "round(sxx * syy - sxy * sxy, 4) AS det", "round(sxx + syy, 4) AS trace")


@query("corner_harris", f"{_STRUCT_SQL} SELECT image_id, x, y, round({_HARRIS}, 3) AS harris FROM s")
def harris(spark, sf_dir):
    return _structure(spark, sf_dir).selectExpr("image_id", "x", "y", f"round({_HARRIS}, 3) AS harris")


@query("corner_shi_tomasi", f"{_STRUCT_SQL} SELECT image_id, x, y, round({_SHI}, 4) AS small FROM s")
def shi_tomasi(spark, sf_dir):
    return _structure(spark, sf_dir).selectExpr("image_id", "x", "y", f"round({_SHI}, 4) AS small")


_T = filters.TRIANGLE


@query("wavelet_a_trous", f"WITH {PX}, c1 AS (SELECT * FROM {_separable_sql('px', _T, _T, 'v')}), c2 AS (SELECT * FROM {_separable_sql('c1', _T, _T, 'v', offset=2)}) SELECT px.image_id, px.x, px.y, round(px.v - c1.v, 5) AS w_1, round(c1.v - c2.v, 5) AS w_2, round(c2.v, 5) AS c_2, round((px.v - c1.v) + (c1.v - c2.v) + c2.v, 5) AS rebuilt FROM px JOIN c1 USING (image_id, x, y) JOIN c2 USING (image_id, x, y)")
def a_trous(spark, sf_dir):
    w = filters.a_trous(pixels(spark, sf_dir).select("image_id", "x", "y", "v"), 2)
    return w.selectExpr("image_id", "x", "y", "round(w_1, 5) AS w_1", "round(w_2, 5) AS w_2", "round(c_2, 5) AS c_2", "round(w_1 + w_2 + c_2, 5) AS rebuilt")


@query("curve_convolve_open", f"WITH {CV} SELECT curve_id, pos, round(o, 6) AS o FROM {_conv_sql('cv', filters.gaussian(1.5), 'curve_id', 'pos', 'v', 'o', 'curve_id, pos')}")
def convolve_open(spark, sf_dir):
    return filters.convolve(curves(spark, sf_dir), filters.gaussian(1.5), ["curve_id"], "pos", "v", "o").selectExpr("curve_id", "pos", "round(o, 6) AS o")


@query("curve_convolve_closed", f"WITH {CV} SELECT curve_id, pos, round(o, 6) AS o FROM {_conv_sql('cv', filters.gaussian(1.5), 'curve_id', 'pos', 'v', 'o', 'curve_id, pos', True)}")
def convolve_closed(spark, sf_dir):
    return filters.convolve(curves(spark, sf_dir), filters.gaussian(1.5), ["curve_id"], "pos", "v", "o", True).selectExpr("curve_id", "pos", "round(o, 6) AS o")


_G1, _G2 = [-w for w in filters.gaussian(2.0, 1)], filters.gaussian(2.0, 2)
_XY_SQL = f"xy AS (SELECT curve_id, pos, pos * 1.0::DOUBLE AS x, v AS y FROM ({CURVES_SQL}))"


@query("curve_curvature", f"WITH {_XY_SQL}, d AS (SELECT * FROM {_conv_sql('xy', _G1, 'curve_id', 'pos', 'x', 'x1', 'curve_id, pos')} JOIN {_conv_sql('xy', _G1, 'curve_id', 'pos', 'y', 'y1', 'curve_id, pos')} USING (curve_id, pos) JOIN {_conv_sql('xy', _G2, 'curve_id', 'pos', 'x', 'x2', 'curve_id, pos')} USING (curve_id, pos) JOIN {_conv_sql('xy', _G2, 'curve_id', 'pos', 'y', 'y2', 'curve_id, pos')} USING (curve_id, pos)) SELECT curve_id, pos, round(coalesce((x1 * y2 - y1 * x2) / nullif(pow(x1 * x1 + y1 * y1, 1.5), 0), 0), 5) + 0e0 AS k FROM d")
def curvature(spark, sf_dir):
    xy = curves(spark, sf_dir).selectExpr("curve_id", "pos", "pos * 1D AS x", "v AS y")
    return filters.curvature(xy, 2.0).selectExpr("curve_id", "pos", "round(k, 5) + 0e0 AS k")


@query("series_boxcar", f"WITH {CV} SELECT curve_id, pos, round(avg(v) OVER w, 6) AS boxcar, CAST(floor(avg(v) OVER w + 0.5) AS BIGINT) AS boxcar_rounded FROM cv WINDOW w AS (PARTITION BY curve_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def boxcar(spark, sf_dir):
    return series.boxcar(curves(spark, sf_dir), 5).selectExpr("curve_id", "pos", "round(boxcar, 6) AS boxcar", "boxcar_rounded")


@query("series_bin_average", f"WITH {CV} SELECT curve_id, pos // 7 AS bin, round(sum(v) / 7, 6) AS mean, count(*) AS n FROM cv GROUP BY ALL")
def bin_average(spark, sf_dir):
    return series.bin_average(curves(spark, sf_dir), 7).selectExpr("curve_id", "bin", "round(mean, 6) AS mean", "n")


@query("series_running_median", f"WITH {CV}, w AS (SELECT curve_id, pos, list_sort(list(v) OVER w) AS l, avg(pos) OVER w AS center FROM cv WINDOW w AS (PARTITION BY curve_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT curve_id, pos, l[4] AS median, center FROM w WHERE len(l) = 7")
def running_median(spark, sf_dir):
    return series.running_median(curves(spark, sf_dir), 7).select("curve_id", "pos", "median", "center")


@query("series_extrema", f"WITH {CV}, w AS (SELECT *, lag(v) OVER a AS p, lead(v) OVER a AS q FROM cv WINDOW a AS (PARTITION BY curve_id ORDER BY pos)) SELECT curve_id, pos, v, CASE WHEN v > p AND v > q THEN 'max' ELSE 'min' END AS kind FROM w WHERE (v > p AND v > q) OR (v < p AND v < q)")
def extrema(spark, sf_dir):
    return series.extrema(curves(spark, sf_dir))


@query("series_zero_crossings", f"WITH {CV}, c AS (SELECT curve_id, pos, v - 50 AS u FROM cv), w AS (SELECT *, lag(u) OVER (PARTITION BY curve_id ORDER BY pos) AS p FROM c) SELECT curve_id, pos, u FROM w WHERE sign(p) * sign(u) < 0")
def crossings(spark, sf_dir):
    return series.zero_crossings(curves(spark, sf_dir).selectExpr("curve_id", "pos", "v - 50 AS u"), "u")


@query("series_summary", f"WITH {CV} SELECT curve_id, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS vmin, max(v) AS vmax FROM cv GROUP BY curve_id")
def summary(spark, sf_dir):
    return series.summary(curves(spark, sf_dir)).selectExpr("curve_id", "n", "round(mean, 6) AS mean", "round(sd, 6) AS sd", "vmin", "vmax")


@query("series_argmin_argmax", f"WITH {CV} SELECT curve_id, (SELECT pos FROM cv q WHERE q.curve_id = cv.curve_id ORDER BY v, pos LIMIT 1) AS argmin, (SELECT pos FROM cv q WHERE q.curve_id = cv.curve_id ORDER BY v DESC, pos LIMIT 1) AS argmax FROM cv GROUP BY curve_id")
def argminmax(spark, sf_dir):
    return series.argmin_argmax(curves(spark, sf_dir))


@query("series_circular_mean", f"WITH {CV}, c AS (SELECT curve_id, avg(sin(radians(v))) AS s, avg(cos(radians(v))) AS c FROM cv GROUP BY curve_id) SELECT curve_id, round(CASE WHEN atan2(s, c) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 5) AS direction, round(sqrt(s * s + c * c), 6) AS resultant FROM c")
def circular(spark, sf_dir):
    return series.circular_mean(curves(spark, sf_dir), "v", "curve_id").selectExpr("curve_id", "round(direction, 5) AS direction", "round(resultant, 6) AS resultant")


@query("fit_line", f"WITH {CV} SELECT curve_id, round(regr_slope(v, pos), 5) AS slope, round(regr_intercept(v, pos), 4) AS intercept, count(*) AS n FROM cv GROUP BY curve_id")
def fit_line(spark, sf_dir):
    return series.line_fit(curves(spark, sf_dir), "pos", "v", "curve_id").selectExpr("curve_id", "round(slope, 5) AS slope", "round(intercept, 4) AS intercept", "n")


@query("fit_parabola", f"""WITH {CV}, m AS (SELECT curve_id, count(*)::DOUBLE AS n, avg(pos) AS mx, avg(v) AS my FROM cv GROUP BY curve_id), c AS (SELECT cv.curve_id, pos - mx AS u, pos, v FROM cv JOIN m USING (curve_id)),
    s AS (SELECT curve_id, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(v) AS t0, sum(u * v) AS t1, sum(u * u * v) AS t2, count(*)::DOUBLE AS n FROM c GROUP BY curve_id),
    f AS (SELECT curve_id, n, s2, s3, s4, t0, t1, t2, ((t2 - s2 * t0 / n) * s2 - s3 * t1) / ((s4 - s2 * s2 / n) * s2 - s3 * s3) AS a FROM s) SELECT curve_id, round(a, 4) + 0e0 AS a, round((t1 - a * s3) / s2 - 2 * a * mx, 2) + 0e0 AS b FROM f JOIN m USING (curve_id)""")
def fit_parabola(spark, sf_dir):
    return series.parabola_fit(curves(spark, sf_dir), "pos", "v", "curve_id").selectExpr("curve_id", "round(a, 4) + 0e0 AS a", "round(b, 2) + 0e0 AS b")


@query("points_unit_standard", f"WITH {PT} SELECT set_id, point_id, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) AS x_std, round((y - avg(y) OVER w) / stddev_samp(y) OVER w, 6) AS y_std FROM pt WINDOW w AS (PARTITION BY set_id)")
def standard(spark, sf_dir):
    return series.unit_standard(point_table(spark, sf_dir), ["x", "y"], "set_id").selectExpr("set_id", "point_id", "round(x_std, 6) AS x_std", "round(y_std, 6) AS y_std")


_NEAR = "SELECT p.set_id, p.point_id AS id1, q.point_id AS id2, ((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))::DOUBLE AS d2 FROM pt p JOIN pt q ON p.set_id = q.set_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 25"


@query("join_radius", f"WITH {PT} {_NEAR}")
def radius(spark, sf_dir):
    p = point_table(spark, sf_dir)
    return points.radius_join(p, p, 5)


_PAIRS = "SELECT p.set_id, p.point_id AS id1, q.point_id AS id2, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) AS d2 FROM pt p JOIN pt q ON p.set_id = q.set_id AND p.point_id <> q.point_id"


@query("join_nearest_neighbor", f"WITH {PT}, r AS (SELECT *, row_number() OVER (PARTITION BY set_id, id1 ORDER BY d2, id2) AS k FROM ({_PAIRS})) SELECT set_id, id1, id2, d2 FROM r WHERE k = 1")
def nearest(spark, sf_dir):
    return points.nearest(point_table(spark, sf_dir), 5)


@query("join_closest_pair", f"WITH {PT}, r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY d2, id1, id2) AS k FROM ({_PAIRS}) WHERE id1 < id2) SELECT set_id, id1, id2, d2 FROM r WHERE k = 1")
def closest(spark, sf_dir):
    return points.closest_pair(point_table(spark, sf_dir), 5)


_SPLIT = "a AS (SELECT * FROM pt WHERE point_id % 2 = 0), b AS (SELECT * FROM pt WHERE point_id % 2 = 1), n AS (SELECT p.set_id, p.point_id AS id1, q.point_id AS id2, ((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))::DOUBLE AS d2 FROM a p JOIN b q ON p.set_id = q.set_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 100), m AS (SELECT *, row_number() OVER (PARTITION BY set_id, id1 ORDER BY d2, id2) AS f, row_number() OVER (PARTITION BY set_id, id2 ORDER BY d2, id1) AS g FROM n)"


def _matches(spark, sf_dir):
    """Even against odd points of each set, as two images' keypoints."""
    p = point_table(spark, sf_dir)
    return p, points.mutual_matches(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), 10)


@query("join_mutual_matches", f"WITH {PT}, {_SPLIT} SELECT set_id, id1, id2, d2 FROM m WHERE f = 1 AND g = 1")
def mutual(spark, sf_dir):
    return _matches(spark, sf_dir)[1]


@query("match_f_measure", f"WITH {PT}, {_SPLIT}, c AS (SELECT set_id, sum(1 - point_id % 2)::BIGINT AS n1, sum(point_id % 2)::BIGINT AS n2 FROM pt GROUP BY set_id), k AS (SELECT set_id, count(*) AS found FROM m WHERE f = 1 AND g = 1 GROUP BY set_id), j AS (SELECT set_id, n1, n2, coalesce(found, 0) AS found FROM c LEFT JOIN k USING (set_id)), q AS (SELECT *, found / nullif(n1, 0) AS p, found / nullif(n2, 0) AS r FROM j) SELECT set_id, found, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM q")
def f_measure(spark, sf_dir):
    p, m = _matches(spark, sf_dir)
    c = p.groupBy("set_id").agg(F.expr("sum(1 - point_id % 2)").alias("n1"), F.expr("sum(point_id % 2)").alias("n2"))
    j = c.join(m.groupBy("set_id").agg(F.count("*").alias("found")), "set_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return j.select("set_id", "found", F.round(points.f_measure(F.col("found"), F.col("n1"), F.col("n2")), 6).alias("f1"))


_CELL = "CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0 ELSE least(3, (({c} - min({c}) OVER w) * 4) // (max({c}) OVER w - min({c}) OVER w)) END"
_CELL_SQL = f"SELECT *, {_CELL.format(c='y')} * 4 + {_CELL.format(c='x')} AS cell FROM pt WINDOW w AS (PARTITION BY set_id)"


@query("points_grid_partition", f"WITH {PT} SELECT set_id, point_id, cell FROM ({_CELL_SQL})")
def grid(spark, sf_dir):
    return points.grid_partition(point_table(spark, sf_dir), 4).select("set_id", "point_id", "cell")


@query("points_sample_per_cell", f"WITH {PT}, c AS ({_CELL_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY set_id, cell ORDER BY md5('1:' || point_id)) AS k FROM c) SELECT set_id, point_id, cell FROM r WHERE k <= 2")
def sample(spark, sf_dir):
    return points.sample_per_cell(points.grid_partition(point_table(spark, sf_dir), 4), 2).select("set_id", "point_id", "cell")


_C30, _S30 = num(math.cos(math.radians(30))), num(math.sin(math.radians(30)))


@query("transform_similarity", f"WITH {PT} SELECT set_id, point_id, round(10 * 1.5e0 + 1.5e0 * ((x - 10) * {_C30} + (y - 20) * {_S30}) + 3, 5) AS xt, round(20 * 1.5e0 + 1.5e0 * (-(x - 10) * {_S30} + (y - 20) * {_C30}) - 4, 5) AS yt FROM pt")
def similarity(spark, sf_dir):
    return points.similarity_transform(point_table(spark, sf_dir), 1.5, 30, 3, -4, 10, 20).selectExpr("set_id", "point_id", "round(xt, 5) AS xt", "round(yt, 5) AS yt")


@query("points_shape", f"WITH {PT} SELECT set_id, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY set_id")
def shape(spark, sf_dir):
    return points.shape(point_table(spark, sf_dir)).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


_POLY = [(10, 5), (45, 12), (38, 50), (22, 30), (8, 52)]
_EDGES = [(*_POLY[i], *_POLY[(i + 1) % len(_POLY)]) for i in range(len(_POLY))]


@query("points_in_polygon", f"""WITH {PT}, e(x0, y0, x1, y1) AS (VALUES {', '.join(map(str, _EDGES))}), j AS (SELECT point_id, x, y, CASE WHEN (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) = 0 AND x BETWEEN least(x0, x1) AND greatest(x0, x1) AND y BETWEEN least(y0, y1) AND greatest(y0, y1) THEN 1 ELSE 0 END AS onedge,
    CASE WHEN (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * (x1 - x0) / nullif(y1 - y0, 0)::DOUBLE THEN 1 ELSE 0 END AS hit FROM pt CROSS JOIN e) SELECT point_id, max(onedge) + sum(hit) % 2 > 0 AS inside FROM j GROUP BY point_id""")
def polygon(spark, sf_dir):
    edges = spark.createDataFrame([(0, *e) for e in _EDGES], "poly_id int, x0 int, y0 int, x1 int, y1 int")
    p = point_table(spark, sf_dir).withColumn("poly_id", F.lit(0))
    return points.in_polygon(p.select("poly_id", "point_id", "x", "y"), edges).select("point_id", "inside")


_XYI = f"xy AS (SELECT curve_id, pos, pos AS x, CAST(floor(v) AS INTEGER) AS y FROM ({CURVES_SQL}))"


def _xyi(spark, sf_dir):
    return curves(spark, sf_dir).selectExpr("curve_id", "pos", "pos AS x", "CAST(floor(v) AS INT) AS y")


@query("curve_area", f"WITH {_XYI}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM xy WINDOW w AS (PARTITION BY curve_id ORDER BY pos)) SELECT curve_id, sum(x * ny - nx * y) / 2.0::DOUBLE AS area FROM n GROUP BY curve_id")
def area(spark, sf_dir):
    return points.polygon_area(_xyi(spark, sf_dir))


@query("hough_lines", f"""WITH {_XYI}, n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM xy WINDOW w AS (PARTITION BY curve_id ORDER BY pos)),
    t AS (SELECT curve_id, x, y, CAST((CAST(floor(degrees(atan2(ny - py, nx - px)) + 0.5) AS INTEGER) + 360) % 360 AS INTEGER) AS theta FROM n WHERE px IS NOT NULL AND nx IS NOT NULL)
    SELECT curve_id, theta, CAST(floor(sqrt(pow(x * cos(radians(theta)), 2) + pow(y * sin(radians(theta)), 2)) + 0.5) AS INTEGER) AS r, count(*) AS votes FROM t GROUP BY ALL""")
def hough(spark, sf_dir):
    return points.hough_votes(_xyi(spark, sf_dir))


@query("sort_by_x_then_y", f"WITH {PT} SELECT set_id, point_id, row_number() OVER (PARTITION BY set_id ORDER BY x, y, point_id) AS k, row_number() OVER (PARTITION BY set_id ORDER BY y, x, point_id) AS m FROM pt")
def sorted_points(spark, sf_dir):
    w = lambda *o: F.row_number().over(Window.partitionBy("set_id").orderBy(*o))
    return point_table(spark, sf_dir).select("set_id", "point_id", w("x", "y", "point_id").alias("k"), w("y", "x", "point_id").alias("m"))


@query("sort_top_k", f"WITH {CV} SELECT curve_id, pos, v FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY v DESC, pos) AS k FROM cv) WHERE k <= 5")
def top_k(spark, sf_dir):
    return curves(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("curve_id").orderBy(F.desc("v"), "pos"))).where("k <= 5").drop("k")


@query("search_successor", f"WITH {PT} SELECT set_id, x, lead(x) OVER w AS successor, lag(x) OVER w AS predecessor FROM (SELECT DISTINCT set_id, x FROM pt) WINDOW w AS (PARTITION BY set_id ORDER BY x)")
def successor(spark, sf_dir):
    w = Window.partitionBy("set_id").orderBy("x")
    return point_table(spark, sf_dir).select("set_id", "x").distinct().withColumns({"successor": F.lead("x").over(w), "predecessor": F.lag("x").over(w)})


@query("set_intersection", f"WITH {PT} SELECT x, y FROM pt WHERE point_id % 2 = 0 INTERSECT SELECT x, y FROM pt WHERE point_id % 2 = 1")
def intersection(spark, sf_dir):
    p = point_table(spark, sf_dir)
    return p.where("point_id % 2 = 0").select("x", "y").intersect(p.where("point_id % 2 = 1").select("x", "y"))


@query("set_difference", f"WITH {PT} SELECT x, y FROM pt WHERE point_id % 2 = 0 EXCEPT SELECT x, y FROM pt WHERE point_id % 2 = 1")
def difference(spark, sf_dir):
    p = point_table(spark, sf_dir)
    return p.where("point_id % 2 = 0").select("x", "y").subtract(p.where("point_id % 2 = 1").select("x", "y"))
