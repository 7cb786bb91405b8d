"""Queries of colour and hue gradients, contrast, median pyramids, holes, single labels and two-dimensional thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import color
from lumenframe.functions.steps import applied, as_sql
from lumenframe.operators import edges, filters, graph, histogram, raster
from lumenframe.plans.curves import _conv_sql, _separable_sql
from lumenframe.plans.registry import query
from lumenframe.sources.derived import LABELS_SQL, PIXELS_SQL, labelled, pixels

PX = f"px AS ({PIXELS_SQL})"
_FAR = "least(abs({a}.v - {b}.v), 255 - abs({a}.v - {b}.v)) >= 100"
_JOIN = " ".join(f"LEFT JOIN px {n} ON {n}.image_id = p.image_id AND {n}.x = p.x + ({dx}) AND {n}.y = p.y + ({dy})" for n, dx, dy in (("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("d", 0, 1)))


@query("gradient_hue_steps", f"WITH {PX} SELECT p.image_id, p.x, p.y, CASE WHEN l.v IS NULL OR r.v IS NULL OR u.v IS NULL OR d.v IS NULL THEN 0 WHEN {_FAR.format(a='l', b='r')} OR {_FAR.format(a='u', b='d')} THEN 1 ELSE 0 END AS step FROM px p {_JOIN}")
def hue_steps(spark, sf_dir):
    return edges.hue_steps(pixels(spark, sf_dir), 100).select("image_id", "x", "y", "step")


def _pair_sql(ax: str, ay: str, bx: str, by: str) -> str:
    sides = ", ".join(f"coalesce({q}.lab_{c}, p.lab_{c}) AS {c}{k}" for k, q in ((1, "q"), (2, "r")) for c in "lab")
    base = f"SELECT p.image_id, p.x, p.y, {sides} FROM lab p LEFT JOIN lab q ON q.image_id = p.image_id AND q.x = {ax} AND q.y = {ay} LEFT JOIN lab r ON r.image_id = p.image_id AND r.x = {bx} AND r.y = {by}"
    return as_sql(base, color.delta_e_2000(), "image_id, x, y, de2000")


@query("gradient_delta_e2000", f"WITH lab AS ({as_sql(PIXELS_SQL, color.lab(), 'image_id, x, y, lab_l, lab_a, lab_b')}), h AS ({_pair_sql('p.x - 1', 'p.y', 'p.x + 1', 'p.y')}), u AS ({_pair_sql('p.x', 'p.y - 1', 'p.x', 'p.y + 1')}) SELECT h.image_id, h.x, h.y, round(h.de2000, 4) AS gx, round(u.de2000, 4) AS gy, round(sqrt((pow(h.de2000, 2) + pow(u.de2000, 2)) / 2), 4) AS gxy FROM h JOIN u USING (image_id, x, y)")
def colour_gradient(spark, sf_dir):
    return edges.colour_gradient(pixels(spark, sf_dir)).selectExpr("image_id", "x", "y", *[f"round({c}, 4) AS {c}" for c in ("gx", "gy", "gxy")])


_SIGMA = 0.42466090014400953  # fixed value: the deviation of a Gaussian of full width 1 at half its height
_AXES = [(c, _conv_sql("px", filters.gaussian(s), f"image_id, {o}", c, "v", n, "image_id, x, y")) for c, o in (("x", "y"), ("y", "x")) for n, s in (("narrow", _SIGMA), ("wide", _SIGMA * 1.6))]


@query("gradient_difference_of_gaussians", f"WITH {PX}, d AS (SELECT image_id, x, y, a.narrow - b.wide AS gx, c.narrow - e.wide AS gy FROM {_AXES[0][1]} a JOIN {_AXES[1][1]} b USING (image_id, x, y) JOIN {_AXES[2][1]} c USING (image_id, x, y) JOIN {_AXES[3][1]} e USING (image_id, x, y)) SELECT image_id, x, y, round(gx, 5) + 0e0 AS gx, round(gy, 5) + 0e0 AS gy, round(sqrt(gx * gx + gy * gy), 5) AS gxy FROM d")
def difference_of_gaussians(spark, sf_dir):
    d = edges.difference_of_gaussians(pixels(spark, sf_dir).select("image_id", "x", "y", "v"), _SIGMA)
    return d.selectExpr("image_id", "x", "y", "round(gx, 5) + 0e0 AS gx", "round(gy, 5) + 0e0 AS gy", "round(sqrt(gx * gx + gy * gy), 5) AS gxy")


@query("filter_divided_by_blur", f"WITH {PX}, b AS (SELECT image_id, x, y, floor(round(o, 6)) AS blurred FROM {_separable_sql('px', filters.gaussian(1.0), filters.gaussian(1.0))}) SELECT image_id, x, y, CASE WHEN blurred = 0 THEN 0 ELSE floor(round(v * 100 / blurred, 6)) END::INTEGER AS ratio FROM b JOIN px USING (image_id, x, y)")
def divided(spark, sf_dir):
    return edges.divided_by_blur(pixels(spark, sf_dir).select("image_id", "x", "y", "v"), 1.0).select("image_id", "x", "y", "ratio")


@query("filter_contrast", f"""WITH {PX}, m AS (SELECT p.image_id, p.x, p.y, any_value(p.v) AS v, avg(q.v) AS m FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 7 AND abs(q.y - p.y) <= 7 GROUP BY p.image_id, p.x, p.y),
    s AS (SELECT p.image_id, p.x, p.y, any_value(p.v) AS v, any_value(p.m) AS m, sqrt(avg(pow(q.v - q.m, 2))) AS s FROM m p JOIN m q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 7 AND abs(q.y - p.y) <= 7 GROUP BY p.image_id, p.x, p.y),
    r AS (SELECT image_id, (max(v) + min(v)) / 2.0::DOUBLE AS r FROM px GROUP BY image_id), t AS (SELECT image_id, x, y, v, round(m * (1 + 0.2::DOUBLE * (s / r - 1)), 9) AS t FROM s JOIN r USING (image_id)),
    w AS (SELECT image_id, x, y, CASE WHEN v > t THEN v + t ELSE v END AS w FROM t), e AS (SELECT image_id, min(w) AS lo, max(w) AS hi FROM w GROUP BY image_id)
    SELECT image_id, x, y, floor(round((w - lo) * 255 / (hi - lo), 6))::INTEGER AS contrast FROM w JOIN e USING (image_id)""")
def contrast(spark, sf_dir):
    return edges.contrasted(pixels(spark, sf_dir), 7).select("image_id", "x", "y", "contrast")


_LEVELS = 3
_PYRAMID = [PX, "c0 AS (SELECT image_id, x, y, v FROM px)"]
for _k in range(_LEVELS):
    _PYRAMID.append(f"m{_k} AS (SELECT p.image_id, p.x, p.y, list_sort(list(q.v))[count(*) // 2 + 1] AS v FROM c{_k} p JOIN c{_k} q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.image_id, p.x, p.y)")
    _PYRAMID.append(f"c{_k + 1} AS (SELECT image_id, (x // 2)::INTEGER AS x, (y // 2)::INTEGER AS y, floor(avg(v) + 0.5)::INTEGER AS v FROM m{_k} GROUP BY ALL)")
_PARTS = [f"SELECT image_id, {k} AS level, c.x, c.y, c.v - d.v AS w FROM c{k} c JOIN c{k + 1} d USING (image_id) WHERE d.x = c.x // 2 AND d.y = c.y // 2" for k in range(_LEVELS)]


@query("wavelet_median_pyramid", f"WITH {', '.join(_PYRAMID)} {' UNION ALL '.join(_PARTS)} UNION ALL SELECT image_id, {_LEVELS}, x, y, v FROM c{_LEVELS}")
def median_pyramid(spark, sf_dir):
    """Coefficients by level; the last level is the smooth image."""
    parts, smooth = edges.median_pyramid(pixels(spark, sf_dir), _LEVELS)
    out = smooth.selectExpr("image_id", f"{_LEVELS} AS level", "x", "y", "v AS w")
    for k, w in enumerate(parts):
        out = out.unionByName(w.selectExpr("image_id", f"{k} AS level", "x", "y", "w"))
    return out


@query("wavelet_median_rebuilt", PIXELS_SQL.replace("SELECT", "SELECT image_id, x, y, v FROM (SELECT", 1) + ")")
def median_rebuilt(spark, sf_dir):
    """The image again, out of its coefficients."""
    return edges.pyramid_rebuilt(*edges.median_pyramid(pixels(spark, sf_dir), _LEVELS))


def _first_sql(src: str, sigma: float, axis: str, value: str, name: str) -> str:
    other = "y" if axis == "x" else "x"
    return _conv_sql(src, [-w for w in filters.gaussian(sigma, 1)], f"image_id, {other}", axis, value, name, "image_id, x, y")


@query("curvature_image", f"""WITH {PX}, gx AS {_first_sql('px', 0.5**0.5, 'x', 'v', 'gx')}, gy AS {_first_sql('px', 0.5**0.5, 'y', 'v', 'gy')}, gxx AS {_first_sql('gx', 1.0, 'x', 'gx', 'gxx')}, gyy AS {_first_sql('gy', 1.0, 'y', 'gy', 'gyy')}
    SELECT image_id, x, y, round(CASE WHEN gx * gx + gy * gy < 1e-12 THEN 0 ELSE (gx * gyy - gy * gxx) / pow(gx * gx + gy * gy, 1.5) END, 5) + 0e0 AS k FROM gx JOIN gy USING (image_id, x, y) JOIN gxx USING (image_id, x, y) JOIN gyy USING (image_id, x, y)""")
def image_curvature(spark, sf_dir):
    return edges.image_curvature(pixels(spark, sf_dir).select("image_id", "x", "y", "v"), 1.0).selectExpr("image_id", "x", "y", "round(k, 5) + 0e0 AS k")


@query("region_holes", f"""WITH RECURSIVE z AS (SELECT image_id, x, y FROM ({PIXELS_SQL}) WHERE v < 96), b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ({PIXELS_SQL}) WHERE v >= 96 GROUP BY image_id),
    open(image_id, x, y) AS (SELECT z.image_id, x, y FROM z JOIN b USING (image_id) WHERE x <= x0 OR x >= x1 OR y <= y0 OR y >= y1 UNION SELECT z.image_id, z.x, z.y FROM open o JOIN z ON z.image_id = o.image_id AND abs(z.x - o.x) + abs(z.y - o.y) = 1)
    SELECT z.image_id, z.x, z.y FROM z ANTI JOIN open o ON o.image_id = z.image_id AND o.x = z.x AND o.y = z.y""")
def holes(spark, sf_dir):
    return edges.holes(pixels(spark, sf_dir).select("image_id", "x", "y", F.expr("CASE WHEN v >= 96 THEN 1 ELSE 0 END").alias("v")))


_LAB = as_sql(LABELS_SQL, color.lab(), "image_id, x, y, label, lab_l, lab_a, lab_b")


@query("label_single_pixels", f"""WITH l AS ({_LAB}), n AS (SELECT p.image_id, p.x, p.y, p.label, q.label AS other, round(pow(p.lab_l - q.lab_l, 2) + pow(p.lab_a - q.lab_a, 2) + pow(p.lab_b - q.lab_b, 2), 6) AS d, CASE WHEN q.x < p.x THEN 0 WHEN q.x > p.x THEN 1 WHEN q.y < p.y THEN 2 ELSE 3 END AS k FROM l p JOIN l q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1)
    SELECT image_id, x, y, CASE WHEN bool_or(label = other) THEN any_value(label) ELSE first(other ORDER BY d, k) END AS relabelled FROM n GROUP BY image_id, x, y""")
def single_labels(spark, sf_dir):
    return edges.without_single_labels(labelled(spark, sf_dir)).select("image_id", "x", "y", "relabelled")


_BINS = 16


@query("threshold_otsu_2d", f"""WITH {PX}, m AS (SELECT p.image_id, p.x, p.y, any_value(p.v) AS v, sum(q.v)::BIGINT AS t, count(*) AS c FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.image_id, p.x, p.y),
    e AS (SELECT image_id, min(v) AS lo, max(v) - min(v) + 1 AS r, count(*) AS n FROM px GROUP BY image_id), c AS (SELECT image_id, (v - lo) * {_BINS} // r AS i, (t - lo * c) * {_BINS} // (c * r) AS j, count(*) AS f FROM m JOIN e USING (image_id) GROUP BY ALL),
    g AS (SELECT image_id, sum(f)::DOUBLE AS n, sum(f * i)::DOUBLE AS a, sum(f * j)::DOUBLE AS b FROM c GROUP BY image_id),
    k AS (SELECT p.image_id, p.i, p.j, coalesce(sum(q.f) FILTER (WHERE q.i <= greatest(p.i - 1, 0) AND q.j <= greatest(p.j - 1, 0)), 0)::DOUBLE AS w0, coalesce(sum(q.f * q.i) FILTER (WHERE q.i <= greatest(p.i - 1, 0) AND q.j <= greatest(p.j - 1, 0)), 0) AS a0, coalesce(sum(q.f * q.j) FILTER (WHERE q.i <= greatest(p.i - 1, 0) AND q.j <= greatest(p.j - 1, 0)), 0) AS b0,
        sum(q.f) FILTER (WHERE q.i >= p.i AND q.j >= p.j)::DOUBLE AS w1, sum(q.f * q.i) FILTER (WHERE q.i >= p.i AND q.j >= p.j) AS a1, sum(q.f * q.j) FILTER (WHERE q.i >= p.i AND q.j >= p.j) AS b1 FROM c p JOIN c q USING (image_id) GROUP BY p.image_id, p.i, p.j),
    d AS (SELECT image_id, i, j, round(CASE WHEN w0 = 0 THEN 0 ELSE w0 / n * (pow(a0 / w0 - a / n, 2) + pow(b0 / w0 - b / n, 2)) END + w1 / n * (pow(a1 / w1 - a / n, 2) + pow(b1 / w1 - b / n, 2)), 9) AS tr FROM k JOIN g USING (image_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tr DESC, i, j) AS k FROM d) SELECT image_id, i::INTEGER AS s, j::INTEGER AS t, round(lo + (i + 0.5::DOUBLE) * r / {_BINS}, 5) AS threshold FROM o JOIN e USING (image_id) WHERE k = 1""")
def otsu_2d(spark, sf_dir):
    return edges.otsu_2d(pixels(spark, sf_dir), _BINS).withColumn("threshold", F.round("threshold", 5))


_LCH = [*color.lch_luv(), ("c8", "least(7, CAST(floor(lchuv_c * 8 / 139e0) AS INTEGER))"), ("h8", "least(7, CAST(floor(lchuv_h * 8 / 359e0) AS INTEGER))")]


@query("hist_lch64", "SELECT image_id, c8 * 8 + h8 AS bin, count(*) AS n FROM (" + as_sql(PIXELS_SQL, _LCH) + ") GROUP BY ALL")
def lch64(spark, sf_dir):
    """Counts in 8 bins of LUV chroma (to 139) by 8 of hue (to 359 degrees); larger values are in the last bins."""
    return histogram.counts(applied(pixels(spark, sf_dir), [*_LCH, ("bin64", "c8 * 8 + h8")]), "bin64")


# Bounds of the colours of the sun's centre.
_SUN = [*color.hsv(), ("sun", "CASE WHEN r < 15 AND g < 15 AND b < 15 THEN FALSE ELSE (sat < 0.4e0 AND bright > 0.25e0 AND hue <= 0.18e0) OR (sat < 0.05e0 AND bright > 0.95e0) END")]


@query("color_sun_center", as_sql(PIXELS_SQL, _SUN, "image_id, x, y, sun"))
def sun(spark, sf_dir):
    """Whether a pixel has a colour of the centre of the sun."""
    return applied(pixels(spark, sf_dir), _SUN).select("image_id", "x", "y", "sun")


# How far channels of grey are off their mean, and how far green is above the others.
@query("color_group_grey_green", f"WITH l AS ({LABELS_SQL}), m AS (SELECT image_id, label, floor(avg(r) + 0.5)::INTEGER AS r, floor(avg(g) + 0.5)::INTEGER AS g, floor(avg(b) + 0.5)::INTEGER AS b FROM l GROUP BY ALL) SELECT image_id, label, list_max(list_transform([r, g, b], lambda c: abs(c - (r + g + b) // 3))) < 40 AS grey, g - greatest(r, b) >= 8 AS green FROM m")
def grey_green(spark, sf_dir):
    """Whether the mean colour of a label is grey (all channels less than 40 off their mean) or green (8 above the others)."""
    m = labelled(spark, sf_dir).groupBy("image_id", "label").agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"]).withColumn("m", F.expr("(r + g + b) div 3"))
    return m.selectExpr("image_id", "label", "abs(r - m) < 40 AND abs(g - m) < 40 AND abs(b - m) < 40 AS grey", "g - r >= 8 AND g - b >= 8 AS green")


@query("raster_bilinear_at", f"WITH {PX}, q AS (SELECT image_id, y * 32 + x AS place_id, x + (y % 4) * 0.25::DOUBLE AS qx, y + (x % 5) * 0.2::DOUBLE AS qy FROM px), c AS (SELECT q.image_id, place_id, (1 - abs(p.x - qx)) * (1 - abs(p.y - qy)) AS w, p.v FROM q JOIN px p ON p.image_id = q.image_id AND p.x > qx - 1 AND p.x < qx + 1 AND p.y > qy - 1 AND p.y < qy + 1) SELECT image_id, place_id, round(sum(w * v), 5) AS v FROM c GROUP BY ALL HAVING sum(w) > 1 - 1e-9")
def bilinear_at(spark, sf_dir):
    p = pixels(spark, sf_dir)
    places = p.selectExpr("image_id", "y * 32 + x AS place_id", "x + (y % 4) * 0.25D AS x", "y + (x % 5) * 0.2D AS y")
    return edges.bilinear_at(p, places).select("image_id", "place_id", F.round("v", 5).alias("v"))


@query("hist_first_peak", f"WITH {PX}, h AS (SELECT i AS image_id, k AS bin, count(v) AS n FROM (SELECT DISTINCT image_id AS i FROM px) CROSS JOIN range(16) r(k) LEFT JOIN px ON px.image_id = i AND v // 16 = k GROUP BY ALL), s AS (SELECT *, n - lag(n) OVER (PARTITION BY image_id ORDER BY bin) AS d FROM h), f AS (SELECT image_id, min(bin) AS fall FROM s WHERE d < 0 GROUP BY image_id) SELECT h.image_id, coalesce(any_value(fall), 0)::INTEGER - 1 AS peak, coalesce(min(s.bin), 0)::INTEGER AS after FROM (SELECT DISTINCT image_id FROM h) h LEFT JOIN f USING (image_id) LEFT JOIN s ON s.image_id = h.image_id AND s.bin > fall AND s.d > 0 GROUP BY h.image_id")
def first_peak(spark, sf_dir):
    h = histogram.dense_counts(pixels(spark, sf_dir).withColumn("v16", F.expr("v div 16")), 16, "v16")
    return edges.first_peak_and_minimum(h)


@query("graph_low_threshold_weights", f"WITH l AS ({LABELS_SQL}), m AS (SELECT image_id, label, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM l GROUP BY ALL), e AS (SELECT DISTINCT p.image_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM l p JOIN l q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 WHERE p.label <> q.label), d AS (SELECT e.image_id, e.a, e.b, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) AS d FROM e JOIN m p ON p.image_id = e.image_id AND p.label = e.a JOIN m q ON q.image_id = e.image_id AND q.label = e.b) SELECT image_id, a, b, round(d, 6) AS d, round(exp(-d * d / 800), 6) AS weight FROM d")
def low_threshold_weights(spark, sf_dir):
    l = labelled(spark, sf_dir)  # noqa: E741
    near = raster.shifted(raster.shifted(l.select("image_id", "x", "y", F.col("label").alias("v")), "v", 1, 0, "e"), "v", 0, 1, "s")
    pairs = near.select("image_id", "v", F.explode(F.array("e", "s")).alias("o")).where("o IS NOT NULL AND o <> v")
    adjacent = pairs.select("image_id", F.least("v", "o").alias("a"), F.greatest("v", "o").alias("b")).distinct()
    means = l.groupBy("image_id", "label").agg(F.avg("r").alias("mr"), F.avg("g").alias("mg"), F.avg("b").alias("mb"))
    return graph.largest_difference_weights(adjacent, means, 800).withColumns({"d": F.round("d", 6), "weight": F.round("weight", 6)})
