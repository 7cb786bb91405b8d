"""Queries of regions, windows of histograms, kernels, keys, sampling and averages over point sequences."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import color, scalars
from lumenframe.functions.steps import applied, as_sql, num
from lumenframe.operators import filters, histogram, raster, regions
from lumenframe.plans.registry import query
from lumenframe.sources.derived import CURVES_SQL, PIXELS_SQL, POINTS_SQL, curves, labelled, pixels, table
from lumenframe.sources.derived import points as point_table

PX, PT, CV = f"px AS ({PIXELS_SQL})", f"pt AS ({POINTS_SQL})", f"cv AS ({CURVES_SQL})"
_LB = f"l AS (SELECT image_id, CAST((x // 5) + 7 * (y // 6) + (v // 128) AS INTEGER) AS label, x, y, r, g, b FROM ({PIXELS_SQL}))"


@query("filter_near_border", f"WITH {PX} SELECT image_id, x, y, v FROM px WHERE x >= 5 AND y >= 5 AND x < 27 AND y < 27")
def border(spark, sf_dir):
    return regions.near_border(pixels(spark, sf_dir), 32, 32, 5).select("image_id", "x", "y", "v")


@query("raster_resize_frame", f"WITH {PX} SELECT image_id, x + 1 AS x, y + 1 AS y, v FROM px UNION ALL SELECT image_id, 0, y + 1, 0 FROM px WHERE x = 0 UNION ALL SELECT image_id, 33, y + 1, 0 FROM px WHERE x = 0")
def padded(spark, sf_dir):
    """One-pixel borders on the left and right of every row."""
    p = pixels(spark, sf_dir).select("image_id", "x", "y", "v")
    edge = p.where("x = 0").select("image_id", F.explode(F.array(F.lit(0), F.lit(33))).alias("x"), (F.col("y") + 1).alias("y"), F.lit(0).alias("v"))
    return raster.paste(p, 1, 1).select("image_id", "x", "y", "v").unionByName(edge)


@query("raster_unpad", f"WITH {PX} SELECT image_id, x - 1 AS x, y - 1 AS y, v FROM px WHERE x BETWEEN 1 AND 30 AND y BETWEEN 1 AND 30")
def unpadded(spark, sf_dir):
    return raster.crop(pixels(spark, sf_dir), 1, 1, 30, 30).select("image_id", "x", "y", "v")


@query("raster_dimensions", f"WITH {PX} SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS n FROM px GROUP BY image_id")
def dimensions(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("n"))


@query("raster_transpose", f"WITH {PX} SELECT image_id, y AS x, x AS y, v FROM px")
def transpose(spark, sf_dir):
    return pixels(spark, sf_dir).selectExpr("image_id", "y AS x", "x AS y", "v")


@query("raster_rows_as_arrays", f"WITH {PX} SELECT image_id, y, count(*) AS n, sum(v * (x + 1))::BIGINT AS checksum FROM px GROUP BY ALL")
def row_arrays(spark, sf_dir):
    """Row-major export: one array per row; the checksum is taken from the array."""
    rows = pixels(spark, sf_dir).groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("a"))
    return rows.select("image_id", "y", F.size("a").cast("long").alias("n"), F.expr("aggregate(a, 0L, (s, e) -> s + e.v * (e.x + 1))").alias("checksum"))


@query("raster_border_statistics", f"WITH {PX}, e AS (SELECT image_id, v FROM px WHERE x < 2 OR y < 2 OR x >= 30 OR y >= 30) SELECT image_id, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS vmin, max(v) AS vmax, round(stddev_samp(v), 6) AS sd FROM e GROUP BY image_id")
def border_stats(spark, sf_dir):
    return pixels(spark, sf_dir).where("x < 2 OR y < 2 OR x >= 30 OR y >= 30").groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.round(F.stddev_samp("v"), 6).alias("sd"))


_BIN = f"px AS (SELECT image_id, x, y, CASE WHEN v >= 150 THEN 1 ELSE 0 END AS v FROM ({PIXELS_SQL}))"
_RING = [("n", 0, -1), ("ne", 1, -1), ("e", 1, 0), ("se", 1, 1), ("s", 0, 1), ("sw", -1, 1), ("w", -1, 0), ("nw", -1, -1)]
_NEAR_SQL = "SELECT p.image_id, p.x, p.y, p.v, " + ", ".join(f"coalesce({n}.v, 0) AS {n}" for n, _, _ in _RING) + " FROM px p " + " ".join(f'LEFT JOIN px {n} ON {n}.image_id = p.image_id AND {n}.x = p.x + ({dx}) AND {n}.y = p.y + ({dy})' for n, dx, dy in _RING)
_TURNS = " + ".join(f"(CASE WHEN {a} = 0 AND {b} > 0 THEN 1 ELSE 0 END)" for (a, _, _), (b, _, _) in zip(_RING, [*_RING[1:], _RING[0]], strict=True))


def _binary(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "x", "y", F.expr("CASE WHEN v >= 150 THEN 1 ELSE 0 END").alias("v"))


@query("neighbor_counts", f"WITH {_BIN} SELECT image_id, x, y, {' + '.join(n for n, _, _ in _RING)} AS around, {_TURNS} AS turns FROM ({_NEAR_SQL})")
def neighbor_counts(spark, sf_dir):
    return regions.neighbour_counts(_binary(spark, sf_dir)).select("image_id", "x", "y", "around", "turns")


@query("neighbor_disconnects", f"WITH {_BIN} SELECT image_id, x, y FROM ({_NEAR_SQL}) WHERE v > 0 AND {_TURNS} > 1")
def disconnects(spark, sf_dir):
    return regions.would_disconnect(_binary(spark, sf_dir)).select("image_id", "x", "y")


@query("window_histogram", f"WITH {PX}, f AS (SELECT image_id, x, y, v FROM px), j AS (SELECT p.image_id, p.x, p.y, q.v // 64 AS bin FROM f p JOIN f q ON p.image_id = q.image_id AND abs(p.x - q.x) <= 2 AND abs(p.y - q.y) <= 2) SELECT image_id, x, y, sum(CASE WHEN bin = 0 THEN 1 ELSE 0 END)::BIGINT AS b0, sum(CASE WHEN bin = 1 THEN 1 ELSE 0 END)::BIGINT AS b1, sum(CASE WHEN bin = 2 THEN 1 ELSE 0 END)::BIGINT AS b2, sum(CASE WHEN bin = 3 THEN 1 ELSE 0 END)::BIGINT AS b3 FROM j GROUP BY image_id, x, y")
def window_hist(spark, sf_dir):
    """Window sums of integral histograms."""
    p = raster.filled(pixels(spark, sf_dir).select("image_id", "x", "y", "v"), "v")
    return regions.window_histogram(p, 2, 4).where("v IS NOT NULL").selectExpr("image_id", "x", "y", *[f"hist[{k}] AS b{k}" for k in range(4)])


_ORIENT = [("magnitude", "sqrt(gx * gx + gy * gy)"), ("t", "CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 180 WHEN degrees(atan2(gy, gx)) >= 180 THEN 0e0 ELSE degrees(atan2(gy, gx)) END"), ("bin", "least(8, CAST(floor(t * 9 / 180) AS INTEGER))")]
_GRAD = "SELECT image_id, x, y, CASE WHEN lf IS NULL AND rt IS NULL THEN 0 WHEN lf IS NULL THEN rt - v WHEN rt IS NULL THEN v - lf ELSE (rt - lf) / 2.0 END::DOUBLE AS gx, CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2.0 END::DOUBLE AS gy FROM (SELECT image_id, x, y, v, lag(v) OVER a AS lf, lead(v) OVER a AS rt, lag(v) OVER c AS u, lead(v) OVER c AS d FROM px WINDOW a AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"
_HOG = f"SELECT image_id, CAST(x // 4 AS INTEGER) AS cx, CAST(y // 4 AS INTEGER) AS cy, bin, sum(magnitude) AS w FROM ({as_sql(f'WITH {PX} {_GRAD}', _ORIENT)}) GROUP BY ALL"


def _hog(spark, sf_dir):
    g = applied(filters.central_gradients(pixels(spark, sf_dir)), _ORIENT)
    return g.groupBy("image_id", F.expr("CAST(x div 4 AS INT)").alias("cx"), F.expr("CAST(y div 4 AS INT)").alias("cy"), "bin").agg(F.sum("magnitude").alias("w"))


@query("feature_hog_cells", f"SELECT image_id, cx, cy, bin, round(w, 4) AS w FROM ({_HOG})")
def hog(spark, sf_dir):
    return _hog(spark, sf_dir).withColumn("w", F.round("w", 4))


@query("feature_hog_intersection", f"WITH h AS ({_HOG}), n AS (SELECT image_id, cx, cy, bin, w / nullif(sum(w) OVER (PARTITION BY image_id, cx, cy), 0) AS p FROM h) SELECT a.image_id, a.cx, a.cy, round(sum(least(a.p, b.p)), 5) AS similarity FROM n a JOIN n b ON b.image_id = a.image_id + 1 AND b.cx = a.cx AND b.cy = a.cy AND b.bin = a.bin GROUP BY ALL")
def hog_intersection(spark, sf_dir):
    """Orientation histograms of each cell against the same cell of the next image."""
    n = _hog(spark, sf_dir).withColumn("p", F.col("w") / F.nullif(F.sum("w").over(Window.partitionBy("image_id", "cx", "cy")), F.lit(0.0)))
    b = n.select((F.col("image_id") - 1).alias("image_id"), "cx", "cy", "bin", F.col("p").alias("q"))
    return n.join(b, ["image_id", "cx", "cy", "bin"]).groupBy("image_id", "cx", "cy").agg(F.round(F.sum(F.least("p", "q")), 5).alias("similarity"))


@query("feature_grey_cells", f"WITH {PX} SELECT image_id, x // 4 AS cx, y // 4 AS cy, v // 32 AS bin, count(*) AS n FROM px GROUP BY ALL")
def grey_cells(spark, sf_dir):
    return pixels(spark, sf_dir).selectExpr("image_id", "x div 4 AS cx", "y div 4 AS cy", "v div 32 AS bin").groupBy("image_id", "cx", "cy", "bin").agg(F.count("*").alias("n"))


_THETA = [*color.lab(), *color.polar_theta("lab_a", "lab_b")]


@query("feature_hue_cells", "SELECT image_id, x // 8 AS cx, y // 8 AS cy, theta // 32 AS bin, count(*) AS n FROM (" + as_sql(PIXELS_SQL, _THETA) + ") GROUP BY ALL")
def hue_cells(spark, sf_dir):
    return applied(pixels(spark, sf_dir), _THETA).selectExpr("image_id", "x div 8 AS cx", "y div 8 AS cy", "theta div 32 AS bin").groupBy("image_id", "cx", "cy", "bin").agg(F.count("*").alias("n"))


@query("hist_lab16", "SELECT image_id, channel, bin, count(*) AS n FROM (SELECT image_id, unnest(['l', 'a', 'b']) AS channel, unnest([CAST(least(15, greatest(0, floor(lab_l * 16 / 100))) AS INTEGER), CAST(least(15, greatest(0, floor((lab_a + 128) / 16))) AS INTEGER), CAST(least(15, greatest(0, floor((lab_b + 128) / 16))) AS INTEGER)]) AS bin FROM (" + as_sql(PIXELS_SQL, color.lab()) + ")) GROUP BY ALL")
def lab16(spark, sf_dir):
    p = applied(pixels(spark, sf_dir), color.lab())
    put = "least(15, greatest(0, CAST(floor({}) AS INT)))"
    bins = F.explode(F.array(*[F.expr(f"struct('{c}' AS channel, {put.format(e)} AS bin)") for c, e in (("l", "lab_l * 16 / 100"), ("a", "(lab_a + 128) / 16"), ("b", "(lab_b + 128) / 16"))])).alias("e")
    return p.select("image_id", bins).groupBy("image_id", "e.channel", "e.bin").agg(F.count("*").alias("n"))


@query("peak_local_max", f"WITH {PX}, b AS (SELECT p.image_id, p.x, p.y, any_value(p.v) AS v, max(q.v) AS hi FROM px p JOIN px q ON p.image_id = q.image_id AND abs(p.x - q.x) <= 2 AND abs(p.y - q.y) <= 2 GROUP BY p.image_id, p.x, p.y), t AS (SELECT image_id, greatest(min(v), 0.5::DOUBLE * max(v)) AS t FROM px GROUP BY image_id) SELECT b.image_id, x, y, v FROM b JOIN t USING (image_id) WHERE v = hi AND v >= t")
def peak_local_max(spark, sf_dir):
    image = Window.partitionBy("image_id")
    p = pixels(spark, sf_dir).select("image_id", "x", "y", "v").withColumn("t", F.greatest(F.min("v").over(image), 0.5 * F.max("v").over(image)))
    return raster.box(p, 2).where("v = box_max AND v >= t").select("image_id", "x", "y", "v")


@query("label_ellipse", f"WITH {_LB}, m AS (SELECT image_id, label, count(*)::DOUBLE AS n, avg(x) AS cx, avg(y) AS cy, avg(x * x) AS xx, avg(x * y) AS xy, avg(y * y) AS yy FROM l GROUP BY ALL), c AS (SELECT image_id, label, xx - cx * cx AS a, xy - cx * cy AS b, yy - cy * cy AS c FROM m WHERE n >= 5), h AS (SELECT *, (a + c) / 2 AS mean, sqrt(pow((a - c) / 2, 2) + b * b) AS half FROM c) SELECT image_id, label, round(2 * sqrt(mean + half), 4) AS major, round(2 * sqrt(greatest(mean - half, 0)), 4) AS minor FROM h")
def ellipse(spark, sf_dir):
    m = labelled(spark, sf_dir).groupBy("image_id", "label").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("m10"), F.sum("y").alias("m01"), F.sum(F.expr("x * x")).alias("m20"), F.sum(F.expr("x * y")).alias("m11"), F.sum(F.expr("y * y")).alias("m02")).where("n >= 5")
    e = regions.moments_ellipse(*[F.col(c) for c in ("n", "m10", "m01", "m20", "m11", "m02")])
    return m.withColumns(e).select("image_id", "label", F.round("major", 4).alias("major"), F.round("minor", 4).alias("minor"))


_MEANS = "m AS (SELECT image_id, label, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM l GROUP BY ALL)"
_ADJ = "adj AS (SELECT DISTINCT p.image_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM l p JOIN l q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 WHERE p.label <> q.label)"


@query("label_merge_by_color", f"WITH RECURSIVE {_LB}, {_MEANS}, {_ADJ}, e AS (SELECT adj.image_id, a, b FROM adj JOIN m p ON p.image_id = adj.image_id AND p.label = a JOIN m q ON q.image_id = adj.image_id AND q.label = b WHERE sqrt(pow(p.mr - q.mr, 2) + pow(p.mg - q.mg, 2) + pow(p.mb - q.mb, 2)) < 18), s AS (SELECT image_id, a, b FROM e UNION ALL SELECT image_id, b, a FROM e), r(image_id, a, b) AS (SELECT image_id, label, label FROM m UNION SELECT r.image_id, r.a, s.b FROM r JOIN s ON s.image_id = r.image_id AND s.a = r.b) SELECT image_id, a AS label, min(b) AS merged FROM r GROUP BY image_id, a")
def merge_labels(spark, sf_dir):
    """Adjacent labels joined while their mean colours are near."""
    l = labelled(spark, sf_dir)  # noqa: E741
    e = raster.shifted(raster.shifted(l.select("image_id", "x", "y", F.col("label").alias("v")), "v", 1, 0, "e"), "v", 0, 1, "s").select("image_id", "v", F.explode(F.array("e", "s")).alias("o")).where("o IS NOT NULL AND o <> v")
    adjacent = e.select("image_id", F.least("v", "o").alias("a"), F.greatest("v", "o").alias("b")).distinct()
    means = l.groupBy("image_id", "label").agg(F.avg("r").alias("mr"), F.avg("g").alias("mg"), F.avg("b").alias("mb"))
    side = lambda s: means.select("image_id", F.col("label").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("mr", "mg", "mb")])
    d = F.sqrt(F.pow(F.col("mr_a") - F.col("mr_b"), 2) + F.pow(F.col("mg_a") - F.col("mg_b"), 2) + F.pow(F.col("mb_a") - F.col("mb_b"), 2))
    edges = adjacent.join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"]).withColumn("d", d)
    return regions.merged_by_difference(edges, means, 18)


@query("label_mode_color", f"WITH {_LB}, h AS (SELECT image_id, label, r // 5 AS bin, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY n DESC, bin) AS k FROM h) SELECT image_id, label, bin * 5 + 2 AS mode_r FROM k WHERE k = 1")
def mode_color(spark, sf_dir):
    h = labelled(spark, sf_dir).groupBy("image_id", "label", F.expr("r div 5").alias("bin")).agg(F.count("*").alias("n"))
    best = h.groupBy("image_id", "label").agg(F.max(F.struct(F.col("n"), (-F.col("bin")).alias("b"))).alias("m"))
    return best.select("image_id", "label", (-F.col("m.b") * 5 + 2).alias("mode_r"))


_K = {f"g{s}_{o}": filters.gaussian(s, o) for s in (0.7, 1.0, 2.0) for o in (0, 1, 2)} | {f"b{n}_{o}": filters.binomial(n, o) for n in (2, 4) for o in (0, 1)}


_KERNELS_SQL = "(VALUES " + ", ".join(f"('{k}', [{', '.join(num(w) for w in v)}])" for k, v in _K.items()) + ") t(kernel, w)"


@query("kernel_tables", f"WITH r AS (SELECT image_id, list(v ORDER BY x) AS vs FROM ({PIXELS_SQL}) WHERE y = 16 GROUP BY image_id HAVING count(*) = 32) SELECT image_id, kernel, len(w) AS taps, round(list_sum(w), 9) AS total, round(list_max(w), 9) AS peak, round(list_sum(list_transform(list_zip(w, vs[1:len(w)]), lambda z: z[1] * z[2])), 5) AS response FROM r CROSS JOIN {_KERNELS_SQL}")
def kernels(spark, sf_dir):
    """The kernels, and what each makes of the beginning of the middle row of every whole image."""
    rows = pixels(spark, sf_dir).where("y = 16").groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("vs")).where("size(vs) = 32")
    kernel = spark.createDataFrame([(k, [float(w) for w in v]) for k, v in _K.items()], "kernel string, w array<double>")  # one row a kernel
    both = rows.crossJoin(F.broadcast(kernel))
    response = F.expr("aggregate(zip_with(w, slice(vs, 1, size(w)), (a, b) -> a * b), 0D, (s, t) -> s + t)")
    return both.select("image_id", "kernel", F.size("w").alias("taps"), F.round(F.aggregate("w", F.lit(0.0), lambda s, w: s + w), 9).alias("total"), F.round(F.array_max("w"), 9).alias("peak"), F.round(response, 5).alias("response"))


@query("trig_tables", "SELECT d, count(*) AS n, round(cos(radians(d)), 9) + 0e0 AS c, round(sin(radians(d)), 9) + 0e0 AS s FROM (SELECT o_orderkey % 360 AS d FROM orders) GROUP BY d")
def trig(spark, sf_dir):
    """Sines and cosines of the directions (in whole degrees) that the orders' keys have, and how many have them."""
    found = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey % 360").alias("d")).agg(F.count("*").alias("n"))
    return found.selectExpr("d", "n", "round(cos(radians(d)), 9) + 0e0 AS c", "round(sin(radians(d)), 9) + 0e0 AS s")


_HALTON = [("u", scalars.radical_inverse("i", 2)), ("w", scalars.radical_inverse("i", 3))]


@query("quasi_monte_carlo_mean", f"SELECT round(avg(u * u * w), 7) AS mean, round(avg(CASE WHEN u * u + w * w <= 1 THEN 4e0 ELSE 0e0 END), 7) AS pi FROM ({as_sql('SELECT o_orderkey AS i FROM orders', _HALTON)})")
def qmc(spark, sf_dir):
    """Averages of functions over Halton points."""
    p = applied(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS i"), _HALTON)
    return p.agg(F.round(F.avg(F.expr("u * u * w")), 7).alias("mean"), F.round(F.avg(F.expr("CASE WHEN u * u + w * w <= 1 THEN 4D ELSE 0D END")), 7).alias("pi"))


@query("fit_residuals", f"WITH {CV}, f AS (SELECT curve_id, regr_slope(v, pos) AS a, regr_intercept(v, pos) AS b FROM cv GROUP BY curve_id) SELECT cv.curve_id, round(sqrt(sum(pow(v - a * pos - b, 2))), 4) AS residual, count(*) AS n FROM cv JOIN f ON f.curve_id = cv.curve_id GROUP BY cv.curve_id")
def residuals(spark, sf_dir):
    c = curves(spark, sf_dir)
    f = c.groupBy("curve_id").agg(F.regr_slope("v", "pos").alias("a"), F.regr_intercept("v", "pos").alias("b"))
    return c.join(f, "curve_id").groupBy("curve_id").agg(F.round(F.sqrt(F.sum(F.pow(F.expr("v - a * pos - b"), 2))), 4).alias("residual"), F.count("*").alias("n"))


@query("error_statistics", f"WITH {PT} SELECT set_id, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, sum(CASE WHEN d <= 20 THEN 1 ELSE 0 END)::BIGINT AS inliers FROM (SELECT set_id, sqrt(pow(x - 25, 2) + pow(y - 30, 2)) AS d FROM pt) GROUP BY set_id")
def error_statistics(spark, sf_dir):
    p = point_table(spark, sf_dir).withColumn("d", F.expr("sqrt(pow(x - 25, 2) + pow(y - 30, 2))"))
    return p.groupBy("set_id").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_samp("d"), 6).alias("sd"), F.sum(F.expr("CASE WHEN d <= 20 THEN 1 ELSE 0 END")).alias("inliers"))


@query("curve_turning_angles", f"WITH {CV}, n AS (SELECT curve_id, pos, lag(v) OVER w AS p, v, lead(v) OVER w AS q FROM cv WINDOW w AS (PARTITION BY curve_id ORDER BY pos)) SELECT curve_id, pos, round(degrees(atan2(q - v, 1.0) - atan2(v - p, 1.0)), 5) AS turn FROM n WHERE p IS NOT NULL AND q IS NOT NULL")
def turning(spark, sf_dir):
    w = Window.partitionBy("curve_id").orderBy("pos")
    c = curves(spark, sf_dir).withColumns({"p": F.lag("v").over(w), "q": F.lead("v").over(w)}).where("p IS NOT NULL AND q IS NOT NULL")
    return c.selectExpr("curve_id", "pos", "round(degrees(atan2(q - v, 1D) - atan2(v - p, 1D)), 5) AS turn")


@query("curve_point_line_distance", f"WITH {PT} SELECT set_id, point_id, round(abs(3 * x - 4 * y + 10) / 5.0, 6) AS d FROM pt")
def line_distance(spark, sf_dir):
    return point_table(spark, sf_dir).selectExpr("set_id", "point_id", "round(abs(3 * x - 4 * y + 10) / 5.0D, 6) AS d")


@query("curve_orientation", f"WITH xy AS (SELECT curve_id, pos, cos(pos * 0.3e0) * (1 + v / 500) AS x, sin(pos * 0.3e0) * (1 + v / 500) AS y FROM ({CURVES_SQL})), n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM xy WINDOW w AS (PARTITION BY curve_id ORDER BY pos)) SELECT curve_id, sum(x * ny - nx * y) > 0 AS counter FROM n GROUP BY curve_id")
def orientation(spark, sf_dir):
    from lumenframe.operators.points import polygon_area

    c = curves(spark, sf_dir).selectExpr("curve_id", "pos", "cos(pos * 0.3e0) * (1 + v / 500) AS x", "sin(pos * 0.3e0) * (1 + v / 500) AS y")
    return polygon_area(c).select("curve_id", (F.col("area") > 0).alias("counter"))


@query("object_size", f"WITH {PT} SELECT p.set_id, round(sqrt(max(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))), 6) AS diameter FROM pt p JOIN pt q ON p.set_id = q.set_id GROUP BY p.set_id")
def object_size(spark, sf_dir):
    """Diameter of a point set: only the lowest and highest point of each column can be its ends."""
    ends = point_table(spark, sf_dir).groupBy("set_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select("set_id", "x", F.explode(F.array("lo", "hi")).alias("y"))
    other = ends.select("set_id", F.col("x").alias("u"), F.col("y").alias("w"))
    return ends.join(other, "set_id").groupBy("set_id").agg(F.round(F.sqrt(F.max(F.expr("pow(x - u, 2) + pow(y - w, 2)"))), 6).alias("diameter"))


@query("angle_differences", f"WITH {PT}, a AS (SELECT set_id, point_id, (x * 37) % 360 AS p, (y * 53) % 360 AS q FROM pt) SELECT set_id, count(*) AS n, round(avg(pow(least(abs(p - q), 360 - abs(p - q)), 2)), 5) AS ssd FROM a GROUP BY set_id")
def angle_differences(spark, sf_dir):
    """Mean squared difference of angles on the circle."""
    p = point_table(spark, sf_dir).selectExpr("set_id", "(x * 37) % 360 AS p", "(y * 53) % 360 AS q")
    return p.groupBy("set_id").agg(F.count("*").alias("n"), F.round(F.avg(F.expr("pow(least(abs(p - q), 360 - abs(p - q)), 2)")), 5).alias("ssd"))


@query("weighted_sampling", f"WITH {PX}, h AS (SELECT image_id, v AS bin, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT image_id, bin, sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY image_id) AS total FROM h), d AS (SELECT unnest(range(16)) AS k) SELECT image_id, k, min(bin) AS pick FROM c CROSS JOIN d WHERE upto * 16 > k * total GROUP BY ALL")
def weighted(spark, sf_dir):
    """Values at evenly spaced shares of the cumulative distribution."""
    h = histogram.counts(pixels(spark, sf_dir)).withColumns({"upto": F.sum("n").over(Window.partitionBy("image_id").orderBy("bin")), "total": F.sum("n").over(Window.partitionBy("image_id"))})
    first = F.floor((F.col("upto") - F.col("n")) * 16 / F.col("total"))
    last = F.ceil(F.col("upto") * 16 / F.col("total")) - 1
    shares = h.withColumn("k", F.explode(F.when(last >= first, F.sequence(F.greatest(first, F.lit(0)), last)).otherwise(F.array().cast("array<bigint>"))))
    return shares.where("upto * 16 > k * total").groupBy("image_id", "k").agg(F.min("bin").alias("pick"))


@query("bits_big_endian", "SELECT o_orderkey AS id, lpad(lower(to_hex(o_custkey)), 16, '0') AS hex FROM orders")
def big_endian(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "lpad(lower(hex(o_custkey)), 16, '0') AS hex")


@query("decimal_arithmetic", "SELECT o_orderkey AS id, (o_orderkey::HUGEINT * 1000000007 * (o_custkey + 1))::VARCHAR AS product, (o_orderkey::HUGEINT * 1000000007 - o_custkey)::VARCHAR AS difference FROM orders")
def big_numbers(spark, sf_dir):
    """Whole numbers beyond 64 bits as decimals."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(CAST(o_orderkey AS DECIMAL(19,0)) * CAST(1000000007 AS DECIMAL(10,0)) * CAST(o_custkey + 1 AS DECIMAL(7,0)) AS STRING) AS product", "CAST(CAST(o_orderkey AS DECIMAL(19,0)) * CAST(1000000007 AS DECIMAL(10,0)) - o_custkey AS STRING) AS difference")


