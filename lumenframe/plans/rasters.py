"""Queries of raster, histogram and threshold operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import color
from lumenframe.functions.steps import applied, as_sql
from lumenframe.operators import histogram, raster
from lumenframe.plans.registry import query
from lumenframe.sources.derived import PIXELS_SQL, WIDTH, labelled, pixels

PX = f"px AS ({PIXELS_SQL})"


@query("raster_pixel_index", f"WITH {PX} SELECT image_id, x, y, y * 32 + x AS idx, (y * 32 + x) % 32 AS col_, (y * 32 + x) // 32 AS row_ FROM px")
def index(spark, sf_dir):
    return raster.pixel_index(pixels(spark, sf_dir), WIDTH).select("image_id", "x", "y", "idx", "col_", "row_")


@query("raster_crop", f"WITH {PX} SELECT image_id, x - 4 AS x, y - 6 AS y, v FROM px WHERE x BETWEEN 4 AND 19 AND y BETWEEN 6 AND 21")
def crop(spark, sf_dir):
    return raster.crop(pixels(spark, sf_dir), 4, 6, 19, 21).select("image_id", "x", "y", "v")


@query("raster_paste", f"WITH {PX} SELECT image_id, x, y, v FROM px WHERE x BETWEEN 4 AND 19 AND y BETWEEN 6 AND 21")
def paste(spark, sf_dir):
    return raster.paste(raster.crop(pixels(spark, sf_dir), 4, 6, 19, 21), 4, 6).select("image_id", "x", "y", "v")


@query("raster_arithmetic", f"WITH {PX} SELECT image_id, x, y, v + r AS added, v - r AS subtracted, v * r AS multiplied FROM px")
def arithmetic(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return raster.arithmetic(p.select("image_id", "x", "y", "v"), p.select("image_id", "x", "y", "r").withColumnRenamed("r", "v")).select("image_id", "x", "y", "added", "subtracted", "multiplied")


@query("raster_constant_arithmetic", f"WITH {PX} SELECT image_id, x, y, v + 10 AS plus, v * 3 AS times, v // 7 AS over, greatest(0, least(255, 2 * v - 100)) AS clipped FROM px")
def constant(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumns({"plus": F.expr("v + 10"), "times": F.expr("v * 3"), "over": F.expr("v div 7"), "clipped": F.expr("2 * v - 100")})
    return raster.clipped(p, "clipped").select("image_id", "x", "y", "plus", "times", "over", "clipped")


@query("raster_extremes", f"""WITH {PX}, lo AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v, y, x) AS k FROM px), hi AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS k FROM px),
    c AS (SELECT image_id, count(*) AS n FROM px GROUP BY image_id) SELECT c.image_id, n, lo.v AS vmin, lo.x AS xmin, lo.y AS ymin, hi.v AS vmax, hi.x AS xmax, hi.y AS ymax FROM c JOIN lo USING (image_id) JOIN hi USING (image_id) WHERE lo.k = 1 AND hi.k = 1""")
def extremes(spark, sf_dir):
    return raster.extremes(pixels(spark, sf_dir))


@query("raster_rescale", f"WITH {PX} SELECT image_id, x, y, round(10 + (v - min(v) OVER w) * 190.0::DOUBLE / (max(v) OVER w - min(v) OVER w), 6) AS scaled FROM px WINDOW w AS (PARTITION BY image_id)")
def rescale(spark, sf_dir):
    return raster.rescaled(pixels(spark, sf_dir), 10, 200).selectExpr("image_id", "x", "y", "round(scaled, 6) AS scaled")


@query("raster_normalize_max", f"WITH {PX} SELECT image_id, x, y, CAST(floor(v * 255 / max(v) OVER (PARTITION BY image_id)) AS BIGINT) AS norm FROM px")
def normalise(spark, sf_dir):
    return raster.normalised_to_max(pixels(spark, sf_dir)).select("image_id", "x", "y", "norm")


@query("raster_nonzero", f"WITH {PX} SELECT image_id, count(*) AS n, sum(CASE WHEN v % 16 <> 0 THEN 1 ELSE 0 END)::BIGINT AS nonzero, sum(CASE WHEN v % 16 <> 0 THEN y * 32 + x ELSE 0 END)::BIGINT AS idx_sum FROM px GROUP BY image_id")
def nonzero(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"), F.expr("sum(CASE WHEN v % 16 <> 0 THEN 1 ELSE 0 END)").alias("nonzero"), F.expr("sum(CASE WHEN v % 16 <> 0 THEN y * 32 + x ELSE 0 END)").alias("idx_sum"))


_AROUND_SQL = "SELECT p.image_id, p.x, p.y, p.v, min(q.v) AS lo, max(q.v) AS hi, count(q.v) AS k FROM px p LEFT JOIN px q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND (q.x <> p.x OR q.y <> p.y) GROUP BY ALL"


@query("raster_single_pixel_filter", f"WITH px AS (SELECT image_id, x, y, v // 200 AS v FROM ({PIXELS_SQL})) SELECT image_id, x, y, CASE WHEN lo = hi AND lo <> v THEN lo ELSE v END AS filtered FROM ({_AROUND_SQL})")
def single(spark, sf_dir):
    return raster.without_single_pixels(pixels(spark, sf_dir).withColumn("v", F.expr("v div 200"))).select("image_id", "x", "y", "filtered")


_BINARY_SQL = f"px AS (SELECT image_id, x, y, CASE WHEN v >= 160 THEN 1 ELSE 0 END AS v FROM ({PIXELS_SQL}))"


def _binary(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "x", "y", F.expr("CASE WHEN v >= 160 THEN 1 ELSE 0 END").alias("v"))


def _morph(sql: str, dilate: bool) -> str:
    pick, missing = ("max", 0) if dilate else ("min", 1)
    return f"SELECT p.image_id, p.x, p.y, {pick}(q.v) AS v FROM ({sql}) p JOIN ({sql}) q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL"


@query("morph_dilate", f"WITH {_BINARY_SQL} {_morph('SELECT * FROM px', True)}")
def dilate(spark, sf_dir):
    return raster.morphology(_binary(spark, sf_dir), True)


@query("morph_erode", f"WITH {_BINARY_SQL} {_morph('SELECT * FROM px', False)}")
def erode(spark, sf_dir):
    return raster.morphology(_binary(spark, sf_dir), False)


@query("morph_opening", f"WITH {_BINARY_SQL}, e AS ({_morph('SELECT * FROM px', False)}) {_morph('SELECT * FROM e', True)}")
def opening(spark, sf_dir):
    return raster.morphology(raster.morphology(_binary(spark, sf_dir), False), True)


@query("morph_closing", f"WITH {_BINARY_SQL}, e AS ({_morph('SELECT * FROM px', True)}) {_morph('SELECT * FROM e', False)}")
def closing(spark, sf_dir):
    return raster.morphology(raster.morphology(_binary(spark, sf_dir), True), False)


def _box_sql(half: int, columns: str, extra: str = "") -> str:
    return f"SELECT p.image_id, p.x, p.y, any_value(p.v) AS v, {columns} FROM px p JOIN px q ON q.image_id = p.image_id AND q.x BETWEEN p.x - {half} AND p.x + {half} AND q.y BETWEEN p.y - {half} AND p.y + {half} GROUP BY p.image_id, p.x, p.y"


@query("window_box_mean", f"WITH {PX} SELECT image_id, x, y, n, s, s // n AS mean FROM ({_box_sql(2, 'count(*) AS n, sum(q.v)::BIGINT AS s')})")
def box_mean(spark, sf_dir):
    return raster.box(pixels(spark, sf_dir), 2).selectExpr("image_id", "x", "y", "box_n AS n", "box_sum AS s", "box_sum div box_n AS mean")


@query("window_maximum_filter", f"WITH {PX} SELECT image_id, x, y, hi AS box_max, CASE WHEN v = hi THEN 1 ELSE 0 END AS peak FROM ({_box_sql(2, 'max(q.v) AS hi')})")
def maximum(spark, sf_dir):
    return raster.box(pixels(spark, sf_dir), 2).selectExpr("image_id", "x", "y", "box_max", "CASE WHEN v = box_max THEN 1 ELSE 0 END AS peak")


@query("window_unit_deviation", f"WITH {PX} SELECT image_id, x, y, round((v - m) / nullif(sd, 0), 5) AS z FROM ({_box_sql(3, 'avg(q.v) AS m, stddev_samp(q.v) AS sd')})")
def unit_deviation(spark, sf_dir):
    """Local standardisation by window sums (mean and sample deviation from n, sum and sum of squares)."""
    b = raster.box(pixels(spark, sf_dir), 3, squares=True)
    return b.selectExpr("image_id", "x", "y", "round((v - box_sum / box_n) / nullif(sqrt((box_sum2 - box_sum * box_sum / box_n) / (box_n - 1)), 0), 5) AS z")


@query("threshold_adaptive_mean", f"WITH {PX} SELECT image_id, x, y, CASE WHEN v > m - 7 THEN 255 ELSE 0 END AS out FROM ({_box_sql(3, 'avg(q.v) AS m')})")
def adaptive_mean(spark, sf_dir):
    return raster.box(pixels(spark, sf_dir), 3).selectExpr("image_id", "x", "y", "CASE WHEN v > box_sum / box_n - 7 THEN 255 ELSE 0 END AS out")


@query("threshold_adaptive", f"""WITH {PX}, m AS ({_box_sql(7, 'avg(q.v) AS m')}), d AS (SELECT image_id, x, y, v, m, (v - m) * (v - m) AS v2 FROM m), px2 AS (SELECT image_id, x, y, v2 AS v FROM d),
    s AS (SELECT p.image_id, p.x, p.y, sqrt(avg(q.v)) AS s FROM px2 p JOIN px2 q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 7 AND p.x + 7 AND q.y BETWEEN p.y - 7 AND p.y + 7 GROUP BY ALL),
    r AS (SELECT image_id, (max(v) + min(v)) / 2.0::DOUBLE AS r FROM px GROUP BY image_id) SELECT image_id, x, y, round(m * (1 + 0.2::DOUBLE * (s / r - 1)), 5) AS t FROM d JOIN s USING (image_id, x, y) JOIN r USING (image_id)""")
def adaptive(spark, sf_dir):
    return raster.adaptive_threshold(pixels(spark, sf_dir), 7).selectExpr("image_id", "x", "y", "round(t, 5) AS t")


@query("threshold_unsharp_mask", f"WITH {PX} SELECT image_id, x, y, CASE WHEN abs(v - m) >= 5 THEN greatest(0, least(255, CAST(trunc(0.6::DOUBLE * (v - m) + v) AS INTEGER))) ELSE v END AS out FROM ({_box_sql(1, 'avg(q.v) AS m')})")
def unsharp(spark, sf_dir):
    return raster.box(pixels(spark, sf_dir), 1).withColumn("m", F.expr("box_sum / box_n")).selectExpr("image_id", "x", "y", "CASE WHEN abs(v - m) >= 5 THEN greatest(0, least(255, CAST(0.6D * (v - m) + v AS INT))) ELSE v END AS out")


@query("raster_integral", f"WITH {PX} SELECT p.image_id, p.x, p.y, sum(q.v)::BIGINT AS sat FROM px p JOIN px q ON q.image_id = p.image_id AND q.x <= p.x AND q.y <= p.y GROUP BY ALL")
def integral(spark, sf_dir):
    return raster.integral(pixels(spark, sf_dir)).select("image_id", "x", "y", "sat")


@query("raster_column_sums", f"WITH {PX} SELECT image_id, x, y, (sum(v) OVER (PARTITION BY image_id, x ORDER BY y))::BIGINT AS col_sum FROM px")
def column_sums(spark, sf_dir):
    return raster.column_sums(pixels(spark, sf_dir)).select("image_id", "x", "y", "col_sum")


@query("raster_bin_image", f"WITH {PX} SELECT image_id, x // 3 AS x, y // 3 AS y, CAST(floor(avg(v) + 0.5) AS INTEGER) AS v FROM px GROUP BY image_id, x // 3, y // 3")
def binned(spark, sf_dir):
    return raster.binned(pixels(spark, sf_dir), 3)


@query("raster_unbin_image", f"WITH {PX}, s AS (SELECT image_id, x // 4 AS x, y // 4 AS y, CAST(floor(avg(v) + 0.5) AS INTEGER) AS v FROM px GROUP BY ALL), k AS (SELECT unnest([0, 1]) AS d) SELECT image_id, 2 * x + a.d AS x, 2 * y + c.d AS y, v FROM s, k a, k c")
def unbinned(spark, sf_dir):
    return raster.unbinned(raster.binned(pixels(spark, sf_dir), 4), 2)


@query("hist_counts", f"WITH {PX} SELECT image_id, v AS bin, count(*) AS n FROM px GROUP BY ALL")
def hist(spark, sf_dir):
    return histogram.counts(pixels(spark, sf_dir))


@query("hist_cumulative", f"WITH {PX}, h AS (SELECT image_id, v AS bin, count(*) AS n FROM px GROUP BY ALL) SELECT image_id, bin, n, (sum(n) OVER (PARTITION BY image_id ORDER BY bin))::BIGINT AS cdf FROM h")
def cumulative(spark, sf_dir):
    return histogram.counts(pixels(spark, sf_dir)).withColumn("cdf", F.sum("n").over(Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


@query("hist_equalize", f"""WITH {PX}, k AS (SELECT DISTINCT image_id, unnest(range(256))::INTEGER AS bin FROM px), h AS (SELECT image_id, v AS bin, count(*) AS n FROM px GROUP BY ALL),
    c AS (SELECT image_id, bin, sum(coalesce(n, 0)) OVER (PARTITION BY image_id ORDER BY bin) AS cdf FROM k LEFT JOIN h USING (image_id, bin)),
    m AS (SELECT image_id, min(cdf) FILTER (WHERE bin > 0 AND cdf > 0) AS low, max(cdf) AS total FROM c GROUP BY image_id)
    SELECT image_id, x, y, v, CASE WHEN v = 0 THEN 0 ELSE CAST(coalesce(floor((cdf - low) * 254 / nullif(total - low, 0)::DOUBLE + 0.5), 0) AS INTEGER) + 1 END AS equalised FROM px JOIN c ON c.image_id = px.image_id AND c.bin = px.v JOIN m ON m.image_id = px.image_id""".replace("SELECT image_id, x, y, v, CASE", "SELECT px.image_id, x, y, v, CASE"))
def equalize(spark, sf_dir):
    return histogram.equalised(pixels(spark, sf_dir)).select("image_id", "x", "y", "v", "equalised")


@query("threshold_otsu", f"""WITH {PX}, h AS (SELECT image_id, v AS bin, count(*)::DOUBLE AS n FROM px GROUP BY ALL), a AS (SELECT p.image_id, p.bin, sum(q.n) FILTER (WHERE q.bin <= p.bin) AS w0, sum(q.n * q.bin) FILTER (WHERE q.bin <= p.bin) AS s0, sum(q.n) AS w, sum(q.n * q.bin) AS s FROM h p JOIN h q ON p.image_id = q.image_id GROUP BY ALL),
    t AS (SELECT image_id, bin, coalesce(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), 0) AS between FROM a) SELECT image_id, threshold FROM (SELECT image_id, bin AS threshold, row_number() OVER (PARTITION BY image_id ORDER BY round(between, 3) DESC, bin) AS k FROM t) WHERE k = 1""")
def otsu(spark, sf_dir):
    return histogram.otsu(pixels(spark, sf_dir)).select("image_id", "threshold")


@query("stats_quartiles", f"""WITH {PX}, s AS (SELECT image_id, list_sort(list(v)) AS l, count(*) AS n, avg(v) AS m FROM px GROUP BY image_id)
    SELECT image_id, CAST(floor(m) AS BIGINT) AS mean, l[n // 2 + 1] AS median, l[n // 4 + 1] AS q1, l[n // 2 + 1] AS q2, l[(n * 3) // 4 + 1] AS q3, l[n] AS q4 FROM s""")
def quartiles(spark, sf_dir):
    return histogram.quantile_picks(pixels(spark, sf_dir))


_CH = "ch AS (SELECT image_id, channel, CAST(val // 16 AS INTEGER) AS bin, count(*) AS n FROM (SELECT image_id, 'r' AS channel, r AS val FROM px UNION ALL SELECT image_id, 'g', g FROM px UNION ALL SELECT image_id, 'b', b FROM px) GROUP BY ALL)"


@query("hist_rgb16", f"WITH {PX}, {_CH} SELECT * FROM ch")
def rgb16(spark, sf_dir):
    return histogram.channel_histograms(pixels(spark, sf_dir), ("r", "g", "b"))


@query("hist_similarity", f"""WITH {PX}, {_CH}, s AS (SELECT *, n / (sum(n) OVER (PARTITION BY image_id, channel))::DOUBLE AS p FROM ch), pairs AS (SELECT DISTINCT image_id AS a, image_id + 1 AS b FROM px WHERE image_id + 1 IN (SELECT image_id FROM px)),
    f AS (SELECT a, b, channel, bin, sum(pa) AS pa, sum(pb) AS pb FROM (SELECT a, b, channel, bin, p AS pa, 0 AS pb FROM pairs JOIN s ON s.image_id = a UNION ALL SELECT a, b, channel, bin, 0, p FROM pairs JOIN s ON s.image_id = b) GROUP BY ALL),
    c AS (SELECT a, b, channel, sum(least(pa, pb)) AS i, sum(0.5 * (pa - pb) * (pa - pb) / (pa + pb)) AS c FROM f GROUP BY ALL) SELECT a, b, round(avg(i), 6) AS intersection, round(avg(c), 6) AS chi2 FROM c GROUP BY a, b""")
def hist_similarity(spark, sf_dir):
    p = pixels(spark, sf_dir)
    ids = p.select("image_id").distinct()
    pairs = ids.select(F.col("image_id").alias("a"), (F.col("image_id") + 1).alias("b")).join(ids.select(F.col("image_id").alias("b")), "b", "left_semi")
    return histogram.similarity(histogram.channel_histograms(p, ("r", "g", "b")), pairs).selectExpr("a", "b", "round(intersection, 6) AS intersection", "round(chi2, 6) AS chi2")


_THETA = [*color.lab(), *color.polar_theta("lab_a", "lab_b")]


@query("hist_hue_classes", "SELECT image_id, CASE WHEN theta >= 193 THEN 5 WHEN theta >= 107 THEN 4 WHEN theta >= 61 THEN 3 WHEN theta >= 41 THEN 2 WHEN theta >= 19 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM (" + as_sql(PIXELS_SQL, _THETA) + ") GROUP BY ALL")
def hue(spark, sf_dir):
    return histogram.hue_classes(applied(pixels(spark, sf_dir), _THETA))


@query("hist_peaks", f"WITH {PX}, h AS (SELECT image_id, v // 8 AS bin, count(*) AS n FROM px GROUP BY ALL) SELECT image_id, min(bin) AS first_bin, max(bin) AS last_bin, (SELECT q.bin FROM h q WHERE q.image_id = h.image_id ORDER BY n DESC, bin LIMIT 1) AS mode_bin FROM h GROUP BY image_id")
def peaks(spark, sf_dir):
    return histogram.last_and_first_bins(histogram.counts(pixels(spark, sf_dir).withColumn("v", F.expr("v div 8"))))


@query("hist_add", f"WITH {PX}, h AS (SELECT image_id, v AS bin, count(*) AS n FROM px GROUP BY ALL) SELECT image_id // 2 AS pair, bin, sum(n)::BIGINT AS n FROM h GROUP BY ALL")
def hist_add(spark, sf_dir):
    return histogram.counts(pixels(spark, sf_dir)).groupBy(F.expr("image_id div 2").alias("pair"), "bin").agg(F.sum("n").alias("n"))


@query("label_mean_color", f"WITH l AS (SELECT image_id, CAST((x // 5) + 7 * (y // 6) + (v // 128) AS INTEGER) AS label, x, y, r, g, b FROM ({PIXELS_SQL})), m AS (SELECT image_id, label, CAST(floor(avg(r)) AS INTEGER) AS mr, CAST(floor(avg(g)) AS INTEGER) AS mg, CAST(floor(avg(b)) AS INTEGER) AS mb FROM l GROUP BY ALL) SELECT image_id, x, y, mr, mg, mb FROM l JOIN m USING (image_id, label)")
def label_mean(spark, sf_dir):
    """Each pixel takes the truncated mean colour of its label."""
    l = labelled(spark, sf_dir)  # noqa: E741
    m = l.groupBy("image_id", "label").agg(*[F.floor(F.avg(c)).cast("int").alias(f"m{c}") for c in "rgb"])
    return l.join(m, ["image_id", "label"]).select("image_id", "x", "y", "mr", "mg", "mb")


@query("label_moments", f"WITH l AS (SELECT image_id, CAST((x // 5) + 7 * (y // 6) + (v // 128) AS INTEGER) AS label, x, y FROM ({PIXELS_SQL})) SELECT image_id, label, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, sum(x)::BIGINT AS m10, sum(y)::BIGINT AS m01, sum(x * x)::BIGINT AS m20, sum(x * y)::BIGINT AS m11, sum(y * y)::BIGINT AS m02, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l GROUP BY ALL")
def moments(spark, sf_dir):
    """Area, centroid, first and second moments and bounding box of each region."""
    l = labelled(spark, sf_dir)  # noqa: E741
    return l.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.sum("x").alias("m10"), F.sum("y").alias("m01"), F.sum(F.expr("x * x")).alias("m20"), F.sum(F.expr("x * y")).alias("m11"), F.sum(F.expr("y * y")).alias("m02"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("label_adjacency", f"WITH l AS (SELECT image_id, CAST((x // 5) + 7 * (y // 6) + (v // 128) AS INTEGER) AS label, x, y FROM ({PIXELS_SQL})), e AS (SELECT p.image_id, p.label AS a, q.label AS b FROM l p JOIN l q ON p.image_id = q.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) WHERE p.label <> q.label) SELECT image_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS border FROM e GROUP BY ALL")
def adjacency(spark, sf_dir):
    """Region adjacency: pairs of labels that are 4-neighbours, with the length of their border."""
    l = labelled(spark, sf_dir).select("image_id", "x", "y", F.col("label").alias("v"))  # noqa: E741
    l = raster.shifted(raster.shifted(l, "v", 1, 0, "e"), "v", 0, 1, "s")  # noqa: E741
    edges = l.select("image_id", "v", F.explode(F.array("e", "s")).alias("o")).where("o IS NOT NULL AND o <> v")
    return edges.groupBy("image_id", F.least("v", "o").alias("a"), F.greatest("v", "o").alias("b")).agg(F.count("*").alias("border"))


@query("label_condense", f"WITH l AS (SELECT image_id, y * 32 + x AS idx, CAST((x // 5) + 7 * (y // 6) + (v // 128) AS INTEGER) AS label FROM ({PIXELS_SQL})), f AS (SELECT image_id, label, min(idx) AS first FROM l GROUP BY ALL) SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY first) - 1 AS dense FROM f")
def condense(spark, sf_dir):
    """Dense labels in first-seen order."""
    l = labelled(spark, sf_dir).groupBy("image_id", "label").agg(F.min(F.expr("y * 32 + x")).alias("first"))  # noqa: E741
    return l.select("image_id", "label", (F.row_number().over(Window.partitionBy("image_id").orderBy("first")) - 1).alias("dense"))
