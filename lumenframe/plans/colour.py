"""Queries of colour operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import color
from lumenframe.functions.steps import applied, as_sql
from lumenframe.plans.registry import query
from lumenframe.sources.derived import PIXELS_SQL, pixels

_KEY = "image_id, x, y"


def _rounded(names: list[str], places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) + 0e0 AS {n}" for n in names)  # no negative zeros


def _scalar(name: str, steps, columns: list[str], base: str = PIXELS_SQL, prepare=pixels) -> None:
    """A query that adds columns to each pixel, and the same nested selects as SQL."""

    @query(name, as_sql(base, steps, f"{_KEY}, {_rounded(columns)}"))
    def run(spark, sf_dir):
        return applied(prepare(spark, sf_dir), steps).selectExpr("image_id", "x", "y", *[f"round({c}, 6) + 0e0 AS {c}" for c in columns])


_scalar("color_xyz_1931", color.xyz_1931(), ["cx", "cy", "cz"])
_scalar("color_chromaticity_xy", color.chromaticity(), ["chx", "chy"])
_scalar("color_xyz_srgb", color.xyz_srgb(), ["px", "py", "pz"])
_scalar("color_xyz_srgb_variant", color.xyz_srgb(standard=False), ["px", "py", "pz"])
_scalar("color_lab", color.lab(), ["lab_l", "lab_a", "lab_b"])
_scalar("color_luv", color.luv(), ["luv_l", "luv_u", "luv_v"])
_scalar("color_lch_lab", color.lch_lab(), ["lab_l", "lch_c", "lch_h"])
_scalar("color_lch_luv", color.lch_luv(), ["luv_l", "lchuv_c", "lchuv_h"])
_scalar("color_hsv", color.hsv(), ["hue", "sat", "bright"])
_scalar("color_grey_modes", color.grey_modes(), ["grey_mean", "grey_luma", "luma", "bin01"])
_scalar("color_lab_theta", [*color.lab(), *color.polar_theta("lab_a", "lab_b")], ["theta"])
_scalar("color_luv_theta", [*color.luv(), *color.polar_theta("luv_u", "luv_v")], ["theta"])
_scalar("color_xyz_to_rgb", [*color.xyz_srgb(), *color.xyz_to_rgb()], ["or_", "og_", "ob_"])
_scalar("color_white_angle", [*color.chromaticity(), ("dx", "chx - 0.3127e0"), ("dy", "chy - 0.3290e0"), ("wtheta", "CASE WHEN atan2(dy, dx) < 0e0 THEN degrees(atan2(dy, dx)) + 360e0 ELSE degrees(atan2(dy, dx)) END"), ("in_white", "CASE WHEN dx * dx + dy * dy < 0.0025e0 THEN 1 ELSE 0 END")], ["wtheta", "in_white"])
_scalar("color_shifted_theta", [*color.lab(), *color.polar_theta("lab_a", "lab_b"), ("moved", "theta + 60"), ("wrapped", "CASE WHEN moved > 255 THEN moved - 255 WHEN moved < 0 THEN moved + 255 ELSE moved END")], ["wrapped"])

# Differences between each pixel and the next pixel of its row.
_NEXT_SQL = f"SELECT *, lead(r) OVER w AS r_n, lead(g) OVER w AS g_n, lead(b) OVER w AS b_n FROM ({PIXELS_SQL}) WINDOW w AS (PARTITION BY image_id, y ORDER BY x)"
_PAIR = [*color.lab(), *color.second(color.lab(), "_n", ["r", "g", "b"]), ("l1", "lab_l"), ("a1", "lab_a"), ("b1", "lab_b"), ("l2", "lab_l_n"), ("a2", "lab_a_n"), ("b2", "lab_b_n")]


def _with_next(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("image_id", "y").orderBy("x")
    return pixels(spark, sf_dir).withColumns({f"{c}_n": F.lead(c).over(w) for c in "rgb"}).where("r_n IS NOT NULL")


_NEXT_SQL = f"SELECT * FROM ({_NEXT_SQL}) WHERE r_n IS NOT NULL"
_scalar("color_delta_e76", [*_PAIR, *color.delta_e_76()], ["de76"], _NEXT_SQL, _with_next)
_scalar("color_delta_e94", [*_PAIR, *color.delta_e_94()], ["de94"], _NEXT_SQL, _with_next)
_scalar("color_delta_e2000", [*_PAIR, *color.delta_e_2000()], ["de2000"], _NEXT_SQL, _with_next)
_scalar("color_lab_normalised_difference", [*_PAIR, *color.normalised_difference("nd", (100.0, 200.0, 200.0))], ["nd"], _NEXT_SQL, _with_next)


@query("color_group_rgb_stats", f"SELECT image_id, round(avg(r), 6) AS mr, round(avg(g), 6) AS mg, round(avg(b), 6) AS mb, round(stddev_samp(r), 6) AS sr, round(stddev_samp(g), 6) AS sg, round(stddev_samp(b), 6) AS sb FROM ({PIXELS_SQL}) GROUP BY image_id")
def group_rgb(spark, sf_dir):
    """Mean and deviation of the channels of a pixel group; sums merge across tasks."""
    p = pixels(spark, sf_dir)
    return p.groupBy("image_id").agg(*[F.round(F.avg(c), 6).alias(f"m{c}") for c in "rgb"], *[F.round(F.stddev_samp(c), 6).alias(f"s{c}") for c in "rgb"])


@query("color_group_hsv_stats", "SELECT image_id, round(avg(hue), 6) AS mh, round(avg(sat), 6) AS ms, round(avg(bright), 6) AS mv, round(stddev_samp(hue), 6) AS dh, round(stddev_samp(sat), 6) AS ds, round(stddev_samp(bright), 6) AS dv FROM (" + as_sql(PIXELS_SQL, color.hsv()) + ") GROUP BY image_id")
def group_hsv(spark, sf_dir):
    p = applied(pixels(spark, sf_dir), color.hsv())
    return p.groupBy("image_id").agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("hue", "mh"), ("sat", "ms"), ("bright", "mv"))], *[F.round(F.stddev_samp(c), 6).alias(n) for c, n in (("hue", "dh"), ("sat", "ds"), ("bright", "dv"))])


@query("color_group_lab_differences", "WITH g AS (SELECT image_id, avg(lab_l) AS l, avg(lab_a) AS a, avg(lab_b) AS bb FROM (" + as_sql(PIXELS_SQL, color.lab()) + ") GROUP BY image_id) " + as_sql("SELECT p.image_id, p.l AS l1, p.a AS a1, p.bb AS b1, q.l AS l2, q.a AS a2, q.bb AS b2 FROM g p JOIN g q ON q.image_id = p.image_id + 1", color.delta_e_2000(), "image_id, round(de2000, 6) AS de2000, round(abs(l1 - l2), 6) AS dl, round(abs(a1 - a2), 6) AS da, round(abs(b1 - b2), 6) AS db"))
def group_lab(spark, sf_dir):
    """Average Lab of each image against that of the next one."""
    g = applied(pixels(spark, sf_dir), color.lab()).groupBy("image_id").agg(F.avg("lab_l").alias("l"), F.avg("lab_a").alias("a"), F.avg("lab_b").alias("bb"))
    p = g.selectExpr("image_id", "l AS l1", "a AS a1", "bb AS b1")
    q = g.selectExpr("image_id - 1 AS image_id", "l AS l2", "a AS a2", "bb AS b2")
    return applied(p.join(q, "image_id"), color.delta_e_2000()).selectExpr("image_id", "round(de2000, 6) AS de2000", "round(abs(l1 - l2), 6) AS dl", "round(abs(a1 - a2), 6) AS da", "round(abs(b1 - b2), 6) AS db")


@query("color_mode", as_sql(f"SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM ({PIXELS_SQL}) GROUP BY image_id", color.colour_mode(), "image_id, mode"))
def mode(spark, sf_dir):
    return applied(pixels(spark, sf_dir).groupBy("image_id").agg(*[F.avg(c).alias(f"m{c}") for c in "rgb"]), color.colour_mode()).select("image_id", "mode")
