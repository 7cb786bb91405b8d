"""Queries of corners across scales, robust fits, packed points and merged regions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenframe.functions import color
from lumenframe.functions.steps import applied, as_sql
from lumenframe.operators import corners, filters, fits, merging, packing, raster
from lumenframe.plans.curves import _XY_SQL, _conv_sql
from lumenframe.plans.registry import query
from lumenframe.sources.derived import LABELS_SQL, PIXELS_SQL, curves, labelled, pixels, table

# Corners ----------------------------------------------------------------------------------------------------
SIGMAS = (4.0, 2.8, 2.0, 1.4)


def _candidates_sql(k: int, sigma: float) -> str:
    """CTEs k{k} (curvatures) and c{k} (candidates) of a scale."""
    g1, g2 = ([(-1) ** d * w for w in filters.gaussian(sigma, d)] for d in (1, 2))
    parts = " JOIN ".join(f"{_conv_sql('xy', g, 'curve_id', 'pos', c, f'{c}{d}', 'curve_id, pos')} USING (curve_id, pos)" for c in "xy" for d, g in ((1, g1), (2, g2)))
    parts = parts.replace(" USING (curve_id, pos)", "", 1)
    return f"""k{k} AS MATERIALIZED (SELECT curve_id, pos, abs(coalesce((x1 * y2 - y1 * x2) / nullif(pow(x1 * x1 + y1 * y1, 1.5e0), 0), 0)) AS k FROM {parts}),
        q{k} AS (SELECT curve_id, quantile_cont(k, 0.75) AS q3 FROM k{k} GROUP BY curve_id),
        h{k} AS (SELECT curve_id, any_value(q3) AS q3, [{", ".join(f"count(*) FILTER (WHERE floor(k / nullif(q3 * 2, 0) * 16) = {b})" for b in range(16))}] AS h FROM k{k} JOIN q{k} USING (curve_id) GROUP BY curve_id),
        p{k} AS (SELECT *, coalesce(list_filter(range(0, 15), lambda b: h[b + 1] > h[b + 2])[1], 15) AS peak FROM h{k}),
        t{k} AS (SELECT curve_id, (coalesce(list_filter(range(0, 15), lambda b: b > peak AND h[b + 1] < h[b + 2])[1], 15) + 0.5e0) * 2 * q3 / 16 AS low FROM p{k}),
        n{k} AS (SELECT *, lag(k) OVER w AS before, lead(k) OVER w AS after FROM k{k} WINDOW w AS (PARTITION BY curve_id ORDER BY pos)),
        x{k} AS (SELECT *, k > before AS top FROM n{k} WHERE (k > before AND k > after) OR (k < before AND k < after)),
        s{k} AS (SELECT *, CASE WHEN NOT lag(top) OVER w THEN lag(k) OVER w END AS m0, CASE WHEN NOT lead(top) OVER w THEN lead(k) OVER w END AS m1 FROM x{k} WINDOW w AS (PARTITION BY curve_id ORDER BY pos)),
        c{k} AS MATERIALIZED (SELECT curve_id, pos, k FROM s{k} JOIN t{k} USING (curve_id) WHERE top AND k >= low AND (coalesce(k > 2 * m0, false) OR coalesce(k > 2 * m1, false) OR (m0 IS NULL AND m1 IS NULL)))"""


def _tracked_sql() -> str:
    steps = [_XY_SQL, *[_candidates_sql(k, s) for k, s in enumerate(SIGMAS)], "w0 AS (SELECT curve_id, pos AS corner, pos, k, 0 AS lost FROM c0)"]
    for k, s in enumerate(SIGMAS[:-1]):
        steps.append(f"""b{k} AS (SELECT w.curve_id, w.corner, c.pos, c.k, row_number() OVER (PARTITION BY w.curve_id, w.corner ORDER BY abs(c.pos - w.pos), c.pos) AS n FROM w{k} w JOIN c{k + 1} c ON c.curve_id = w.curve_id AND abs(c.pos - w.pos) <= {math.ceil(s)}),
            w{k + 1} AS MATERIALIZED (SELECT w.curve_id, w.corner, coalesce(b.pos, w.pos) AS pos, coalesce(b.k, w.k) AS k, lost + CASE WHEN b.pos IS NULL THEN 1 ELSE 0 END AS lost FROM w{k} w LEFT JOIN b{k} b ON b.curve_id = w.curve_id AND b.corner = w.corner AND b.n = 1)""")
    return f"WITH {', '.join(steps)} SELECT curve_id, corner, pos, round(k, 5) AS k, lost FROM w{len(SIGMAS) - 1}"


def _xy(spark, sf_dir):
    return curves(spark, sf_dir).selectExpr("curve_id", "pos", "pos * 1D AS x", "v AS y")


@query("corner_scale_candidates", f"WITH {_XY_SQL}, {_candidates_sql(0, SIGMAS[0])} SELECT curve_id, pos, round(k, 5) AS k FROM c0")
def corner_candidates(spark, sf_dir):
    return corners.candidates(_xy(spark, sf_dir), SIGMAS[0]).withColumn("k", F.round("k", 5))


@query("corner_scale_tracks", _tracked_sql())
def corner_tracks(spark, sf_dir):
    """Corners at a blur of 4, followed down to 1.4."""
    return corners.tracked(_xy(spark, sf_dir), SIGMAS).withColumn("k", F.round("k", 5))


# Robust fits ------------------------------------------------------------------------------------------------
_FIT_SQL = """pts AS MATERIALIZED (SELECT l_suppkey AS set_id, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
    few AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY md5(concat_ws(':', set_id, l_orderkey, l_linenumber)), x, y) AS n FROM pts), pool AS (SELECT set_id, list({'x': x, 'y': y} ORDER BY n) AS p, count(*) AS n FROM few WHERE n <= 64 GROUP BY set_id),
    three AS (SELECT set_id, h, p[h % n + 1] AS s0, p[(h * 3 + h + 3) % n + 1] AS s1, p[(h * 5 + 2 * (h + 3)) % n + 1] AS s2 FROM pool, range(24) r(h)),
    slopes AS (SELECT *, (s1.y - s0.y) / (s1.x - s0.x) AS d0, (s2.y - s1.y) / (s2.x - s1.x) AS d1 FROM three WHERE s0.x <> s1.x AND s1.x <> s2.x AND s0.x <> s2.x),
    hyp AS MATERIALIZED (SELECT set_id, h, (d1 - d0) / (s2.x - s0.x) AS a, d0 - (d1 - d0) / (s2.x - s0.x) * (s0.x + s1.x) AS b, s0.y - s0.x * (d0 - (d1 - d0) / (s2.x - s0.x) * s1.x) AS c FROM slopes)"""


def _fit_points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS set_id", "l_orderkey", "l_linenumber", "l_quantity AS x", "l_extendedprice / 1000 AS y")


@query("fit_sampled_parabolas", f"WITH {_FIT_SQL} SELECT set_id, h, round(a + 1e-7, 4) AS a, round(b + 1e-7, 4) AS b, round(c + 1e-7, 4) AS c FROM hyp")
def sampled_parabolas(spark, sf_dir):
    """Parabolas through three of the points of a supplier's lines: price by quantity."""
    made = fits.parabola_hypotheses(_fit_points(spark, sf_dir), "set_id", ["l_orderkey", "l_linenumber"])
    return made.select("set_id", "h", *[F.expr(f"round({c} + 1e-7, 4) AS {c}") for c in "abc"])  # ties are exact decimals: off the edge


@query("fit_robust_parabola", f"""WITH {_FIT_SQL}, votes AS (SELECT set_id, h, count(*) AS n, sum(CASE WHEN abs(y - (a * x * x + b * x + c)) <= 2 THEN 1 ELSE 0 END)::BIGINT AS inliers FROM pts JOIN hyp USING (set_id) GROUP BY set_id, h),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY inliers DESC, h) AS k FROM votes) WHERE k = 1),
    kept AS (SELECT set_id, best.h, best.n, inliers, x, y FROM pts JOIN best USING (set_id) JOIN hyp USING (set_id) WHERE hyp.h = best.h AND abs(y - (a * x * x + b * x + c)) <= 2),
    m AS (SELECT set_id, h, n AS all_n, inliers, count(*)::DOUBLE AS n, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM kept GROUP BY set_id, h, all_n, inliers),
    d AS (SELECT *, nullif(s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2), 0) AS det FROM m)
    SELECT set_id, h, all_n AS n, inliers, round((t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / det, 3) + 0e0 AS a,
        round((s4 * (t1 * n - s1 * t0) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / det, 3) + 0e0 AS b, round((s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / det, 3) + 0e0 AS c FROM d""")  # fmt: skip
def robust_parabola(spark, sf_dir):
    """Price by quantity of a supplier's lines: the parabola near most of them, refitted to these."""
    made = fits.robust_parabola(_fit_points(spark, sf_dir), "set_id", ["l_orderkey", "l_linenumber"], 2.0)
    return made.select("set_id", "h", "n", "inliers", *[F.expr(f"round({c}, 3) + 0D AS {c}") for c in "abc"])


# Packing ----------------------------------------------------------------------------------------------------
_BOTH_SQL = f"pts AS MATERIALIZED (SELECT a.image_id, a.y * 32 + a.x AS id, a.x, a.y, md5(concat_ws(':', a.image_id, a.y * 32 + a.x)) AS h FROM (SELECT * FROM ({PIXELS_SQL}) WHERE v % 3 <> 0) a SEMI JOIN (SELECT * FROM ({PIXELS_SQL}) WHERE r % 2 = 0) b ON b.image_id = a.image_id + 1 AND b.x = a.x AND b.y = a.y)"


def _packed_sql(limit: int, rounds: int = 14) -> str:
    near = f"near AS MATERIALIZED (SELECT p.image_id, p.id AS p, q.id AS q FROM pts p JOIN pts q ON p.image_id = q.image_id AND p.id <> q.id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) < {limit * limit})"
    steps = [_BOTH_SQL, near, "u0 AS (SELECT image_id, id, h FROM pts)"]
    for k in range(1, rounds + 1):
        steps.append(f"c{k} AS MATERIALIZED (SELECT image_id, id FROM u{k - 1} u WHERE NOT EXISTS (SELECT 1 FROM near n JOIN u{k - 1} o ON o.image_id = n.image_id AND o.id = n.q WHERE n.image_id = u.image_id AND n.p = u.id AND (o.h, o.id) < (u.h, u.id)))")
        steps.append(f"u{k} AS MATERIALIZED (SELECT * FROM u{k - 1} u WHERE NOT EXISTS (SELECT 1 FROM c{k} c WHERE c.image_id = u.image_id AND c.id = u.id) AND NOT EXISTS (SELECT 1 FROM near n JOIN c{k} c ON c.image_id = n.image_id AND c.id = n.q WHERE n.image_id = u.image_id AND n.p = u.id))")
    return f"WITH {', '.join(steps)} SELECT image_id, id, x, y, round FROM pts JOIN ({' UNION ALL '.join(f'SELECT image_id, id, {k} AS round FROM c{k}' for k in range(1, rounds + 1))}) USING (image_id, id)"


@query("packing_of_intersection", _packed_sql(4))
def packing_of_intersection(spark, sf_dir):
    """Points, no two closer than 4 pixels, in what a set of pixels of an image shares with one of the next image."""
    px = pixels(spark, sf_dir)
    other = px.where("r % 2 = 0").selectExpr("image_id - 1 AS image_id", "x", "y")
    both = px.where("v % 3 <> 0").join(other, ["image_id", "x", "y"], "left_semi").selectExpr("image_id", "y * 32 + x AS id", "x", "y")
    return packing.packed(both, 4)


# Merging ----------------------------------------------------------------------------------------------------
_TWO = [*color.lab(), *color.second(color.lab(), "_n", ["r", "g", "b"]), ("l1", "lab_l"), ("a1", "lab_a"), ("b1", "lab_b"), ("l2", "lab_l_n"), ("a2", "lab_a_n"), ("b2", "lab_b_n"), *color.delta_e_2000()]
_GRAPH_SQL = f"""lb AS MATERIALIZED ({LABELS_SQL}), gr AS (SELECT p.*, abs(coalesce(e.v, p.v) - coalesce(w.v, p.v)) + abs(coalesce(s.v, p.v) - coalesce(n.v, p.v)) AS g_ FROM lb p LEFT JOIN lb e ON e.image_id = p.image_id AND e.y = p.y AND e.x = p.x + 1 LEFT JOIN lb w ON w.image_id = p.image_id AND w.y = p.y AND w.x = p.x - 1
        LEFT JOIN lb s ON s.image_id = p.image_id AND s.x = p.x AND s.y = p.y + 1 LEFT JOIN lb n ON n.image_id = p.image_id AND n.x = p.x AND n.y = p.y - 1),
    node AS MATERIALIZED (SELECT image_id, label, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY g_, y, x) AS k FROM gr) WHERE k = 1),
    adj AS (SELECT DISTINCT p.image_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM lb p JOIN lb q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 WHERE p.label <> q.label),
    two AS (SELECT adj.image_id, adj.a AS na, adj.b AS nb, p.r, p.g, p.b, q.r AS r_n, q.g AS g_n, q.b AS b_n FROM adj JOIN node p ON p.image_id = adj.image_id AND p.label = adj.a JOIN node q ON q.image_id = adj.image_id AND q.label = adj.b),
    edge AS MATERIALIZED (SELECT image_id, na AS a, nb AS b, round(de2000, 6) AS weight FROM ({as_sql("two", _TWO).replace("FROM (two)", "FROM two")}))"""
_FOREST_SQL = f"""{_GRAPH_SQL}, ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY weight, a, b) AS n FROM edge),
    both_ AS MATERIALIZED (SELECT image_id, n, a AS p, b AS q FROM ranked UNION ALL SELECT image_id, n, b, a FROM ranked),
    reach AS (SELECT image_id, n, a AS p FROM ranked UNION SELECT r.image_id, r.n, o.q FROM reach r JOIN both_ o ON o.image_id = r.image_id AND o.p = r.p AND o.n < r.n)"""


def _region_graph(spark, sf_dir):
    """Labels with the colour at their pixel of least gradient, and adjacent ones with their difference."""
    l = labelled(spark, sf_dir)  # noqa: E741
    near = l
    for name, dx, dy in (("_e", 1, 0), ("_w", -1, 0), ("_s", 0, 1), ("_n", 0, -1)):
        near = raster.shifted(near, "v", dx, dy, name)
    gradient = F.expr("abs(coalesce(_e, v) - coalesce(_w, v)) + abs(coalesce(_s, v) - coalesce(_n, v))")
    nodes = near.groupBy("image_id", "label").agg(F.min(F.struct(gradient.alias("g_"), "y", "x", "r", "g", "b")).alias("m")).select("image_id", "label", "m.r", "m.g", "m.b")
    e = raster.shifted(raster.shifted(l.select("image_id", "x", "y", F.col("label").alias("v")), "v", 1, 0, "e"), "v", 0, 1, "s").select("image_id", "v", F.explode(F.array("e", "s")).alias("o")).where("o IS NOT NULL AND o <> v")
    adjacent = e.select("image_id", F.least("v", "o").alias("na"), F.greatest("v", "o").alias("nb")).distinct()
    side = lambda c, s: nodes.select("image_id", F.col("label").alias(c), *[F.col(x).alias(x + s) for x in "rgb"])
    two = adjacent.join(side("na", ""), ["image_id", "na"]).join(side("nb", "_n"), ["image_id", "nb"])
    return nodes, applied(two, _TWO).select("image_id", F.col("na").alias("a"), F.col("nb").alias("b"), F.round("de2000", 6).alias("weight"))


@query("label_merge_forest", f"WITH RECURSIVE {_FOREST_SQL} SELECT image_id, a, b, weight FROM ranked e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.image_id = e.image_id AND r.n = e.n AND r.p = e.b)")
def merge_forest(spark, sf_dir):
    """The order in which adjacent labels merge: least colour differences of their pixels of least gradient, without rings."""
    _, edges = _region_graph(spark, sf_dir)
    return merging.spanning_forest(edges)[0].select("image_id", "a", "b", "weight")


@query("label_merge_least_gradient", f"""WITH RECURSIVE {_GRAPH_SQL}, light AS MATERIALIZED (SELECT image_id, a AS p, b AS q FROM edge WHERE weight < 14 UNION ALL SELECT image_id, b, a FROM edge WHERE weight < 14),
    reach AS (SELECT image_id, label, label AS p FROM node UNION SELECT r.image_id, r.label, o.q FROM reach r JOIN light o ON o.image_id = r.image_id AND o.p = r.p) SELECT image_id, label, min(p) AS merged FROM reach GROUP BY image_id, label""")  # fmt: skip
def merge_least_gradient(spark, sf_dir):
    """Labels joined by forest edges lighter than 14, named by the smallest."""
    nodes, edges = _region_graph(spark, sf_dir)
    return merging.merged(nodes, edges, 14.0)
