"""Queries of curves traced out of pixels and of watersheds: rounds of joins over sparse pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import chains, watershed
from lumenframe.plans.registry import query
from lumenframe.sources.derived import PIXELS_SQL, pixels

# Pixels of a mask, and what links them: 4-neighbours, and diagonal ones without a pixel beside both.
_MASK_SQL = f"SELECT image_id, x, y, y::BIGINT * 1048576 + x AS p FROM ({PIXELS_SQL}) WHERE v % 8 < 3"
_LINKS_SQL = f"""m AS MATERIALIZED ({_MASK_SQL}), around AS (SELECT * FROM (VALUES (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)) t(dx, dy)),
    links AS MATERIALIZED (SELECT a.image_id, a.p, b.p AS q FROM m a CROSS JOIN around JOIN m b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy
        WHERE dx * dy = 0 OR NOT EXISTS (SELECT 1 FROM m c WHERE c.image_id = a.image_id AND ((c.x = a.x + dx AND c.y = a.y) OR (c.x = a.x AND c.y = a.y + dy)))),
    degrees AS MATERIALIZED (SELECT m.image_id, m.p, count(q) AS degree FROM m LEFT JOIN links l ON l.image_id = m.image_id AND l.p = m.p GROUP BY m.image_id, m.p)"""
# Walks from every end, and round every ring from its smallest pixel to its smaller neighbour.
_TRACE_SQL = f"""{_LINKS_SQL}, c AS MATERIALIZED (SELECT l.image_id, l.p, l.q FROM links l JOIN degrees a ON a.image_id = l.image_id AND a.p = l.p AND a.degree <= 2 JOIN degrees b ON b.image_id = l.image_id AND b.p = l.q AND b.degree <= 2),
    ends AS (SELECT d.image_id, d.p FROM degrees d LEFT JOIN c ON c.image_id = d.image_id AND c.p = d.p WHERE degree <= 2 GROUP BY d.image_id, d.p HAVING count(c.q) < 2),
    walk AS (SELECT image_id, p AS curve, -1::BIGINT AS before, p, 0::BIGINT AS pos FROM ends UNION ALL SELECT w.image_id, w.curve, w.p, c.q, pos + 1 FROM walk w JOIN c ON c.image_id = w.image_id AND c.p = w.p AND c.q <> w.before),
    opened AS MATERIALIZED (SELECT image_id, p, min(curve) AS curve, arg_min(pos, curve) AS pos FROM walk GROUP BY image_id, p),
    ring AS MATERIALIZED (SELECT c.* FROM c ANTI JOIN opened o ON o.image_id = c.image_id AND o.p = c.p),
    reach AS (SELECT image_id, p, p AS r FROM ring UNION SELECT reach.image_id, reach.p, ring.q FROM reach JOIN ring ON ring.image_id = reach.image_id AND ring.p = reach.r),
    least_ AS (SELECT image_id, p, min(r) AS curve FROM reach GROUP BY image_id, p),
    turn AS (SELECT ring.image_id, ring.p AS curve, ring.p AS before, min(ring.q) AS p, 1::BIGINT AS pos FROM ring JOIN least_ l ON l.image_id = ring.image_id AND l.p = ring.p AND l.curve = l.p GROUP BY ring.image_id, ring.p
        UNION ALL SELECT t.image_id, t.curve, t.p, c.q, t.pos + 1 FROM turn t JOIN c ON c.image_id = t.image_id AND c.p = t.p AND c.q <> t.before WHERE c.q <> t.curve),
    traced AS (SELECT image_id, p, curve, pos, false AS closed FROM opened UNION ALL SELECT image_id, p, curve, pos, true FROM turn UNION ALL SELECT image_id, p, curve, 0, true FROM least_ WHERE p = curve)"""


def mask(spark, sf_dir):
    return pixels(spark, sf_dir).where("v % 8 < 3").select("image_id", "x", "y")


@query("edge_junctions", f"WITH {_LINKS_SQL} SELECT image_id, (p % 1048576)::INTEGER AS x, (p // 1048576)::INTEGER AS y, degree FROM degrees WHERE degree > 2")
def junctions(spark, sf_dir):
    return chains.junctions(mask(spark, sf_dir))


@query("edge_curves", f"WITH RECURSIVE {_TRACE_SQL} SELECT image_id, curve, pos, (p % 1048576)::INTEGER AS x, (p // 1048576)::INTEGER AS y, closed FROM traced")
def edge_curves(spark, sf_dir):
    return chains.trace(mask(spark, sf_dir))


@query("edge_closed_curves", f"""WITH RECURSIVE {_TRACE_SQL}, g AS (SELECT image_id, curve, count(*) AS n, bool_or(closed) AS cycle, abs(arg_min(p % 1048576, pos) - arg_max(p % 1048576, pos)) AS gap_x, abs(arg_min(p // 1048576, pos) - arg_max(p // 1048576, pos)) AS gap_y FROM traced GROUP BY image_id, curve HAVING count(*) >= 4),
    t AS (SELECT *, cycle OR greatest(gap_x, gap_y) <= 2 AS closed FROM g) SELECT image_id, curve, n, closed, gap_x::INTEGER AS gap_x, gap_y::INTEGER AS gap_y, (CASE WHEN closed THEN greatest(greatest(gap_x, gap_y) - 1, 0) ELSE 0 END)::INTEGER AS fills FROM t""")  # fmt: skip
def closed_curves(spark, sf_dir):
    return chains.closing(chains.trace(mask(spark, sf_dir)), 1, 4)


# Sparse pixels with plateaus; the SQL spreads every minimum upwards and counts which reach a pixel.
_SPARSE_SQL = f"SELECT image_id, x, y, y::BIGINT * 1048576 + x AS p, v // 32 AS v FROM ({PIXELS_SQL}) WHERE r % 7 <> 0"
_LOWER_SQL = f"""s AS MATERIALIZED ({_SPARSE_SQL}), around AS (SELECT * FROM (VALUES (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)) t(dx, dy)),
    e AS MATERIALIZED (SELECT a.image_id, a.p, a.v, b.p AS q, b.v AS u FROM s a CROSS JOIN around JOIN s b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy),
    bfs AS (SELECT DISTINCT image_id, p, 1 AS dist FROM e WHERE u < v UNION SELECT e.image_id, e.p, dist + 1 FROM bfs JOIN e ON e.image_id = bfs.image_id AND e.q = bfs.p AND e.u = e.v WHERE dist < 40),
    lc AS MATERIALIZED (SELECT s.image_id, s.x, s.y, s.p, s.v, coalesce(min(dist), 0)::INTEGER AS dist FROM s LEFT JOIN bfs ON bfs.image_id = s.image_id AND bfs.p = s.p GROUP BY ALL)"""
_BASINS_SQL = f"""{_LOWER_SQL}, flat AS MATERIALIZED (SELECT e.image_id, e.p, e.q FROM e JOIN lc ON lc.image_id = e.image_id AND lc.p = e.p AND lc.dist = 0 WHERE e.u = e.v),
    reach AS (SELECT image_id, p, p AS r FROM lc WHERE dist = 0 UNION SELECT reach.image_id, reach.p, flat.q FROM reach JOIN flat ON flat.image_id = reach.image_id AND flat.p = reach.r),
    minima AS (SELECT image_id, p, min(r) AS basin FROM reach GROUP BY image_id, p),
    down AS MATERIALIZED (SELECT e.image_id, e.p, e.q FROM e JOIN lc a ON a.image_id = e.image_id AND a.p = e.p JOIN lc b ON b.image_id = e.image_id AND b.p = e.q WHERE e.u < e.v OR (e.u = e.v AND b.dist < a.dist)),
    up AS (SELECT image_id, p, basin FROM minima UNION SELECT down.image_id, down.p, up.basin FROM up JOIN down ON down.image_id = up.image_id AND down.q = up.p),
    least_ AS (SELECT image_id, p, min(q) AS q FROM down GROUP BY image_id, p),
    follow AS (SELECT image_id, p, basin FROM minima UNION SELECT l.image_id, l.p, f.basin FROM follow f JOIN least_ l ON l.image_id = f.image_id AND l.q = f.p),
    met AS (SELECT image_id, p, count(*) AS n FROM up GROUP BY image_id, p)"""


def sparse(spark, sf_dir):
    return pixels(spark, sf_dir).where("r % 7 <> 0").selectExpr("image_id", "x", "y", "v div 32 AS v")


@query("watershed_lower_complete", f"WITH RECURSIVE {_LOWER_SQL} SELECT image_id, p, v, dist FROM lc")
def lower_complete(spark, sf_dir):
    return watershed.lower_complete(sparse(spark, sf_dir))


@query("watershed_of_points", f"WITH RECURSIVE {_BASINS_SQL} SELECT lc.image_id, x, y, v, dist, basin, CASE WHEN n > 1 THEN 0 ELSE basin END AS label, n > 1 AS ridge FROM lc JOIN follow USING (image_id, p) JOIN met USING (image_id, p)")
def watershed_of_points(spark, sf_dir):
    return watershed.watershed(sparse(spark, sf_dir))


@query("watershed_basin_sizes", f"WITH RECURSIVE {_BASINS_SQL} SELECT lc.image_id, basin, count(*) AS n, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS ridge_pixels, min(v) AS lowest FROM lc JOIN follow USING (image_id, p) JOIN met USING (image_id, p) GROUP BY lc.image_id, basin")
def basin_sizes(spark, sf_dir):
    made = watershed.watershed(sparse(spark, sf_dir))
    return made.groupBy("image_id", "basin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("ridge"), 1).otherwise(0)).alias("ridge_pixels"), F.min("v").alias("lowest"))
