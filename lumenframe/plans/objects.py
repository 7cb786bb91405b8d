"""Queries of objects found in other images. Scenes: the middle of each image, every other one halved, turned and shifted by rules of its id,
over the pixels of the next image."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import objects
from lumenframe.plans.registry import query
from lumenframe.sources.derived import PIXELS_SQL, pixels

_HALVED_SQL = "SELECT image_id, (x // 2)::INTEGER AS x, (y // 2)::INTEGER AS y, (sum(v) // 4)::INTEGER AS v FROM px GROUP BY ALL HAVING count(*) = 4"
# Of each planted pixel: the turned place less the smallest turned place, plus where the corner is to lie.
_X = "CASE turn WHEN 0 THEN x - lo WHEN 1 THEN hi - 1 - y WHEN 2 THEN hi - 1 - x ELSE y - lo END + image_id % 5 + 1"
_Y = "CASE turn WHEN 0 THEN y - lo WHEN 1 THEN x - lo WHEN 2 THEN hi - 1 - y ELSE hi - 1 - x END + image_id % 3 + 2"
_RULES = "image_id, x, y, v, CAST(image_id % 4 AS INTEGER) AS turn, {lo} AS lo, {hi} AS hi"
_SCENES_SQL = f"""px AS MATERIALIZED ({PIXELS_SQL}), half AS MATERIALIZED ({_HALVED_SQL}),
    cut AS (SELECT {_RULES.format(lo=4, hi=28)} FROM px WHERE image_id % 2 = 0 AND x BETWEEN 4 AND 27 AND y BETWEEN 4 AND 27 UNION ALL SELECT {_RULES.format(lo=2, hi=14)} FROM half WHERE image_id % 2 = 1 AND x BETWEEN 2 AND 13 AND y BETWEEN 2 AND 13),
    planted AS (SELECT image_id, {_X} AS x, {_Y} AS y, v FROM cut),
    scene AS MATERIALIZED (SELECT b.image_id - 1 AS image_id, b.x, b.y, coalesce(p.v, b.v) AS v FROM px b LEFT JOIN planted p ON p.image_id = b.image_id - 1 AND p.x = b.x AND p.y = b.y WHERE b.image_id > 0)"""


def _features_sql(source: str, name: str) -> str:
    turned = " ".join(f"WHEN {q} THEN {t}" for q, t in enumerate(objects.TURNS))
    bits = " + ".join(f"(CASE WHEN q[{a + 1}] < q[{b + 1}] THEN {1 << k} ELSE 0 END)" for k, (a, b) in enumerate(objects.PAIRS))
    return f"""{name}_p AS MATERIALIZED (SELECT a.image_id, a.x, a.y, list(b.v ORDER BY b.y, b.x) AS p FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.image_id, a.x, a.y HAVING count(*) = 25),
    {name}_s AS MATERIALIZED (SELECT *, list_sum(list_transform(p, lambda v: abs(v - p[13]))) AS score, list_sum(list_transform(range(25), lambda i: (i % 5 - 2) * p[i + 1])) AS mx, list_sum(list_transform(range(25), lambda i: (i // 5 - 2) * p[i + 1])) AS my FROM {name}_p),
    {name}_k AS (SELECT a.* FROM {name}_s a JOIN {name}_s b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL HAVING count(*) = 8 AND max(b.score) < a.score),
    {name}_t AS (SELECT *, CASE WHEN abs(mx) > abs(my) THEN CASE WHEN mx > 0 THEN 0 ELSE 2 END ELSE CASE WHEN my > 0 THEN 1 ELSE 3 END END AS side FROM {name}_k WHERE abs(mx) <> abs(my)),
    {name}_q AS (SELECT *, list_transform(CASE side {turned} END, lambda i: p[i + 1]) AS q FROM {name}_t),
    {name} AS MATERIALIZED (SELECT image_id, x, y, side, ({bits})::BIGINT AS code FROM {name}_q)"""


_FOUND_SQL = f"""{_SCENES_SQL}, {_features_sql("px", "f0")}, {_features_sql("half", "f1")}, {_features_sql("scene", "fs")},
    tf AS (SELECT 0 AS level, * FROM f0 UNION ALL SELECT 1, * FROM f1),
    hit AS (SELECT t.image_id AS template, s.image_id AS scene, level, t.x AS tx, t.y AS ty, s.x AS sx, s.y AS sy, (s.side - t.side + 4) % 4 AS turn, bit_count(xor(t.code, s.code)) AS bits FROM tf t CROSS JOIN fs s WHERE bit_count(xor(t.code, s.code)) <= 3),
    found AS MATERIALIZED (SELECT *, sx - (CASE turn WHEN 0 THEN tx WHEN 1 THEN -ty WHEN 2 THEN -tx ELSE ty END) AS dx, sy - (CASE turn WHEN 0 THEN ty WHEN 1 THEN tx WHEN 2 THEN -ty ELSE -tx END) AS dy FROM hit)"""
_LOCATED_SQL = f"""{_FOUND_SQL}, binned AS MATERIALIZED (SELECT f.*, kind, floor((dx + kx) / 4.0)::BIGINT AS bx, floor((dy + ky) / 4.0)::BIGINT AS b_y FROM found f CROSS JOIN (VALUES (0, 0, 0), (1, 2, 0), (2, 0, 2), (3, 2, 2)) k(kind, kx, ky)),
    votes AS (SELECT template, scene, level, turn, kind, bx, b_y, count(DISTINCT (tx, ty)) AS votes FROM binned GROUP BY ALL HAVING count(DISTINCT (tx, ty)) >= 4),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template, scene ORDER BY votes DESC, level, turn, kind, bx, b_y) AS k FROM votes) WHERE k = 1),
    inside AS MATERIALIZED (SELECT b.*, votes FROM binned b JOIN best USING (template, scene, level, turn, kind, bx, b_y)),
    mode AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template, scene ORDER BY n DESC, dx, dy) AS k FROM (SELECT template, scene, dx, dy, count(DISTINCT (tx, ty)) AS n FROM inside GROUP BY ALL)) WHERE k = 1)
    SELECT i.template, i.scene, i.turn, i.level, m.dx, m.dy, i.votes, least(count(DISTINCT (tx, ty)), count(DISTINCT (sx, sy))) AS inliers FROM inside i JOIN mode m ON m.template = i.template AND m.scene = i.scene AND abs(i.dx - m.dx) <= 1 AND abs(i.dy - m.dy) <= 1 GROUP BY ALL HAVING inliers >= 4"""


def scenes(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "x", "y", "v")
    cut = lambda df, odd, lo, hi: df.where(f"image_id % 2 = {odd} AND x BETWEEN {lo} AND {hi - 1} AND y BETWEEN {lo} AND {hi - 1}").selectExpr(*[f"{c}" for c in ("image_id", "x", "y", "v")], "CAST(image_id % 4 AS INT) AS turn", f"{lo} AS lo", f"{hi} AS hi")
    planted = cut(px, 0, 4, 28).unionByName(cut(objects.halved(px), 1, 2, 14)).selectExpr("image_id", f"{_X} AS x", f"{_Y} AS y", "v AS planted")
    return px.selectExpr("image_id - 1 AS image_id", "x", "y", "v").where("image_id >= 0").join(planted, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("planted", "v").alias("v"))


def _matches(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "x", "y", "v")
    both = objects.features(px).withColumn("level", F.lit(0)).unionByName(objects.features(objects.halved(px)).withColumn("level", F.lit(1)))
    return objects.matches(both, objects.features(scenes(spark, sf_dir)))


@query("object_features", f"WITH {_SCENES_SQL}, {_features_sql('scene', 'fs')} SELECT * FROM fs")
def object_features(spark, sf_dir):
    return objects.features(scenes(spark, sf_dir))


@query("object_matches", f"WITH {_FOUND_SQL} SELECT template, scene, level, tx, ty, sx, sy, turn, dx, dy, bits FROM found")
def object_matches(spark, sf_dir):
    """All pairs of features of images and scenes whose codes differ by three bits at most."""
    return _matches(spark, sf_dir)


@query("object_locations", f"WITH {_LOCATED_SQL}")
def object_locations(spark, sf_dir):
    """In which scenes each image is found, and where."""
    return objects.located(_matches(spark, sf_dir))
