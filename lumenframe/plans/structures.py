"""Queries of graphs, descriptors, sets, numbers, rotations and cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import scalars
from lumenframe.functions.steps import Steps, applied, as_sql
from lumenframe.operators import descriptors, graph, raster
from lumenframe.plans.registry import query
from lumenframe.sources.derived import PIXELS_SQL, labelled, pixels, table
from lumenframe.sources.derived import points as point_table

PX = f"px AS ({PIXELS_SQL})"
_BIN = f"px AS (SELECT image_id, x, y, CASE WHEN v >= 96 THEN 1 ELSE 0 END AS v FROM ({PIXELS_SQL}))"


def _components_sql(adjacent: str) -> str:
    return f"""WITH RECURSIVE {_BIN}, e AS (SELECT p.image_id, p.y * 32 + p.x AS a, q.y * 32 + q.x AS b FROM px p JOIN px q ON p.image_id = q.image_id AND p.v = q.v AND {adjacent}),
    r(image_id, a, b) AS (SELECT image_id, y * 32 + x, y * 32 + x FROM px UNION SELECT r.image_id, r.a, e.b FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.b),
    m AS (SELECT image_id, a, min(b) AS c FROM r GROUP BY ALL), s AS (SELECT image_id, c, count(*) AS size FROM m GROUP BY ALL)
    SELECT px.image_id, x, y, v, (m.c // 32) * 1048576 + m.c % 32 AS component, size FROM px JOIN m ON m.image_id = px.image_id AND m.a = px.y * 32 + px.x JOIN s ON s.image_id = m.image_id AND s.c = m.c WHERE size >= 3"""


def _binary(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "x", "y", F.expr("CASE WHEN v >= 96 THEN 1 ELSE 0 END").alias("v"))


@query("graph_connected_4", _components_sql("abs(p.x - q.x) + abs(p.y - q.y) = 1"))
def connected4(spark, sf_dir):
    return graph.connected_per_image(_binary(spark, sf_dir), "v", False, 3)


@query("graph_connected_8", _components_sql("abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1"))
def connected8(spark, sf_dir):
    return graph.connected_per_image(_binary(spark, sf_dir), "v", True, 3)


@query("graph_connected_values", _components_sql("abs(p.x - q.x) + abs(p.y - q.y) = 1"))
def connected_values(spark, sf_dir):
    """As graph_connected_4, for rasters of any size: the smallest name spreads along runs of rows and columns."""
    return graph.connected_values(_binary(spark, sf_dir), "v", False, 3)


_LB = f"l AS (SELECT image_id, CAST((x // 5) + 7 * (y // 6) + (v // 128) AS INTEGER) AS label, x, y, r, g, b FROM ({PIXELS_SQL}))"
_ADJ = "adj AS (SELECT DISTINCT p.image_id, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM l p JOIN l q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 WHERE p.label <> q.label)"


@query("graph_region_weights", f"WITH {_LB}, {_ADJ}, m AS (SELECT image_id, label, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM l GROUP BY ALL), d AS (SELECT adj.image_id, a, b, pow(p.mr - q.mr, 2) + pow(p.mg - q.mg, 2) + pow(p.mb - q.mb, 2) AS d2 FROM adj JOIN m p ON p.image_id = adj.image_id AND p.label = a JOIN m q ON q.image_id = adj.image_id AND q.label = b) SELECT image_id, a, b, round(d2, 4) AS d2, round(exp(-d2 / 800), 6) AS weight FROM d")
def weights(spark, sf_dir):
    l = labelled(spark, sf_dir)  # noqa: E741
    e = raster.shifted(raster.shifted(l.select("image_id", "x", "y", F.col("label").alias("v")), "v", 1, 0, "e"), "v", 0, 1, "s").select("image_id", "v", F.explode(F.array("e", "s")).alias("o")).where("o IS NOT NULL AND o <> v")
    adjacent = e.select("image_id", F.least("v", "o").alias("a"), F.greatest("v", "o").alias("b")).distinct()
    means = l.groupBy("image_id", "label").agg(F.avg("r").alias("mr"), F.avg("g").alias("mg"), F.avg("b").alias("mb"))
    return graph.region_weights(adjacent, means, 800).withColumns({"d2": F.round("d2", 4), "weight": F.round("weight", 6)})


@query("graph_border_pixels", f"WITH {_LB} SELECT p.image_id, p.label, p.x, p.y FROM l p LEFT JOIN l q ON p.image_id = q.image_id AND p.label = q.label AND abs(p.x - q.x) + abs(p.y - q.y) = 1 GROUP BY ALL HAVING count(q.x) < 4")
def border(spark, sf_dir):
    return graph.border_pixels(labelled(spark, sf_dir)).select("image_id", "label", "x", "y")


@query("cluster_kmeans_1d")
def kmeans(spark, sf_dir):
    return graph.kmeans_1d(pixels(spark, sf_dir), 4)


@query("graph_label_points", f"WITH {_LB} SELECT image_id, label, count(*) AS n, min(y * 32 + x) AS first_idx, max(y * 32 + x) AS last_idx FROM l GROUP BY ALL")
def label_points(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("image_id", "label").agg(F.count("*").alias("n"), F.min(F.expr("y * 32 + x")).alias("first_idx"), F.max(F.expr("y * 32 + x")).alias("last_idx"))


# Descriptors: every vector against the stated query set (ids divisible by 100).
_Q = "q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id AS bid, embedding AS bv FROM embeddings)"
_SSD = "list_sum(list_transform(list_zip(bv, qv), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").selectExpr("vec_id AS qid", "embedding AS qv"), e.selectExpr("vec_id AS bid", "embedding AS bv")


@query("knn_l2", f"WITH {_Q}, d AS (SELECT qid, bid, {_SSD} AS d FROM q CROSS JOIN b WHERE qid <> bid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, bid) AS k FROM d) SELECT qid, bid, round(d, 5) AS d, k FROM r WHERE k <= 10")
def knn(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return descriptors.block_neighbours(q, b, 10).withColumn("d", F.round("d", 5))


@query("knn_cosine", f"WITH {_Q}, d AS (SELECT qid, bid, list_sum(list_transform(list_zip(bv, qv), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(bv, lambda z: z::DOUBLE * z))) * sqrt(list_sum(list_transform(qv, lambda z: z::DOUBLE * z)))) AS c FROM q CROSS JOIN b WHERE qid <> bid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY -c, bid) AS k FROM d) SELECT qid, bid, round(c, 5) AS c, k FROM r WHERE k <= 10")
def knn_cosine(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    return descriptors.block_neighbours(q, b, 10, "cosine").selectExpr("qid", "bid", "round(-d, 5) AS c", "k")


@query("hamming_matrix", f"WITH {_Q} SELECT qid, bid, list_sum(list_transform(list_zip(bv, qv), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))::INTEGER AS d FROM q CROSS JOIN b WHERE qid <> bid")
def hamming(spark, sf_dir):
    c = descriptors.sign_codes(table(spark, sf_dir, "embeddings"), "embedding", 60)
    q = c.where("vec_id % 100 = 0").selectExpr("vec_id AS qid", "code AS qc")
    return descriptors.in_blocks(c.selectExpr("vec_id AS bid", "code"), q).where("qid <> bid").select("qid", "bid", descriptors.hamming("code", "qc").alias("d"))


@query("match_ratio_test", f"WITH {_Q}, d AS (SELECT qid, bid, {_SSD} AS d FROM q CROSS JOIN b WHERE qid <> bid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, bid) AS k FROM d), m AS (SELECT qid, max(bid) FILTER (WHERE k = 1) AS bid, max(d) FILTER (WHERE k = 1) AS d, max(d) FILTER (WHERE k = 2) AS s FROM r GROUP BY qid), g AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY d, qid) AS n FROM m WHERE d < 0.985::DOUBLE * s) SELECT qid, bid, round(d, 5) AS d FROM g WHERE n = 1")
def ratio(spark, sf_dir):
    q, b = _sides(spark, sf_dir)
    top2 = descriptors.block_neighbours(q, b, 2)
    return descriptors.greedy_one_to_one(descriptors.ratio_test(top2, 0.985)).select("qid", "bid", F.round("d", 5).alias("d"))


@query("box_iou", "WITH b AS (SELECT p_partkey AS id, p_size AS x0, p_partkey % 37 AS y0, p_size + 10 + p_partkey % 7 AS x1, p_partkey % 37 + 12 AS y1 FROM part), j AS (SELECT a.id, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, c.x0 AS bx0, c.y0 AS by0, c.x1 AS bx1, c.y1 AS by1 FROM b a JOIN b c ON c.id = a.id + 1), k AS (SELECT *, least(ax1, bx1) - greatest(ax0, bx0) + 1 AS w, least(ay1, by1) - greatest(ay0, by0) + 1 AS h FROM j) SELECT id, round(CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE w * h END / ((ax1 - ax0 + 1) * (ay1 - ay0 + 1) + (bx1 - bx0 + 1) * (by1 - by0 + 1) - CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE w * h END), 6) AS iou FROM k")
def iou(spark, sf_dir):
    b = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size AS x0", "p_partkey % 37 AS y0", "p_size + 10 + p_partkey % 7 AS x1", "p_partkey % 37 + 12 AS y1")
    j = b.selectExpr("id", "x0 AS ax0", "y0 AS ay0", "x1 AS ax1", "y1 AS ay1").join(b.selectExpr("id - 1 AS id", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1"), "id")
    return descriptors.box_iou(j).select("id", F.round("iou", 6).alias("iou"))


@query("precision_recall", "WITH e AS (SELECT l_linenumber % 3 AS t, CAST(l_quantity AS INTEGER) % 3 AS p FROM lineitem), c AS (SELECT DISTINCT t AS class FROM e UNION SELECT DISTINCT p FROM e), s AS (SELECT class, sum(CASE WHEN t = class AND p = class THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN t <> class AND p = class THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN t = class AND p <> class THEN 1 ELSE 0 END)::BIGINT AS fn FROM c CROSS JOIN e GROUP BY class) SELECT class, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM s")
def prec_recall(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber % 3 AS t", "CAST(l_quantity AS INT) % 3 AS p")
    return descriptors.precision_recall(e, "t", "p").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# Numbers ----------------------------------------------------------------------------------------------------
_NUM = "SELECT o_orderkey AS id, o_orderkey AS i, o_totalprice AS p, o_custkey - 50 AS s, (o_orderkey % 17) - 8.0e0 AS ar, (o_orderkey % 5) - 2.0e0 AS ai, (o_custkey % 7) - 3.5e0 AS br, (o_custkey % 3) - 1.0e0 AS bi FROM orders"


def _numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey AS i", "o_totalprice AS p", "o_custkey - 50 AS s", "(o_orderkey % 17) - 8.0e0 AS ar", "(o_orderkey % 5) - 2.0e0 AS ai", "(o_custkey % 7) - 3.5e0 AS br", "(o_custkey % 3) - 1.0e0 AS bi")


def scalar(name: str, steps: Steps, columns: list[str], sql: str = _NUM, make=_numbers, places: int = 5) -> None:
    shown = ", ".join(f"round({c}, {places}) + 0e0 AS {c}" for c in columns)  # no negative zeros

    @query(name, as_sql(sql, steps, f"id, {shown}"))
    def run(spark, sf_dir):
        return applied(make(spark, sf_dir), steps).selectExpr("id", *[f"round({c}, {places}) + 0e0 AS {c}" for c in columns])


scalar("math_powers_of_ten", [("e10", scalars.power_of_ten("p")), ("down", scalars.round_down_by_power("p")), ("up", scalars.round_up_by_power("p"))], ["e10", "down", "up"])
scalar("math_cube_root", [("root", scalars.real_cube_root("s"))], ["root"])
scalar("math_interpolation", [("mid", scalars.interpolated("i % 10", "0", "s", "10", "p"))], ["mid"])
scalar("math_polar_angle", [("deg", scalars.polar_degrees("ar", "br"))], ["deg"])
scalar("math_complex_product", scalars.complex_product(), ["re", "im"])
scalar("math_complex_quotient", scalars.complex_quotient(), ["re", "im"])
scalar("math_complex_functions", scalars.complex_functions(), [n for n, _ in scalars.complex_functions()], places=4)
scalar("math_halton", [("h2", scalars.radical_inverse("i", 2)), ("h3", scalars.radical_inverse("i", 3))], ["h2", "h3"])
scalar("ransac_trials", [("w", "0.3e0 + (i % 60) / 1e2"), ("trials7", scalars.ransac_trials("w", 7)), ("trials2", scalars.ransac_trials("w", 2))], ["trials7", "trials2"])
_QUAT: Steps = [("pw", "cos(i * 1e-2)"), ("px", "sin(i * 1e-2)"), ("py", "0e0"), ("pz", "0e0"), ("qw", "cos(s * 1e-2)"), ("qx", "0e0"), ("qy", "sin(s * 1e-2)"), ("qz", "0e0")]
scalar("rotation_quaternion_product", [*_QUAT, *scalars.quaternion_product()], ["mw", "mx", "my", "mz"])
ANGLES: Steps = [("a", "(i % 300) * 1e-2 - 1.5e0"), ("b", "(i % 280) * 1e-2 - 1.4e0"), ("c", "(s % 300) * 1e-2")]
scalar("rotation_zyx_roundtrip", [*ANGLES, *scalars.rotation_zyx(), *scalars.euler_from_zyx()], ["r00", "r12", "r21", "ea", "eb", "ec"])
_F: Steps = [(f"f{k // 3}{k % 3}", f"({v!r}e0)") for k, v in enumerate((0.0, -0.4, 1.2, 0.5, 0.0, -2.0, -1.0, 1.8, 0.3))]
scalar("epipolar_sampson", [*_F, ("x1", "ar"), ("y1", "ai"), ("x2", "br"), ("y2", "bi"), *scalars.sampson()], ["algebraic", "sampson", "epipolar_distance"])
_CAMERA: Steps = [*ANGLES, *scalars.rotation_zyx(), ("wx", "ar"), ("wy", "ai"), ("wz", "br + 20e0"), ("t0", "0.1e0"), ("t1", "0.2e0"), ("t2", "30e0"), ("k1", "0.01e0"), ("k2", "0.001e0"), ("fx", "500e0"), ("fy", "510e0"), ("ox", "320e0"), ("oy", "240e0")]
scalar("camera_projection", [*_CAMERA, *scalars.projection()], ["xn", "yn", "px_", "py_"], places=3)


@query("math_combinations", "SELECT n, k, CAST(round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))) AS BIGINT) AS choose FROM (SELECT DISTINCT p_size % 21 AS n, p_size % 7 AS k FROM part) WHERE k <= n")
def combinations(spark, sf_dir):
    """n over k as an exact product of integers."""
    nk = table(spark, sf_dir, "part").selectExpr("p_size % 21 AS n", "p_size % 7 AS k").distinct().where("k <= n")
    return nk.withColumn("choose", F.expr("aggregate(CASE WHEN k = 0 THEN array(0) ELSE sequence(1, k) END, 1L, (s, j) -> CASE WHEN j = 0 THEN s ELSE s * (n - j + 1) div j END)"))


@query("bits_counts", "SELECT o_orderkey AS id, bit_count(o_orderkey)::INTEGER AS ones, CASE WHEN o_orderkey = 0 THEN 0 ELSE CAST(floor(log2(o_orderkey * 1.0)) AS INTEGER) + 1 END AS width, xor(o_orderkey, o_custkey) AS x FROM orders")
def bits(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "bit_count(o_orderkey) AS ones", "CASE WHEN o_orderkey = 0 THEN 0 ELSE length(bin(o_orderkey)) END AS width", "o_orderkey ^ o_custkey AS x")


@query("sum_xor", "SELECT label, sum(list_sum(list_transform(range(1, len(embedding)), lambda j: xor(CAST(trunc(embedding[j] * 100) AS INTEGER), CAST(trunc(embedding[j + 1] * 100) AS INTEGER)))))::BIGINT AS s FROM embeddings GROUP BY label")
def sum_xor(spark, sf_dir):
    """Of each two neighbouring components, in hundredths: products of floats stay floats, which decides on which side of a whole
    number they end. Pairs with a null don't count, and vectors without a pair have no sum."""
    pairs = "transform(sequence(1, size(embedding) - 1), j -> CAST(embedding[j - 1] * 100F AS INT) ^ CAST(embedding[j] * 100F AS INT))"
    each = F.expr(f"CASE WHEN size(embedding) > 1 THEN aggregate(filter({pairs}, x -> x IS NOT NULL), CAST(NULL AS BIGINT), (s, x) -> coalesce(s, 0L) + x) END")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sum(each).alias("s"))


@query("vector_normalized_by_label", "WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, j, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd FROM e GROUP BY label, j")
def vector_stats(spark, sf_dir):
    """Mean and deviation of each component by class: the figures of unit standardisation."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("j", "v"))
    return e.groupBy("label", (F.col("j") + 1).alias("j")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"), F.round(F.stddev_samp(F.col("v").cast("double")), 5).alias("sd"))


@query("matrix_gram", "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT p.j::BIGINT AS i, q.j::BIGINT AS j, round(sum(p.v * q.v), 3) AS g FROM e p JOIN e q ON p.vec_id = q.vec_id AND q.j >= p.j GROUP BY ALL")
def gram(spark, sf_dir):
    return descriptors.gram(table(spark, sf_dir, "embeddings"), "embedding").withColumn("g", F.round("g", 3))


@query("keys_unordered_pairs", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def pair_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n"))


@query("set_membership_bits", "SELECT l_orderkey AS id, bit_or(1::BIGINT << l_linenumber)::BIGINT AS members FROM lineitem GROUP BY l_orderkey")
def membership(spark, sf_dir):
    """A bit string of which elements of a small universe a set has."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.expr("bit_or(shiftleft(1L, l_linenumber))").alias("members"))


@query("points_distinct_keys", "SELECT set_id, x, y, count(*) AS n, min(point_id) AS first_id FROM (SELECT p_brand AS set_id, p_partkey AS point_id, p_size AS x, CAST((p_partkey * 13) % 61 AS INTEGER) AS y FROM part) GROUP BY ALL")
def distinct_keys(spark, sf_dir):
    return point_table(spark, sf_dir).groupBy("set_id", "x", "y").agg(F.count("*").alias("n"), F.min("point_id").alias("first_id"))
