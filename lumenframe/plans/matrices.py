"""Queries of sparse matrices, transformations, tolerances and single numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import rotations
from lumenframe.functions.steps import Steps, applied
from lumenframe.operators import matrices, points
from lumenframe.plans.registry import query
from lumenframe.plans.structures import ANGLES, _numbers, scalar
from lumenframe.plans.views import VECTOR
from lumenframe.sources.derived import POINTS_SQL, table
from lumenframe.sources.derived import points as point_table

# Entries of two matrices over the line items, of even and of odd orders; quantities are whole numbers.
A_SQL = "a AS (SELECT (l_suppkey % 50)::INTEGER AS i, (l_partkey % 40)::INTEGER AS j, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL)"
B_SQL = "b AS (SELECT (l_suppkey % 50)::INTEGER AS i, (l_partkey % 40)::INTEGER AS j, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL)"

ALL_SQL = "a AS (SELECT (l_suppkey % 50)::INTEGER AS i, (l_partkey % 40)::INTEGER AS j, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL)"


def _matrix(spark, sf_dir, rows: str):
    return matrices.total(table(spark, sf_dir, "lineitem").where(rows).selectExpr("CAST(l_suppkey % 50 AS INT) AS i", "CAST(l_partkey % 40 AS INT) AS j", "CAST(l_quantity AS BIGINT) AS v"))


def _a(spark, sf_dir):
    return _matrix(spark, sf_dir, "l_orderkey % 2 = 0")


def _b(spark, sf_dir):
    return _matrix(spark, sf_dir, "l_orderkey % 2 = 1")


def _all(spark, sf_dir):
    return _matrix(spark, sf_dir, "true")


@query("matrix_subtract", f"WITH {A_SQL}, {B_SQL} SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.v, 0) - coalesce(b.v, 0) AS v FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)")
def subtract(spark, sf_dir):
    return matrices.subtracted(_a(spark, sf_dir), _b(spark, sf_dir))


@query("matrix_multiply", f"WITH {A_SQL}, {B_SQL} SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM a JOIN b USING (j) GROUP BY a.i, b.i")
def multiply(spark, sf_dir):
    """a times b transposed."""
    return matrices.multiplied(_a(spark, sf_dir), matrices.transposed(_b(spark, sf_dir)))


@query("matrix_pointwise", f"WITH {A_SQL}, {B_SQL} SELECT i, j, a.v * b.v AS v FROM a JOIN b USING (i, j)")
def pointwise(spark, sf_dir):
    return matrices.pointwise(_a(spark, sf_dir), _b(spark, sf_dir))


@query("matrix_summary", f"WITH {ALL_SQL} SELECT count(*) FILTER (WHERE v <> 0) AS nodes, (sum(v) FILTER (WHERE i = j))::DOUBLE AS trace, round(sqrt(sum(v::DOUBLE * v)), 5) AS norm FROM a")
def summary(spark, sf_dir):
    return matrices.summary(_all(spark, sf_dir)).withColumn("norm", F.round("norm", 5))


@query("matrix_column_sums", f"WITH {ALL_SQL} SELECT j, sum(v)::BIGINT AS v FROM a GROUP BY j")
def sums(spark, sf_dir):
    return matrices.column_sums(_all(spark, sf_dir))


@query("matrix_row_repeated", f"WITH {ALL_SQL} SELECT r::INTEGER AS i, (j + 40 * c)::INTEGER AS j, v FROM a CROSS JOIN range(3) x(r) CROSS JOIN range(2) y(c) WHERE i = 7")
def row_repeated(spark, sf_dir):
    return matrices.row_repeated(_all(spark, sf_dir), 7, 3, 2, 40)


@query("matrix_equal_within", f"WITH {A_SQL}, {B_SQL}, d AS (SELECT abs(coalesce(a.v, 0) - coalesce(b.v, 0)) AS d FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j) SELECT max(d) <= 20 AS equal, max(d)::DOUBLE AS gap FROM d")
def equal_within(spark, sf_dir):
    return matrices.equal_within(_a(spark, sf_dir), _b(spark, sf_dir), 20)


# A rotation scaled and sheared, times its inverse: the SQL states the unit matrix.
_SKEWED: Steps = [*ANGLES, *rotations.xyz(), ("m00", "2e0 * m00 + 3e0"), ("m11", "m11 - 4e0"), ("m21", "m21 + 1e0"), *matrices.inverse3()]
_UNIT: Steps = [(f"u{i}{j}", " + ".join(f"m{i}{k} * n{k}{j}" for k in range(3))) for i in range(3) for j in range(3)]
scalar("matrix_inverse", [*_SKEWED, *_UNIT], [n for n, _ in _UNIT])

_SERIES: Steps = [("number", "0.5e0 + (i % 100) * 1e-2"), ("d", "number - 1e0"), ("series", " + ".join(f"({'-' if k % 2 == 0 else ''}pow(d, {k}) / {k})" for k in range(1, 11)))]
scalar("math_log_series", _SERIES, ["series"])


@query("bits_reversed", "SELECT o_orderkey AS id, list_sum([(((o_orderkey >> k) & 1)::HUGEINT << (63 - k)) for k in range(64)])::HUGEINT::VARCHAR AS reversed FROM orders")
def reversed_bits(spark, sf_dir):
    """All 64 bits of the keys, as unsigned decimals."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), matrices.reversed_bits(F.col("o_orderkey"), 64).alias("reversed"))


# Rotations: unit quaternions of principal axes, vectors as axis and angle, angles of z-x-y rotations, displacement of two.
_AXIS: Steps = [("axis", "i % 3"), ("pw", "cos(a / 2)"), *[(f"p{c}", f"CASE WHEN axis = {k} THEN sin(a / 2) ELSE 0e0 END") for k, c in enumerate("xyz")]]
scalar("rotation_principal_quaternion", [*ANGLES, *_AXIS], ["pw", "px", "py", "pz"])
scalar("rotation_axis_angle", [*VECTOR, ("angle", "sqrt(vx * vx + vy * vy + vz * vz)"), ("kx", "vx / angle"), ("ky", "vy / angle"), ("kz", "vz / angle")], ["angle", "kx", "ky", "kz"])


def zxy() -> Steps:
    """m = Rz(c) Rx(a) Ry(b), and the angles again."""
    return [
        ("m00", "cos(c) * cos(b) - sin(c) * sin(a) * sin(b)"), ("m01", "-sin(c) * cos(a)"), ("m02", "cos(c) * sin(b) + sin(c) * sin(a) * cos(b)"),
        ("m10", "sin(c) * cos(b) + cos(c) * sin(a) * sin(b)"), ("m11", "cos(c) * cos(a)"), ("m12", "sin(c) * sin(b) - cos(c) * sin(a) * cos(b)"),
        ("m20", "-cos(a) * sin(b)"), ("m21", "sin(a)"), ("m22", "cos(a) * cos(b)"),
        ("za", "asin(m21)"), ("zb", "atan2(-m20, m22)"), ("zc", "atan2(-m01, m11)"),
    ]


scalar("rotation_zxy_roundtrip", [*ANGLES, *zxy()], ["m00", "m12", "m20", "za", "zb", "zc"])


def displacement() -> Steps:
    """displacement: the Frobenius norm of I - M R, for matrices m and r."""
    return [(f"t{i}{j}", f"{int(i == j)}e0 - ({' + '.join(f'm{i}{k} * r{k}{j}' for k in range(3))})") for i in range(3) for j in range(3)] + [("displacement", "sqrt(" + " + ".join(f"t{i}{j} * t{i}{j}" for i in range(3) for j in range(3)) + ")")]


scalar("rotation_displacement", [*ANGLES, *rotations.xyz(), *VECTOR, *rotations.rodrigues(m="r"), *displacement()], ["displacement"])

# Similarity transformations of the plane: reversed ones, likeness, means, and tolerances of epipolar distances.
_PARAMS: Steps = [("scale", "0.5e0 + (i % 10) * 1e-1"), ("turn", "(i % 60) * 1e-1"), ("ox", "ar"), ("oy", "br"), ("tx", "s * 1e-1"), ("ty", "(i % 7) - 3e0")]
_BACK = [n for n, _ in points.similarity_reversed()]


@query("transform_reversed", "WITH p AS (SELECT o_orderkey AS id, 0.5::DOUBLE + (o_orderkey % 10) * 0.1::DOUBLE AS scale, (o_orderkey % 60) * 0.1::DOUBLE AS turn, (o_orderkey % 17) - 8.0::DOUBLE AS ox, (o_custkey % 7) - 3.5::DOUBLE AS oy, (o_custkey - 50) * 0.1::DOUBLE AS tx, (o_orderkey % 7) - 3.0::DOUBLE AS ty FROM orders) SELECT id, round(1 / scale, 5) AS back_scale, round(CASE WHEN turn = 0 THEN 0 ELSE 2 * pi() - turn END, 5) AS back_turn, round(ox * scale + tx, 5) + 0e0 AS back_ox, round(oy * scale + ty, 5) + 0e0 AS back_oy, round(-tx / scale, 5) + 0e0 AS back_tx, round(-ty / scale, 5) + 0e0 AS back_ty, round(11 - id % 5, 5) AS x2, round(4 + id % 3, 5) AS y2 FROM p")
def transform_reversed(spark, sf_dir):
    """The parameters that lead back, and a point there and back."""
    p = applied(_numbers(spark, sf_dir), [*_PARAMS, ("x", "11e0 - i % 5"), ("y", "4e0 + i % 3"), *points.similarity_steps("", "x", "y", "1"), *points.similarity_reversed(), *points.similarity_steps("back_", "x1", "y1", "2")])
    return p.selectExpr("id", *[f"round({c}, 5) + 0e0 AS {c}" for c in (*_BACK, "x2", "y2")])


_POSES = f"SELECT set_id, point_id, 1 + x * 0.02::DOUBLE AS scale, (y * 6) % 360 AS turn, x - y AS tx, x + y AS ty FROM ({POINTS_SQL})"


def _poses(spark, sf_dir):
    return point_table(spark, sf_dir).selectExpr("set_id", "point_id", "1 + x * 0.02D AS scale", "(y * 6) % 360 AS turn", "x - y AS tx", "x + y AS ty")


@query("transform_similar_groups", f"WITH p AS (SELECT *, round(scale * 100)::BIGINT AS c FROM ({_POSES})) SELECT a.set_id, a.point_id, count(*) FILTER (WHERE b.point_id <> a.point_id) AS likes FROM p a JOIN p b ON b.set_id = a.set_id AND 10 * abs(a.c - b.c) <= a.c + b.c AND least(abs(a.turn - b.turn), 360 - abs(a.turn - b.turn)) <= 20 GROUP BY ALL")
def similar_groups(spark, sf_dir):
    """For each transformation how many others of its set have a scale within 10 % of the pair's mean and a turn within 20 degrees."""
    return points.similar_transformations(_poses(spark, sf_dir), "scale", "turn")


@query("transform_average", f"WITH p AS ({_POSES}), r AS (SELECT set_id, max(turn) - min(turn) > 180 AS wraps FROM p GROUP BY set_id), q AS (SELECT set_id, scale, tx, ty, CASE WHEN wraps AND turn < 180 THEN turn + 360 ELSE turn END AS turn FROM p JOIN r USING (set_id)) SELECT set_id, count(*) AS n, round(avg(turn) - CASE WHEN avg(turn) > 360 THEN 360 ELSE 0 END, 5) AS turn, round(avg(scale), 5) AS scale, round(avg(tx), 5) AS tx, round(avg(ty), 5) AS ty, round(stddev_samp(turn), 5) AS turn_sd, round(stddev_samp(scale), 5) AS scale_sd, round(stddev_samp(tx), 5) AS tx_sd, round(stddev_samp(ty), 5) AS ty_sd FROM q GROUP BY set_id")
def average(spark, sf_dir):
    a = points.average_transformation(_poses(spark, sf_dir))
    return a.select("set_id", "n", *[F.round(c, 5).alias(c) for c in a.columns if c not in ("set_id", "n")])


@query("epipolar_tolerances", f"SELECT set_id, round(sqrt(3.84::DOUBLE) * s, 5) AS dof1, round(sqrt(5.99::DOUBLE) * s, 5) AS dof2, round(sqrt(7.82::DOUBLE) * s, 5) AS dof3 FROM (SELECT set_id, stddev_samp(x - y) AS s FROM ({POINTS_SQL}) GROUP BY set_id)")
def tolerances(spark, sf_dir):
    """Distances that 95 % of errors with the set's deviation stay below, for 1, 2 and 3 degrees of freedom."""
    s = point_table(spark, sf_dir).groupBy("set_id").agg(F.stddev_samp(F.col("x") - F.col("y")).alias("s"))
    return s.selectExpr("set_id", *[f"round(sqrt({c}D * s * s), 5) AS dof{k}" for k, c in ((1, 3.84), (2, 5.99), (3, 7.82))])


@query("fit_log_likelihood", f"WITH p AS (SELECT set_id, y - (30 + 0.1::DOUBLE * x - 0.002::DOUBLE * x * x) AS d FROM ({POINTS_SQL})), s AS (SELECT set_id, count(*) AS n, var_samp(d) AS v, sum(d * d) AS q FROM p GROUP BY set_id HAVING count(*) > 1) SELECT set_id, round(n / 2.0::DOUBLE * ln(1 / (2 * pi() * v)) - q / (2 * v), 5) AS log_likelihood FROM s")
def log_likelihood(spark, sf_dir):
    """Of each set's points under a parabola with normal errors of the residuals' own deviation."""
    d = point_table(spark, sf_dir).withColumn("d", F.expr("y - (30 + 0.1D * x - 0.002D * x * x)"))
    s = d.groupBy("set_id").agg(F.count("*").alias("n"), F.var_samp("d").alias("v"), F.sum(F.col("d") * F.col("d")).alias("q")).where("n > 1")
    return s.selectExpr("set_id", "round(-0.5D * (n * ln(2 * pi() * v) + q / v), 5) AS log_likelihood")


_CURVES = "SELECT l_orderkey AS curve_id, l_linenumber AS pos, l_partkey % 11 AS x, l_suppkey % 7 AS y FROM lineitem"


@query("curve_closed", f"WITH c AS ({_CURVES}), e AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY pos, x, y) AS k, count(*) OVER (PARTITION BY curve_id) AS n FROM c) SELECT a.curve_id, a.n, a.n >= 4 AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AS closed FROM e a JOIN e b ON b.curve_id = a.curve_id AND b.k = b.n WHERE a.k = 1")
def closed(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS curve_id", "l_linenumber AS pos", "l_partkey % 11 AS x", "l_suppkey % 7 AS y")
    return points.closed_curves(c, 2, 4)


@query("curve_scaled_down", f"WITH c AS (SELECT set_id, avg(x) AS cx, avg(y) AS cy FROM ({POINTS_SQL}) GROUP BY set_id) SELECT set_id, floor(round(cx + 0.25::DOUBLE * (x - cx), 9) + 0.5)::INTEGER AS x, floor(round(cy + 0.25::DOUBLE * (y - cy), 9) + 0.5)::INTEGER AS y, max(point_id) AS point_id FROM ({POINTS_SQL}) p JOIN c USING (set_id) GROUP BY ALL")
def scaled_down(spark, sf_dir):
    return points.scaled_down(point_table(spark, sf_dir), 0.25).select("set_id", "x", "y", "point_id")


@query("points_circle", "WITH r AS (SELECT DISTINCT p_size AS radius FROM part), q AS (SELECT radius, unnest(range(0, (floor(pi() / 2 / asin(1.0::DOUBLE / radius) + 1e-9) + 1)::BIGINT)) * asin(1.0::DOUBLE / radius) AS t FROM r), p AS (SELECT radius, floor(round(radius * cos(t), 9) + 0.5)::INTEGER AS x, floor(round(radius * sin(t), 9) + 0.5)::INTEGER AS y FROM q), m AS (SELECT radius, x, y FROM p UNION SELECT radius, -x, y FROM p UNION SELECT radius, x, -y FROM p UNION SELECT radius, -x, -y FROM p) SELECT radius, x, y, (row_number() OVER (PARTITION BY radius ORDER BY round(CASE WHEN y < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END, 9), x) - 1)::INTEGER AS pos FROM m")
def circle(spark, sf_dir):
    return points.circle(table(spark, sf_dir, "part").select(F.col("p_size").alias("radius")).distinct())


@query("points_window", f"SELECT set_id, point_id, i::INTEGER AS x, j::INTEGER AS y FROM ({POINTS_SQL}) JOIN range(48) a(i) ON abs(i - x) <= 2 JOIN range(56) b(j) ON abs(j - y) <= 2")
def windows(spark, sf_dir):
    return points.windows(point_table(spark, sf_dir), 2, 48, 56, ["set_id", "point_id"])


scalar("shape_chord_distance", [("chord", "abs(ar) / 10"), ("longest", "CASE WHEN i % 9 = 0 THEN 0e0 ELSE 2e0 END"), ("len", "(i % 25) + 1e0"), *points.chord_distance("chord / len", "longest", "len", "25e0")], ["distance"])

# A pixel's direction of length 1 in the camera's frame; and the camera's turn taken back.
_LENS: Steps = [("u", "320e0 + ar * 10"), ("v", "240e0 + br * 10"), ("fx", "500e0"), ("fy", "510e0"), ("ox", "320e0"), ("oy", "240e0"), ("skewness", "2e0"), *rotations.intrinsics()]
_UNIT_DIRECTION: Steps = [("norm", "sqrt(cu * cu + cv * cv + 1)"), ("dx", "cu / norm"), ("dy", "cv / norm"), ("dz", "1 / norm")]
scalar("camera_unit_directions", [*_LENS, *_UNIT_DIRECTION], ["dx", "dy", "dz"])
_THERE: Steps = [*ANGLES, *rotations.xyz(), *rotations.turned("m", "ar", "ai", "br", "h"), *[(f"k{i}{j}", f"m{j}{i}") for i in range(3) for j in range(3)], *rotations.turned("k", "hx", "hy", "hz", "g")]


@query("rotation_inverse", "SELECT o_orderkey AS id, (o_orderkey % 17) - 8.0e0 AS gx, (o_orderkey % 5) - 2.0e0 AS gy, (o_custkey % 7) - 3.5e0 AS gz FROM orders")
def inverse_rotation(spark, sf_dir):
    """Vectors turned and, by the transposed matrix, turned back: the vectors."""
    return applied(_numbers(spark, sf_dir), _THERE).selectExpr("id", *[f"round({c}, 5) + 0e0 AS {c}" for c in ("gx", "gy", "gz")])
