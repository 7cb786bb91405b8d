"""Queries of eigenvectors, null spaces and clusters of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import clusters, descriptors, spectra
from lumenframe.plans.registry import query
from lumenframe.sources.derived import table

_GRAM_SQL = "e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS MATERIALIZED (SELECT p.j::BIGINT AS i, q.j::BIGINT AS j, sum(p.v * q.v) AS v FROM e p JOIN e q ON p.vec_id = q.vec_id GROUP BY ALL)"


def _power_sql(k: int, values: int = 1, squarings: int = 12) -> str:
    """The largest eigenvalue by repeated squaring of the matrix g0, taken off for the next: another way than the query's."""
    steps = [_GRAM_SQL, "g0 AS MATERIALIZED (SELECT * FROM g)"]
    for c in range(k):
        steps.append(f"p{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM g{c}) AS v FROM g{c})")
        for s in range(squarings):
            steps.append(f"r{c}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{c}_{s} a JOIN p{c}_{s} b ON a.j = b.i GROUP BY a.i, b.j)")
            steps.append(f"p{c}_{s + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM r{c}_{s}) AS v FROM r{c}_{s})")
        # The column of the largest diagonal entry is the eigenvector.
        steps.append(f"x{c} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS x FROM p{c}_{squarings} WHERE j = (SELECT arg_max(i, v) FROM p{c}_{squarings} WHERE i = j))")
        steps.append(f"l{c} AS MATERIALIZED (SELECT sum(a.x * g.v * b.x) AS value FROM g{c} g JOIN x{c} a ON a.i = g.i JOIN x{c} b ON b.i = g.j)")
        steps.append(f"g{c + 1} AS MATERIALIZED (SELECT g.i, g.j, g.v - l.value * a.x * b.x AS v FROM g{c} g JOIN x{c} a ON a.i = g.i JOIN x{c} b ON b.i = g.j CROSS JOIN l{c} l)")
    return ", ".join(steps)


def _gram(spark, sf_dir):
    return spectra.symmetric(descriptors.gram(table(spark, sf_dir, "embeddings"), "embedding"))


@query("matrix_eigen_values", f"WITH {_power_sql(3)} {' UNION ALL '.join(f'SELECT {c} AS c, round(value, 4) AS value FROM l{c}' for c in range(3))}")
def eigen_values(spark, sf_dir):
    """The three largest eigenvalues of the vectors' Gram matrix."""
    values, _ = spectra.leading(_gram(spark, sf_dir), 3)
    return spark.createDataFrame([(c, float(v)) for c, v in enumerate(values)], "c int, value double").withColumn("value", F.round("value", 4))


@query("matrix_eigen_vector", f"WITH {_power_sql(1)} SELECT i, round(x * (SELECT sign(arg_min(x, i)) FROM x0 WHERE abs(x) > 1e-6), 5) + 0e0 AS x FROM x0")
def eigen_vector(spark, sf_dir):
    """The eigenvector of the largest one, as rows."""
    _, vectors = spectra.leading(_gram(spark, sf_dir), 1)
    return vectors.select("i", F.expr("round(x, 5) + 0D AS x"))


@query("matrix_eigen_residuals")
def eigen_residuals(spark, sf_dir):
    """How far A x is from value x for the five leading pairs."""
    a = _gram(spark, sf_dir)
    return spectra.residuals(a, *spectra.leading(a, 5))


# Columns 1, quantity, discount, tax, quantity + 3 (a sum of others) and discount - tax: two directions are taken to 0.
_DEPENDENT = ["1D", "l_quantity", "l_discount * 100", "l_tax * 100", "l_quantity + 3", "l_discount * 100 - l_tax * 100"]


@query("matrix_null_space", "SELECT i::INTEGER AS i, round(p, 5) + 0e0 AS p FROM (VALUES (1, 1, 9 / 11e0), (1, 2, 3 / 11e0), (1, 5, -3 / 11e0), (2, 1, 3 / 11e0), (2, 2, 1 / 11e0), (2, 5, -1 / 11e0), (5, 1, -3 / 11e0), (5, 2, -1 / 11e0), (5, 5, 1 / 11e0), (3, 3, 1 / 3e0), (3, 4, -1 / 3e0), (3, 6, -1 / 3e0), (4, 3, -1 / 3e0), (4, 4, 1 / 3e0), (4, 6, 1 / 3e0), (6, 3, -1 / 3e0), (6, 4, 1 / 3e0), (6, 6, 1 / 3e0)) t(i, j, p) WHERE i = j")
def null_space(spark, sf_dir):
    """Of a matrix of dependent columns of lineitem: the diagonal of the projection on its null space, which doesn't depend on the basis."""
    rows = table(spark, sf_dir, "lineitem").select(F.array(*[F.expr(c) for c in _DEPENDENT]).alias("a"))
    found = spectra.null_space(spectra.symmetric(descriptors.gram(rows, "a")), 4)
    return found.groupBy(F.col("i").cast("int").alias("i")).agg(F.expr("round(sum(x * x), 5) + 0D").alias("p"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS vector")


_ROUND_SQL = """s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, embedding AS c FROM embeddings ORDER BY vec_id LIMIT 8),
    d AS (SELECT vec_id, embedding, cluster, list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2 FROM embeddings CROSS JOIN s),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) AS k FROM d) WHERE k = 1)"""


@query("cluster_vectors_round", f"WITH {_ROUND_SQL}, u AS (SELECT cluster, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM n) SELECT cluster::INTEGER AS cluster, j::INTEGER AS j, round(avg(v), 5) + 0e0 AS center, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT cluster::INTEGER, 0, round(sum(d2), 5), count(*) FROM n GROUP BY cluster")
def kmeans_round(spark, sf_dir):
    """One round of Lloyd's from the eight first vectors: new centres, and at j = 0 the sums of squared distances."""
    import numpy as np

    rows = _vectors(spark, sf_dir)
    start = np.array([r["vector"] for r in rows.orderBy("id").limit(8).collect()], float)
    return clusters.sums(rows, start).select("cluster", "j", F.expr("round(CASE WHEN j = 0 THEN s ELSE s / n END, 5) + 0D AS center"), "n")


@query("cluster_vectors")
def cluster_vectors(spark, sf_dir):
    """Each vector's cluster of ten, and its distance to the centre."""
    rows = _vectors(spark, sf_dir)
    centers, _ = clusters.kmeans(rows, 10)
    return clusters.assigned(rows, centers).selectExpr("id AS vec_id", "cluster", "round(sqrt(d2), 5) AS distance")


@query("cluster_vectors_inertia")
def cluster_inertia(spark, sf_dir):
    """The sum of squared distances of each round, which never rises."""
    _, inertia = clusters.kmeans(_vectors(spark, sf_dir), 10)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(inertia)], "round int, inertia double")
