"""Eigenvectors and null spaces of symmetric matrices given as rows (i, j, v): block iteration with Rayleigh-Ritz values.

A matrix of n columns is as many as n * n rows and stays a table; only figures of the block, of block * block size, reach the
driver. Powers of the matrix by repeated squaring (a join and a sum each) make the iteration converge in few rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.graph import cut_lineage


def symmetric(upper: DataFrame, value: str = "g") -> DataFrame:
    """Both triangles (i, j, v) from the upper one."""
    low = upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("v"))
    return upper.select("i", "j", F.col(value).alias("v")).unionByName(low)


def product(a: DataFrame, x: DataFrame) -> DataFrame:
    """i, c, x: the matrix times a block of columns (i, c, x)."""
    right = x.select(F.col("i").alias("j"), "c", "x")
    return a.join(right, "j").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def squared(a: DataFrame) -> DataFrame:
    """The matrix times itself, over its largest entry."""
    right = a.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    made = cut_lineage(a.join(right, "j").groupBy("i", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v")))
    most = made.agg(F.max(F.abs("v"))).first()[0]
    return made.withColumn("v", F.col("v") / F.lit(most)) if most else made


def _inner(a: DataFrame, b: DataFrame, size: int) -> np.ndarray:
    """The products of the columns of two blocks."""
    pairs = a.select("i", "c", "x").join(b.select("i", F.col("c").alias("d"), F.col("x").alias("y")), "i").groupBy("c", "d").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    out = np.zeros((size, size))
    for r in pairs.collect():  # size * size rows
        out[r["c"], r["d"]] = r["s"]
    return out


def _combined(x: DataFrame, weights: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    w = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    each = x.select("i", F.get(w, F.col("c")).alias("w"), "x").select("i", F.posexplode("w").alias("c", "w"), "x")
    return each.groupBy("i", "c").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def _orthonormal(x: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The same column space with orthonormal columns, and how many; directions that the block doesn't have are columns of 0."""
    for _ in range(2):  # the second pass mends what rounding left
        values, vectors = np.linalg.eigh(_inner(x, x, size))
        keep = values > 1e-13 * values.max()
        weights = np.zeros((size, size))
        weights[:, keep] = vectors[:, keep] / np.sqrt(values[keep])
        x = cut_lineage(_combined(x, weights))
    return x, int(keep.sum())


def leading(a: DataFrame, k: int, squarings: int = 6, within: float = 1e-10, most_rounds: int = 30, every: bool = True) -> tuple[list[float], DataFrame]:
    """The k eigenvalues of largest size, in descending order of size, and their unit eigenvectors (i, c, x; c numbers them; the first entry that isn't
    near 0 is positive).

    The block has twice k columns and starts from values by rule. Rounds end once no value moves by more than `within` of the
    largest. Where a power leaves fewer than k directions, lower ones are taken instead (unless every is false: then values
    of the others are 0). A matrix of a lower rank has fewer vectors.
    """
    a = cut_lineage(a)
    n = a.select("i").distinct().count()
    size = min(2 * k + 2, n)
    powers = [a]
    for _ in range(squarings):
        powers.append(squared(powers[-1]))
    starts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: (F.pmod(F.xxhash64(F.col("i"), c), F.lit(2001)) - 1000) / 1000.0)
    x = a.select("i").distinct().select("i", F.posexplode(starts).alias("c", "x"))
    start, _ = _orthonormal(x, size)
    while True:
        power, last = powers[squarings], None
        x, live = _orthonormal(cut_lineage(product(power, start)), size)
        if live >= k or not squarings or not every:
            break
        squarings //= 2
    for _ in range(most_rounds):
        x, _ = _orthonormal(cut_lineage(product(power, x)), size)
        image = cut_lineage(product(a, x))
        h = _inner(x, image, size)
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:k]
        now = values[order]
        if last is not None and np.abs(now - last).max() <= within * max(np.abs(now).max(), 1e-300):
            break
        last = now
    weights = np.zeros((size, size))
    weights[:, :k] = vectors[:, order]
    found = _combined(x, weights).where(F.col("c") < k)
    sign = found.where("abs(x) > 1e-6").groupBy("c").agg(F.signum(F.min(F.struct("i", "x"))["x"]).alias("sign"))
    return now.tolist(), cut_lineage(found.join(sign, "c").select("i", "c", (F.col("x") * F.col("sign")).alias("x")))


def residuals(a: DataFrame, values: list[float], vectors: DataFrame) -> DataFrame:
    """c, value, residual: the length of A x - value x of each pair."""
    listed = F.array(*[F.lit(float(v)) for v in values])
    both = product(a, vectors).withColumnRenamed("x", "y").join(vectors, ["i", "c"])
    return both.withColumn("value", F.get(listed, F.col("c"))).groupBy("c", "value").agg(F.sqrt(F.sum((F.col("y") - F.col("value") * F.col("x")) ** 2)).alias("residual"))


def null_space(a: DataFrame, most: int, squarings: int = 14) -> DataFrame:
    """i, c, x: unit vectors, orthogonal to each other, that the positive semidefinite matrix takes to (near) 0, up to `most` of them.

    They lead the spectrum of (bound - A), the bound being the largest sum of absolute entries of a row. A vector counts if its
    value is below n times the rounding of the bound.
    """
    a = cut_lineage(a)
    sums = a.groupBy("i").agg(F.sum(F.abs("v")).alias("s"))
    bound, n = sums.agg(F.max("s"), F.count("*")).first()
    if not n:
        return a.select("i", F.lit(0).alias("c"), F.lit(0.0).alias("x"))
    turned = a.select("i", "j", (-F.col("v")).alias("v")).unionByName(sums.select("i", F.col("i").alias("j"), F.lit(float(bound)).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    values, vectors = leading(turned, min(most, n), squarings, every=False)
    near = [c for c, v in enumerate(values) if bound - v <= n * 1e-12 * bound]
    return vectors.where(F.col("c").isin(near)) if near else vectors.where("false")
