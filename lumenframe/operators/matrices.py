"""Matrices as rows (i, j, v), one for each stored entry, from 0; an entry that isn't stored is 0, a place is stored once.

Sums are pre-aggregated before they are shuffled. Products join the columns of one side with the rows of the other, so a
full row against a full column makes as many terms as the product needs; a skewed inner index is split by the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(entries: DataFrame) -> DataFrame:
    """Entries of one place added up."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b; places where nothing is left aren't stored."""
    return total(a.select("i", "j", "v").unionByName(b.select("i", "j", (-F.col("v")).alias("v")))).where("v <> 0")


def multiplied(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product a b."""
    right = b.select(F.col("i").alias("_k"), F.col("j"), F.col("v").alias("_w"))
    return total(a.select("i", F.col("j").alias("_k"), "v").join(right, "_k").select("i", "j", (F.col("v") * F.col("_w")).alias("v")))


def pointwise(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products of the entries at equal places."""
    return a.select("i", "j", "v").join(b.select("i", "j", F.col("v").alias("_w")), ["i", "j"]).select("i", "j", (F.col("v") * F.col("_w")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def summary(a: DataFrame) -> DataFrame:
    """One row: stored entries that aren't 0, the trace, and the Frobenius norm; 0 for an empty matrix."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.agg(F.count_if(F.col("v") != 0).alias("nodes"), zero(F.sum(F.when(F.col("i") == F.col("j"), F.col("v").cast("double")))).alias("trace"), zero(F.sqrt(F.sum(F.col("v").cast("double") * F.col("v")))).alias("norm"))


def column_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum("v").alias("v"))


def row_repeated(a: DataFrame, row: int, down: int, across: int, width: int) -> DataFrame:
    """One row of a matrix of `width` columns, as a block of down x across copies."""
    at = a.where(F.col("i") == row).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return at.select("i", (F.col("j") + F.col("_k") * width).alias("j"), "v")


def equal_within(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """One row: whether all entries, absent ones as 0, differ by at most `tolerance`, and the largest difference."""
    gap = F.coalesce(F.max(F.abs("v")), F.lit(0)).cast("double")
    return subtracted(a, b).agg((gap <= tolerance).alias("equal"), gap.alias("gap"))


def inverse3(m: str = "m", out: str = "n") -> list[tuple[str, str]]:
    """Steps of the inverse of a 3 x 3 matrix of nine columns m00..m22, by cofactors; null for a singular one."""
    minor = lambda i, j: [(r, c) for r in range(3) if r != i for c in range(3) if c != j]
    cofactor = {}
    for i in range(3):
        for j in range(3):
            (a, b, c, d), sign = [f"{m}{r}{s}" for r, s in minor(i, j)], "" if (i + j) % 2 == 0 else "-"
            cofactor[i, j] = f"{sign}({a} * {d} - {b} * {c})"
    det = " + ".join(f"{m}0{j} * ({cofactor[0, j]})" for j in range(3))
    return [(f"{m}_det", f"nullif({det}, 0e0)"), *[(f"{out}{j}{i}", f"({cofactor[i, j]}) / {m}_det") for i in range(3) for j in range(3)]]


def reversed_bits(value: Column, width: int) -> Column:
    """The lowest `width` bits of a whole number in the opposite order; all 64 of them as text of an unsigned decimal."""
    made = F.conv(F.reverse(F.lpad(F.right(F.bin(value), F.lit(width)), width, "0")), 2, 10)
    return made if width > 63 else made.cast("long")
