"""Ordered values (curves): smoothing, medians, extrema, scaling, circular statistics, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(by: str, order: str):
    return Window.partitionBy(by).orderBy(order)


def boxcar(df: DataFrame, k: int, value: str = "v", by: str = "curve_id", order: str = "pos") -> DataFrame:
    """Mean of the last k values, fewer at the start; rounded half up as well."""
    mean = F.avg(value).over(_order(by, order).rowsBetween(1 - k, 0))
    return df.withColumn("boxcar", mean).withColumn("boxcar_rounded", F.floor(mean + 0.5).cast("long"))


def bin_average(df: DataFrame, size: int, value: str = "v", by: str = "curve_id", order: str = "pos") -> DataFrame:
    """Sums of consecutive bins over the bin size; a short last bin is divided by the whole size too."""
    return df.groupBy(by, F.floor(F.col(order) / size).alias("bin")).agg((F.sum(value) / size).alias("mean"), F.count("*").alias("n"))


def running_median(df: DataFrame, k: int, value: str = "v", by: str = "curve_id", order: str = "pos") -> DataFrame:
    """Upper median of the last k values once there are k, with the mean position of these."""
    w = _order(by, order).rowsBetween(1 - k, 0)
    rows = df.withColumn("_l", F.sort_array(F.collect_list(value).over(w))).withColumn("_m", F.avg(order).over(w))
    return rows.where(F.size("_l") == k).withColumn("median", F.col("_l")[k // 2]).withColumn("center", F.col("_m")).drop("_l", "_m")


def extrema(df: DataFrame, value: str = "v", by: str = "curve_id", order: str = "pos") -> DataFrame:
    """Inner points that are higher (max) or lower (min) than both neighbours."""
    w = _order(by, order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    kind = F.when((F.col(value) > before) & (F.col(value) > after), "max").when((F.col(value) < before) & (F.col(value) < after), "min")
    return df.withColumn("kind", kind).where("kind IS NOT NULL")


def zero_crossings(df: DataFrame, value: str, by: str = "curve_id", order: str = "pos") -> DataFrame:
    """Points whose value has another sign than the one before."""
    before = F.lag(value).over(_order(by, order))
    return df.withColumn("_b", before).where(F.signum("_b") * F.signum(value) < 0).drop("_b")


def summary(df: DataFrame, value: str = "v", by: str = "curve_id") -> DataFrame:
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def argmin_argmax(df: DataFrame, value: str = "v", by: str = "curve_id", order: str = "pos") -> DataFrame:
    """First position of the smallest and of the largest value."""
    return df.groupBy(by).agg(F.min(F.struct(value, order))[order].alias("argmin"), (-F.max(F.struct(F.col(value), -F.col(order)))["col2"]).alias("argmax"))


def circular_mean(df: DataFrame, degrees: str, by: str) -> DataFrame:
    """Mean direction (0..360) and length of the mean vector."""
    rad = F.radians(degrees)
    return df.groupBy(by).agg(F.avg(F.sin(rad)).alias("_s"), F.avg(F.cos(rad)).alias("_c")).selectExpr(by, "CASE WHEN degrees(atan2(_s, _c)) < 0 THEN degrees(atan2(_s, _c)) + 360 ELSE degrees(atan2(_s, _c)) END AS direction", "sqrt(_s * _s + _c * _c) AS resultant")


def line_fit(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Least-squares line from mergeable sums."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def parabola_fit(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """y = a x^2 + b x + c by normal equations from seven mergeable moments, solved by Cramer's rule; null where singular."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    m = df.groupBy(by).agg(F.count("*").cast("double").alias("n"), F.sum(xd).alias("s1"), F.sum(xd**2).alias("s2"), F.sum(xd**3).alias("s3"), F.sum(xd**4).alias("s4"), F.sum(yd).alias("t0"), F.sum(xd * yd).alias("t1"), F.sum(xd**2 * yd).alias("t2"))
    det = lambda a, b, c, d, e, f, g, h, i: f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
    whole = f"nullif({det('s4', 's3', 's2', 's3', 's2', 's1', 's2', 's1', 'n')}, 0D)"
    return m.selectExpr(by, f"{det('t2', 's3', 's2', 't1', 's2', 's1', 't0', 's1', 'n')} / {whole} AS a", f"{det('s4', 't2', 's2', 's3', 't1', 's1', 's2', 't0', 'n')} / {whole} AS b", f"{det('s4', 's3', 't2', 's3', 's2', 't1', 's2', 's1', 't0')} / {whole} AS c")


def unit_standard(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(value - mean) / sample deviation of each column within the group; a deviation of 0 only shifts."""
    w = Window.partitionBy(by)
    return df.withColumns({f"{c}_std": (F.col(c) - F.avg(c).over(w)) / F.coalesce(F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(1.0)) for c in columns})
