"""Convolution along rows, columns and curves, gradients and angles.

A row, column or curve is gathered as one array and convolved by higher-order functions: one shuffle per axis,
no row per kernel weight. Borders reflect (index -i-1 and 2n-i-1); closed curves wrap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lumenframe.operators.descriptors import bounded


def gaussian(sigma: float, order: int = 0, reach: float = 0.001) -> list[float]:
    """Kernel of the Gaussian (order 0, sums to 1), or its first or second derivative, down to `reach` of the peak."""
    half = max(1, math.ceil(sigma * math.sqrt(-2 * math.log(reach))))
    x = range(-half, half + 1)
    g = [math.exp(-0.5 * (i / sigma) ** 2) for i in x]
    total = sum(g)
    if order == 0:
        return [v / total for v in g]
    if order == 1:
        return [-i / sigma**2 * v / total for i, v in zip(x, g, strict=True)]
    return [(i * i / sigma**4 - 1 / sigma**2) * v / total for i, v in zip(x, g, strict=True)]


def binomial(n: int, order: int = 0) -> list[float]:
    """Binomial approximations: row n of Pascal's triangle over 2**n, and its differences."""
    row = [math.comb(n, k) / 2**n for k in range(n + 1)]
    for _ in range(order):
        row = [a - b for a, b in zip([0.0, *row], [*row, 0.0], strict=True)]
        row = [-v for v in row]
    return row if len(row) % 2 else [*row, 0.0]


def _convolved(array: str, kernel: list[float], closed: bool, offset: int = 1) -> str:
    """SQL text: `array` convolved (correlated) with the kernel; taps lie `offset` apart."""
    half = len(kernel) // 2
    weights = "array(" + ", ".join(f"{w!r}D" for w in kernel) + ")"
    at = f"i + (j - {half}) * {offset}"
    n = f"size({array})"
    index = f"pmod({at}, {n})" if closed else f"CASE WHEN pmod({at}, 2 * {n}) < {n} THEN pmod({at}, 2 * {n}) ELSE 2 * {n} - 1 - pmod({at}, 2 * {n}) END"
    return f"transform(sequence(0, {n} - 1), i -> aggregate(sequence(0, {len(kernel) - 1}), 0D, (s, j) -> s + {weights}[j] * {array}[CAST({index} AS INT)]))"


def convolve(df: DataFrame, kernel: list[float], by: list[str], order: str, value: str, name: str, closed: bool = False, offset: int = 1) -> DataFrame:
    """Adds `name`, the values along `order` within each group convolved with the kernel. Other columns are kept."""
    others = [c for c in df.columns if c not in by]
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in others if c != order]))).alias("_s"))
    rows = rows.withColumn("_a", F.expr(f"transform(_s, e -> CAST(e.{value} AS DOUBLE))")).withColumn("_c", F.expr(_convolved("_a", kernel, closed, offset)))
    rows = rows.select(*by, F.explode(F.arrays_zip("_s", "_c")).alias("_z"))
    return rows.select(*by, *[F.col(f"_z._s.{c}").alias(c) for c in others], F.col("_z._c").alias(name))


def separable(df: DataFrame, kernel_x: list[float], kernel_y: list[float], value: str = "v", name: str = "out", offset: int = 1) -> DataFrame:
    """Rows with kernel_x, then columns with kernel_y."""
    rows = convolve(df, kernel_x, ["image_id", "y"], "x", value, "_row", offset=offset)
    return convolve(rows, kernel_y, ["image_id", "x"], "y", "_row", name, offset=offset).drop("_row")


def central_gradients(df: DataFrame, value: str = "v") -> DataFrame:
    """gx and gy: half the difference of the two neighbours, one-sided at the edges."""
    from pyspark.sql import Window

    def one(w, name):
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - F.col(value)).cast("double")).when(after.isNull(), (F.col(value) - before).cast("double")).otherwise((after - before) / 2.0)

    return df.withColumn("gx", one(Window.partitionBy("image_id", "y").orderBy("x"), "gx")).withColumn("gy", one(Window.partitionBy("image_id", "x").orderBy("y"), "gy"))


def angles(gx: str = "gx", gy: str = "gy") -> list[tuple[str, str]]:
    """Orientation in degrees: -180..180, 0..180, 0..360, and the magnitude, as expressions."""
    deg = f"degrees(atan2({gy}, {gx}))"
    return [
        ("magnitude", f"sqrt({gx} * {gx} + {gy} * {gy})"),
        ("theta", deg),
        ("theta180", f"CASE WHEN {deg} < 0 THEN {deg} + 180 WHEN {deg} >= 180 THEN {deg} - 180 ELSE {deg} END"),
        ("theta360", f"CASE WHEN {deg} < 0 THEN {deg} + 360 ELSE {deg} END"),
    ]


SOBEL_SMOOTH, SOBEL_DIFF = [0.25, 0.5, 0.25], [-0.5, 0.0, 0.5]
B3_SPLINE = [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]
TRIANGLE = [0.25, 0.5, 0.25]
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
# Laws' texture vectors.
LAWS = {"L5": [1, 4, 6, 4, 1], "E5": [-1, -2, 0, 2, 1], "S5": [-1, 0, 2, 0, -1], "R5": [1, -4, 6, -4, 1], "W5": [-1, 2, 0, -2, 1]}


def a_trous(df: DataFrame, levels: int, kernel: list[float] = TRIANGLE, value: str = "v") -> DataFrame:
    """Wavelet planes without downsampling: c_j (smooth at 2**j) and w_j = c_{j-1} - c_j; value = c_last + sum of w."""
    out = df.withColumn("c_0", F.col(value).cast("double"))
    for j in range(levels):
        out = separable(out, kernel, kernel, f"c_{j}", f"c_{j + 1}", offset=2**j)
        out = out.withColumn(f"w_{j + 1}", F.col(f"c_{j}") - F.col(f"c_{j + 1}"))
    return out


#: Points of curves that are convolved at a time.
POINTS = 1 << 18


def _derivatives(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, sigma: float, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """x' y'' - y' x'' and x'^2 + y'^2 of curves that lie one after another (sizes: their points), tap by tap as in _convolved."""
    n = np.repeat(sizes, sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(x)) - start
    kernels = [[(-1) ** d * w for w in gaussian(sigma, d)] for d in (1, 2)]
    half, out = len(kernels[0]) // 2, np.zeros((4, len(x)))
    for j, weights in enumerate(zip(*kernels, strict=True)):
        at = (place + j - half) % (n if closed else 2 * n)
        at = start + (at if closed else np.where(at < n, at, 2 * n - 1 - at))
        for k, (v, w) in enumerate((v[at], w) for v in (x, y) for w in weights):
            out[k] += w * v
    x1, x2, y1, y2 = out
    return x1 * y2 - y1 * x2, x1 * x1 + y1 * y1


def curvature(df: DataFrame, sigma: float, by: str = "curve_id", order: str = "pos", closed: bool = False) -> DataFrame:
    """k = (x' y'' - y' x'') / (x'^2 + y'^2)^1.5 of curves (x, y) with Gaussian derivatives; 0 where undefined.

    A curve is gathered once for the four derivatives; many are convolved at a time.
    """
    others = [c for c in df.columns if c != by]
    points = F.sort_array(F.collect_list(F.struct(order, *[c for c in others if c != order]))).alias("_s")
    rows = df.groupBy(by).agg(points).select(by, "_s", *[F.expr(f"transform(_s, e -> CAST(e.{c} AS DOUBLE))").alias(f"_{c}") for c in "xy"])
    schema = StructType([*rows.select(by, "_s").schema.fields, *[StructField(c, ArrayType(DoubleType())) for c in ("_n", "_d")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, sizes = 0, pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + POINTS, "right")))
                b = batch.slice(lo, hi - lo)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[lo:hi])]), pa.int32())
                flat = [b.column(k).flatten() for k in (2, 3)]
                made = _derivatives(*[v.to_numpy(zero_copy_only=False) for v in flat], sizes[lo:hi], sigma, closed)
                gaps = None
                if any(v.null_count for v in flat):  # what a null takes part in is undefined
                    holes = [np.where(v.is_null().to_numpy(zero_copy_only=False), np.nan, 0.0) for v in flat]
                    gaps = np.isnan(_derivatives(*holes, sizes[lo:hi], sigma, closed)[1])
                made = [pa.ListArray.from_arrays(offsets, pa.array(v, mask=gaps)) for v in made]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *made], names=schema.names)
                lo = hi

    made = bounded(rows).mapInArrow(run, schema).select(by, F.explode(F.arrays_zip("_s", "_n", "_d")).alias("_z"))
    return made.select(by, *[F.col(f"_z._s.{c}").alias(c) for c in others], F.expr("coalesce(_z._n / nullif(pow(_z._d, 1.5D), 0D), 0D)").alias("k")).select(*df.columns, "k")
