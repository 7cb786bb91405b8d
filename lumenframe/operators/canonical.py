"""Regions in frames of their own: an ellipse from moments, a square of cells laid over it, and histograms of gradients of blocks of cells.

Regions are pixels (image_id, label, x, y); images are pixels (image_id, x, y, v). A region's frame is a row
that is joined with the tiles of its image; a cell's value is a weighted mean of the (up to) four pixels around its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lumenframe.functions.steps import Steps, applied
from lumenframe.operators.descriptors import bounded

#: Cells of a side of a frame, cells of a side of a block, and bins of directions over half a turn.
CELLS, BLOCK, BINS = 8, 4, 8
#: Pixels of a side of the tiles in which images meet frames.
TILE = 64

#: From n, cx, cy and the second central moments mxx, myy, mxy: direction of the long axis and half axes (twice the deviations).
FRAME: Steps = [
    ("mixed", "round(mxy, 9) + 0e0"),
    ("theta", "0.5e0 * atan2(2e0 * mixed, round(mxx - myy, 9) + 0e0)"),
    ("spread", "sqrt((mxx - myy) * (mxx - myy) / 4e0 + mixed * mixed)"),
    ("a", "2e0 * sqrt((mxx + myy) / 2e0 + spread)"),
    ("b", "2e0 * sqrt(greatest((mxx + myy) / 2e0 - spread, 0e0))"),
]
#: From a frame and a cell (cu, cv): its place in the image.
PLACE: Steps = [
    ("u", f"(cu - {(CELLS - 1) / 2}e0) / {CELLS / 2}e0 * a"),
    ("w", f"(cv - {(CELLS - 1) / 2}e0) / {CELLS / 2}e0 * b"),
    ("sx", "cx + u * cos(theta) - w * sin(theta)"),
    ("sy", "cy + u * sin(theta) + w * cos(theta)"),
]


def frames(regions: DataFrame, least: int = 6) -> DataFrame:
    """image_id, label, n, cx, cy, theta, a, b of regions of at least `least` pixels."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = regions.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.avg(x * x).alias("sxx"), F.avg(y * y).alias("syy"), F.avg(x * y).alias("sxy")).where(F.col("n") >= least)
    m = m.withColumns({"mxx": F.expr("sxx - cx * cx"), "myy": F.expr("syy - cy * cy"), "mxy": F.expr("sxy - cx * cy")})
    return applied(m, FRAME).select("image_id", "label", "n", "cx", "cy", "theta", "a", "b")


def _dense(listed: str, value: str, kind: str) -> Column:
    """The sorted structs of `listed` as an array in which each one's `value` (SQL text on e) stands at its place e.at; null where none is."""
    gap = f"array_repeat(CAST(NULL AS {kind}), e.at - coalesce(get({listed}, i - 1).at, -1) - 1)"
    return F.expr(f"flatten(transform({listed}, (e, i) -> concat({gap}, array({value}))))")


def _tiles(image: DataFrame) -> DataFrame:
    """image_id, tx, ty, at, s, n: a tile's pixels, with the first row and column of the next tiles, as places, sums and numbers of values."""
    px = image.select("image_id", "x", "y", "v")
    for c in "xy":  # a tile's first pixels close the tile before it too
        own = F.floor(F.col(c) / TILE)
        px = px.withColumn(f"t{c}", F.explode(F.when(F.pmod(F.col(c), F.lit(TILE)) == 0, F.array(own - 1, own)).otherwise(F.array(own))))
    at = ((F.col("y") - F.col("ty") * TILE) * (TILE + 1) + F.col("x") - F.col("tx") * TILE).cast("int").alias("at")
    keys = ["image_id", "tx", "ty"]
    per = px.repartition(*keys).groupBy(*keys, at).agg(F.sum("v").cast("double").alias("s"), F.count("*").alias("n"))
    listed = per.groupBy(*keys).agg(F.collect_list(F.struct("at", "s", "n")).alias("_l"))
    return listed.select(*keys, F.col("_l.at").alias("at"), F.col("_l.s").alias("s"), F.col("_l.n").alias("n"))


def _cells_in_tile(tx: int, ty: int, at: np.ndarray, s: np.ndarray, n: np.ndarray, frame: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Row of the frame, cu, cv and value of the cells that lie in a tile; NaN in s stands for null."""
    cx, cy, cos, sin, a, b = (f[:, None] for f in frame)
    cell = np.arange(CELLS * CELLS)
    cu, cv = cell % CELLS, cell // CELLS
    u, w = (cu - (CELLS - 1) / 2) / (CELLS / 2) * a, (cv - (CELLS - 1) / 2) / (CELLS / 2) * b
    sx, sy = cx + u * cos - w * sin, cy + u * sin + w * cos
    x, y = np.floor(sx), np.floor(sy)
    row, cell = np.nonzero((np.floor(x / TILE) == tx) & (np.floor(y / TILE) == ty))
    sx, sy, x, y = (v[row, cell] for v in (sx, sy, x, y))
    sums, counts = np.full((TILE + 1) ** 2, np.nan), np.zeros((TILE + 1) ** 2)
    sums[at], counts[at] = s, n
    total, whole, some = np.zeros(len(row)), np.zeros(len(row)), np.zeros(len(row), bool)
    for dx in (0, 1):
        for dy in (0, 1):
            weight = np.maximum((1 - np.abs(sx - (x + dx))) * (1 - np.abs(sy - (y + dy))), 0)
            place = ((y + dy - ty * TILE) * (TILE + 1) + x + dx - tx * TILE).astype(int)
            there = (weight > 0) & ~np.isnan(sums[place])
            total += np.where(there, weight * sums[place], 0)
            whole += weight * counts[place]
            some |= there
    met = whole > 0
    return row[met], cu[cell[met]], cv[cell[met]], np.where(some[met], total[met], np.nan) / whole[met]


def resampled(framed: DataFrame, image: DataFrame) -> DataFrame:
    """image_id, label, cu, cv, value: the image in each region's frame; cells without any pixel around them are left out.

    Frames go to the tiles that they may touch, and are cut into cells there: neither cells nor their four pixels are shuffled.
    """
    reach = (CELLS - 1) / CELLS
    spans = {"x": f"{reach}D * (a * abs(cos(theta)) + b * abs(sin(theta))) + 1e-6D", "y": f"{reach}D * (a * abs(sin(theta)) + b * abs(cos(theta))) + 1e-6D"}
    near = framed.select("image_id", "label", "cx", "cy", F.cos("theta").alias("cos"), F.sin("theta").alias("sin"), "a", "b", "theta")
    for c, span in spans.items():
        near = near.withColumn(f"t{c}", F.explode(F.expr(f"sequence(floor((c{c} - ({span})) / {TILE}), floor((c{c} + ({span})) / {TILE}))")))
    keys, traits = ["image_id", "tx", "ty"], ["cx", "cy", "cos", "sin", "a", "b"]
    near = near.groupBy(*keys).agg(F.collect_list(F.struct("label", *traits)).alias("_f"))
    met = near.join(_tiles(image), keys).select(*keys, "at", "s", "n", *[F.col(f"_f.{c}").alias(f"f_{c}") for c in ("label", *traits)])
    kinds = {f.name: f.dataType for f in framed.schema.fields}
    schema = StructType([*[StructField(c, kinds[c]) for c in ("image_id", "label")], *[StructField(c, IntegerType()) for c in ("cu", "cv")], StructField("value", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = {name: b.column(k) for k, name in enumerate(b.schema.names)}
            tx, ty = of["tx"].to_pylist(), of["ty"].to_pylist()
            for k in range(len(b)):
                array = lambda c, k=k: of[c][k].values.to_numpy(zero_copy_only=False)
                row, cu, cv, value = _cells_in_tile(tx[k], ty[k], array("at"), array("s"), array("n"), [array(f"f_{c}") for c in traits])
                ids = of["image_id"].take(pa.array(np.full(len(row), k)))
                yield pa.RecordBatch.from_arrays([ids, of["f_label"][k].values.take(pa.array(row)), pa.array(cu, pa.int32()), pa.array(cv, pa.int32()), pa.array(value, mask=np.isnan(value))], names=schema.names)

    return bounded(met).mapInArrow(run, schema)


def block_histograms(cells: DataFrame) -> DataFrame:
    """image_id, label, block, bin, share: per block of BLOCK x BLOCK cells the gradients' magnitudes by direction (without sign), over
    the length of the block's histogram; blocks without gradients, and bins that none falls into, are left out.

    Gradients are differences of the cells on both sides, or of a cell and its one neighbour; others don't count.
    """
    at = (F.col("cv") * CELLS + F.col("cu")).alias("at")
    listed = cells.groupBy("image_id", "label").agg(F.sort_array(F.collect_list(F.struct(at, "cu", "cv", "value"))).alias("_l"))
    each = listed.withColumn("_g", _dense("_l", "e.value", "double")).select("image_id", "label", "_g", F.explode("_l").alias("c")).select("image_id", "label", "_g", "c.*")

    def across(place: str, step: int):
        before, after = F.expr(f"CASE WHEN {place} > 0 THEN get(_g, at - {step}) END"), F.expr(f"CASE WHEN {place} < {CELLS - 1} THEN get(_g, at + {step}) END")
        return F.round(F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(F.coalesce(after - F.col("value"), F.col("value") - before)), 6)

    g = each.withColumns({"gx": across("cu", 1), "gy": across("cv", CELLS)}).where("gx IS NOT NULL AND gy IS NOT NULL AND (gx <> 0 OR gy <> 0)")
    turn = F.expr("pmod(atan2(gy, gx) + 1e-9, pi())")
    g = g.select("image_id", "label", F.expr(f"(cv div {BLOCK}) * {CELLS // BLOCK} + cu div {BLOCK}").cast("int").alias("block"), F.least(F.floor(turn / F.expr("pi()") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), F.expr("sqrt(gx * gx + gy * gy)").alias("size"))
    sums = g.groupBy("image_id", "label", "block").agg(*[F.sum(F.when(F.col("bin") == k, F.col("size"))).alias(f"_s{k}") for k in range(BINS)])
    whole = F.sqrt(sum((F.coalesce(F.col(f"_s{k}") * F.col(f"_s{k}"), F.lit(0.0)) for k in range(BINS)), F.lit(0.0)))
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("bin"), F.col(f"_s{k}").alias("size")) for k in range(BINS)])).alias("b")
    return sums.select("image_id", "label", "block", whole.alias("_whole"), bins).where("b.size IS NOT NULL").select("image_id", "label", "block", "b.bin", (F.col("b.size") / F.col("_whole")).alias("share"))
