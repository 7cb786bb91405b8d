"""Watershed of sparse pixels in tiles: no raster has to fit a task.

Pixels are rows (image_id, x, y, v), all different, neighbours are the eight around. Plateaus are completed: their pixels are
ordered by the distance (within the plateau) to a pixel with a lower neighbour. Minima are plateaus without one. Every other
pixel has the neighbours below it, by value and then distance, as parents; pixels from which these lead to one minimum only
belong to its basin, the others are the watershed.

A tile, with the pixels beside it, is the largest unit of a task and is worked out at once; only what crosses borders of tiles
takes rounds, of those tiles beside which something has changed. Images within one tile take none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.chains import AROUND, name
from lumenframe.operators.graph import TILE, connected_values, cut_lineage

_KEY = ["image_id", "_tx", "_ty"]
_PLACED = "image_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"


def met(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides: fronts and pointers of a round may be taken for small, and would pass through the driver."""
    return a.join(b.hint("merge"), on, how)


def jumped(pointers: DataFrame) -> DataFrame:
    """image_id, p, root: where pointers (p, to; roots point to themselves) lead, by doubling."""
    pointers = cut_lineage(pointers)
    while True:
        far = pointers.select("image_id", F.col("p").alias("to"), F.col("to").alias("further"))
        new = cut_lineage(met(pointers, far, ["image_id", "to"]).select("image_id", "p", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
        pointers = new.select("image_id", "p", "to")
        if new.where("moved").isEmpty():
            return pointers.withColumnRenamed("to", "root")


def joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """image_id, p, root: the smallest node of each component. Each round points every component's root to the smallest root
    beside it, and jumps to the end of these pointers."""
    roots = nodes.select("image_id", "p", F.col("p").alias("root"))
    while True:
        side = lambda c: roots.select("image_id", F.col("p").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        across = met(met(edges, side("p"), ["image_id", "p"]), side("q"), ["image_id", "q"]).where("root_q < root_p")
        hooks = cut_lineage(across.groupBy("image_id", F.col("root_p").alias("p")).agg(F.min("root_q").alias("to")))
        if hooks.isEmpty():
            return roots
        every = met(roots.where("p = root").select("image_id", "p"), hooks, ["image_id", "p"], "left").select("image_id", "p", F.coalesce("to", "p").alias("to"))
        ends = jumped(every).select("image_id", F.col("p").alias("root"), F.col("root").alias("end"))
        roots = cut_lineage(met(roots, ends, ["image_id", "root"]).select("image_id", "p", F.col("end").alias("root")))


def _beside(pixels: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """The pixels at borders of their tiles, once for each of `tiles` beside them and with its numbers."""
    at = lambda c, d: f"pmod({c}, {tile}) = {tile - 1 if d > 0 else 0}" if d else "true"
    to = [F.when(F.expr(f"{at('x', dx)} AND {at('y', dy)}"), F.struct((F.col("_tx") + dx).alias("_tx"), (F.col("_ty") + dy).alias("_ty"))) for dx, dy in AROUND]
    border = pixels.where(f"pmod(x, {tile}) IN (0, {tile - 1}) OR pmod(y, {tile}) IN (0, {tile - 1})")
    sent = border.withColumn("_to", F.explode(F.array_compact(F.array(*to)))).withColumns({c: F.col(f"_to.{c}") for c in ("_tx", "_ty")}).drop("_to")
    return met(sent, tiles, _KEY, "left_semi")


def _rounds(pixels: DataFrame, run: Callable[[pa.Table], pa.Table], tile: int) -> DataFrame:
    """What run makes of all tiles and of the pixels beside them (not _own), again for those beside which some are _new."""
    tiles = cut_lineage(pixels.select(*_KEY).distinct())
    todo, rest, left = pixels, None, tiles
    while True:
        seen = _beside(pixels, left, tile).withColumn("_own", F.lit(False))
        made = todo.withColumn("_own", F.lit(True)).unionByName(seen).groupBy(*_KEY).applyInArrow(run, pixels.schema)
        pixels = cut_lineage(made if rest is None else made.unionByName(rest))
        left = cut_lineage(_beside(pixels.where("_new"), tiles, tile).select(*_KEY).distinct())
        if left.isEmpty():
            return pixels
        todo, rest = met(pixels, left, _KEY, "left_semi"), met(pixels, left, _KEY, "left_anti").withColumn("_new", F.lit(False))


class _Grid:
    """Pixels of a table on a raster with a margin: their places, which are its own, and values as whole numbers in order (-1: none)."""

    def __init__(self, pixels: pa.Table) -> None:
        x, y = (pixels[c].to_numpy().astype(np.int64) for c in "xy")
        self.wide = x.max() - x.min() + 3
        self.at = (y - y.min() + 1) * self.wide + x - x.min() + 1
        self.size = (y.max() - y.min() + 3) * self.wide
        self.own = pixels["_own"].to_numpy()
        self.around = np.array(sorted(dy * self.wide + dx for dx, dy in AROUND))  # in the order of their names
        there = pixels["v"].is_valid().to_numpy()
        self.code = np.full(self.size, -1)
        self.code[self.at[there]] = np.unique(pixels["v"].filter(pa.array(there)).to_numpy(), return_inverse=True)[1]

    def spread(self, column: pa.ChunkedArray, none: int | bool) -> np.ndarray:
        out = np.full(self.size, none)
        out[self.at] = column.fill_null(none).to_numpy()
        return out

    def mine(self, a: np.ndarray, of: pa.Table, column: str, there: np.ndarray | None = None) -> pa.Array:
        """The own pixels' values, null where they aren't there."""
        at = self.at[self.own]
        return pa.array(a[at], of.schema.field(column).type, mask=None if there is None else ~there[at])


def _made(pixels: pa.Table, grid: _Grid, **columns: pa.Array) -> pa.Table:
    out = pixels.filter(pa.array(grid.own)).drop_columns(["_own"])
    for c, v in columns.items():
        out = out.set_column(out.schema.get_field_index(c), c, v)
    return out


def _levelled(pixels: pa.Table) -> pa.Table:
    """dist of a tile's pixels: 1 beside lower ones, one more a step within plateaus, from pixels of other tiles too; else null."""
    grid = _Grid(pixels)
    code, before = grid.code, grid.spread(pixels["dist"], 0)
    dist = before.copy()
    mine = grid.at[grid.own & (code[grid.at] >= 0)]
    beside = code[mine[:, None] + grid.around]
    dist[mine[((beside >= 0) & (beside < code[mine][:, None])).any(axis=1)]] = 1
    open_ = np.zeros(grid.size, bool)
    open_[mine] = True
    given = grid.at[dist[grid.at] > 0]
    given = given[np.argsort(dist[given], kind="stable")]
    steps, front, step, k = dist[given], given[:0], 0, 0
    while len(front) or k < len(given):
        step = step + 1 if len(front) else steps[k]
        end = np.searchsorted(steps, step, "right")
        front, k = np.concatenate([front, given[k:end]]), end
        front = front[dist[front] == step]
        near = front[:, None] + grid.around
        further = open_[near] & (code[near] == code[front][:, None]) & ((dist[near] == 0) | (dist[near] > step + 1))
        front = np.unique(near[further])
        dist[front] = step + 1
    return _made(pixels, grid, dist=grid.mine(dist, pixels, "dist", dist > 0), _new=grid.mine(dist != before, pixels, "_new"))


def _followed(pixels: pa.Table) -> pa.Table:
    """root and ridge of a tile's pixels, from the lowest up; null where they hang on pixels of other tiles without these."""
    grid = _Grid(pixels)
    code, dist, root, ridge = grid.code, grid.spread(pixels["dist"], 0), grid.spread(pixels["root"], 0), grid.spread(pixels["ridge"], False)
    known = grid.spread(pixels["root"].is_valid(), False)
    before = known.copy()
    todo = grid.at[grid.own & ~known[grid.at]]
    todo = todo[np.lexsort((dist[todo], code[todo]))]
    level = np.flatnonzero((np.diff(code[todo]) != 0) | (np.diff(dist[todo]) != 0)) + 1
    for part in np.split(todo, level):
        near = part[:, None] + grid.around
        c, d = code[near], code[part][:, None]
        parent = (c >= 0) & ((c < d) | ((c == d) & (dist[near] < dist[part][:, None])))
        ready = (known[near] | ~parent).all(axis=1)
        part, near, parent = part[ready], near[ready], parent[ready]
        root[part] = root[near[np.arange(len(part)), parent.argmax(axis=1)]]
        # A ridge begins where parents differ, and what lies above it belongs to it.
        ridge[part] = (parent & (ridge[near] | (root[near] != root[part][:, None]))).any(axis=1)
        known[part] = True
    made = {c: grid.mine(a, pixels, c, known) for c, a in (("root", root), ("ridge", ridge))}
    return _made(pixels, grid, _new=grid.mine(known & ~before, pixels, "_new"), **made)


def _complete(df: DataFrame, tile: int) -> DataFrame:
    """Pixels in tiles with their dist, null in minima."""
    pixels = df.where(_PLACED).select("image_id", *[F.floor(F.col(c) / tile).alias(f"_t{c}") for c in "xy"], "x", "y", "v", F.lit(None).cast("int").alias("dist"), F.lit(False).alias("_new"))
    return _rounds(cut_lineage(pixels), _levelled, tile)


def lower_complete(df: DataFrame, tile: int = TILE) -> DataFrame:
    """image_id, p, v, dist: the distance of each pixel to a lower neighbour, 1 if it has one, 0 in minima."""
    made = _complete(df, tile).select("image_id", name().alias("p"), "v", F.coalesce("dist", F.lit(0)).alias("dist"))
    return made.unionByName(df.where(f"NOT ({_PLACED})").select("image_id", name().alias("p"), "v", F.lit(0).alias("dist")))


def watershed(df: DataFrame, tile: int = TILE) -> DataFrame:
    """image_id, x, y, v, dist, basin, label: basin is the smallest pixel (y * 2^20 + x) of the minimum to which the smallest
    parents lead; label is the same, or 0 on the watershed (so the basin of pixel 0 is named 0 in both: tell it by `ridge`)."""
    made = _complete(df, tile)
    minima = connected_values(made.where("dist IS NULL AND v IS NOT NULL"), "v", eight=True, tile=tile).select("image_id", "x", "y", "component")
    root = F.coalesce("component", F.when(F.col("v").isNull(), name()))
    start = met(made, minima, ["image_id", "x", "y"], "left").select(*_KEY, "x", "y", "v", F.coalesce("dist", F.lit(0)).alias("dist"), root.alias("root"), F.when(root.isNotNull(), False).alias("ridge"), F.lit(False).alias("_new"))
    out = _rounds(cut_lineage(start), _followed, tile)
    return out.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "v", "dist", F.col("root").alias("basin"), F.when(F.col("ridge"), 0).otherwise(F.col("root")).alias("label"), "ridge")
