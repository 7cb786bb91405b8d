"""Curves traced out of sets of pixels by pointer doubling: the rounds grow with the logarithm of the longest curve.

Pixels are rows (image_id, x, y), all different. Two pixels are linked if they are 4-neighbours, or diagonal ones without a
pixel that is a 4-neighbour of both, so thin lines have no triangles. Pixels with more than two links are junctions; they cut
curves and belong to none. A pixel's name is y * 2^20 + x.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.graph import cut_lineage

#: Offsets of the neighbours, E first and clockwise (y points down); bit k of a mask is neighbour k.
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
_STEPS = "array(" + ", ".join(f"{dy} * 1048576L + {dx}" for dx, dy in AROUND) + ")"


def name() -> F.Column:
    return F.expr("y * 1048576L + x")


def masks(df: DataFrame, says: str = "255", name: str = "mask") -> DataFrame:
    """df (image_id, x, y, ...) with a mask of the neighbours that are in df and whose bit for this pixel is set in their `says`.

    Each pixel tells the cells around it that it is there, and cells are grouped: one shuffle, no join.
    """
    others = [c for c in df.columns if c not in ("image_id", "x", "y")]
    told = F.array(F.struct("x", "y", F.lit(0).alias("bit"), F.struct(F.lit(True).alias("here"), *others).alias("own")), *[
        F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.expr(f"CASE WHEN {says} & {1 << k} <> 0 THEN {1 << ((k + 4) % 8)} ELSE 0 END").alias("bit"), F.lit(None).cast(f"struct<here:boolean{''.join(f',{c}:{t}' for c, t in df.select(*others).dtypes)}>").alias("own"))
        for k, (dx, dy) in enumerate(AROUND)
    ])
    cells = df.select("image_id", F.explode(told).alias("t")).groupBy("image_id", "t.x", "t.y").agg(F.max("t.own").alias("own"), F.bit_or("t.bit").alias(name))
    return cells.where("own.here").select("image_id", "x", "y", *[F.col(f"own.{c}").alias(c) for c in others], name)


def linked(df: DataFrame) -> DataFrame:
    """image_id, x, y, links (a mask of the linked neighbours), degree."""
    bits = []
    for k in range(8):
        apart = f"mask & {(1 << ((k + 1) % 8)) | (1 << ((k + 7) % 8))} = 0" if k % 2 else "true"
        bits.append(f"CASE WHEN {apart} THEN mask & {1 << k} ELSE 0 END")
    return masks(df.select("image_id", "x", "y")).select("image_id", "x", "y", F.expr(" | ".join(bits)).alias("links")).withColumn("degree", F.bit_count("links"))


def junctions(df: DataFrame) -> DataFrame:
    """image_id, x, y, degree: the pixels with more than two links."""
    return linked(df).where("degree > 2").select("image_id", "x", "y", "degree")


def _doubled(arcs: DataFrame, more: dict[str, str]) -> DataFrame:
    """Arcs (image_id, p, q) that jump to arcs (to_p, to_q) until they have an `end`; dist counts the steps of the jump, and each
    expression of `more` merges a column with that of the arc reached (there named other_...). Arcs on cycles never end:
    the rounds stop once nothing changes."""
    arcs, seen = cut_lineage(arcs), None
    while True:
        state = arcs.agg(F.count(F.when(F.col("end").isNull(), 1)), F.sum(F.when(F.col("end").isNull(), F.col("low").cast("decimal(38,0)")))).first()
        if not state[0] or tuple(state) == seen:
            return arcs
        seen = tuple(state)
        other = arcs.select("image_id", F.col("p").alias("to_p"), F.col("q").alias("to_q"), *[F.col(c).alias(f"other_{c}") for c in ("to_p", "to_q", "dist", "end", *more)])
        moved = arcs.where("end IS NULL").join(other, ["image_id", "to_p", "to_q"])
        merged = {"to_p": "other_to_p", "to_q": "other_to_q", "dist": "dist + other_dist", "end": "other_end", **more}
        arcs = cut_lineage(arcs.where("end IS NOT NULL").unionByName(moved.select("image_id", "p", "q", *[F.expr(e).alias(c) for c, e in merged.items()])))


def trace(df: DataFrame) -> DataFrame:
    """image_id, curve, pos, x, y, closed: the curves of the pixels, in order.

    A curve is named by its smaller end and starts there; a closed one, by its smallest pixel, and goes on from there to the
    smaller of its two neighbours. A pixel without links, or with links to junctions only, is a curve of its own.
    """
    chain = linked(df).where("degree <= 2").select("image_id", "x", "y", "links")
    chain = masks(chain, "links", "mask").select("image_id", "x", "y", F.expr("links & mask").alias("links"))
    steps = f"transform(filter(sequence(0, 7), k -> links & shiftleft(1, k) <> 0), k -> y * 1048576L + x + {_STEPS}[k])"
    pixels = cut_lineage(chain.select("image_id", name().alias("p"), F.array_sort(F.expr(steps)).alias("near")))
    arcs = pixels.select("image_id", "p", F.explode("near").alias("q"))
    after = arcs.join(pixels.select("image_id", F.col("p").alias("q"), F.col("near").alias("far")), ["image_id", "q"])
    after = after.withColumn("to_q", F.expr("get(filter(far, r -> r <> p), 0)")).select("image_id", "p", "q", F.when(F.col("to_q").isNotNull(), F.col("q")).alias("to_p"), "to_q")
    ends = _doubled(after.withColumns({"dist": F.lit(1).cast("long"), "end": F.when(F.col("to_q").isNull(), F.col("q")), "low": F.col("p")}), {"low": "least(low, other_low)"})
    # Open curves: the two ends of each pixel, itself where it has no neighbour on a side.
    sides = ends.where("end IS NOT NULL").select("image_id", "p", "end", "dist").unionByName(pixels.where("size(near) < 2").select("image_id", "p", F.col("p").alias("end"), F.lit(0).cast("long").alias("dist")))
    opened = sides.groupBy("image_id", "p").agg(F.min(F.struct("end", "dist")).alias("s")).select("image_id", "p", F.col("s.end").alias("curve"), F.col("s.dist").alias("pos"), F.lit(False).alias("closed"))
    # Closed ones are cut at their smallest pixel; `via` is the pixel from which it is reached.
    around = ends.where("end IS NULL").select("image_id", "p", "q", "low")
    cut = after.join(around, ["image_id", "p", "q"]).withColumn("end", F.when(F.col("q") == F.col("low"), F.col("q")))
    cut = cut.select("image_id", "p", "q", *[F.when(F.col("end").isNull(), F.col(c)).alias(c) for c in ("to_p", "to_q")], F.lit(1).cast("long").alias("dist"), "end", "low", F.col("p").alias("via"))
    rounds = _doubled(cut, {"low": "low", "via": "other_via"})
    first = pixels.select("image_id", F.col("p").alias("low"), F.get("near", F.lit(0)).alias("via"))
    closed = rounds.join(first, ["image_id", "low", "via"]).select("image_id", "p", F.col("low").alias("curve"), F.when(F.col("p") == F.col("low"), 0).otherwise(F.col("dist")).alias("pos"), F.lit(True).alias("closed"))
    return opened.unionByName(closed).select("image_id", "curve", "pos", F.expr("CAST(p & 1048575 AS INT)").alias("x"), F.expr("CAST(p >> 20 AS INT)").alias("y"), "closed")


def closing(curves: DataFrame, gap: int = 1, least: int = 6) -> DataFrame:
    """image_id, curve, n, closed, gap_x, gap_y, fills: per traced curve of at least `least` pixels, how far its ends are apart; it
    counts as closed if neither difference exceeds gap + 1, and `fills` pixels then close it."""
    g = curves.groupBy("image_id", "curve").agg(F.count("*").alias("n"), F.min(F.struct("pos", "x", "y")).alias("a"), F.max(F.struct("pos", "x", "y")).alias("b"), F.max("closed").alias("cycle"))
    g = g.where(F.col("n") >= least).select("image_id", "curve", "n", "cycle", F.abs(F.col("a.x") - F.col("b.x")).alias("gap_x"), F.abs(F.col("a.y") - F.col("b.y")).alias("gap_y"))
    g = g.withColumn("closed", F.col("cycle") | (F.greatest("gap_x", "gap_y") <= gap + 1))
    return g.select("image_id", "curve", "n", "closed", "gap_x", "gap_y", F.when(F.col("closed"), F.greatest(F.greatest("gap_x", "gap_y") - 1, F.lit(0))).otherwise(0).alias("fills"))
