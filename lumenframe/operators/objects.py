"""Objects found in other images: binary features matched by a band join, poses voted in bins, the best bin verified.

Rasters are rows (image_id, x, y, v). A feature is a pixel that stands out more than its eight neighbours, with a code of
comparisons within its 5 x 5 patch after turning the patch (by quarter turns) so that its bright side points to +x. Codes
within `most` bits of each other share one of most + 1 bands, so an equi-join on bands finds all such pairs; nothing forms
all pairs of features. A match says by which turn and shift the one feature comes to lie on the other; turn, scale and shift
are binned, with bins that overlap by half, and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a code that may differ, and bits of a band.
MOST, BAND = 3, 15
BITS = (MOST + 1) * BAND
#: Width of the bins of shifts.
BIN = 4


def _turned(q: int) -> list[int]:
    """Places (y * 5 + x) of the patch such that the patch is turned back by q quarter turns from +x to +y."""
    out = []
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            x, y = dx, dy
            for _ in range(q):
                x, y = -y, x
            out.append((y + 2) * 5 + x + 2)
    return out


TURNS = [_turned(q) for q in range(4)]
#: The places that bit k compares, by rule: all differ.
PAIRS = [(a, (a + d) % 25) for d in (7, 11, 3) for a in range(25)][:BITS]


def patches(df: DataFrame) -> DataFrame:
    """df with `p`, the 5 x 5 pixels around each pixel row by row, for pixels that have all of them."""
    rows = Window.partitionBy("image_id", "y").orderBy("x")
    cols = Window.partitionBy("image_id", "x").orderBy("y")
    at = lambda c, k, w: F.lag(c, -k).over(w)
    whole = (at("x", 2, rows) - at("x", -2, rows) == 4)
    made = df.select("image_id", "x", "y", "v", F.when(whole, F.array(*[at("v", k, rows) for k in range(-2, 3)])).alias("_r"))
    made = made.withColumn("p", F.when(at("y", 2, cols) - at("y", -2, cols) == 4, F.concat(*[at("_r", k, cols) for k in range(-2, 3)])))
    return made.where("p IS NOT NULL").drop("_r")


def features(df: DataFrame) -> DataFrame:
    """image_id, x, y, side (0..3: the patch's bright side is +x, +y, -x, -y), code: pixels whose patch differs from them more
    than those of their eight neighbours (which must have patches, too) do, without those whose bright side is a tie."""
    p = patches(df).withColumn("score", F.expr("aggregate(p, 0L, (s, v) -> s + abs(v - p[12]))"))
    rows = Window.partitionBy("image_id", "y").orderBy("x")
    cols = Window.partitionBy("image_id", "x").orderBy("y")
    beside = F.when(F.lead("x").over(rows) - F.lag("x").over(rows) == 2, F.greatest(F.lag("score").over(rows), F.lead("score").over(rows)))
    p = p.withColumn("_b", beside).withColumn("_t", F.when(F.col("_b").isNotNull(), F.greatest("_b", "score")))
    above, below = F.lag("_t").over(cols), F.lead("_t").over(cols)
    around = F.when((F.lead("y").over(cols) - F.lag("y").over(cols) == 2) & above.isNotNull() & below.isNotNull(), F.greatest("_b", above, below))
    p = p.withColumn("_n", around).where("score > _n")
    mx, my = (" + ".join(f"({d}) * p[{i}]" for i in range(25) if (d := (i % 5 if c == "x" else i // 5) - 2)) for c in "xy")
    p = p.withColumns({"_mx": F.expr(mx), "_my": F.expr(my)}).where("abs(_mx) <> abs(_my)")
    p = p.withColumn("side", F.expr("CASE WHEN abs(_mx) > abs(_my) THEN if(_mx > 0, 0, 2) ELSE if(_my > 0, 1, 3) END"))
    p = p.withColumn("p", F.expr(f"transform(CASE side {' '.join(f'WHEN {q} THEN array({", ".join(map(str, t))})' for q, t in enumerate(TURNS))} END, i -> p[i])"))
    bits = " + ".join(f"if(p[{a}] < p[{b}], {1 << k}L, 0L)" for k, (a, b) in enumerate(PAIRS))
    return p.select("image_id", "x", "y", "side", F.expr(bits).alias("code"))


def halved(df: DataFrame) -> DataFrame:
    """Means (rounded down) of whole squares of 2 x 2 pixels."""
    small = df.groupBy("image_id", F.expr("x div 2").cast("int").alias("x"), F.expr("y div 2").cast("int").alias("y")).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    return small.where("n = 4").select("image_id", "x", "y", F.expr("CAST(v div 4 AS INT)").alias("v"))


def matches(templates: DataFrame, scenes: DataFrame, most: int = MOST) -> DataFrame:
    """template, scene, level, tx, ty, sx, sy, turn, dx, dy, bits: pairs of features (templates: with a level) whose codes differ by at most
    `most` bits; turn and (dx, dy) bring the template's place, halved level times, to the scene's."""
    if most > MOST:
        raise ValueError("codes that differ more need not share a band")
    bands = F.posexplode(F.array(*[F.shiftright("code", k * BAND).bitwiseAND((1 << BAND) - 1) for k in range(MOST + 1)])).alias("band", "part")
    t = templates.select(F.col("image_id").alias("template"), "level", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("side").alias("ts"), F.col("code").alias("tc"), "code").select("*", bands).drop("code")
    s = scenes.select(F.col("image_id").alias("scene"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("side").alias("ss"), F.col("code").alias("sc"), "code").select("*", bands).drop("code")
    found = t.join(s, ["band", "part"]).withColumn("differ", F.col("tc").bitwiseXOR(F.col("sc")))
    # A pair is taken at the first band that it shares.
    first = F.coalesce(*[F.when(F.col("differ").bitwiseAND(((1 << BAND) - 1) << (k * BAND)) == 0, k) for k in range(MOST + 1)])
    found = found.withColumn("bits", F.bit_count("differ")).where((F.col("bits") <= most) & (F.col("band") == first)).withColumn("turn", F.expr("(ss - ts + 4) % 4"))
    x, y = "CASE turn WHEN 0 THEN tx WHEN 1 THEN -ty WHEN 2 THEN -tx ELSE ty END", "CASE turn WHEN 0 THEN ty WHEN 1 THEN tx WHEN 2 THEN -ty ELSE -tx END"
    return found.select("template", "scene", "level", "tx", "ty", "sx", "sy", "turn", F.expr(f"sx - ({x})").alias("dx"), F.expr(f"sy - ({y})").alias("dy"), "bits")


def located(found: DataFrame, least: int = 4) -> DataFrame:
    """template, scene, turn, level, dx, dy, votes, inliers: for each template and scene the pose that most of the template's features
    vote for (ties by level, turn, bin), with the commonest shift in its bin (ties to the smaller), if `least` features
    of both sides lie within one pixel of it."""
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.floor((F.col("dx") + kx) / BIN).alias("bx"), F.floor((F.col("dy") + ky) / BIN).alias("by")) for k, (kx, ky) in enumerate([(0, 0), (BIN // 2, 0), (0, BIN // 2), (BIN // 2, BIN // 2)])])).alias("b")
    binned = found.select("*", bins).select("template", "scene", "level", "turn", "tx", "ty", "sx", "sy", "dx", "dy", "b.kind", "b.bx", "b.by")
    pose = ["template", "scene", "level", "turn", "kind", "bx", "by"]
    votes = binned.groupBy(*pose).agg(F.countDistinct("tx", "ty").alias("votes"))
    best = votes.where(F.col("votes") >= least).groupBy("template", "scene").agg(F.max(F.struct("votes", *[(-F.col(c)).alias(c) for c in pose[2:]])).alias("m"))
    best = best.select("template", "scene", "m.votes", *[(-F.col(f"m.{c}")).alias(c) for c in pose[2:]])
    inside = binned.join(best, pose)
    shifts = inside.groupBy("template", "scene", "dx", "dy").agg(F.countDistinct("tx", "ty").alias("n"))
    mode = shifts.groupBy("template", "scene").agg(F.max(F.struct("n", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))).alias("m")).select("template", "scene", (-F.col("m.dx")).alias("at_x"), (-F.col("m.dy")).alias("at_y"))
    near = inside.join(mode, ["template", "scene"]).where("abs(dx - at_x) <= 1 AND abs(dy - at_y) <= 1")
    out = near.groupBy("template", "scene", "turn", "level", F.col("at_x").alias("dx"), F.col("at_y").alias("dy"), "votes").agg(F.least(F.countDistinct("tx", "ty"), F.countDistinct("sx", "sy")).alias("inliers"))
    return out.where(F.col("inliers") >= least)
