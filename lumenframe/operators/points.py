"""Point sets as rows (set_id, point_id, x, y): joins by distance, partitions, shapes and transformations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.graph import cut_lineage


#: Points of a place that are paired at a time.
SHARE = 1024


def _near(left: DataFrame, right: DataFrame, radius: float, by: str) -> DataFrame:
    """Rows (by, x1, y1, ...) and (by, x2, y2, ...) within `radius` in the same set, with d2: an equi-join on grid cells as wide as
    the radius, then the distance.

    The right side is repeated for the 9 cells around each row, the left one is not; no pair is formed beyond neighbouring cells.
    Both sides are shuffled: a broadcast is chosen by the size of the files, which tells little of rows that are repeated nine times.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = left.withColumns({"cx": cell("x1"), "cy": cell("y1")})
    right = right.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumns({"cx": cell("x2") + F.col("dx"), "cy": cell("y2") + F.col("dy")}).drop("dx", "dy")
    d2 = F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)
    return left.join(right.hint("merge"), [by, "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def _side(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.select(by, F.col("point_id").alias(f"id{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))


def radius_join(a: DataFrame, b: DataFrame, radius: float, by: str = "set_id", crowded: bool = True) -> DataFrame:
    """Pairs (by, id1, id2, d2) within `radius` in the same set.

    Points at one place are paired in shares, as lists of ids: lists are shuffled and compared, and pairs come out as runs of rows
    that differ in an id only. Their number grows with the square of a set's points. Not crowded: there are few points at a
    place, and each is paired by itself.
    """
    if not crowded:
        return _near(_side(a, by, 1), _side(b, by, 2), radius, by).select(by, "id1", "id2", "d2")

    def shares(df: DataFrame, n: int) -> DataFrame:
        place = [by, f"x{n}", f"y{n}"]
        nth = F.row_number().over(Window.partitionBy(*place).orderBy(f"id{n}"))
        listed = F.sort_array(F.collect_list(F.struct(f"id{n}"))).alias(f"ids{n}")  # structs keep nulls
        return _side(df, by, n).withColumn("_share", F.floor((nth - 1) / SHARE)).groupBy(*place, "_share").agg(listed).drop("_share")

    met = _near(shares(a, 1), shares(b, 2), radius, by).select(by, "ids1", "ids2", "d2")
    pairs = met.select(by, F.explode("ids1").alias("p"), "ids2", "d2").select(by, F.col("p.id1").alias("id1"), F.explode("ids2").alias("q"), "d2")
    return pairs.select(by, "id1", F.col("q.id2").alias("id2"), "d2")


def nearest_within(a: DataFrame, b: DataFrame, radius: float, by: str = "set_id") -> DataFrame:
    """The nearest other point within the radius, ties by id."""
    pairs = radius_join(a, b, radius, by, False).where("id1 <> id2")
    return pairs.groupBy(by, "id1").agg(F.min(F.struct("d2", "id2")).alias("m")).select(by, "id1", F.col("m.id2").alias("id2"), F.col("m.d2").alias("d2"))


def _widening(rows: DataFrame, keys: list[str], radius: float, search) -> DataFrame:
    """The results of search(rows left, radius) for all rows, with the radius doubled for those that have none yet.

    What is found within a radius is settled, so each round handles fewer rows; every row must have a result at some radius.
    """
    found, todo = None, rows
    while found is None or not todo.isEmpty():
        got = cut_lineage(search(todo, radius))
        found = got if found is None else found.unionByName(got)
        todo = cut_lineage(todo.join(got.select(*keys), keys, "left_anti"))
        radius *= 2
    return found


def _in_company(a: DataFrame, by: str) -> DataFrame:
    """The points of sets that have more than one id."""
    several = a.groupBy(by).agg(F.min("point_id").alias("_low"), F.max("point_id").alias("_high")).where("_low < _high").select(by)
    return a.join(several, by, "left_semi")


def _two_at_each_place(a: DataFrame, by: str) -> DataFrame:
    """Of the points at each place of a set the two with the smallest ids."""
    order = Window.partitionBy(by, "x", "y").orderBy("point_id")
    return a.select(by, "point_id", "x", "y").distinct().withColumn("_k", F.row_number().over(order)).where("_k <= 2").drop("_k")


def _places(firsts: DataFrame, by: str) -> DataFrame:
    """(by, x, y, _low, _next): the two smallest ids of each place, the same one twice where there is no other."""
    return firsts.groupBy(by, "x", "y").agg(F.min("point_id").alias("_low"), F.max("point_id").alias("_next"))


def nearest(a: DataFrame, radius: float, by: str = "set_id") -> DataFrame:
    """Every point's nearest other point in its set, however far; ties by id. The radius is where the search begins.

    Points with others at their place have one of these, and only the rest search, among the two smallest ids of each place:
    the work grows with the places, not with the pairs of points.
    """
    rows = _in_company(a, by).select(by, "point_id", "x", "y").distinct()
    firsts = cut_lineage(_two_at_each_place(rows, by))
    together = rows.join(_places(firsts, by).where("_low < _next").hint("merge"), [by, "x", "y"])
    other = F.when(F.col("point_id") == F.col("_low"), F.col("_next")).otherwise(F.col("_low"))
    met = cut_lineage(together.groupBy(by, F.col("point_id").alias("id1")).agg(F.min(other).alias("id2")).withColumn("d2", F.lit(0.0)))
    alone = cut_lineage(rows.withColumn("id1", F.col("point_id")).join(met.select(by, "id1").hint("merge"), [by, "id1"], "left_anti"))
    return met.unionByName(_widening(alone, [by, "id1"], radius, lambda left, r: nearest_within(left, firsts, r, by)))


def closest_pair(a: DataFrame, radius: float, by: str = "set_id") -> DataFrame:
    """Every set's closest pair of different points, however far; ties by ids. The radius is where the search begins.

    Points at one place are the closest pair of their set without a search, which only other sets need.
    """
    rows = _in_company(a, by)

    pair = lambda pairs: pairs.groupBy(by).agg(F.min(F.struct("d2", "id1", "id2")).alias("m")).select(by, "m.id1", "m.id2", "m.d2")

    def search(left: DataFrame, r: float) -> DataFrame:
        mine = rows.join(left, by, "left_semi")
        return pair(radius_join(mine, mine, r, by, False).where("id1 < id2"))

    together = _places(_two_at_each_place(rows, by), by).where("_low < _next")
    met = cut_lineage(pair(together.select(by, F.lit(0.0).alias("d2"), F.col("_low").alias("id1"), F.col("_next").alias("id2"))))
    apart = rows.select(by).distinct().join(met.select(by), by, "left_anti")
    return met.unionByName(_widening(cut_lineage(apart), [by], radius, search))


def _foremost(a: DataFrame, by: str) -> DataFrame:
    """The points with the smallest id at their place, and all those whose id is at several places."""
    at, of = Window.partitionBy(by, "x", "y"), Window.partitionBy(by, "point_id")
    moves = (F.min("x").over(of) < F.max("x").over(of)) | (F.min("y").over(of) < F.max("y").over(of))
    return a.select(by, "point_id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL").withColumns({"_low": F.min("point_id").over(at), "_moves": moves}).where("point_id = _low OR _moves").drop("_low", "_moves")


def mutual_matches(a: DataFrame, b: DataFrame, radius: float, by: str = "set_id") -> DataFrame:
    """Pairs that are each other's nearest within the radius, ties by id.

    Of the points at one place only the one with the smallest id can be the nearest of another, so no others are paired.
    """
    pairs = cut_lineage(radius_join(_foremost(a, by), _foremost(b, by), radius, by, False))
    forth = pairs.groupBy(by, "id1").agg(F.min(F.struct("d2", "id2")).alias("m")).select(by, "id1", "m.id2", "m.d2")
    back = pairs.groupBy(by, "id2").agg(F.min(F.struct("d2", "id1")).alias("m")).select(by, "m.id1", "id2")
    return forth.join(back.hint("merge"), [by, "id1", "id2"])


def f_measure(found: Column, n1: Column, n2: Column, beta: float = 1.0) -> Column:
    """F-beta of precision found / n1 and recall found / n2."""
    p, r = found / F.nullif(n1, F.lit(0)), found / F.nullif(n2, F.lit(0))
    return F.coalesce((1 + beta**2) * p * r / F.nullif(beta**2 * p + r, F.lit(0.0)), F.lit(0.0))


def grid_partition(df: DataFrame, n: int, by: str = "set_id") -> DataFrame:
    """Cell number row * n + column of an n x n grid over each set's extent; the far edges belong to the last cells."""
    w = Window.partitionBy(by)

    def part(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high == low, 0).otherwise(F.least(F.lit(n - 1), F.floor((F.col(c) - low) * n / F.nullif(high - low, F.lit(0)))))

    return df.withColumn("cell", (part("y") * n + part("x")).cast("long"))


def sample_per_cell(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Up to k points of each (set_id, cell), those with the smallest seeded hashes: the same at each run."""
    order = Window.partitionBy("set_id", "cell").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("point_id").cast("string")).cast("binary")))
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def similarity_transform(df: DataFrame, scale: float, degrees: float, tx: float, ty: float, ox: float = 0, oy: float = 0) -> DataFrame:
    """Rotation (y downwards) and scaling about an origin, then translation."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = F.col("x") - ox, F.col("y") - oy
    return df.withColumns({"xt": ox * scale + scale * (dx * c + dy * s) + tx, "yt": oy * scale + scale * (-dx * s + dy * c) + ty})


def in_polygon(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds inside: ray casting against edges (poly_id, x0, y0, x1, y1) of the point's poly_id; edges count as inside.

    An equi-join on poly_id, then sums per point; the table of edges may be of any size.
    """
    j = points.join(edges, "poly_id")
    cross = (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0"))
    on_edge = (cross == 0) & F.col("x").between(F.least("x0", "x1"), F.greatest("x0", "x1")) & F.col("y").between(F.least("y0", "y1"), F.greatest("y0", "y1"))
    at = F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0))
    hit = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (F.col("x") < at)
    key = [c for c in points.columns]
    return j.groupBy(*key).agg((F.max(F.when(on_edge, 1).otherwise(0)) + F.sum(F.when(hit, 1).otherwise(0)) % 2 > 0).alias("inside"))


def shape(df: DataFrame, by: str = "set_id") -> DataFrame:
    """Count, centroid, extent and outer bounds of each set."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def polygon_area(df: DataFrame, by: str = "curve_id", order: str = "pos") -> DataFrame:
    """Signed area of closed curves by the shoelace sum; positive where clockwise with y downwards."""
    w = Window.partitionBy(by).orderBy(order)
    first = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(first)), F.coalesce(F.lead("y").over(w), F.first("y").over(first))
    return df.withColumn("_t", F.col("x") * ny - nx * F.col("y")).groupBy(by).agg((F.sum("_t") / 2.0).alias("area"))


def hough_votes(df: DataFrame, by: str = "curve_id", order: str = "pos") -> DataFrame:
    """Votes of edge points for (theta, r): the rounded tangent angle from the previous to the next point, and
    r = sqrt((x cos t)^2 + (y sin t)^2) rounded; most votes first by rank."""
    w = Window.partitionBy(by).orderBy(order)
    rows = df.withColumns({"_px": F.lag("x").over(w), "_py": F.lag("y").over(w), "_nx": F.lead("x").over(w), "_ny": F.lead("y").over(w)}).where("_px IS NOT NULL AND _nx IS NOT NULL")
    rows = rows.withColumn("theta", F.expr("CAST(pmod(CAST(floor(degrees(atan2(CAST(_ny - _py AS DOUBLE), CAST(_nx - _px AS DOUBLE))) + 0.5D) AS INT), 360) AS INT)"))
    rows = rows.withColumn("r", F.expr("CAST(floor(sqrt(pow(x * cos(radians(theta)), 2) + pow(y * sin(radians(theta)), 2)) + 0.5D) AS INT)"))
    return rows.groupBy(by, "theta", "r").agg(F.count("*").alias("votes"))


def similarity_steps(prefix: str, x: str, y: str, out: str) -> list[tuple[str, str]]:
    """Steps of a point turned and scaled about an origin, then shifted; the parameters are columns scale, turn, ox, oy, tx, ty."""
    s, t, ox, oy, tx, ty = (f"{prefix}{n}" for n in ("scale", "turn", "ox", "oy", "tx", "ty"))
    return [
        (f"x{out}", f"{ox} * {s} + {s} * (({x} - {ox}) * cos({t}) + ({y} - {oy}) * sin({t})) + {tx}"),
        (f"y{out}", f"{oy} * {s} + {s} * (({y} - {oy}) * cos({t}) - ({x} - {ox}) * sin({t})) + {ty}"),
    ]


def similarity_reversed() -> list[tuple[str, str]]:
    """Steps of the parameters back_* that undo similarity_steps: about the image of the origin."""
    return [
        ("back_scale", "1 / scale"), ("back_turn", "CASE WHEN turn > 0 THEN 2 * pi() - turn ELSE -turn END"),
        ("back_ox", "ox * scale + tx"), ("back_oy", "oy * scale + ty"),
        ("back_tx", "ox - back_ox * back_scale"), ("back_ty", "oy - back_oy * back_scale"),
    ]


def similar_transformations(df: DataFrame, scale: str, turn: str, share: float = 0.1, degrees: int = 20, by: str = "set_id", key: str = "point_id") -> DataFrame:
    """(by, key, likes): how many others of a group are alike in scale (both within `share` of their mean) and turn.

    Rows of the same scale and turn are counted first. Pairs of these classes are sought in cells of the turn as wide as
    `degrees` (a divisor of 360) and of the logarithm of the scale, so a class meets those of nine cells only; the counts are
    added up and handed to the rows, less the rows of the key itself. No pair is kept.
    """
    ratio = (1 + share) / (1 - share)
    rows = df.select(by, key, scale, turn)
    classes = rows.groupBy(by, scale, turn).agg(F.count("*").alias("_n"))
    cells = classes.withColumns({"_t": F.floor(F.pmod(F.col(turn), F.lit(360)) / degrees).cast("int"), "_s": F.floor(F.log(F.col(scale)) / math.log(ratio * (1 + 1e-9))).cast("int")})
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    other = [F.col(scale).alias("_scale"), F.col(turn).alias("_turn")]
    near = cells.select(by, F.col("_n").alias("_m"), *other, "_t", "_s", F.explode(step).alias("_dt")).withColumn("_ds", F.explode(step))
    near = near.select(by, "_m", "_scale", "_turn", F.pmod(F.col("_t") + F.col("_dt"), F.lit(360 // degrees)).alias("_t"), (F.col("_s") + F.col("_ds")).alias("_s"))
    gap = F.abs(F.col(turn) - F.col("_turn"))
    # Half the difference within a share of half the sum; rounded, so that the limit itself counts.
    alike = (F.round(F.abs(F.col(scale) - F.col("_scale")) - share * (F.col(scale) + F.col("_scale")), 9) <= 0) & (F.least(gap, 360 - gap) <= degrees)
    likes = cells.join(near.hint("merge"), [by, "_t", "_s"]).groupBy(by, scale, turn).agg(F.sum(F.when(alike, F.col("_m")).otherwise(0)).alias("_likes"))
    mine = rows.join(rows.select(by, key, *other).hint("merge"), [by, key]).groupBy(by, key).agg(F.count_if(alike).alias("_mine"))
    every = rows.join(likes.hint("merge"), [by, scale, turn]).groupBy(by, key).agg(F.sum("_likes").alias("_likes"))
    return every.join(mine.hint("merge"), [by, key]).select(by, key, (F.col("_likes") - F.col("_mine")).alias("likes"))


def average_transformation(df: DataFrame, by: str = "set_id") -> DataFrame:
    """Means and deviations of scale, turn (degrees in 0..360) and shift by group; turns on both sides of 0 are averaged across it."""
    spread = Window.partitionBy(by)
    wraps = F.max("turn").over(spread) - F.min("turn").over(spread) > 180
    t = df.withColumn("_w", wraps).withColumn("turn", F.when(F.col("_w") & (F.col("turn") < 180), F.col("turn") + 360).otherwise(F.col("turn")))
    mean = t.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("turn", "scale", "tx", "ty")], *[F.stddev_samp(c).alias(f"{c}_sd") for c in ("turn", "scale", "tx", "ty")])
    return mean.withColumn("turn", F.when(F.col("turn") > 360, F.col("turn") - 360).otherwise(F.col("turn")))


def closed_curves(df: DataFrame, gap: int, least: int = 2, by: str = "curve_id", order: str = "pos") -> DataFrame:
    """(by, n, closed): whether a curve of `least` points or more ends within `gap` of its beginning in x and in y.

    Of several points at the first or last position the smallest or largest (x, y) counts.
    """
    at = F.struct(order, "x", "y")
    ends = df.groupBy(by).agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    near = lambda c: F.abs(F.col("a")[c] - F.col("b")[c]) <= gap
    return ends.select(by, "n", ((F.col("n") >= least) & near("x") & near("y")).alias("closed"))


def scaled_down(df: DataFrame, scale: float, by: str = "set_id", order: str = "point_id") -> DataFrame:
    """Points scaled about the centroid of their set and rounded; of those that fall together the last one stays."""
    centre = df.groupBy(by).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    to = lambda c: F.floor(F.round(F.col(f"_c{c}") + scale * (F.col(c) - F.col(f"_c{c}")), 9) + 0.5).cast("int")
    moved = df.join(centre, by).select(by, order, to("x").alias("x"), to("y").alias("y"))
    return moved.groupBy(by, "x", "y").agg(F.max(order).alias(order))


def circle(radii: DataFrame) -> DataFrame:
    """(radius, x, y, pos) of whole-numbered circles of radius 1 or more about (0, 0), counter-clockwise from (radius, 0).

    One quarter is sampled at steps of asin(1 / radius) and mirrored; positions follow the angle.
    """
    step, half = F.asin(1 / F.col("radius")), F.lit(math.pi / 2)
    quarter = radii.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.floor(half / step + 1e-9)), lambda k: k * step)))
    whole = lambda f: F.floor(F.round(F.col("radius") * f("t"), 9) + 0.5).cast("int")
    quarter = quarter.select("radius", whole(F.cos).alias("x"), whole(F.sin).alias("y"))
    mirrored = F.array(*[F.struct((sx * F.col("x")).alias("x"), (sy * F.col("y")).alias("y")) for sx in (1, -1) for sy in (1, -1)])
    ring = quarter.select("radius", F.explode(mirrored).alias("p")).select("radius", "p.x", "p.y").distinct()
    angle = F.round(F.pmod(F.atan2("y", "x") + F.lit(2 * math.pi), F.lit(2 * math.pi)), 9)
    return ring.withColumn("pos", F.row_number().over(Window.partitionBy("radius").orderBy(angle, F.col("x"))) - 1)


def windows(df: DataFrame, half: int, width: int, height: int, by: list[str]) -> DataFrame:
    """All points of the square of half-width `half` about each point, within 0..width-1 and 0..height-1."""
    ends = lambda c, n: F.sequence(F.greatest(F.col(c) - half, F.lit(0)), F.least(F.col(c) + half, F.lit(n - 1)))
    inside = df.where(F.col("x").between(-half, width - 1 + half) & F.col("y").between(-half, height - 1 + half))
    return inside.select(*by, ends("x", width).alias("_x"), ends("y", height).alias("_y")).select(*by, F.explode("_x").alias("x"), "_y").select(*by, "x", F.explode("_y").alias("y"))


def chord_distance(chord: str, longest: str, length: str, most: str) -> list[tuple[str, str]]:
    """Step distance: the square of the share of `most` points that isn't matched, plus that of the chord difference over the longest."""
    return [("distance", f"pow(1 - ({length}) / ({most}), 2) + CASE WHEN {longest} = 0 THEN 0e0 ELSE pow(({chord}) / {longest}, 2) END")]
