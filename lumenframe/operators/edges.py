"""Gradients of colour and hue, difference of Gaussians, contrast, median pyramids, holes and labels of single pixels.

All of it works on rows of pixels (image_id, x, y, ...) and shuffles by image and row or column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import color
from lumenframe.functions.steps import applied, renamed
from lumenframe.operators import filters, graph, raster

PIXEL = ["image_id", "x", "y"]


def hue_steps(df: DataFrame, least: int, value: str = "v", turn: int = 255) -> DataFrame:
    """Adds step: 1 where the neighbours left and right, or above and below, differ by `least` or more on a circle of `turn`.

    Pixels without all four neighbours have 0.
    """

    def far(a: str, b: str) -> Column:
        gap = F.abs(F.col(a) - F.col(b))
        return F.least(gap, turn - gap) >= least

    inside = F.col("w").isNotNull() & F.col("e").isNotNull() & F.col("n").isNotNull() & F.col("s").isNotNull()
    return raster.neighbours(df, value).withColumn("step", F.when(inside & (far("w", "e") | far("n", "s")), 1).otherwise(0)).drop(*raster.AROUND)


def colour_gradient(df: DataFrame) -> DataFrame:
    """(image_id, x, y, gx, gy, gxy): CIEDE2000 between the neighbours of a pixel; at an edge the pixel itself is one of them."""
    lab = applied(df, color.lab()).select(*PIXEL, F.struct("lab_l", "lab_a", "lab_b").alias("lab"))
    near, steps = raster.neighbours(lab, "lab"), color.delta_e_2000()
    for axis, before, after in (("x", "w", "e"), ("y", "n", "s")):
        sides = {f"{c}{k}{axis}": F.coalesce(side, "lab")[f"lab_{c}"] for k, side in ((1, before), (2, after)) for c in "lab"}
        names = {f"{c}{k}": f"{c}{k}{axis}" for k in (1, 2) for c in "lab"} | {n: f"{n}_{axis}" for n, _ in steps}
        near = applied(near.withColumns(sides), renamed(steps, names))
    return near.selectExpr(*PIXEL, "de2000_x AS gx", "de2000_y AS gy", "sqrt((de2000_x * de2000_x + de2000_y * de2000_y) / 2) AS gxy")


def difference_of_gaussians(df: DataFrame, sigma: float, ratio: float = 1.6, value: str = "v") -> DataFrame:
    """Adds gx and gy: along rows and along columns, the narrow blur less the one `ratio` times as wide, as one kernel."""
    wide, narrow = filters.gaussian(sigma * ratio), filters.gaussian(sigma)
    pad = [0.0] * ((len(wide) - len(narrow)) // 2)
    kernel = [n - w for n, w in zip([*pad, *narrow, *pad], wide, strict=True)]
    rows = filters.convolve(df, kernel, ["image_id", "y"], "x", value, "gx")
    return filters.convolve(rows, kernel, ["image_id", "x"], "y", value, "gy")


def divided_by_blur(df: DataFrame, sigma: float, value: str = "v") -> DataFrame:
    """Adds ratio: 100 times a pixel over its blurred whole value, cut to a whole number; 0 where the blurred one is 0."""
    kernel = filters.gaussian(sigma)
    blurred = filters.separable(df, kernel, kernel, value, "_b").withColumn("_b", F.floor(F.round("_b", 6)))
    return blurred.withColumn("ratio", F.when(F.col("_b") != 0, F.floor(F.round(100 * F.col(value) / F.nullif(F.col("_b"), F.lit(0)), 6))).otherwise(0).cast("int")).drop("_b")


def contrasted(df: DataFrame, half: int, k: float = 0.2, value: str = "v") -> DataFrame:
    """Adds contrast: pixels above their local threshold are raised by it, then each image is spread to 0..255."""
    raised = raster.adaptive_threshold(df, half, k, value).withColumn("_t", F.round("t", 9))
    raised = raised.withColumn("_v", F.col(value) + F.when(F.col(value) > F.col("_t"), F.col("_t")).otherwise(F.lit(0.0)))
    return raster.rescaled(raised, 0, 255, "_v").withColumn("contrast", F.floor(F.round("scaled", 6)).cast("int")).drop("t", "_t", "_v", "scaled")


def median_filtered(df: DataFrame, value: str = "v", complete: bool = False) -> DataFrame:
    """Adds median: the upper median of the 3 x 3 pixels that are there. complete=True: absent pixels are rows of nulls."""
    near = raster.neighbours(df, value, complete).withColumn("_a", F.array_sort(F.array_compact(F.array(value, *raster.AROUND))))
    return near.withColumn("median", F.expr("_a[size(_a) div 2]")).drop("_a", *raster.AROUND)


def median_pyramid(df: DataFrame, levels: int, value: str = "v") -> tuple[list[DataFrame], DataFrame]:
    """Coefficients (image_id, x, y, w) of each level, the first at full size, and the last smooth image (v).

    A level is the median-filtered one before at half the size; its coefficients are what that leaves over. Absent pixels
    are filled in once, as nulls, and left out of the results.
    """
    now, out = raster.filled(df.select(*PIXEL, F.col(value).cast("int").alias("v")), "v"), []
    halves = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in "xy"]
    for _ in range(levels):
        bins = Window.partitionBy("image_id", *halves)
        level = median_filtered(now, complete=True).withColumn("median", F.when(F.col("v").isNotNull(), F.col("median")))
        level = level.withColumn("_up", F.floor(F.avg("median").over(bins) + 0.5).cast("int"))
        out.append(level.where("v IS NOT NULL").select(*PIXEL, (F.col("v") - F.col("_up")).alias("w")))
        now = level.groupBy("image_id", *halves).agg(F.first("_up").alias("v"))
    return out, now.where("v IS NOT NULL")


def pyramid_rebuilt(coefficients: list[DataFrame], smooth: DataFrame) -> DataFrame:
    """The image of a median pyramid, exactly."""
    for w in reversed(coefficients):
        keys = w.withColumns({"_x": F.floor(F.col("x") / 2).cast("int"), "_y": F.floor(F.col("y") / 2).cast("int")})
        coarse = smooth.select("image_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias("_up"))
        smooth = keys.join(coarse, ["image_id", "_x", "_y"]).select(*PIXEL, (F.col("_up") + F.col("w")).alias("v"))
    return smooth


def image_curvature(df: DataFrame, sigma: float, value: str = "v") -> DataFrame:
    """Adds k = (gx gyy - gy gxx) / (gx^2 + gy^2)^1.5 by Gaussian derivatives, the second ones of the first; 0 where flat."""
    first, second = [-w for w in filters.gaussian(0.5**0.5, 1)], [-w for w in filters.gaussian(sigma, 1)]
    rows, columns = ["image_id", "y"], ["image_id", "x"]
    out = filters.convolve(filters.convolve(df, first, rows, "x", value, "gx"), second, rows, "x", "gx", "gxx")
    out = filters.convolve(filters.convolve(out, first, columns, "y", value, "gy"), second, columns, "y", "gy", "gyy")
    return out.withColumn("k", F.expr("CASE WHEN gx * gx + gy * gy < 1e-12 THEN 0D ELSE (gx * gyy - gy * gxx) / pow(gx * gx + gy * gy, 1.5D) END"))


def holes(df: DataFrame, value: str = "v") -> DataFrame:
    """Pixels (image_id, x, y) of value 0 that pixels of other values enclose, neighbours being those of the same row or column.

    A region of zeros is enclosed if it stays inside of the others' bounding box on all sides; absent pixels count as others.
    """
    pieces = graph.connected_per_image(df.select(*PIXEL, F.when(F.col(value) == 0, 0).otherwise(1).alias("v")), "v", False, 1)
    ends = [f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo_", F.min), ("hi_", F.max))]
    box = pieces.where("v = 1").groupBy("image_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("first_", F.min), ("last_", F.max))])
    inside = pieces.where("v = 0").groupBy("image_id", "component").agg(*ends).join(box, "image_id").where("lo_x > first_x AND hi_x < last_x AND lo_y > first_y AND hi_y < last_y")
    return pieces.where("v = 0").join(inside.select("image_id", "component"), ["image_id", "component"], "left_semi").select(*PIXEL)


def without_single_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds relabelled: a pixel whose four neighbours all have other labels takes that of the one nearest in CIELAB.

    Of equally near ones the first of left, right, above and below counts; all pixels are judged by the labels before.
    """
    lab = applied(df, color.lab()).withColumn("_p", F.struct(F.col(label).alias("label"), "lab_l", "lab_a", "lab_b"))
    near = raster.neighbours(lab.select(*df.columns, "_p"), "_p")
    far = lambda c: sum((F.col("_p")[n] - F.col(c)[n]) * (F.col("_p")[n] - F.col(c)[n]) for n in ("lab_l", "lab_a", "lab_b"))
    sides = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.round(far(c), 6).alias("d"), F.lit(k).alias("k"), F.col(c)["label"].alias("label"))) for k, c in enumerate(("w", "e", "n", "s"))]))
    near = near.withColumn("_s", sides)
    alone = ~F.exists("_s", lambda z: z["label"] == F.col(label)) & (F.size("_s") > 0)
    return near.withColumn("relabelled", F.when(alone, F.array_min("_s")["label"]).otherwise(F.col(label))).drop("_p", "_s", *raster.AROUND)


def otsu_2d(df: DataFrame, bins: int, value: str = "v") -> DataFrame:
    """(image_id, s, t, threshold): the bins of value and of 3 x 3 mean that part an image's pixels best.

    Classes are the pixels below both bins and those from both on; the trace of the matrix between them decides, of equal
    ones the first (s, t). The threshold is the middle of bin s. An image needs bins^2 counts in one array, however many pixels it has.
    """
    near = raster.box(df.select(*PIXEL, value), 1, value)
    ends = near.groupBy("image_id").agg(F.min(value).alias("lo"), (F.max(value) - F.min(value) + 1).alias("range"))
    binned = near.join(ends, "image_id").selectExpr("image_id", "lo", "range", f"CAST((({value} - lo) * {bins}) div range AS INT) AS i", f"CAST(((box_sum - lo * box_n) * {bins}) div (box_n * range) AS INT) AS j")
    counts = binned.groupBy("image_id", "i", "j").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("range").alias("range"))
    listed = counts.groupBy("image_id").agg(
        F.collect_list(F.struct("i", "j", "n")).alias("cells"), F.first("lo").alias("lo"), F.first("range").alias("range"), F.sum("n").alias("_n"), F.sum(F.expr("n * i")).alias("_a"), F.sum(F.expr("n * j")).alias("_b")
    )
    each = listed.withColumn("c", F.explode("cells"))
    added = "named_struct('w', 0L, 'a', 0L, 'b', 0L), (s, q) -> named_struct('w', s.w + q.n, 'a', s.a + q.n * q.i, 'b', s.b + q.n * q.j)"
    # The lower class ends one bin before (s, t), at bin 0 for the first ones.
    each = each.withColumns({
        "q": F.expr(f"aggregate(filter(cells, q -> q.i <= greatest(c.i - 1, 0) AND q.j <= greatest(c.j - 1, 0)), {added})"),
        "r": F.expr(f"aggregate(filter(cells, q -> q.i >= c.i AND q.j >= c.j), {added})"),
    })
    part = lambda x: f"CASE WHEN {x}.w = 0 THEN 0D ELSE {x}.w / _n * (pow({x}.a / {x}.w - _a / _n, 2) + pow({x}.b / {x}.w - _b / _n, 2)) END"
    best = each.withColumn("trace", F.expr(f"round({part('q')} + {part('r')}, 9)"))
    best = best.groupBy("image_id").agg(F.min(F.struct(-F.col("trace"), "c.i", "c.j", "lo", "range")).alias("m"))
    return best.select("image_id", F.col("m.i").alias("s"), F.col("m.j").alias("t"), (F.col("m.lo") + (F.col("m.i") + 0.5) * F.col("m.range") / bins).alias("threshold"))


def bilinear_at(df: DataFrame, places: DataFrame, value: str = "v") -> DataFrame:
    """places (image_id, place_id, x, y as doubles) with `value` interpolated between the pixels around.

    A place with a pixel missing among those it needs isn't in the result. Each place meets at most four pixels by key.
    """
    share = lambda c: [(F.floor(c), 1 - (F.col(c) - F.floor(c))), (F.floor(c) + 1, F.col(c) - F.floor(c))]
    corners = F.array(*[F.struct(cx.cast("int").alias("x"), cy.cast("int").alias("y"), (wx * wy).alias("w")) for cx, wx in share("x") for cy, wy in share("y")])
    needed = places.select("image_id", "place_id", F.explode(F.filter(corners, lambda c: c["w"] > 0)).alias("c")).select("image_id", "place_id", "c.x", "c.y", "c.w")
    met = needed.join(df.select(*PIXEL, value), PIXEL, "left").groupBy("image_id", "place_id").agg(F.sum(F.col("w") * F.col(value)).alias(value), F.count_if(F.col(value).isNull()).alias("_missing"))
    return met.where("_missing = 0").drop("_missing")


def first_peak_and_minimum(hist: DataFrame, by: str = "image_id") -> DataFrame:
    """(by, peak, after) of dense histograms (bin, n): the bin before the first fall, and the bin of the first rise after it.

    Without a fall the peak is -1; without a rise after it, `after` is 0.
    """
    before = F.lag("n").over(Window.partitionBy(by).orderBy("bin"))
    steps = hist.select(by, "bin", F.when(F.col("n") < before, -1).when(F.col("n") > before, 1).otherwise(0).alias("step"))
    steps = steps.withColumn("fall", F.min(F.when(F.col("step") == -1, F.col("bin"))).over(Window.partitionBy(by)))
    return steps.groupBy(by).agg(F.coalesce(F.min("fall") - 1, F.lit(-1)).alias("peak"), F.coalesce(F.min(F.when((F.col("step") == 1) & (F.col("bin") > F.col("fall")), F.col("bin"))), F.lit(0)).alias("after"))
