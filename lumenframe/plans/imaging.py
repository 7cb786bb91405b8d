"""Queries of image algorithms that run per image in numpy; SQL can't express them, so tests hold them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenframe.functions import geometry
from lumenframe.operators import images
from lumenframe.operators.descriptors import bounded
from lumenframe.plans.registry import query
from lumenframe.sources.derived import curves, pixels
from lumenframe.sources.derived import points as point_table


def _raster(name: str, f, out: dict[str, str], values: tuple[str, ...] = ("v",)) -> None:
    @query(name)
    def run(spark, sf_dir):
        return images.per_image(pixels(spark, sf_dir), f, list(values), out)


def _rows(name: str, f, out: str, values: tuple[str, ...] = ("v",)) -> None:
    @query(name)
    def run(spark, sf_dir):
        return images.per_image_rows(pixels(spark, sf_dir), f, list(values), out)


_raster("image_low_pass", lambda a: {"o": images.low_pass(a)}, {"o": "double"})
_raster("image_spectrum", lambda a: {"power": np.abs(np.fft.fftshift(np.fft.fft2(a)))}, {"power": "double"})
_raster("image_periodic_part", lambda a: dict(zip(("periodic", "smooth"), images.periodic_and_smooth(a), strict=True)), {"periodic": "double", "smooth": "double"})
_raster("image_phase_congruency", images.phase_congruency, {"strength": "double", "orientation": "double", "phase": "double"})
_raster("image_median_filter", lambda a: {"o": images.median_filtered(a, 1)}, {"o": "double"})
_raster("image_multiscale_median", lambda a: dict(zip(("w1", "w2", "smooth"), images.multiscale_median(a, 2), strict=True)), {"w1": "double", "w2": "double", "smooth": "double"})
_raster("image_canny", lambda a: {"edge": images.canny(a)}, {"edge": "int"})
_raster("image_canny_color", lambda r, g, b: {"edge": np.maximum(np.maximum(images.canny(r), images.canny(g)), images.canny(b))}, {"edge": "int"}, ("r", "g", "b"))
_raster("image_thinning", lambda a: {"thin": images.zhang_suen(a >= 128)}, {"thin": "int"})
_raster("image_spur_removal", lambda a: {"thin": images.without_spurs(images.zhang_suen(a >= 128))}, {"thin": "int"})
_raster("image_components", lambda a: {"label": images.components(a // 64)}, {"label": "long"})
_raster("image_watershed", lambda a: {"basin": images.watershed(np.floor(images.blurred(a, 1.0) / 8))}, {"basin": "int"})
_raster("image_slic", lambda r, g, b: {"label": images.slic([r, g, b], 16)}, {"label": "int"}, ("r", "g", "b"))
_raster("image_fast_corners", lambda a: {"response": images.fast_corners(a)}, {"response": "double"})
_raster("threshold_otsu_multilevel", lambda a: {"level": np.searchsorted(images.multilevel_thresholds(a, 4), a)}, {"level": "int"})
_raster("flow_horn_schunck", lambda a, b: dict(zip(("u", "w"), images.horn_schunck(a, b, 10.0, 30), strict=True)), {"u": "double", "w": "double"}, ("v", "g"))
_rows("flow_lucas_kanade", images.lucas_kanade, "px int, py int, u double, w double", ("v", "g"))
_rows("image_pyramid", lambda a: [(k, p.shape[1], p.shape[0], float(p.mean())) for k, p in enumerate(images.pyramid(a))], "level int, w int, h int, mean double")
_rows("image_bilinear_half", lambda a: [(x, y, float(v)) for (y, x), v in np.ndenumerate(images.bilinear(a, a.shape[0] // 2, a.shape[1] // 2))], "x int, y int, v double")
_rows("feature_oriented_histograms", images.oriented_histograms, "cx int, cy int, bin int, weight double")
_rows("feature_binary_descriptors", images.binary_descriptors, "x int, y int, response double, angle double, d0 long, d1 long, d2 long, d3 long")
_rows("feature_stable_regions", lambda a: images.stable_regions(np.floor(images.blurred(a, 1.0))), "level double, area int, variation double, cx double, cy double, m20 double, m11 double, m02 double")
_rows("region_outline", lambda a: [(k, x, y) for k, (x, y) in enumerate(images.outline(images.components(a // 64) == images.components(a // 64)[0, 0]))], "pos int, x int, y int")


def _cut(a: np.ndarray) -> list[tuple]:
    """Normalised cut of the grid of 4 x 4 cells, weighted by grey similarity of neighbours."""
    h, w = max(1, a.shape[0] // 4), max(1, a.shape[1] // 4)
    cells = images.bilinear(a, h, w)
    n = h * w
    weights = np.zeros((n, n))
    for y in range(h):
        for x in range(w):
            for dy, dx in ((0, 1), (1, 0)):
                if y + dy < h and x + dx < w:
                    i, j = y * w + x, (y + dy) * w + x + dx
                    weights[i, j] = weights[j, i] = np.exp(-((cells[y, x] - cells[y + dy, x + dx]) ** 2) / 800)
    return [(k % w, k // w, int(c)) for k, c in enumerate(images.normalized_cut(weights, 0.3))]


_rows("graph_normalized_cut", _cut, "cx int, cy int, class int")


@query("shape_inflections")
def inflections(spark, sf_dir):
    """Curvature scale space of closed curves (position and value of each series, scaled)."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("pos")
        t = 2 * np.pi * pdf["pos"].to_numpy() / len(pdf)
        r = 1 + pdf["v"].to_numpy() / 500
        rows = geometry.inflections(np.column_stack([r * np.cos(t), r * np.sin(t)]), [1, 2, 4, 8])
        return pd.DataFrame([(int(pdf["curve_id"].iloc[0]), *x) for x in rows], columns=["curve_id", "sigma", "pos"])

    return curves(spark, sf_dir).groupBy("curve_id").applyInPandas(run, "curve_id long, sigma double, pos int")


#: Points of an outline, shortest run of them that is matched, and pairs of outlines that are matched at a time.
_OUTLINE, _RUN, _PAIRS = 24, 8, 128


def _outlines(batches):
    """curve_id and the points of the outline, one after another, of curves (curve_id, values in order)."""
    for batch in batches:
        made = []
        for v in batch.column(1):
            v = v.values.to_numpy(zero_copy_only=False)
            t = 2 * np.pi * np.arange(len(v)) / len(v)
            r = 1 + v / 500
            made.append(geometry.resampled(np.column_stack([r * np.cos(t), r * np.sin(t)]), _OUTLINE).reshape(-1))
        flat = pa.array(np.concatenate(made) if made else np.zeros(0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * 2 * _OUTLINE, flat)], names=["curve_id", "outline"])


def _matches(batches):
    """The best match of each pair of outlines."""
    names = ["a", "b", "cost", "start", "turn", "length"]
    for batch in batches:
        for lo in range(0, len(batch), _PAIRS):
            both = batch.column(0).slice(lo, _PAIRS).flatten()
            ids = both.field(0).to_numpy().reshape(-1, 2)
            made = np.array([geometry.chord_angles(p) for p in both.field(1).flatten().to_numpy().reshape(-1, _OUTLINE, 2)])
            cost, *at = geometry.partial_matches(made[::2], made[1::2], _RUN)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(cost), *[pa.array(x.astype(np.int32)) for x in at]], names=names)


@query("shape_chord_angle_match")
def shape_match(spark, sf_dir):
    """Each curve's outline against the next one's: best partial match of the chord-angle matrices."""
    c = curves(spark, sf_dir)
    rows = c.groupBy("curve_id").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p"))
    outlines = bounded(rows.select("curve_id", F.expr("transform(p, e -> cast(e.v AS double))").alias("v"))).mapInArrow(_outlines, "curve_id long, outline array<double>")
    pairs = outlines.where("curve_id IS NOT NULL").select(F.explode(F.array("curve_id", F.col("curve_id") - 1)).alias("pair"), "curve_id", "outline")
    met = pairs.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("curve_id", "outline"))).alias("s")).where("size(s) = 2")
    return met.select("s").mapInArrow(_matches, "a long, b long, cost double, start int, turn int, length int")


@query("ransac_similarity")
def similarity(spark, sf_dir):
    """Per set, points against their transformed copies with a third of outliers: the similarity found again."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("point_id")
        a = pdf[["x", "y"]].to_numpy(float)
        c, s = np.cos(0.4), np.sin(0.4)
        b = 1.5 * a @ np.array([[c, s], [-s, c]]) + (3, -4)
        b[::3] += 25 + a[::3, ::-1]
        columns = ["set_id", "n", "inliers", "scale", "angle", "tx", "ty"]
        if len(a) < 4:
            return pd.DataFrame([], columns=columns)
        (scale, angle, t), good = geometry.ransac_similarity(a, b, 0.5)
        return pd.DataFrame([(pdf["set_id"].iloc[0], len(a), int(good.sum()), round(scale, 6), round(angle, 6), round(t[0], 5), round(t[1], 5))], columns=columns)

    return point_table(spark, sf_dir).groupBy("set_id").applyInPandas(run, "set_id string, n int, inliers int, scale double, angle double, tx double, ty double")


@query("ransac_epipolar")
def epipolar(spark, sf_dir):
    """Per set, two views of a scene made from the points: the fundamental matrix by seven-point RANSAC."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("point_id")
        p = pdf[["x", "y", "point_id"]].to_numpy(float)
        world = np.column_stack([p[:, 0] / 10 - 2.5, p[:, 1] / 10 - 3, 12 + (p[:, 2] * 7 % 23) / 4])
        k = geometry.intrinsic(500, 320, 240)
        a = geometry.project(k, np.eye(3), np.zeros(3), world)
        b = geometry.project(k, geometry.rotation_zyx(0.02, 0.1, 0.03), np.array([-1.0, 0.1, 0.2]), world)
        b[::4] += (40, -30)
        columns = ["set_id", "n", "inliers", "error"]
        if len(a) < 12:
            return pd.DataFrame([], columns=columns)
        f, good = geometry.ransac_fundamental(a, b, 1.0)
        return pd.DataFrame([(pdf["set_id"].iloc[0], len(a), int(good.sum()), float(np.sqrt(geometry.sampson(f, a[good], b[good]).mean())))], columns=columns)

    return point_table(spark, sf_dir).groupBy("set_id").applyInPandas(run, "set_id string, n int, inliers int, error double")


def _registration(a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """Translation that takes the smoothed grey image without its edge to the whole of it: one pixel each way."""
    from lumenframe.functions import search

    s = images.blurred(a, 2.0)
    if min(s.shape) < 17:
        return []
    warp, error = search.align(s[1:-1, 1:-1], s)
    return [(float(warp[0, 2]), float(warp[1, 2]), error)]


_rows("align_translation", _registration, "tx double, ty double, error double", ("v", "g"))


def _axis(a: np.ndarray) -> dict[str, np.ndarray]:
    from lumenframe.functions import search

    mask = images.blurred(a, 1.0) > 110
    return {"distance": search.distance_transform(mask), "axis": search.medial_axis(mask)}


_raster("region_medial_axis", _axis, {"distance": "double", "axis": "int"})


@query("curve_corners")
def curve_corners(spark, sf_dir):
    """Corners of the closed curves by curvature at one scale."""
    import pandas as pd

    from lumenframe.functions import search

    def run(pdf):
        pdf = pdf.sort_values("pos")
        t = 2 * np.pi * pdf["pos"].to_numpy() / len(pdf)
        r = 1 + pdf["v"].to_numpy() / 500
        rows = search.curve_corners(np.column_stack([r * np.cos(t), r * np.sin(t)]))
        return pd.DataFrame([(int(pdf["curve_id"].iloc[0]), p) for p in rows], columns=["curve_id", "pos"])

    return curves(spark, sf_dir).groupBy("curve_id").applyInPandas(run, "curve_id long, pos int")


@query("bundle_adjustment")
def bundle_adjustment(spark, sf_dir):
    """Per set, two views of a scene made from the points, disturbed and adjusted: points, error before and after."""
    import pandas as pd

    def run(pdf):
        p = pdf.sort_values("point_id")[["x", "y", "point_id"]].to_numpy(float)
        columns = ["set_id", "n", "before", "after"]
        if len(p) < 8:
            return pd.DataFrame([], columns=columns)
        world = np.column_stack([p[:, 0] / 10 - 2.5, p[:, 1] / 10 - 3, 12 + (p[:, 2] * 7 % 23) / 4])
        k = geometry.intrinsic(500, 320, 240)
        poses = np.array([[0, 0, 0, 0, 0, 0], [0.02, 0.1, 0.03, -1.0, 0.1, 0.2], [-0.05, 0.2, 0.0, -2.0, 0.0, 0.3]])
        views = [geometry.project(k, geometry.rodrigues(c[:3]), c[3:], world) for c in poses]
        seen = [(c, i, *xy) for c, v in enumerate(views) for i, xy in enumerate(v)]
        start = poses + 0.01 * np.array([[0], [1], [-1]])
        guess = world + 0.02 * np.sin(np.arange(world.size)).reshape(world.shape)
        first = np.concatenate([geometry.project(k, geometry.rodrigues(c[:3]), c[3:], guess) - v for c, v in zip(start, views, strict=True)])
        _, _, error = geometry.bundle_adjust(k, start, guess, seen, 15)
        return pd.DataFrame([(pdf["set_id"].iloc[0], len(p), float(np.sqrt((first**2).mean())), error)], columns=columns)

    return point_table(spark, sf_dir).groupBy("set_id").applyInPandas(run, "set_id string, n int, before double, after double")
