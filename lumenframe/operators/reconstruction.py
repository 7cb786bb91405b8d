"""Affine reconstruction of points from many views: a measurement table factored by alternating least squares.

Observations are rows (view, point, x, y); a view need not see all points. They are gathered by point once. Points may be many;
views are few: their cameras, and sums of the products of their coordinates, are figures that the driver hands to the tasks. The
equations of a point are sums over its views and those of a view sums over all points, so a round is one pass over the points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from lumenframe.operators.descriptors import bounded
from lumenframe.operators.graph import cut_lineage

#: Rows of `o` of a batch: first observation of each point, view (its number), coordinates, and which of these are there.
Seen = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _seen(batch: pa.RecordBatch, views: np.ndarray) -> Seen:
    o = batch.column(1)
    n, flat = o.value_lengths().to_numpy(), o.flatten()
    w = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (1, 2)])
    there = ~np.isnan(w)
    return np.cumsum(n) - n, np.searchsorted(views, flat.field(0).to_numpy()), np.where(there, w, 0.0), there


def _summed(gathered: DataFrame, views: np.ndarray, size: int, add: Callable[[Seen, np.ndarray], None]) -> np.ndarray:
    """So many sums over all points: a task adds up its batches, the sums of the tasks are added by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                add(_seen(b, views), total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for r in gathered.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def _solved_points(seen: Seen, motion: np.ndarray) -> np.ndarray:
    """The least-squares place of each point (of smallest length where it isn't unique), motion being (views, 2, 4)."""
    starts, k, w, there = seen
    m = motion[k]
    a = np.einsum("nai,naj->nij", m[..., :3] * there[..., None], m[..., :3])
    b = np.einsum("nai,na->ni", m[..., :3], (w - m[..., 3]) * there)
    a, b = (np.add.reduceat(x, starts, axis=0) for x in (a, b))
    return np.einsum("pij,pj->pi", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)


def _first_motion(gathered: DataFrame, views: np.ndarray) -> np.ndarray | None:
    """The leading eigenvectors of the products of the centred coordinates of points that all views see, and the means of these; None where
    no point is."""
    n = 2 * len(views)

    def rows(seen: Seen, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates less the mean, and how many there are, of the points that all views see."""
        starts, k, w, there = seen
        point = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
        out, count = np.zeros((len(starts), len(views), 2)), np.zeros((len(starts), len(views), 2))
        np.add.at(out, (point, k), (w - mean[k]) * there)
        np.add.at(count, (point, k), there)
        whole = (count > 0).all(axis=(1, 2))
        return out[whole].reshape(-1, n), count[whole].reshape(-1, n)

    def means(seen: Seen, total: np.ndarray) -> None:
        total += np.concatenate([x.sum(axis=0) for x in rows(seen, np.zeros((len(views), 2)))])

    def products(seen: Seen, total: np.ndarray) -> None:
        w, _ = rows(seen, mean)
        total += (w.T @ w).reshape(-1)

    sums = _summed(gathered, views, 2 * n, means)
    if not sums[n:].all():
        return None
    mean = (sums[:n] / sums[n:]).reshape(-1, 2)
    values, vectors = np.linalg.eigh(_summed(gathered, views, n * n, products).reshape(n, n))
    lead = np.zeros((n, 3))
    top = np.flatnonzero(values > 1e-13 * values[-1])[::-1][:3]
    lead[:, : len(top)] = vectors[:, top]
    return np.concatenate([lead.reshape(-1, 2, 3), mean[..., None]], axis=2)


def affine(observed: DataFrame, rounds: int = 30, within: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(motion: view, axis, m; points: point, s): x and y of a view are m[0..2] . s + m[3] with axis 0 and 1.

    Both are known up to an affine change of the space that leaves all reprojections as they are. Rounds end once the
    sum of squared errors falls by less than `within` of itself. Points that fewer than two views see have the smallest solution.
    Coordinates that are null or NaN count as not seen; where no point is seen by all views both are empty.
    """
    rows = observed.where("view IS NOT NULL AND point IS NOT NULL").select("view", "point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    gathered = cut_lineage(bounded(rows.groupBy("point").agg(F.collect_list(F.struct("view", "x", "y")).alias("o"))))
    ids = sorted(r[0] for r in gathered.select(F.explode("o.view")).distinct().collect())
    views = np.array(ids)
    motion = used = _first_motion(gathered, views) if ids else None
    shape, last = (len(ids), 2, 4, 5), None

    def run(seen: Seen, total: np.ndarray) -> None:
        starts, k, w, there = seen
        s = np.column_stack([_solved_points(seen, used), np.ones(len(starts))])
        s = np.repeat(s, np.diff(np.append(starts, len(k))), axis=0)
        total[-1] += (((np.einsum("nai,ni->na", used[k], s) - w) * there) ** 2).sum()
        sides = np.concatenate([np.broadcast_to(s[:, None], (len(s), 2, 4)), w[..., None]], axis=2)
        each = np.einsum("ni,naj,na->naij", s, sides, there).reshape(len(s), -1)
        order = np.argsort(k, kind="stable")
        found, first = np.unique(k[order], return_index=True)
        total[:-1].reshape(len(ids), -1)[found] += np.add.reduceat(each[order], first, axis=0)

    for _ in range(rounds if motion is not None else 0):
        used = motion
        sums = _summed(gathered, views, int(np.prod(shape)) + 1, run)
        both = sums[:-1].reshape(shape)
        motion = np.einsum("vaij,vaj->vai", np.linalg.pinv(both[..., :4], rcond=1e-12, hermitian=True), both[..., 4])
        step = motion - used
        now = max(sums[-1] - np.einsum("vai,vaij,vaj->", step, both[..., :4], step), 0.0)  # squared errors after this step
        if last is not None and last - now <= within * last:
            break
        last = now

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b) and used is not None:
                s = _solved_points(_seen(b, views), used)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["point", "s"])

    points = gathered.mapInArrow(places, StructType([gathered.schema["point"], StructField("s", ArrayType(DoubleType()))]))
    cameras = [(v, a, m.tolist()) for v, both in zip(ids, motion, strict=True) for a, m in enumerate(both)] if motion is not None else []
    made = observed.sparkSession.createDataFrame(cameras, StructType([observed.schema["view"], StructField("axis", IntegerType()), StructField("m", ArrayType(DoubleType()))]))
    return made, points


def reprojected(observed: DataFrame, motion: DataFrame, points: DataFrame) -> DataFrame:
    """view, point, x, y, px, py: each observation and where the reconstruction puts it."""
    both = motion.groupBy("view").agg(F.max(F.when(F.col("axis") == 0, F.col("m"))).alias("mx"), F.max(F.when(F.col("axis") == 1, F.col("m"))).alias("my"))
    put = lambda m: f"{m}[0] * s[0] + {m}[1] * s[1] + {m}[2] * s[2] + {m}[3]"
    return observed.join(both, "view").join(points, "point").select("view", "point", "x", "y", F.expr(put("mx")).alias("px"), F.expr(put("my")).alias("py"))


def errors(placed: DataFrame) -> DataFrame:
    """view, n, rms, worst: the distances between observations and reprojections by view."""
    d2 = F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)
    return placed.groupBy("view").agg(F.count("*").alias("n"), F.sqrt(F.avg(d2)).alias("rms"), F.sqrt(F.max(d2)).alias("worst"))
