"""k-means over vectors: seeds by oversampling rounds, then Lloyd's rounds whose sums are merged by a grouped shuffle.

Centres are broadcast: their size is that of k vectors (in seeding, of the candidates), whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of oversampling, and candidates that a round is to give for each of the k centres.
SEED_ROUNDS, OVERSAMPLE = 4, 2


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _squares(a: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ centers.T + (centers * centers).sum(axis=1), 0)


def assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """id, vector, cluster (ties to the lower number), d2."""
    shared, kept = rows.sparkSession.sparkContext.broadcast(centers), rows.select("id", "vector")
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes) + ", cluster int, d2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _squares(_matrix(b.column(1)), shared.value)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["id", "vector", "cluster", "d2"])

    return kept.mapInArrow(run, schema)


def sums(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """cluster, j, s, n: per cluster the sums of its vectors' components (j from 1) and, at j = 0, of the squared distances;
    n counts its vectors. A task adds up its batches."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        total, count = np.zeros((len(table), table.shape[1] + 1)), np.zeros(len(table), np.int64)
        for b in batches:
            a = _matrix(b.column(0))
            d = _squares(a, table)
            near = d.argmin(axis=1)
            np.add.at(total, near, np.column_stack([d[np.arange(len(d)), near], a]))
            count += np.bincount(near, minlength=len(table))
        used = np.flatnonzero(count)
        cluster, j = np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], total.shape[1]))], names=["cluster", "j", "s", "n"])

    return rows.select("vector").mapInArrow(run, "cluster int, j int, s double, n long").groupBy("cluster", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def moved(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """New centres (one without vectors stays), vectors of each, and the sum of squared distances to the old centres."""
    new, count, inertia = centers.copy(), np.zeros(len(centers), np.int64), 0.0
    for r in sums(rows, centers).collect():  # as many rows as the centres have numbers
        count[r["cluster"]] = r["n"]
        if r["j"]:
            new[r["cluster"], r["j"] - 1] = r["s"] / r["n"]
        else:
            inertia += r["s"]
    return new, count, inertia


def seeds(rows: DataFrame, k: int, rounds: int = SEED_ROUNDS, oversample: int = OVERSAMPLE) -> np.ndarray:
    """k centres (fewer where there are fewer distinct vectors): from the first vector by id, each round takes vectors with a chance of
    oversample * k * d2 / (sum of d2), by a hash of id and round, so reruns agree. Candidates, some oversample * k * rounds, are
    weighed by the vectors nearest to them and thinned to k, each time taking the one that adds most."""
    first = rows.orderBy("id").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    found = np.array([first[0]["vector"]], float)
    for r in range(rounds):
        near = assigned(rows, found)
        total = near.agg(F.sum("d2")).first()[0]
        if not total:
            break
        chance = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        picked = near.where(chance < oversample * k * F.col("d2") / F.lit(float(total))).orderBy("id").select("vector").collect()  # about oversample * k rows
        if picked:
            found = np.unique(np.concatenate([found, np.array([p["vector"] for p in picked], float)]), axis=0)
    _, weight, _ = moved(rows, found)
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(found)):
        gain = _squares(found, found[chosen]).min(axis=1) * weight
        if not gain.max():
            break
        chosen.append(int(gain.argmax()))
    return found[chosen]


def kmeans(rows: DataFrame, k: int, rounds: int = 12, within: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Centres of rows (id, vector; all of one length), and the sum of squared distances of each round, which never rises. Rounds end
    once it falls by less than `within` of itself."""
    centers, inertia = seeds(rows, k), []
    for _ in range(rounds if len(centers) else 0):
        centers, _, now = moved(rows, centers)
        inertia.append(now)
        if len(inertia) > 1 and inertia[-2] - now <= within * inertia[-2]:
            break
    return centers, inertia
