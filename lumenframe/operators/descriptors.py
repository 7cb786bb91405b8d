"""Descriptor vectors: distances, nearest neighbours with a query block, ratio tests, Hamming codes, boxes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators.graph import cut_lineage


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ssd(a: str, b: str) -> Column:
    """Sum of squared differences."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def sign_codes(df: DataFrame, vector: str, bits: int, name: str = "code") -> DataFrame:
    """Binary descriptors: the signs of all components, `bits` (at most 63) to a long."""
    words = F.sequence(F.lit(0), F.floor((F.greatest(F.size(vector), F.lit(1)) - 1) / bits))
    word = lambda k: F.aggregate(F.slice(vector, (k * bits + 1).cast("int"), bits), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1) + F.when(x > 0, 1).otherwise(0))
    return df.withColumn(name, F.transform(words, word))


def hamming(a: str, b: str) -> Column:
    """Signs in which two codes of the same length differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def gram(df: DataFrame, vector: str) -> DataFrame:
    """i, j, g: the upper triangle of A^T A (numbered from 1) over the vectors, all of one length, as rows of A. A task
    adds up its batches, the sums of the tasks are added by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            column = b.column(0).drop_null()
            if len(column):
                a = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
                total = a.T @ a + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i + 1), pa.array(j + 1), pa.array(total[i, j])], names=["i", "j", "g"])

    return df.select(vector).mapInArrow(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def in_blocks(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row of base with every row of a stated query set, each partition of the one with each of the other: tasks hold
    a block of queries at a time, however many there are."""
    return base.crossJoin(queries.hint("shuffle_replicate_nl"))


#: Rows of a block of base rows and of a block of queries that meet as matrices.
BASE_BLOCK, QUERY_BLOCK = 4096, 512
#: Components beyond this are compared by expressions: their squares could overflow.
_LARGE = 1e100


def blocks(df: DataFrame, keys: list[str], columns: list[str], vector: str, rows: int) -> DataFrame:
    """keys, each of columns as an array, and the vectors (of one length, without nulls) one after another as an array of doubles:
    up to `rows` rows that share the keys and lie next to each other. Written once to the checkpoint folder."""
    kept = df.select(*keys, *columns, F.col(vector).cast("array<double>").alias(vector))
    schema = T.StructType([*[kept.schema[c] for c in keys], *[T.StructField(c, T.ArrayType(kept.schema[c].dataType)) for c in columns], T.StructField(vector, T.ArrayType(T.DoubleType()))])

    def made(table: pa.Table) -> pa.RecordBatch:
        table, n = table.combine_chunks(), len(table)
        edges = np.zeros(n, bool)
        edges[:1] = True
        for c in keys:
            v = table[c].to_numpy()
            edges[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(edges)
        ends = np.append(starts[1:], n)
        at = np.concatenate([np.arange(a, b, rows) for a, b in zip(starts, ends, strict=True)])
        offsets = np.append(at, n).astype(np.int32)
        whole = lambda c: table[c].chunk(0)
        flat = whole(vector).flatten()
        size = len(flat) // n
        columns_ = [whole(c).take(pa.array(at)) for c in keys] + [pa.ListArray.from_arrays(pa.array(offsets), whole(c)) for c in columns]
        return pa.RecordBatch.from_arrays([*columns_, pa.ListArray.from_arrays(pa.array(offsets * np.int32(size)), flat)], names=[*keys, *columns, vector])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n >= rows:
                yield made(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield made(pa.Table.from_batches(held))

    return cut_lineage(kept.mapInArrow(run, schema))


def _matrix(vectors: pa.ListScalar, n: int) -> np.ndarray:
    return vectors.values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1)


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where values (nulls too) are."""
    both = pa.concat_arrays([a, b]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return both[: len(a)], both[len(a) :]


def _in_order(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the products of the rows' components, added one after another."""
    d = np.zeros(len(q))
    for c in range(q.shape[1]):
        d += b[:, c] * q[:, c]
    return d


def _nearest_in_block(q: np.ndarray, b: np.ndarray, qgrp: np.ndarray, bgrp: np.ndarray, rank: np.ndarray, k: int, measure: str, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q its k nearest rows of b of other groups (those within reach, where it is given), ties by rank.

    Products of matrices pick candidates, with a margin above their rounding; their distances are summed component by component.
    """
    with np.errstate(all="ignore"):
        nq, nb = (q * q).sum(axis=1), (b * b).sum(axis=1)
        if measure == "cosine":
            rough = (q / np.sqrt(nq)[:, None]) @ (b / -np.sqrt(nb)[:, None]).T
            margin = np.full(len(q), 1e-9)
        else:
            rough = (-2 * q) @ b.T
            rough += nb
            margin = 1e-10 * (nq + nb.max(initial=0))
            reach = None if reach is None else reach - nq
        rough[qgrp[:, None] == bgrp[None, :]] = np.inf
        if reach is None or np.isinf(reach).any():
            limit = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
            limit = limit if reach is None else np.fmin(limit, reach)
        else:
            limit = reach
        i, j = np.nonzero(~(rough > (limit + 2 * margin)[:, None]))
        keep = qgrp[i] != bgrp[j]
        i, j = i[keep], j[keep]
        x, y = q[i], b[j]
        if measure == "cosine":
            ends = lambda v: np.sqrt(_in_order(v, v))
            d = -(_in_order(x, y) / (ends(y) * ends(x)))
        else:
            d = _in_order(y - x, y - x)
    order = np.lexsort((rank[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep]


def bounded(df: DataFrame) -> DataFrame:
    """df itself, after bounding the session's Arrow batches (read when a plan runs): a pair of blocks may be some MB."""
    conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= 512:
        conf.set(rows, "512")
    if size not in conf.getAll:
        conf.set(size, str(16 << 20))
    return df


def met(pairs: DataFrame, k: int, measure: str = "l2") -> DataFrame:
    """qid, id, d: of each pair of blocks (qid, qgrp, qv and, where they are given, reach and wants; id, grp, vector, cell), the k
    nearest rows of other groups for each query, ties by id. A caller takes the k nearest of these. reach: what lies further isn't
    wanted; wants: by cell, whether a query wants it."""
    reach, wants = (["reach"] if "reach" in pairs.columns else []), (["cell", "wants"] if "wants" in pairs.columns else [])
    kept = pairs.select("qid", "qgrp", "qv", "id", "grp", "vector", *reach, *wants)
    schema = T.StructType([T.StructField("qid", kept.schema["qid"].dataType.elementType), T.StructField("id", kept.schema["id"].dataType.elementType), T.StructField("d", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                qid, qgrp, ids, grp = (batch[c][r].values for c in ("qid", "qgrp", "id", "grp"))
                far = batch["reach"][r].values.to_numpy(zero_copy_only=False).astype(float) if reach else None
                far = None if far is None else np.where(np.isnan(far), np.inf, far)
                q = _matrix(batch["qv"][r], len(qid))
                if wants:
                    asks = np.flatnonzero(batch["wants"][r].values.flatten().to_numpy(zero_copy_only=False).reshape(len(qid), -1)[:, batch["cell"][r].as_py()])
                    if not len(asks):
                        continue
                    qid, qgrp, q, far = qid.take(pa.array(asks)), qgrp.take(pa.array(asks)), q[asks], far[asks]
                keys = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(pa.table(list(keys), names=[str(c) for c in range(len(keys))]), sort_keys=[(str(c), "ascending") for c in range(len(keys))]).to_numpy()] = np.arange(len(ids))
                i, j, d = _nearest_in_block(q, _matrix(batch["vector"][r], len(ids)), *_codes(qgrp, grp), rank, k, measure, far)
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(i)), ids.take(pa.array(j)), pa.array(d)], names=["qid", "id", "d"])

    return bounded(kept).mapInArrow(run, schema)


def block_neighbours(queries: DataFrame, base: DataFrame, k: int, measure: str = "l2") -> DataFrame:
    """The k nearest rows (bid, bv) of each query (qid, qv), ties by bid, by `measure`: l2 (squared) or cosine (negative).

    A stated query set against all rows: every block of the one meets every block of the other as matrices, and hands on k rows for
    each query. Vectors of other lengths, with nulls, and with components that aren't finite or are very large (for the
    cosine: or near 0 all) are compared by expressions, row by row.
    """
    order = Window.partitionBy("qid").orderBy("d", "bid")
    size = base.agg(F.max(F.size("bv"))).first()[0] or 0
    plain = lambda v: f"coalesce(size({v}) = {max(size, 1)} AND forall({v}, z -> z IS NOT NULL AND abs(z) < {_LARGE}D)" + (f" AND exists({v}, z -> abs(z) > 1e-100D)" if measure == "cosine" else "") + ", false)"
    sides = [(base.where("bid IS NOT NULL"), "bid", "bv"), (queries.where("qid IS NOT NULL"), "qid", "qv")]
    (even_b, odd_b), (even_q, odd_q) = ((df.where(plain(v)), df.where(f"NOT {plain(v)}")) for df, _, v in sides)
    b = blocks(even_b.repartition("bid").selectExpr("bid AS id", "bid AS grp", "bv AS vector"), [], ["id", "grp"], "vector", BASE_BLOCK)
    q = blocks(even_q.repartition("qid").selectExpr("qid", "qid AS qgrp", "qv"), [], ["qid", "qgrp"], "qv", QUERY_BLOCK)
    found = [met(in_blocks(b, q), k, measure).withColumnRenamed("id", "bid")]
    distance = -cosine("bv", "qv") if measure == "cosine" else ssd("bv", "qv")
    for left, right in ((odd_b, queries), (even_b, odd_q)):
        if not left.isEmpty() and not right.isEmpty():
            found.append(in_blocks(left, right).where("qid <> bid").select("qid", "bid", distance.alias("d")))
    every = functools.reduce(DataFrame.unionByName, found)
    return every.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("qid", "bid", "d", "k")


def _packed(df: DataFrame, side: str, rows: int = 1024) -> DataFrame:
    """Rows (grp, id, vector) as blocks of up to so many rows: the ids, and the vectors as one matrix in bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), rows):
                part = pdf[k : k + rows]
                m = np.array(part["vector"].tolist(), float)
                yield pd.DataFrame({f"{side}grp": [part["grp"].to_numpy()], f"{side}id": [part["id"].to_numpy()], f"{side}v": [m.tobytes()]})

    return cut_lineage(df.select(F.col("grp").cast("long"), F.col("id").cast("long"), "vector").mapInPandas(run, f"{side}grp array<long>, {side}id array<long>, {side}v binary"))


def _nearest_of(q: np.ndarray, b: np.ndarray, other: np.ndarray, ids: np.ndarray, grps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q its k nearest rows of b where `other` allows, as indexes into q and b and squared distances.

    Products of matrices pick candidates, with a margin above their rounding; their distances are summed component by component.
    """
    with np.errstate(all="ignore"):
        nq, nb = (q * q).sum(axis=1), (b * b).sum(axis=1)
        rough = nq[:, None] + nb[None, :] - 2 * (q @ b.T)
        rough[~other] = np.inf
        limit = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1] if len(b) else nq
        margin = 1e-10 * (nq[:, None] + nb[None, :])
        i, j = np.nonzero(other & ~(rough > limit[:, None] + margin + margin.max(initial=0)))
        d = np.zeros(len(i))
        for c in range(q.shape[1]):
            d += (b[j, c] - q[i, c]) ** 2
    order = np.lexsort((ids[j], grps[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep], d[keep]


def nearest_vectors(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qgrp, qid, grp, id, d2, k: the k nearest rows of base of other groups for each query, ties by group and id.

    Both are rows (grp, id, vector) with vectors of one length without nulls. Every block of the one side meets every block of
    the other in a task, which hands on k rows for each query.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q, b = (np.frombuffer(v).reshape(len(ids), -1) for v, ids in ((r.qv, r.qid), (r.bv, r.bid)))
                i, j, d = _nearest_of(q, b, r.qgrp[:, None] != r.bgrp[None, :], r.bid, r.bgrp, k)
                yield pd.DataFrame({"qgrp": r.qgrp[i], "qid": r.qid[i], "grp": r.bgrp[j], "id": r.bid[j], "d2": d})

    found = in_blocks(_packed(base, "b"), _packed(queries, "q")).mapInPandas(run, "qgrp long, qid long, grp long, id long, d2 double")
    order = Window.partitionBy("qgrp", "qid").orderBy("d2", "grp", "id")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def ratio_test(top2: DataFrame, ratio: float) -> DataFrame:
    """From the two nearest of each query, the nearest where it beats the second by the ratio."""
    best = top2.groupBy("qid").agg(F.min(F.struct("k", "bid", "d")).alias("m"), F.max(F.when(F.col("k") == 2, F.col("d"))).alias("second"))
    return best.where(F.col("m.d") < ratio * F.col("second")).select("qid", F.col("m.bid").alias("bid"), F.col("m.d").alias("d"))


def greedy_one_to_one(matches: DataFrame) -> DataFrame:
    """Of matches (qid, bid, d), each bid's cheapest; with one candidate per qid this is the greedy assignment."""
    order = Window.partitionBy("bid").orderBy("d", "qid")
    return matches.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def box_iou(df: DataFrame) -> DataFrame:
    """Intersection over union of inclusive pixel boxes (ax0, ay0, ax1, ay1) and (bx0, by0, bx1, by1)."""
    w = F.least("ax1", "bx1") - F.greatest("ax0", "bx0") + 1
    h = F.least("ay1", "by1") - F.greatest("ay0", "by0") + 1
    inter = F.when((w <= 0) | (h <= 0), 0).otherwise(w * h)
    area = lambda s: (F.col(f"{s}x1") - F.col(f"{s}x0") + 1) * (F.col(f"{s}y1") - F.col(f"{s}y0") + 1)
    return df.withColumn("iou", inter / (area("a") + area("b") - inter))


def precision_recall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class of two label columns: true positives, false positives, false negatives, precision, recall, F1."""
    both = F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), (F.col(truth) == F.col(predicted)).cast("int").alias("h")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), (F.col(truth) == F.col(predicted)).cast("int").alias("h")))).alias("e")
    g = df.select(both).groupBy(F.col("e.c").alias("class")).agg(F.sum(F.expr("e.t * e.h")).alias("tp"), F.sum(F.expr("(1 - e.t) * (1 - e.h)")).alias("fp"), F.sum(F.expr("e.t * (1 - e.h)")).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return g.withColumns({"precision": p, "recall": r}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))
