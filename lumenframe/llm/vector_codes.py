"""Vectors compressed to codes of integer codebooks, one codebook a part of the vector.

Components become integers, so sums and distances are exact and the codebooks don't depend on the order in which tasks
end. Each round broadcasts the codebooks (ENTRIES entries a part: their size is that of ENTRIES vectors, whatever the
table holds), assigns Arrow batches by norm expansion and integer matrix products, and merges the sums of each entry by
a grouped shuffle of one small row per task, entry and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.session import checkpointed

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LONGEST = (1 << 63) - 1
#: Bits of a limb: sums of any size travel as limbs, which many tasks can add up in 64 bits.
LIMB = 40
#: Shares into which a label's rows are dealt for the join with the labels' sums.
SALTS = 16


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector isn't null and holds neither null nor non-finite components."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    return vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) as (row, width); shorter vectors are filled up with zeros. Python integers where 64 bits are too few."""
    n = len(column)
    at = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values, np.float64)[at[0] : at[-1]] if n else np.zeros(0)
    length = np.diff(at)
    large = bool(len(flat)) and float(np.abs(flat).max()) * SCALE >= 2.0**62
    whole = np.array([int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in flat.tolist()], object) if large else np.floor(flat * SCALE).astype(np.int64)
    if (length == width).all():
        return whole.reshape(n, width)
    out = np.zeros((n, width), object if large else np.int64)
    out[np.arange(width) < length[:, None]] = whole
    return out


def squared_distances(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(part, row, entry) from parts (row, PARTS, size) and books (PARTS, entry, size)."""
    parts = x.transpose(1, 0, 2)
    products = np.matmul(parts, books.transpose(0, 2, 1))
    return (parts * parts).sum(axis=2)[:, :, None] - 2 * products + (books * books).sum(axis=2)[:, None, :]


def assign(column: pa.Array, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, size) integers, the nearest entry (ties to the lower index) and its squared distance by (part, row)."""
    size = books.shape[2]
    x = integers(column, PARTS * size).reshape(len(column), PARTS, size)
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if 4 * size * largest * largest > LONGEST:  # else what overflows in the terms of the expansion cancels modulo 2**64
        x, books = x.astype(object), books.astype(object)
    d = squared_distances(x, books)
    entry = d.argmin(axis=2)
    return x, entry, np.take_along_axis(d, entry[:, :, None], axis=2)[:, :, 0]


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(k, limb) whose sum of limb * 2**(LIMB * k) is the value; the last one has its sign."""
    k = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        value, k = value >> LIMB, k + 1
    yield k, value


def _as_books(entries: list) -> np.ndarray:
    """int64 where that holds all entries, else Python's integers."""
    books = np.array(entries, object)
    return books.astype(np.int64) if not books.size or max(abs(v) for v in books.ravel()) < 1 << 62 else books


_SUMS = "part int, entry int, place int, limb int, value long"


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Per part and entry: the sums of the components of its parts, as limbs, and the number of its parts at place -1."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        total, count = np.zeros(table.shape, object), np.zeros(table.shape[:2], np.int64)
        for b in batches:
            x, entry, _ = assign(b.column(0), table)
            for p in range(PARTS):
                for k in np.unique(entry[p]).tolist():
                    mine = x[entry[p] == k, p]
                    total[p, k] += mine.sum(axis=0).astype(object)
                    count[p, k] += len(mine)
        rows = []
        for p, k in zip(*np.nonzero(count), strict=True):
            rows.append((p, k, -1, 0, int(count[p, k])))
            rows += [(p, k, place, limb, v) for place, s in enumerate(total[p, k]) for limb, v in limbs(int(s))]
        if rows:
            kinds = [pa.int32()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])

    return vectors.mapInArrow(run, _SUMS).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))


def codebooks(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(PARTS, entries, size) integers after the rounds; fewer entries where the table keeps fewer vectors.

    The first entries are the parts of the vectors with the smallest keys (rows with equal keys by their vectors, null
    keys last). Each round replaces an entry by floor(sum / count) of its parts; one without parts stays.
    """
    rows = kept(vectors, vector).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-width // PARTS) * PARTS
    seeds = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()  # at most `entries` rows
    first = integers(pa.array([r["vector"] for r in seeds], pa.list_(pa.float64())), width)
    books = _as_books(first.reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2).tolist()).reshape(PARTS, len(seeds), width // PARTS)
    for _ in range(rounds if len(seeds) else 0):
        count: dict[tuple, int] = {}
        total: dict[tuple, int] = {}
        for part, entry, place, limb, value in _sums(rows.select("vector"), books).collect():  # as many rows as the codebooks have numbers
            if place < 0:
                count[part, entry] = value
            else:
                total[part, entry, place] = total.get((part, entry, place), 0) + (value << (LIMB * limb))
        new = books.astype(object)
        for (part, entry, place), value in total.items():
            new[part, entry, place] = value // count[part, entry]
        books = _as_books(new.tolist()).reshape(books.shape)
    return books


def encode(vectors: DataFrame, books: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The columns of vectors but the vector, for the rows kept, with `code` (PARTS indexes below 256, two hex digits each) and `error`
    (squared distances summed over the parts; what is beyond a long counts as the largest long). Both replace columns
    of these names."""
    rows = kept(vectors, vector)
    others = [c for c in rows.columns if c not in (vector, "code", "error")]
    schema = rows.select(*others).schema.add("code", "string").add("error", "long")
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, entry, distance = assign(b.column(0), shared.value)
            code = entry.T.astype(np.uint8).tobytes().hex()
            error = distance.astype(object).sum(axis=0)  # PARTS distances below 2**63 can sum up to more
            made = [pa.array([code[k : k + 2 * PARTS] for k in range(0, len(code), 2 * PARTS)], pa.string()), pa.array([min(int(e), LONGEST) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*others, "code", "error"])

    return rows.select(vector, *others).mapInArrow(run, schema)


def written(books: np.ndarray) -> str:
    """All components by part, entry and place, as decimal numbers."""
    return ",".join(str(int(v)) for v in books.ravel())


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector kept: key, code, error, label_error, codebooks_sha256.

    label_error is the sum of error over the rows of the same label, null labels together. Vectors that are null, or hold
    null, NaN or infinite components, are dropped. Vectors are taken to be as long as the longest, and that as a multiple
    of PARTS, by zeros at the end; empty vectors are kept and have an error of 0 if all are empty. Rows that repeat a key
    or a vector get a row each. Other columns are not read. An empty table gives an empty result. Sums beyond a
    long count as the largest long.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books = codebooks(rows, "key", "vector", entries, rounds)
    if not books.shape[1]:
        empty = F.lit(None)
        return rows.where("false").select(F.col("key").alias(key), empty.cast("string").alias("code"), empty.cast("long").alias("error"), empty.cast("long").alias("label_error"), empty.cast("string").alias("codebooks_sha256"))
    coded = checkpointed(encode(rows, books, "key", "vector").withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int")))
    # One label may hold most rows: its rows are dealt to SALTS shares, the few rows of sums go to each of them.
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("share")))
    digest = hashlib.sha256(written(books).encode()).hexdigest()
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(width: int = 64) -> str:
    """SQL for compress() over the table `embeddings` with unique keys and vectors of `width` components."""
    size = width // PARTS
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, p, d, floor({SCALE}::DOUBLE * e[p * {size} + d + 1]::DOUBLE)::BIGINT AS x FROM kept, range({PARTS}) a(p), range({size}) b(d))",
        f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT p, k, d, x AS c FROM parts JOIN seeds USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        distances = f"SELECT vec_id, p, k, sum((x - c) * (x - c))::BIGINT AS s FROM parts JOIN c{r} USING (p, d) GROUP BY vec_id, p, k"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(k, s * {ENTRIES} + k) AS k, min(s) AS s FROM ({distances}) GROUP BY vec_id, p)")
        sums = f"SELECT p, k, d, sum(x)::BIGINT AS t, count(*) AS n FROM parts JOIN a{r} USING (vec_id, p) GROUP BY p, k, d"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, k, d, coalesce((t - ((t % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN ({sums}) USING (p, k, d))")
    return f"""WITH {", ".join(steps[:-1])},
        coded AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(s)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, k, d)) FROM c{ROUNDS}) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""
