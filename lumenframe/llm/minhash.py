"""Near-duplicate classes by b-bit MinHash, confirmed on full shingle sets.

1. Each text gives its set of word shingles (as 64-bit hashes), BANDS * ROWS minima, a band key per ROWS
   minima, and the low 2 bits of each minimum packed into one signature.
2. Texts with the same set are one class member from here on.
3. Members that share a band key are candidates: first each with a leader of its bucket, the member with the
   smallest hash under one of LEADERS seeds, so that a group meets few leaders, but not one only. The signatures
   estimate similarity by bit counts, corrected for chance collisions of 2-bit values; pairs far below the
   threshold go. The others are confirmed on the full sets, and linked members joined into components.
4. Buckets that still hold several components are cut into blocks; each two blocks are compared in numpy: pairs
   of different components, in the first band that they share, by the same estimate and then by their sets with
   hashes cut to 32 bits. What passes is confirmed on the full sets. So every two members of a bucket have been
   compared or were already in one component; no bucket is capped.

With 32 bands of 4 rows a pair at similarity 0.8 shares no band with probability 5e-8; the estimates are let
off by 6 standard deviations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.components import components
from lumenframe.llm.session import bounded_batches, checkpointed, fresh, frugal, likely
from lumenframe.llm.text import mix64, range_hashes, slices, stream64, word_bounds

BANDS, ROWS, BITS = 32, 4, 2
PERMUTATIONS = BANDS * ROWS
LEADERS = 4
#: An estimate counts a pair out when it is more than this below the threshold; so does a similarity by 32-bit hashes,
#: in which a set of 20,000 shingles has less than one false one.
SLACK, SHORT_SLACK = 0.25, 0.005
#: Members of a block of a bucket.
BLOCK = 256
#: Shingles that are hashed by all permutations at a time.
_STEP = 512
_A = stream64(PERMUTATIONS, 101) | np.uint64(1)
_B = stream64(PERMUTATIONS, 202)


def shingle_hashes(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of the shingles of each text; with fewer words, its whole sequence; none without words."""
    for lo, hi, raw, offsets in slices(column):
        starts, ends, row = word_bounds(raw, offsets)
        h = range_hashes(raw, starts, ends, lower=True)
        at = np.searchsorted(row, np.arange(hi - lo + 1))
        rolled = h.copy()
        for k in range(1, words):  # of the words from here on; wrong only where a row ends, which is not read
            rolled[:-k] = mix64(rolled[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= words:
                yield lo + i, np.unique(rolled[a : b - words + 1])
            elif b > a:
                one = h[a : a + 1]
                for k in range(a + 1, b):
                    one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + h[k])
                yield lo + i, mix64(one + np.uint64(b - a))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    out = np.full(n, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), _STEP):
        np.minimum(out, (shingles[k : k + _STEP, None] * _A[:n] + _B[:n]).min(axis=0), out=out)
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low BITS of each (scrambled) minimum, side by side in 64-bit words."""
    low = (mix64(least) & np.uint64(3)).astype(np.uint8)
    return np.packbits(np.stack([low >> 1, low & 1], axis=1).reshape(-1)).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each row of a to each of b (packed signatures as uint64 words), corrected for chance."""
    differ = np.zeros((len(a), len(b)), np.int16)
    odd = np.uint64(0x5555555555555555)
    for k in range(a.shape[1]):
        x = a[:, None, k] ^ b[None, :, k]
        differ += np.bitwise_count((x | (x >> np.uint64(1))) & odd).astype(np.int16)
    agree, chance = 1 - differ / (32 * a.shape[1]), 0.5**BITS
    return (agree - chance) / (1 - chance)


SKETCH = "doc_id long, n_shingles long, set_id binary, signature array<long>, bands array<long>"


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, s in shingle_hashes(b.column(1), words):
                raw = s.tobytes()
                if len(s):
                    least = minima(s)
                    grouped = least.reshape(BANDS, ROWS)
                    band = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for k in range(ROWS):
                        band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
                    out.append((ids[i], len(s), hashlib.blake2b(raw, digest_size=16).digest(), packed_bits(least), band.view(np.int64)))
                else:
                    out.append((ids[i], 0, b"", [], []))
            if out:
                yield _batch(out, SKETCH)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), SKETCH)


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def second_pass(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int, short: bool) -> DataFrame:
    """Of the documents named in wanted (doc_id): doc_id, set_id, n_shingles and the sorted shingles, of 64 or (short)
    32 bits.

    Texts are read where they lie, not shuffled: a bit map of the wanted ids leaves those out that can't be wanted, and
    the join that decides has only what it lets through.
    """
    schema = "doc_id long, set_id binary, n_shingles long, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, held = b.column(0).to_pylist(), [], 0
            for i, s in shingle_hashes(b.column(1), words):
                if len(s):
                    raw = s.tobytes()
                    out.append((ids[i], hashlib.blake2b(raw, digest_size=16).digest(), len(s), np.unique(s.astype(np.uint32)).tobytes() if short else raw))
                    held += len(raw)
                if held > 1 << 22:
                    yield _batch(out, schema)
                    out, held = [], 0
            if out:
                yield _batch(out, schema)

    read = likely(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", wanted)
    found = read.where("likely").select("doc_id", "text").mapInArrow(frugal(run), schema)
    return checkpointed(found.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "set_id"]))


def _similar(percent: int):
    """Keeps rows of (a, b, shingles_a, shingles_b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets. Sizes alone rule some out before."""
    full = sets.select("doc_id", "n_shingles", "shingles")
    left = pairs.join(full.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("shingles").alias("sb")), "b")
    both = left.join(full.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("shingles").alias("sa")), "a")
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(near).select("a", "b", "sa", "sb").mapInArrow(frugal(_similar(percent)), "a long, b long")


def _native_estimate(x: str, y: str):
    """estimates() of two signature columns (four longs each) with column functions."""
    odd = F.lit(0x5555555555555555)
    words = [F.col(x)[k].bitwiseXOR(F.col(y)[k]) for k in range(4)]
    differ = sum((F.bit_count(w.bitwiseOR(F.shiftright(w, 1)).bitwiseAND(odd)) for w in words[1:]), F.bit_count(words[0].bitwiseOR(F.shiftright(words[0], 1)).bitwiseAND(odd)))
    chance = 0.5**BITS
    return ((1 - differ / PERMUTATIONS) - chance) / (1 - chance)


def _block_pairs(percent: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Likely links of two blocks of a bucket (or within one) between different components."""
    band, same = int(pdf["band"].iloc[0]), pdf["bi"].iloc[0] == pdf["bj"].iloc[0]
    first = pdf[pdf["side"] == 0]
    second = first if same else pdf[pdf["side"] == 1]
    if not len(first) or not len(second):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sig = lambda x: np.stack(x["sig"].to_numpy()).view(np.uint64)
    comp = [x["comp"].to_numpy() for x in (first, second)]
    size = [x["n_shingles"].to_numpy() for x in (first, second)]
    near = estimates(sig(first), sig(second)) >= percent / 100 - SLACK
    near &= comp[0][:, None] != comp[1][None, :]
    near &= 100 * np.minimum.outer(size[0], size[1]) >= percent * np.maximum.outer(size[0], size[1])
    if same:
        near = np.triu(near)
    i, j = np.nonzero(near)
    if band and len(i):  # an earlier band that both share has compared them
        bands = [np.stack(x["bands"].to_numpy())[:, :band] for x in (first, second)]
        new = ~(bands[0][i] == bands[1][j]).any(axis=1)
        i, j = i[new], j[new]
    sets = [[np.frombuffer(x, np.uint32) for x in part["shingles"]] for part in (first, second)]
    keep = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        x, y = sets[0][p], sets[1][q]
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(both >= (percent / 100 - SHORT_SLACK) * (len(x) + len(y) - both))
    i, j = i[np.array(keep, bool)], j[np.array(keep, bool)]
    a, b = first["doc_id"].to_numpy()[i], second["doc_id"].to_numpy()[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _classes(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """near_duplicates, and `several`: whether the key has more than one set of shingles."""
    bounded_batches(docs)
    sketch = checkpointed(sketches(docs, key, text, words))
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    by_set = some.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    reps = some.join(by_set.select("set_id", F.col("rep").alias("doc_id")), ["set_id", "doc_id"], "left_semi")
    signed = reps.select("doc_id", F.col("signature").alias("sig"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        return checkpointed(_confirmed(pairs, second_pass(docs, wanted, key, text, words, False), percent))

    keys = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    first = F.min(F.struct(F.xxhash64("doc_id", F.col("band") % LEADERS).alias("h"), "doc_id"))["doc_id"]
    buckets = keys.groupBy("band", "key").agg(first.alias("lead"), F.count("*").alias("n")).where("n > 1")
    in_buckets = checkpointed(keys.join(buckets.hint("merge"), ["band", "key"]))
    pairs = in_buckets.where("doc_id <> lead").select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b")).distinct()
    a = signed.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    b = signed.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))
    near = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").where(_native_estimate("sig_a", "sig_b") >= percent / 100 - SLACK).select("a", "b")
    found = components(confirmed(checkpointed(near)))

    comp = in_buckets.where("n > 2").join(found.hint("merge"), "doc_id", "left").withColumn("comp", F.coalesce("component_id", "doc_id"))
    mixed = comp.groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low < high")
    open_ = comp.select("band", "key", "doc_id", "comp").join(mixed.select("band", "key", F.ceil(F.col("m") / BLOCK).alias("nb")), ["band", "key"])
    open_ = checkpointed(open_.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("nb"))))
    if not open_.isEmpty():
        short = second_pass(docs, open_.select("doc_id").distinct(), key, text, words, True)
        traits = reps.select("doc_id", "set_id", F.col("signature").alias("sig"), "bands").dropDuplicates(["doc_id", "set_id"])
        open_ = open_.distinct().join(short.join(traits, ["doc_id", "set_id"]).hint("merge"), "doc_id")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other")
        payload = ["band", "key", "doc_id", "comp", "n_shingles", "sig", "bands", "shingles"]
        dealt = open_.select(*payload, "block", other).select(*payload, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
        more = dealt.groupBy("band", "key", "bi", "bj").applyInPandas(partial(_block_pairs, percent), "a long, b long").distinct()
        more = checkpointed(more)
        if not more.isEmpty():
            # What is joined already stays as links to the smallest member.
            found = components(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(confirmed(more)))

    members = some.select("doc_id", "set_id").join(by_set, "set_id")
    classes = members.join(found.select(F.col("doc_id").alias("rep"), "component_id"), "rep", "left").select("doc_id", "set_id", F.coalesce("component_id", "rep").alias("component_id"))
    # A key with two texts joins the components of both.
    each = classes.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), (F.min("set_id") != F.max("set_id")).alias("several"))
    return sketch.select("doc_id", "n_shingles").join(each, "doc_id", "left").select(
        F.col("doc_id").alias(key), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"), F.coalesce("several", F.lit(False)).alias("several")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= percent * union of their shingle sets (A-Z lower-cased, words
    between \\x20 and \\x09-\\x0D); component_id is the smallest doc_id reachable by links, and that
    document is kept. Null, empty and blank texts have empty sets and are linked with nothing. Rows that
    repeat a key stand for one document; they share its component and are all kept or none (a key
    with two texts belongs to the component of each of its rows). Null keys are not grouped: such rows
    have a null component_id and are kept. Other columns are not read. An empty table gives an empty result.
    """
    return _classes(docs, key, text, words, percent).drop("several")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with their columns.

    Rows with a null key stay, and so do the rows of a key with texts of different words, as one decision can't fit
    them all. Extra columns pass through, whatever their names. An empty table gives an empty result.
    """
    named = fresh(docs, "gone_key")
    gone = _classes(docs, key, text, words, percent).where("NOT kept AND NOT several").select(F.col(key).alias(named)).distinct()
    return docs.join(gone, docs[key].cast("long") == gone[named], "left_anti").select(*docs.columns)
