"""Exact deduplication by skew-safe combining, with DataFrame functions only.

1. Locally: the partial aggregation of the first group-by leaves one row per text and map task.
2. Salted: rows meet by (digest, salt), so the copies of a hot text meet in several tasks.
3. Globally: the winners of the salts meet by digest.

Each stage has the whole normalised text in its grouping key, so contents are compared in full and
two texts that shared a digest would stay apart. Only (id, digest, check hash) goes through the join
that brings the decision back to each row; adaptive execution splits a hot digest there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.session import fresh

SALTS = 8


def normalised(text: Column) -> Column:
    """Null as empty; each run of \\x20 and \\x09-\\x0D as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts, the one with the smallest key stays. Null texts count as
    empty and are copies of empty texts. Rows that repeat the smallest key are one document listed more
    than once: all of them are kept. A null key never wins over another; a group of null keys only has
    a null keep_id and keeps its rows. Other columns of docs, whatever their names, are not read.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("norm"))
    rows = rows.select("id", "norm", F.sha2("norm", 256).alias("digest"))
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "norm").agg(F.min("id").alias("best"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.min("best").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = winners.select("digest", F.xxhash64("norm").alias("check"), "keep_id", "group_size")
    members = rows.select("id", "digest", F.xxhash64("norm").alias("check"))
    return members.join(winners, ["digest", "check"]).select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns.

    A row goes if its own text has a row with a smaller key; rows that repeat a key are judged each by its text.
    A row with a null key goes if its text has a row with a key. Rows that repeat the smallest key of their text all stay.
    Extra columns pass through, whatever their names. An empty table gives an empty result.
    """
    digest, gone_key = fresh(docs, "text_sha256"), fresh(docs, "gone_key")
    gone = exact_dedup(docs, key, text).where(~F.col("kept")).select(F.col(key).alias(gone_key), F.col("text_sha256").alias(f"{digest}_gone")).distinct()
    rows = docs.withColumn(digest, F.sha2(normalised(F.col(text)), 256))
    same = (rows[digest] == gone[f"{digest}_gone"]) & rows[key].eqNullSafe(gone[gone_key])
    return rows.join(gone, same, "left_anti").select(*docs.columns)
