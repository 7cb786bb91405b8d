"""A training-data pipeline over documents: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.exact_dedup import drop_exact_copies
from lumenframe.llm.langid import keep_identified
from lumenframe.llm.minhash import drop_near_duplicates
from lumenframe.llm.mixing import mixed
from lumenframe.llm.packing import pack_texts
from lumenframe.llm.session import released, remove, shared_folder


# Each stage judges rows by their own texts, so null and repeated keys do no harm, passes extra columns of any name
# through, and gives an empty result for an empty table; how ties and repeats count is stated by the operator it calls.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go, and those of which no language is likely; the models learn from docs."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest key stays; without any key, all of them."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and all rows with null keys or with keys of several texts."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat where the mix takes a document twice and are left out where it takes less than half of it."""
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, each row a document of its own; null texts are empty ones."""
    return pack_texts(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: Language ID and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every other stage is written below spark.checkpoint.dir and read again; what earlier
    stages wrote there is deleted once the next one has been written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
