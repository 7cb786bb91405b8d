"""The opN_ queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import vector_codes
from lumenframe.llm.alignment import align
from lumenframe.llm.audio import store_as_audio
from lumenframe.llm.exact_dedup import exact_dedup
from lumenframe.llm.html_extract import extract
from lumenframe.llm.langid import identify
from lumenframe.llm.lm_score import cross_entropy_difference
from lumenframe.llm.minhash import near_duplicates
from lumenframe.llm.mixing import mix
from lumenframe.llm.packing import pack_texts
from lumenframe.llm.pii import find_personal_data
from lumenframe.llm.secrets import find_secrets
from lumenframe.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(_table(spark, sf_dir, "documents"), with_ids=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(store_as_audio(_table(spark, sf_dir, "documents")))


def digested(made: DataFrame) -> DataFrame:
    """store_as_audio's rows with the PCM's size and hash in place of the file and the PCM."""
    return made.withColumns({"pcm_bytes": F.octet_length("pcm").cast("long"), "pcm_sha256": F.sha2("pcm", 256)}).drop("media", "pcm")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"), with_groups=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_minhash": op7_minhash,
    "op8_html": op8_html,
    "op9_audio": op9_audio,
    "op10_lm_score": op10_lm_score,
    "op11_vector_codes": op11_vector_codes,
    "op12_secrets": op12_secrets,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op11_vector_codes": vector_codes.oracle(),
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op4_mixing": r"""
        WITH s AS (SELECT doc_id, coalesce('0' || source, '1') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        per AS (SELECT skey, sum(size)::BIGINT AS source_size FROM s GROUP BY skey),
        weighed AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY skey COLLATE "binary") - 1) % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM per),
        levels AS (SELECT *, cap / weight AS ratio,
            ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
        t AS (SELECT skey, source_size, least(cap, (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, skey LIMIT 1) * weight) AS target FROM levels),
        need AS (SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS need FROM t),
        placed AS (SELECT doc_id, skey, size, (sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start FROM s),
        quota AS (SELECT *, need // nullif(source_size, 0) AS passes, need % nullif(source_size, 0) AS rest, (source_size + 255) // 256 AS blocks FROM need),
        slotted AS (SELECT *, passes * blocks + (rest + 255) // 256 AS slots FROM quota WHERE source_size > 0),
        parts AS (SELECT *, sum(slots) OVER (ORDER BY skey COLLATE "binary" ROWS UNBOUNDED PRECEDING) AS hi FROM slotted),
        points AS (SELECT i AS position, row_number() OVER (ORDER BY ((i + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE, i) - 1 AS nth FROM range((SELECT coalesce(sum(slots), 0)::BIGINT FROM slotted)) r(i)),
        ranked AS (SELECT position, skey, blocks, rest, slots, row_number() OVER (PARTITION BY skey ORDER BY position) - 1 AS rank FROM points JOIN parts ON nth >= hi - slots AND nth < hi),
        turns AS (SELECT position, skey, rank % blocks AS block, CASE WHEN rest > 0 AND rank = slots - 1 THEN rest - (rest - 1) // 256 * 256 ELSE 256 END AS words FROM ranked),
        hits AS (SELECT doc_id, skey, size, start, position, least(start + size, block * 256 + words) - greatest(start, block * 256) AS part
            FROM placed JOIN turns USING (skey) WHERE size > 0 AND block * 256 < start + size AND block * 256 + words > start),
        took AS (SELECT doc_id, skey, size, start, sum(part)::BIGINT AS taken, min(position)::BIGINT AS first_position, sum(position)::BIGINT AS position_sum FROM hits GROUP BY ALL)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_position, coalesce(position_sum, 0) AS position_sum
        FROM placed JOIN need USING (skey) LEFT JOIN took USING (doc_id, skey, size, start)""",
}
