"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source is a stream of words: its documents in an order shuffled by a hash, cut into blocks of equal
numbers of words. Slot t of the schedule stands at the golden-ratio point frac((t + 1) * phi). The slots in the order
of their points are parted into the sources' intervals of the cumulative weights, so each source gets exactly its
quota, spread as evenly as the points are; its slots in the order of the schedule, ranked, take its blocks in turn.

Running counts go by two levels (hash-prefix bucket of a source, then its rows; cell of points, then the points of a
cell; chunk of the schedule, then its slots), so no task holds a whole source or the whole schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.session import checkpointed, fresh

BLOCK_WORDS = 256
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
#: Slots of the schedule, of about so many cells of points, and of a run of ranks, that one task lays out.
CHUNK = 1 << 13
GOLDEN = 0.6180339887498949


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", more: Column | None = None) -> DataFrame:
    """doc_id, skey (orders sources by code point, null last), size in words, the shuffled place h, and `row`, a value of
    more (null without)."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    return docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1")).alias("skey"), words.alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")).alias("h"), (F.lit(None).cast("string") if more is None else more).alias("row"),
    )


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: source_size, target and quota figures. The windows run over one row per source.

    A source is capped where most * size / weight is at or below the water level; the level is that of the
    first source, by that ratio, whose cap lies at or above its share of what the capped ones leave.
    """
    everything = Window.orderBy("skey")
    per = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(everything)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "skey")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - before) / rest)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(Window.partitionBy())
    per = per.withColumn("target", F.least("cap", first["level"] * F.col("weight")))
    per = per.withColumn("need", F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size")))
    size, need = F.col("source_size"), F.col("need")
    per = per.withColumn("blocks", F.ceil(size / block)).withColumn("passes", F.when(size > 0, F.floor(need / size)).otherwise(0)).withColumn("rest", need - F.col("passes") * size)
    return per.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).select("skey", "source_size", "target", "need", "blocks", "passes", "rest", "slots")


def _running(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """by, order and `name`: the rows of the groups before this one, over groups (by, order) of rows."""
    counts = rows.groupBy(*by, order).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.select(*by, order, before.alias(name))


def schedule(per: DataFrame) -> DataFrame:
    """position, skey and rank (and the source's slots, blocks and rest): every position below the number of all slots
    once, and every rank below a source's slots once, in low-discrepancy order."""
    ordered = Window.orderBy("skey")
    upto = F.sum("slots").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    parts = per.where("slots > 0").select("skey", "slots", "blocks", "rest", (upto - F.col("slots")).alias("lo"), upto.alias("hi"))
    runs = parts.withColumn("run", F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor((F.col("hi") - 1) / CHUNK))))
    total = per.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("whole")).where("whole > 0")
    chunks = total.select("whole", F.ceil(F.col("whole") / CHUNK).alias("cells"), F.explode(F.sequence(F.lit(0), F.floor((F.col("whole") - 1) / CHUNK))).alias("chunk")).repartition("chunk")
    points = chunks.select("chunk", "cells", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("whole"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("position"))
    points = points.withColumn("u", (F.col("position") + 1) * F.lit(GOLDEN) % 1.0).withColumn("cell", F.floor(F.col("u") * F.col("cells")))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("u", "position")) - 1
    sorted_ = points.withColumn("place", place).join(_running(points, [], "cell", "before").hint("merge"), "cell").select("position", "chunk", (F.col("before") + F.col("place")).alias("nth"))
    # Merged: the sizes of exploded sides are underestimated.
    drawn = sorted_.withColumn("run", F.floor(F.col("nth") / CHUNK)).join(runs.hint("merge"), "run").where("nth >= lo AND nth < hi").select("position", "chunk", "skey", "slots", "blocks", "rest")
    rank = F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("position")) - 1
    ranked = drawn.withColumn("place", rank).join(_running(drawn, ["skey"], "chunk", "before").hint("merge"), ["skey", "chunk"])
    return ranked.select("position", "skey", (F.col("before") + F.col("place")).alias("rank"), "slots", "blocks", "rest")


def _mix(sized: DataFrame, block: int) -> DataFrame:
    """mix() over sizes(), with the column row."""
    sized = checkpointed(sized)
    per = checkpointed(targets(sized, block=block))
    bucket = F.substring("h", 1, 3)
    by_bucket = sized.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    base = by_bucket.withColumn("base", F.sum("n").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("skey", "bucket", "base")
    within = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("bucket", bucket).withColumn("upto", F.sum("size").over(within))
    placed = placed.join(base.hint("merge"), ["skey", "bucket"]).select("doc_id", "row", "skey", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
    last = (F.col("rest") > 0) & (F.col("rank") == F.col("slots") - 1)
    slots = schedule(per).select("position", "skey", (F.col("rank") % F.col("blocks")).alias("block"), F.when(last, F.col("rest") - (F.ceil(F.col("rest") / block) - 1) * block).otherwise(F.lit(block).cast("long")).alias("words"))
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    overlap = F.greatest(F.lit(0), F.least(end, F.col("block") * block + F.coalesce("words", F.lit(0))) - F.greatest(F.col("start"), F.col("block") * block))
    taken = pieces.join(slots.hint("merge"), ["skey", "block"], "left").withColumn("overlap", overlap).groupBy("doc_id", "row", "skey", "start", "size").agg(
        F.coalesce(F.sum("overlap"), F.lit(0)).alias("taken"), F.min(F.when(F.col("overlap") > 0, F.col("position"))).alias("first_position"), F.coalesce(F.sum(F.when(F.col("overlap") > 0, F.col("position"))), F.lit(0)).alias("position_sum")
    )
    none = placed.where("size = 0").select("doc_id", "row", "skey", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_position"), F.lit(0).cast("long").alias("position_sum"))
    rows = taken.drop("start").unionByName(none)
    return rows.join(per.select("skey", "source_size", "target"), "skey")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, first_position, position_sum.

    taken sums, over the slots of the schedule, the words of the document that lie in the block a slot takes;
    first_position is the first of these slots' positions in the schedule (null if nothing is taken), position_sum the
    sum of all. Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last.
    Rows that repeat a key are separate documents. Ties in the shuffled order go by key, then size.
    No row is taken more than MOST_TIMES times. Other columns are not read. An empty table gives an empty result.
    """
    return _mix(sizes(docs, key, text, source, seed), block).select(F.col("doc_id").alias(key), "size", "source_size", "target", "taken", "first_position", "position_sum")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as whole documents: each row as often as the mix takes it, rounded half up (0 to MOST_TIMES times).

    Rows with equal key, text and source are one document listed more than once: each is repeated as often as they are
    taken on average. Null keys are keys like others. Texts without words are never taken, so their rows go. Extra
    columns pass through, whatever their names. An empty table gives an empty result.
    """
    row, times = fresh(docs, "row_digest"), fresh(docs, "times_taken")
    parts = [F.coalesce(F.concat(F.lit("0"), F.col(c).cast("string")), F.lit("1")) for c in (key, source, text)]
    digest = F.sha2(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]), 256)
    got = _mix(sizes(docs, key, text, source, more=digest), BLOCK_WORDS).where("size > 0").groupBy("row").agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("times"))
    got = got.where("times > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("times")).alias(times))
    return docs.withColumn(row, digest).join(got, row).withColumn(times, F.explode(times)).select(*docs.columns)
