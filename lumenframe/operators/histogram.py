"""Histograms of values: counts, equalisation, thresholds between classes, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, value: str = "v", by: str = "image_id") -> DataFrame:
    return df.groupBy(by, F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def dense_counts(df: DataFrame, bins: int = 256, value: str = "v", by: str = "image_id") -> DataFrame:
    """Counts of every bin 0..bins-1 of each group, absent ones 0."""
    keys = df.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return keys.join(counts(df, value, by), [by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def equalised(df: DataFrame, value: str = "v", by: str = "image_id") -> DataFrame:
    """Histogram equalisation: 0 stays 0, else floor((cdf - cdf_min) * 254 / (n - cdf_min) + 0.5) + 1.

    cdf_min is the cumulative count of the first of bins 1..255 where it is positive.
    """
    upto = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    cdf = dense_counts(df, 256, value, by).withColumn("cdf", F.sum("n").over(upto))
    cdf = cdf.withColumn("low", F.min(F.when((F.col("bin") > 0) & (F.col("cdf") > 0), F.col("cdf"))).over(whole)).withColumn("total", F.max("cdf").over(whole))
    spread = F.nullif(F.col("total") - F.col("low"), F.lit(0))
    table = cdf.select(by, F.col("bin").alias(value), F.when(F.col("bin") == 0, 0).otherwise(F.coalesce(F.floor((F.col("cdf") - F.col("low")) * 254 / spread + 0.5), F.lit(0)) + 1).cast("int").alias("equalised"))
    return df.join(table, [by, value])


def otsu(df: DataFrame, value: str = "v", by: str = "image_id") -> DataFrame:
    """Per group the first threshold that maximises the variance between the classes `<= t` and `> t`."""
    upto = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    h = counts(df, value, by).withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("bin")).over(upto), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("bin")).over(whole)})
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    gap = F.col("s0") / F.col("w0") - s1 / F.nullif(w1, F.lit(0))
    between = F.coalesce(F.col("w0").cast("double") * w1 * gap * gap, F.lit(0.0))
    return h.withColumn("between", between).groupBy(by).agg(F.max(F.struct(F.col("between"), -F.col("bin"))).alias("m")).select(by, (-F.col("m.col2")).cast("int").alias("threshold"), F.col("m.between").alias("between"))


def quantile_picks(df: DataFrame, value: str = "v", by: str = "image_id") -> DataFrame:
    """Mean (truncated), upper median and quartiles as picks sorted[n*k/4] (the last one is the maximum).

    Ranks come from counts of distinct values, so a group's rows needn't be sorted in one task.
    """
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    h = df.groupBy(by, value).agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(by))})
    pick = lambda k: F.min(F.when(F.col("upto") > F.floor(F.col("total") * k / 4), F.col(value)))
    return h.groupBy(by).agg(F.floor(F.sum(F.col(value) * F.col("n")) / F.sum("n")).cast("long").alias("mean"), pick(2).alias("median"), pick(1).alias("q1"), pick(2).alias("q2"), pick(3).alias("q3"), F.max(value).alias("q4"))


def channel_histograms(df: DataFrame, channels: tuple[str, ...], bins: int = 16, by: str = "image_id", most: int = 256) -> DataFrame:
    """(by, channel, bin, n): equal bins of 0..most-1 for each channel, by one explode of the channels."""
    width = most // bins
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.floor(F.col(c) / width).cast("int").alias("bin")) for c in channels])).alias("p")
    return df.select(by, parts).groupBy(by, "p.channel", "p.bin").agg(F.count("*").alias("n"))


def hue_classes(df: DataFrame, value: str = "theta", cuts: tuple[int, ...] = (19, 41, 61, 107, 193), by: str = "image_id") -> DataFrame:
    """Counts of the hue classes between cut points."""
    bin_ = sum((F.when(F.col(value) >= c, 1).otherwise(0) for c in cuts[1:]), F.when(F.col(value) >= cuts[0], 1).otherwise(0))
    return df.groupBy(by, bin_.alias("bin")).agg(F.count("*").alias("n"))


def similarity(hist: DataFrame, pairs: DataFrame, by: str = "image_id") -> DataFrame:
    """For pairs (a, b) of groups: intersection (sum of smaller shares) and chi-squared distance, per channel mean."""
    share = hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by, "channel")))
    a = pairs.join(share.select(F.col(by).alias("a"), "channel", "bin", F.col("p").alias("pa"), F.lit(0.0).alias("pb")), "a")
    b = pairs.join(share.select(F.col(by).alias("b"), "channel", "bin", F.lit(0.0).alias("pa"), F.col("p").alias("pb")), "b")
    both = a.select("a", "b", "channel", "bin", "pa", "pb").unionByName(b.select("a", "b", "channel", "bin", "pa", "pb")).groupBy("a", "b", "channel", "bin").agg(F.sum("pa").alias("pa"), F.sum("pb").alias("pb"))
    gap = F.col("pa") - F.col("pb")
    per = both.groupBy("a", "b", "channel").agg(F.sum(F.least("pa", "pb")).alias("i"), F.sum(0.5 * gap * gap / (F.col("pa") + F.col("pb"))).alias("c"))
    return per.groupBy("a", "b").agg(F.avg("i").alias("intersection"), F.avg("c").alias("chi2"))


def last_and_first_bins(hist: DataFrame, by: str = "image_id") -> DataFrame:
    """First and last non-empty bin and the mode (the first of equals) of each histogram."""
    return hist.where("n > 0").groupBy(by).agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), (-F.max(F.struct(F.col("n"), -F.col("bin")))["col2"]).cast("int").alias("mode_bin"))
