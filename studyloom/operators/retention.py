"""Retention curves: how fast what was learnt is forgotten, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recalls(reviews: DataFrame, by: list[str]) -> DataFrame:
    """(by, at timestamp, id, ok) -> by, gap (whole hours since the review before of the same keys) and ok. The first review of a key
    has no gap and no row. A key's reviews are sorted in one task, which spills: a key is one learner's card."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    gap = F.floor((at - F.lag(at).over(Window.partitionBy(*by).orderBy("at", "id"))) / 3_600_000_000)
    return reviews.withColumn("gap", gap).where("gap IS NOT NULL").drop("at", "id")


def curve(rows: DataFrame, group: Column, width: int) -> DataFrame:
    """recalls' rows -> (group, bin, n, recalled, share): by gaps of `width` hours; the share is smoothed by half a recall of each kind,
    so that it is never 0 or 1."""
    found = rows.groupBy(group.alias("group"), F.floor(F.col("gap") / width).alias("bin")).agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("recalled"))
    return found.withColumn("share", (F.col("recalled") + 0.5) / (F.col("n") + 1))


def stability(points: DataFrame, width: int) -> DataFrame:
    """curve's points -> (group, n, stability, error): S of share = exp(-hours / S), fitted by least squares through the origin on the
    logarithm, a bin counting as often as it has reviews, with the mean squared error of the shares.

    One pass of sums by group, then a second for the error over the points, which are few. A group whose shares don't
    fall has no stability: null.
    """
    hours, y = (F.col("bin") + 0.5) * width, -F.log("share")
    sums = points.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * hours * hours).alias("xx"), F.sum(F.col("n") * hours * y).alias("xy"))
    fits = sums.select("group", "n", F.when(F.col("xy") > 0, F.col("xx") / F.col("xy")).alias("stability"))
    off = points.join(fits.select("group", "stability"), "group").select("group", "n", (F.col("share") - F.exp(-hours / F.col("stability"))).alias("d"))
    errors = off.groupBy("group").agg((F.sum(F.col("n") * F.col("d") * F.col("d")) / F.sum("n")).alias("error"))
    return fits.join(errors, "group")
