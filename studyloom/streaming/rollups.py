"""Rollups of events by hour, kept as mergeable partial results, so that late events change no more than their own day.

A partial result holds counts, sums, ends, a histogram and a sketch of distinct users; two of the same hour and key merge into one, in
any order. The table is partitioned by day and version: a micro-batch reads the last version of the days that it touches, from
before itself, merges its own partial results, and writes them as version n. A batch that is repeated writes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import remove_folder

#: Upper ends of the histogram's bins, the last one open.
EDGES = tuple(float(1 << k) for k in range(12))
PARTIAL = "hour timestamp, event_type string, n long, cents long, low double, high double, hist array<long>, users binary, day date, v long"
KEYS = ["hour", "event_type"]


def bin_of(value: Column) -> Column:
    """How many of EDGES a value reaches; null is in none."""
    return sum(((value >= e).cast("int") for e in EDGES[1:]), (value >= EDGES[0]).cast("int"))


def partial(events: DataFrame) -> DataFrame:
    """(ts, event_type, value, user_id) -> one row an hour and type. A null value counts in n only; a null ts is in no hour and goes."""
    rows = events.where("ts IS NOT NULL").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", F.col("value").cast("double").alias("value"), F.col("user_id").cast("long").alias("user_id"), bin_of(F.col("value")).alias("bin"))
    hist = F.array(*(F.count(F.when(F.col("bin") == k, 1)) for k in range(len(EDGES) + 1)))
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.round(F.col("value") * 100).cast("long")), F.lit(0)).alias("cents"), F.min("value").alias("low"), F.max("value").alias("high"), hist.alias("hist"), F.hll_sketch_agg("user_id").alias("users"),
    )


def merged(partials: DataFrame) -> DataFrame:
    """Partial results of several batches -> one row an hour and type."""
    hist = F.array(*(F.sum(F.col("hist")[k]) for k in range(len(EDGES) + 1)))
    return partials.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.min("low").alias("low"), F.max("high").alias("high"), hist.alias("hist"), F.hll_union_agg("users").alias("users"))


def read_rollup(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The rollup that keep_rollup wrote: of each day its last version (before batch `before`, where given)."""
    rows = spark.read.schema(PARTIAL).parquet(folder)
    rows = rows if before is None else rows.where(F.col("v") < before)
    last = rows.groupBy("day").agg(F.max("v").alias("v"))  # a row a day
    return rows.join(F.broadcast(last), ["day", "v"])


def merge_batch(events: DataFrame, folder: str, n: int) -> None:
    """Merge micro-batch n into the rollup; days that it doesn't touch are neither read nor written."""
    spark, columns = events.sparkSession, [*KEYS, "n", "cents", "low", "high", "hist", "users"]
    fresh = partial(events).withColumn("day", F.to_date("hour")).persist()
    days = [r["day"] for r in fresh.select("day").distinct().collect()]
    if days:
        rows = fresh.select(*columns)
        if n:
            rows = rows.unionByName(read_rollup(spark, folder, n).where(F.col("day").isin(days)).select(*columns))
        after = merged(rows).withColumn("day", F.to_date("hour")).withColumn("v", F.lit(n).cast("long"))
        after.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "v").parquet(folder)
        stale = spark.read.schema(PARTIAL).parquet(folder).where(F.col("day").isin(days)).groupBy("day").agg(F.array_sort(F.collect_set("v")).alias("v")).where(F.size("v") > 2)
        for r in stale.collect():  # a row a day
            for v in r["v"][:-2]:
                remove_folder(spark, f"{folder}/day={r['day']}/v={v}")
    fresh.unpersist()


def keep_rollup(events: DataFrame, folder: str, checkpoint: str):
    """Writer of a stream of events, however late, into the rollup."""
    return events.writeStream.foreachBatch(lambda batch, n: merge_batch(batch, folder, n)).option("checkpointLocation", checkpoint)


def quantile(hist: Column, q: float) -> Column:
    """The upper end of the bin in which the q-quantile lies; infinite in the last one, null without values."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda s, x: s + x)
    reached = F.transform(F.sequence(F.lit(1), F.size(hist)), lambda k: F.aggregate(F.slice(hist, 1, k), F.lit(0).cast("long"), lambda s, x: s + x) >= total * q)
    ends = F.array(*map(F.lit, [*EDGES, float("inf")]))
    return F.when(total > 0, F.element_at(ends, F.array_position(reached, True).cast("int")))
