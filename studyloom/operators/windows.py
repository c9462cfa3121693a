"""Window forms: newest per key, recency, streaks, islands and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in `order`."""
    fields = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_r"))
    return top.select(*keys, *(F.col("_r")[c].alias(c) for c in fields)).select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def recency(df: DataFrame, keys: list[str], order: list[Column], name: str = "recency") -> DataFrame:
    """Place in order scaled to 0..1, oldest first; 1 for a key with one row."""
    by = Window.partitionBy(*keys)
    n, place = F.count("*").over(by), F.row_number().over(by.orderBy(*order)) - 1
    return df.withColumn(name, F.when(n <= 1, F.lit(1.0)).otherwise(place / F.greatest(n - 1, F.lit(1))))


def trailing_streak(df: DataFrame, keys: list[str], order: list[Column], good: Column) -> DataFrame:
    """(keys, streak): how many of the last rows in a row are good."""
    back = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_bad", F.sum(F.when(good, 0).otherwise(1)).over(back))
    return marked.groupBy(*keys).agg(F.count_if(F.col("_bad") == 0).alias("streak"))


def ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, first, last, n): maximal runs of consecutive whole numbers; repeats count once."""
    distinct = df.select(*keys, number).where(F.col(number).isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    marked = distinct.withColumn("_g", F.col(number) - place)
    return marked.groupBy(*keys, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_g")


def runs(df: DataFrame, keys: list[str], order: str, boundary: Column, most: int, name: str = "run") -> DataFrame:
    """Adds a run's number, from 1: a run begins at a boundary, and anew after `most` rows."""
    forward = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_b", F.sum(boundary.cast("int")).over(forward.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.floor((F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order)) - 1) / most)
    marked = marked.withColumn("_i", inside)
    begins = (F.lag("_b").over(forward) != F.col("_b")) | (F.lag("_i").over(forward) != F.col("_i"))
    marked = marked.withColumn("_s", F.coalesce(begins, F.lit(True)).cast("int"))
    return marked.withColumn(name, F.sum("_s").over(forward.rowsBetween(Window.unboundedPreceding, 0))).drop("_b", "_i", "_s")
