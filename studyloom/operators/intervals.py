"""Sets of whole-number intervals, by a sweep over their ends: work goes with the number of intervals, not with what they hold.

An interval is lo..hi, both ends included; a reversed one is turned, one with a null end is none. Sets may overlap themselves and
repeat. A key's ends are sorted in one task, which spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sweep(sets: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Named sets (keys, lo, hi) -> (keys, lo, hi, and of each name how many of its intervals hold it): disjoint pieces between
    neighbouring ends, those that no set holds left out."""
    ends = None
    for name, rows in sets.items():
        low, high = F.least("lo", "hi").cast("long"), F.greatest("lo", "hi").cast("long")
        known = rows.where("lo IS NOT NULL AND hi IS NOT NULL").select(*keys, F.explode(F.array(F.struct(low.alias("at"), F.lit(1).alias("d")), F.struct((high + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
        part = known.select(*keys, "e.at", *(F.when(F.lit(n == name), F.col("e.d")).otherwise(0).alias(n) for n in sets))
        ends = part if ends is None else ends.unionByName(part)
    steps = ends.groupBy(*keys, "at").agg(*(F.sum(n).alias(n) for n in sets))
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = steps.select(*keys, F.col("at").alias("lo"), (F.lead("at").over(order) - 1).alias("hi"), *(F.sum(n).over(upto).alias(n) for n in sets))
    return pieces.where(F.greatest(*sets, F.lit(0)) > 0)


def joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint pieces (keys, lo, hi) -> those that touch as one."""
    order = Window.partitionBy(*keys).orderBy("lo")
    fresh = F.when(F.col("lo") == F.lag("hi").over(order) + 1, 0).otherwise(1)
    runs = pieces.select(*keys, "lo", "hi", fresh.alias("_new")).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def union(rows: DataFrame, keys: list[str]) -> DataFrame:
    return joined(sweep({"a": rows}, keys), keys)


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return joined(sweep({"a": a, "b": b}, keys).where("a > 0 AND b > 0"), keys)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return joined(sweep({"a": a, "b": b}, keys).where("a > 0 AND b = 0"), keys)


def size(lo: Column, hi: Column) -> Column:
    return hi - lo + 1


def ranges_of(rows: DataFrame, at: str) -> DataFrame:
    """Single numbers as intervals of one."""
    return rows.withColumn("lo", F.col(at)).withColumn("hi", F.col(at))


def first_covering(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, order: str, value: str, name: str) -> DataFrame:
    """Each point with `value` of the range low..high (whole numbers, reversed bounds allowed) that holds it and comes first in
    `order`, null where none does.

    The axis is cut into buckets as wide as the ranges are on average, so that a range lies in two of them on average; different
    points meet the ranges of their own bucket by an equi-join.
    """
    spans = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(F.least(low, high).cast("long").alias("_lo"), F.greatest(low, high).cast("long").alias("_hi"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_r"))
    n, total, first, last = spans.agg(F.count("*"), F.sum(F.col("_hi") - F.col("_lo") + 1), F.min("_lo"), F.max("_hi")).first()
    if not n:
        return points.withColumn(name, F.lit(None).cast(dict(ranges.dtypes)[value]))
    width = max(int(total) // n, (last - first) // (4 * n), 1)
    bucket = lambda c: F.floor((c - F.lit(first)) / F.lit(width)).cast("long")
    pieces = spans.select("_lo", "_hi", "_r", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))).alias("_b"))
    asked = points.select(F.col(at).alias("_at")).where(F.col("_at").between(first, last)).distinct().withColumn("_b", bucket(F.col("_at")))
    met = asked.join(pieces, (asked["_b"] == pieces["_b"]) & F.col("_at").between(F.col("_lo"), F.col("_hi")))
    found = met.groupBy("_at").agg(F.min("_r").alias("_r")).select(F.col("_at").alias(at), F.col("_r")["v"].alias(name))
    return points.join(found, at, "left")
