"""Joins, sets and top-k forms that recur across the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nest(parent: DataFrame, child: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Parents with their children as an array of structs in `order`; an empty array without any."""
    fields = [c for c in child.columns if c != key]
    rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in fields if c != order)))).alias(name))
    empty = F.array().cast(rows.schema[name].dataType)
    return parent.join(rows, key, "left").withColumn(name, F.coalesce(name, empty))


def latest_or(parent: DataFrame, child: DataFrame, key: str, value: str, name: str, default: Column) -> DataFrame:
    """Each parent with the largest `value` of its children, or `default`: a correlated scalar subquery, decorrelated."""
    top = child.groupBy(key).agg(F.max(value).alias(name))
    return parent.join(top, key, "left").withColumn(name, F.coalesce(name, default))


def missing(all_: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows of all_ without a match in present."""
    return all_.join(present, list(keys), "left_anti").dropDuplicates(list(keys))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """Each left row with the `value` of the last right row of its key at or before it; ties take the largest value.

    One shuffle on the key: both sides are stacked and the last right value is carried forward.
    """
    columns = left.columns
    stacked = left.select(*columns, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    back = Window.partitionBy(key).orderBy(at, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = stacked.withColumn(name, F.last("_v", ignorenulls=True).over(back))
    return carried.where("_side = 1").select(*columns, name)


def nearest(points: DataFrame, group: str, at: str, is_target: Column, name: str) -> DataFrame:
    """Each row with the nearest target position of its group, ties to the earlier; null without a target. A row that is a
    target itself is not its own."""
    before = Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(group).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    target = F.when(is_target, F.col(at))
    marked = points.withColumn("_p", F.last(target, ignorenulls=True).over(before)).withColumn("_n", F.first(target, ignorenulls=True).over(after))
    left, right = F.col(at) - F.col("_p"), F.col("_n") - F.col(at)
    chosen = F.when(F.col("_n").isNull() | (left <= right), F.col("_p")).otherwise(F.col("_n"))
    return marked.withColumn(name, chosen).drop("_p", "_n")


def within_any(points: DataFrame, bounds: DataFrame, at: str, low: str, high: str, name: str) -> DataFrame:
    """Adds `name`: is each point inside any of the bounds, both ends included? Bounds that are null or reversed hold nothing; a
    null point is inside of none.

    The axis is cut into buckets as wide as the bounds are on average, so that bounds make at most two pieces each on average;
    a bucket's pieces are merged to disjoint ones, and points meet those of their own bucket by an equi-join.
    """

    def number(df: DataFrame, c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp")) if dict(df.dtypes)[c].startswith(("timestamp", "date")) else F.col(c).cast("double")

    spans = bounds.select(number(bounds, low).alias("_lo"), number(bounds, high).alias("_hi")).where("_lo <= _hi")
    n, total, first, last = spans.agg(F.count("*"), F.sum(F.col("_hi") - F.col("_lo")), F.min("_lo"), F.max("_hi")).first()
    if not n:
        return points.withColumn(name, F.lit(False))
    # At least a quarter of what the bounds' stretch has for each, so that there are few buckets though all bounds be points.
    width = max(float(total) / n, float(last - first) / (4 * n)) or 1.0
    inside = lambda c: c.between(F.lit(first), F.lit(last))
    bucket = lambda c: F.when(inside(c), F.floor((c - F.lit(first)) / F.lit(width)).cast("long"))
    pieces = spans.select("_lo", "_hi", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))).alias("_b"))
    order = Window.partitionBy("_b").orderBy("_lo", "_hi")
    reached = F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = pieces.withColumn("_new", F.when(F.col("_lo") <= reached, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(order))
    merged = runs.groupBy("_b", "_k").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_k")
    placed = points.withColumn("_at", number(points, at)).withColumn("_pb", bucket(F.col("_at")))
    hit = (F.col("_pb") == F.col("_b")) & F.col("_at").between(F.col("_lo"), F.col("_hi"))
    return placed.join(merged, hit, "left").withColumn(name, F.col("_lo").isNotNull()).select(*points.columns, name)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark filters before and after its shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows, in ascending order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)
