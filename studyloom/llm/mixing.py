"""Mixing sources to target weights along a curriculum, in DataFrame expressions only.

Each source's weight varies over training time. Its schedule is integrated to a cumulative demand of words; each
document's place in its source's cumulative supply is sent through the inverse of that demand to a training position;
rows are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, row_hash, running_total, spread, table, whole_row

WEIGHTS, CAP = (5, 2, 1), 3
#: Relative weight by quarter of the training time, for the sources of the first, second, third weight, repeating.
SCHEDULE = ((1.6, 1.2, 0.8, 0.4), (1.0, 1.0, 1.0, 1.0), (0.4, 0.8, 1.2, 1.6))


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size long) -> one row per source: source_size, weight, place, target double.

    Sources by code point, null last, take the weights in turn. All words are shared by weight; a source stops at cap
    times its size and its excess is reshared until none is above. With sources in the order in which they stop
    (size / weight), the first one that stays below its stop fixes the share of all that follow.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows over one row per source, not over documents.
    named = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    by_stop = Window.orderBy((F.col("source_size") / F.col("weight")), "place")
    earlier = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stops = named.select(
        "*",
        F.row_number().over(by_stop).alias("rank"),
        (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("left_weight"),
    )
    stops = stops.withColumn("free", wide("left_words") * wide("weight") <= cap * wide("source_size") * wide("left_weight"))
    level = F.min(F.when(F.col("free"), F.struct("rank", "left_words", "left_weight"))).over(everything)
    shared = stops.withColumn("level", level)
    share = F.col("weight").cast("double") * F.col("level.left_words").cast("double") / F.col("level.left_weight").cast("double")
    target = F.when(F.col("rank") < F.col("level.rank"), (cap * F.col("source_size")).cast("double")).otherwise(share)
    return shared.select("source", "source_size", "weight", "place", target.alias("target"))


def training_position(part: Column, schedule: tuple[float, ...]) -> Column:
    """Inverse of the integral of a stepwise schedule: the time at which `part` (0..1) of the demand has been met."""
    steps, total = len(schedule), sum(schedule)
    met, at = 0.0, F.lit(1.0)
    pieces = []
    for i, w in enumerate(schedule):
        if w > 0:
            pieces.append((met, w / total, i))
            met += w / total
    for begin, width, i in reversed(pieces):
        inside = (i + (part - begin) / width) / steps
        at = F.when(part < begin + width, inside).otherwise(at)
    return at


def curriculum_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, schedule: tuple[tuple[float, ...], ...] = SCHEDULE, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, source, ...) -> one row per input row: row, size, source_size, target, part, copies, taken, positions.

    row is a struct of the columns of docs named in keep (all unless given), so that no name clashes with an added one.

    A source with r times its size as target gives each document floor(r) whole copies, and one more to the documents
    that come first in a fixed pseudo-random order until the rest is met. The copy that meets it is taken in part (part
    words, from its start), so that taken words differ from a source's target by less than a word; that is one document
    a source at most. positions holds a training position (0 to 1) per copy, ascending, null where a document has none: the
    copy's place in its source's demand, sent through the inverse of the source's integrated schedule. Rows are not sorted;
    see in_training_order.

    A null, empty or blank text has size 0 and no copies; a very long one is a row like any other. Null sources are a source.
    Repeated rows are mixed each on its own; rows that differ in other columns only are ordered by a hash of all of them, so
    reruns agree. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    size = n_words(text)
    at = spread(F.col("doc_id"), size, F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    rows = docs.select(whole_row(docs, keep).alias("row"), F.col("source").alias("group"), size.alias("value"), at.alias("at"), row_hash(docs).alias("tie"))
    narrow = materialize(rows.select("group", "value", "at"), "sizes")
    targets = source_targets(narrow.select(F.col("group").alias("source"), F.col("value").alias("size")), weights, cap)
    carried = targets.select(F.col("source").alias("group"), "source_size", "target", "place")
    mixed = running_total(rows, narrow, "before", carried).withColumnRenamed("value", "size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    more = F.least(F.col("size"), F.greatest(F.lit(0), F.floor(rest) - F.col("before")))
    mixed = mixed.withColumn("part", more).withColumn("taken", whole * F.col("size") + F.col("part"))
    copies = F.when(F.col("size") > 0, whole + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    mixed = mixed.withColumn("copies", copies)
    middle = lambda e: F.least((e * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.greatest("target", F.lit(1.0)), F.lit(1.0))
    place = lambda u: F.coalesce(*(F.when(F.col("place") % len(schedule) == i, training_position(u, s)) for i, s in enumerate(schedule)))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: place(middle(e))))
    return mixed.select("row", "size", "source_size", "target", "part", "copies", "taken", positions.alias("positions"), "at")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """curriculum_mix's rows -> one row per copy, range-sorted by position: row, copy (from 0), position, words (how many of
    the copy's words, from its start, are taken) and size. Equal positions are ordered by the rows' fixed pseudo-random order."""
    copies = mixed.select("row", "size", "part", "copies", "at", F.posexplode("positions").alias("copy", "position"))
    last = (F.col("part") > 0) & (F.col("copy") == F.col("copies") - 1)
    words = F.when(last, F.col("part")).otherwise(F.col("size"))
    return copies.select("row", "copy", "position", words.alias("words"), "size", "at").orderBy("position", "at").drop("at")


def op3_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = curriculum_mix(docs, keep=["doc_id"])
    first = F.element_at("positions", 1).alias("position")
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "copies", first, "at").orderBy(F.col("position").asc_nulls_last(), "at").drop("at")
