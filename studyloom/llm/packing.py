"""Packing token sequences by cutting-stock column generation.

Each document's ids are cut into full sequences and a remainder. Remainders are counted by length in steps of 8 ids, a
histogram of at most 256 numbers. On it, column generation solves the cutting-stock linear program: knapsack dynamic
programming over the dual prices finds each next pattern of lengths. The patterns' counts are rounded down, what is left
over is packed first-fit-decreasing, and the patterns are dealt to the documents ranked within their length on Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few_texts, materialize, running_total, spread, table
from .tokens import crc, default_path, tokenizer

LENGTH, STEP, END_ID = 2048, 8, 1
#: Pivots of the simplex method per size at most.
ROUNDS = 50


def knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes (each as often as wanted) of the highest price that fits room, by dynamic programming."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(sizes, c, "right")
        best[c], choice[c] = best[c - 1], -1
        if fits:
            worth = best[c - sizes[:fits]] + prices[:fits]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], choice[c] = worth[k], k
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), out


def cutting_stock(demand: dict[int, int], room: int, gap: float = 5e-4) -> list[tuple[int, dict[int, int]]]:
    """(how often, {size: times}) patterns that use up demand {size: count} exactly, each within room.

    The linear program is solved by the revised simplex method until its value is within `gap` of the bound that the
    dual prices give; counts are rounded down and the rest is packed first-fit-decreasing.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    patterns = [row for row in np.diag(room // sizes)]
    inverse = np.diag(1.0 / (room // sizes))
    for turn in range(ROUNDS * len(sizes)):  # any basis gives a whole plan; a bound in place of an anti-cycling rule
        if turn % 64 == 63:  # made anew, as updates add up rounding errors
            inverse = np.linalg.inv(np.array(patterns, float).T)
        prices = inverse.sum(axis=0)
        worth, pattern = knapsack(prices, sizes, room)
        if worth <= 1 + gap:
            break
        change, counts = inverse @ pattern, inverse @ need
        ratio = np.where(change > 1e-9, np.maximum(counts, 0) / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        inverse[out] /= change[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(change[others], inverse[out])
        patterns[out] = pattern
    left, plan = need.astype(np.int64), []
    for pattern, x in zip(patterns, inverse @ need):
        times = int(np.floor(x + 1e-9))
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            plan.append((times, {int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}))
            left -= times * pattern
    while left.any():  # at most one pattern per size is left over
        free, pattern = room, Counter()
        for i in range(len(sizes) - 1, -1, -1):
            n = min(int(left[i]), free // int(sizes[i]))
            if n:
                pattern[int(sizes[i])] = n
                left[i] -= n
                free -= n * int(sizes[i])
        plan.append((1, dict(pattern)))
    return plan


def pieces_of(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens): each text's ids and end_id, cut at multiples of length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        for part in (batch.slice(k, 512) for batch in batches for k in range(0, batch.num_rows, 512)):  # few texts at a time as Python strings
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer(path).encode_all(part.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                rows += [(doc_id, at, min(length, len(ids) - at), crc(ids[at : at + length]), len(ids)) for at in range(0, len(ids), length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few_texts(rows).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, step: int = STEP, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text, ...) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a very long one is cut into as many pieces as it needs. Repeated rows are packed
    each on its own, and pieces that tie are interchangeable; an empty table gives an empty result; other columns are not read. Sequences are numbered from 0 without gaps in the numbers of one kind.
    """
    spark = docs.sparkSession
    at = spread(F.col("doc_id"), F.col("start"), F.col("ids_crc32"))
    pieces = pieces_of(docs, path, length, end_id)
    group = F.when(F.col("length") < length, F.ceil(F.col("length") / step)).otherwise(0).cast("long").alias("group")
    rows = materialize(pieces.select(F.struct("*").alias("row"), group, F.lit(1).cast("long").alias("value"), at.alias("at")), "pieces")
    ranked = running_total(rows.withColumn("tie", F.lit(0)), rows.select("group", "value", "at"), "rank")
    ranked = materialize(ranked.select("row.*", F.col("group").alias("size"), "rank"), "ranked")
    demand = {int(r["size"]): r["n"] for r in ranked.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most length / step rows
    plan = cutting_stock(demand, length // step)
    given, slots, first = Counter(), [], 0
    for times, pattern in plan:
        place = 0
        for size, n in sorted(pattern.items(), reverse=True):
            slots.append((size, given[size], given[size] + times * n, first, times, place))
            given[size] += times * n
            place += n
        first += times
    # One row per pattern and size: a few thousand at most, whatever the input.
    dealt = spark.createDataFrame(slots, "size long, lo long, hi long, first long, times long, place long")
    lists = dealt.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "first", "times", "place"))).alias("slots"))
    joined = ranked.where("size > 0").join(F.broadcast(lists), "size")
    slot = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), 1)
    placed = joined.withColumn("s", slot).withColumn("i", F.col("rank") - F.col("s.lo"))
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("s.first") + F.col("i") % F.col("s.times")).alias("sequence_id"),
        (F.col("s.place") + F.floor(F.col("i") / F.col("s.times"))).alias("slot"),
    )
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("slot")
    full = ranked.where("size = 0").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())
