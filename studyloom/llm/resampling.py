"""Importance resampling towards a target's distribution of hashed word features.

Two passes over Arrow batches. The first counts features into one vector of BUCKETS a partition (np.bincount), and treeReduce
adds the vectors of all partitions up. The second gathers each bucket's gain, which is broadcast, and sums gains by document
(np.bincount with weights). The draw without replacement is by Gumbel noise out of a hash of the id: the highest scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_texts, materialize, table, tree_merged
from .licenses import words_of

#: Buckets of features, words of the longest feature, words that a document needs to be drawn, percent drawn, seed of the noise.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Distinct features whose bucket a task keeps at hand.
KEPT = 1 << 20


class Buckets(dict):
    """feature -> its crc32 modulo the number of buckets, kept for features seen before."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        at = self[feature] = zlib.crc32(feature) % self.buckets
        return at

    def of(self, words: list[bytes], longest: int) -> list[int]:
        """The buckets of all runs of 1 to `longest` consecutive words."""
        found = list(map(self.__getitem__, words))
        for n in range(2, longest + 1):
            found += [self[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
        return found


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """(text) -> how many features each bucket holds, over all rows; one vector a partition, added up as a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            found = [b for text in batch.column("text") for b in known.of(words_of(text.as_py()), longest)]
            total += np.bincount(np.array(found, np.int64), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vector"])

    parts = few_texts(texts.select(F.col("text").cast("string").alias("text"))).mapInArrow(count, "vector binary")
    return tree_merged(parts, lambda row: np.frombuffer(row["vector"], np.int64), np.add, np.zeros(buckets, np.int64))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the source, floored."""
    s, t, k = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, text, ...) -> one row per input row: doc_id, n_words, n_features, weight (floored mean gain of its features)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gains))
        for batch in batches:
            words = [words_of(text.as_py()) for text in batch.column("text")]
            found = [known.of(w, longest) for w in words]
            sizes = np.array([len(f) for f in found], np.int64)
            flat = np.array([b for f in found for b in f], np.int64)
            sums = np.bincount(np.repeat(np.arange(len(found)), sizes), weights=shared.value[flat], minlength=len(found)).astype(np.int64)
            weights = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(sizes), pa.array(weights)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few_texts(rows).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, floored, out of a hash of the id; a null id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def drawn_ranks(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, score, ...), a written table -> the same rows with rank: 1, 2, 3... over the drawn ones, else null.

    The lowest score drawn is read off the number of documents of each score (a score is a bounded whole number, so a bounded table
    reaches the driver). Rows from there up are range-sorted; a row's rank is its place in its partition after all of those before.
    """
    able = F.col("n_words") >= least_words
    counts = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted, met, lowest = sum(n for _, n in counts) * percent // 100, 0, None
    for score, n in counts:
        if met >= wanted:
            break
        met, lowest = met + n, score
    undrawn = scored.withColumn("rank", F.lit(None).cast("long"))
    if lowest is None:
        return undrawn
    high = able & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ordered = scored.where(high).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", 33).alias("part")
    starts, start = [], 0
    for r in sorted(ordered.groupBy(part).agg(F.count("*").alias("n")).collect()):  # a row a partition
        starts.append((r["part"], start))
        start += r["n"]
    starts = F.broadcast(scored.sparkSession.createDataFrame(starts, "part long, start long"))
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(rank <= wanted, rank)).drop("part", "start", "place")
    return ranked.unionByName(undrawn.where(~F.coalesce(high, F.lit(False))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text, ...) and the target's (text, ...) -> one row per document: doc_id, n_words, n_features, weight, score, rank.

    rank is 1, 2, 3... over the `percent` of the documents of `least_words` words or more that have the highest scores, and null for
    all others. A null or empty text has no features, weight 0, and is never drawn; a very long one is read whole. Repeated rows
    are documents of their own; ties go to the smaller doc_id, a null one last, then to either (such rows are equal in all
    columns that count). An empty table gives an empty result; an empty target is a target of equal shares; other columns are
    not read.
    """
    gains = bucket_gains(feature_counts(docs, buckets, longest), feature_counts(target, buckets, longest))
    scored = weighed(docs, gains, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn_ranks(materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scores"), percent, least_words).drop("row")


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
