"""SimHash near-duplicates: fingerprints and a binary-trie self-join on Spark.

Fingerprints are nodes at the bottom of a binary trie. The join walks pairs of trie nodes of equal depth together,
adds up the bits in which their paths differ, and prunes a pair once the sum is over its budget. Two fingerprints that
differ in at most 3 bits differ in at most 1 bit of their first or of their second half, so two tries are walked, over
the fingerprint and over its halves swapped, with a budget of 1 down to depth 32 and of 3 below. That keeps the pairs
alive at any depth near n * (depth + 1), where a single trie with a budget of 3 would keep n * depth**3 / 6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, connected_components, few_texts, materialize, row_hash, whole_row

SEED, SHINGLE, BUDGET = 42, 3, 3


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text's word shingles; 0 where it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else [b" ".join(x) for x in zip(*(words[i:] for i in range(SHINGLE)))]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):  # a very long text in slices, to bound the bit matrix
        ones += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(prints)], names=["doc_id", "row_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, row_hash, fp long), one row per input row, nulls in any column allowed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash(docs).alias("row_hash"))
    return few_texts(rows).mapInArrow(_fingerprints, "doc_id long, row_hash long, fp long")


def trie_links(prints: DataFrame) -> DataFrame:
    """(fp long) -> (a, b): the pairs of different fingerprints, a < b, at 3 or fewer differing bits.

    No pair is lost and none is made for equal fingerprints. A first step enters both tries at the depth where they
    have about one node per fingerprint: each node meets the nodes whose paths differ from its own in at most a bit.
    The next steps descend to the children at depths 32, 48 and 64, of both nodes of a pair together.
    """
    prints = materialize(prints.select("fp").distinct(), "prints")
    depth = min(32, max(8, prints.count().bit_length()))
    found = None
    for turn in (0, 32):
        key = F.col("fp") if not turn else F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
        leaves = prints.select(key.alias("k"))
        at = lambda d, c="k": F.shiftrightunsigned(c, 64 - d) if d < 64 else F.col(c)
        top = leaves.select(at(depth).alias("x")).distinct()
        masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(depth)))
        near = top.select("x", F.explode(masks).alias("m")).select(F.col("x").alias("p"), F.col("x").bitwiseXOR(F.col("m")).alias("q")).where("p <= q")
        pairs = near.join(top.select(F.col("x").alias("q")), "q")
        for upper, lower, budget in ((depth, 32, 1), (32, 48, BUDGET), (48, 64, BUDGET)):
            if upper == lower:
                continue
            children = leaves.select(at(upper).alias("up"), at(lower).alias("down")).distinct()
            pairs = (
                pairs.join(children.select(F.col("up").alias("p"), F.col("down").alias("p2")), "p")
                .join(children.select(F.col("up").alias("q"), F.col("down").alias("q2")), "q")
                .where((F.col("p2") <= F.col("q2")) | (F.col("p") != F.col("q")))
                .where(F.bit_count(F.col("p2").bitwiseXOR(F.col("q2"))) <= budget)
                .select(F.col("p2").alias("p"), F.col("q2").alias("q"))
            )
        back = lambda c: F.col(c) if not turn else F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32))
        links = pairs.where("p <> q").select(F.least(back("p"), back("q")).alias("a"), F.greatest(back("p"), back("q")).alias("b"))
        found = links if found is None else found.unionByName(links)
    return found.distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, row_hash, fp, component_id, component), one row per input row.

    Fingerprints at most 3 bits apart are linked; component_id is the smallest doc_id reachable over links, itself
    included. Equal fingerprints (repeated rows, empty and null texts, whose fingerprint is 0) are one node. A very long text
    is hashed whole, in slices. A null doc_id is a member but never the smallest; where a whole component has none,
    component_id is null. row_hash is a hash of all columns; they are not returned, so no name clashes. An empty table
    gives an empty result.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    members = connected_components(trie_links(prints))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(members.withColumnRenamed("node", "fp"), "fp", "left")
    nodes = nodes.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialize(nodes.join(smallest, "component").select("fp", "component_id", "component"), "classes")
    return prints.join(classes, "fp").select("doc_id", "row_hash", "fp", "component_id", "component")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one row of each component, whole: that of the smallest doc_id (null last), then of the smallest hash of all its
    columns; of rows equal in every column, one. All columns stay, whatever their names; empty and null texts are one
    component; an empty table gives an empty result."""
    members = simhash_components(docs)
    best = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("b"))
    keys = ["id", "none", "hash"]  # plain columns: the join and the window share one exchange
    best = best.select(F.coalesce("b.doc_id", F.lit(0)).alias("id"), F.col("b.none").alias("none"), F.col("b.row_hash").alias("hash"))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(whole_row(docs).alias("row"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), row_hash(docs).alias("hash"))
    kept = rows.join(best, keys, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("hash")))
    return kept.where("n = 1").select("row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
