"""Embedding near-duplicates over a pivot-permutation index.

Each vector is described by its nearest reference points (pivots) in order. Near-equal vectors share most of the first
places, so vectors are listed under pairs of their first pivots; those that share two pivots meet in such a list, and
every pair that meets is verified by its cosine in double precision, in the list of the first two pivots that both share,
so that it counts once. A list gives each of its entries' number of links and one bond to the smallest entry that it
reaches there: no table of all pairs is written. Lists that are long are cut into blocks that meet pairwise, so no task
holds a list; equal vectors are one entry with a count.

Vectors within half of the threshold's angle of a pivot are its ball: any two of them are linked, by the triangle inequality,
so a ball's links are counted by its size and its vectors need not meet each other. In a list a ball of more than a block
has blocks of its own, which meet all blocks but each other: what a group of near copies costs grows with its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, table

#: Least and most pivots (a bounded sample of the vectors; between them, the square root of the vectors' number, so that lists
#: stay short, and an eighth of it where it is small), first places compared, threshold, entries of a block and rows of a call.
LEAST_PIVOTS, PIVOTS, PLACES, THRESHOLD, BLOCK, GROUP = 256, 2048, 5, 0.93, 1024, 8192
#: Candidates drawn for a pivot, and the cosine that no two pivots reach: pivots out of one group of near copies would be
#: ordered by noise.
DRAWN, APART = 16, 0.8
LISTS = "label string, p int, q int, first array<int>, ball int, entry long, copies long, u array<double>"
#: What a ball is narrower than half of the threshold's angle by, as a cosine: far more than rounding.
MARGIN = 1e-9
#: Balls, a row each, that are broadcast at most.
BALLS = 200_000


def pivot_sample(unit: DataFrame, pivots: int, threshold: float = THRESHOLD) -> np.ndarray:
    """At most `pivots` unit vectors of the table, no two with a cosine of APART or more: taken in order of a hash, the same
    ones in every run, from DRAWN candidates a pivot. Where few lie apart the lists are longer; no vector is left out. Each is
    then moved to the middle of the candidates that are linked with it, where its ball holds most."""
    rows = unit.orderBy(F.xxhash64("vec_id", "u")).select("u").limit(DRAWN * pivots).collect()
    drawn, chosen = np.array([r.u for r in rows], float), []
    free = np.ones(len(drawn), bool)
    while len(chosen) < pivots and free.any():
        chosen.append(int(free.argmax()))
        free &= drawn @ drawn[chosen[-1]] < APART
        free[chosen[-1]] = False
    if not chosen:
        return drawn
    middles = (drawn[near].sum(axis=0) for near in (drawn @ drawn[k] >= threshold for k in chosen))
    return np.array([m / math.sqrt(m @ m) for m in middles])


def pivot_number(n: int) -> int:
    return min(PIVOTS, max(LEAST_PIVOTS, math.isqrt(n)), max(2, n // 8))


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, e) -> u, e at length 1; null where e is null or zero, or holds a null or a non-finite component."""
    for batch in batches:
        units: list = [None] * batch.num_rows
        for i, e in enumerate(batch.column("e").to_pylist()):
            v = np.array(e, float) if e and None not in e else np.zeros(0)
            if np.isfinite(v).all() and v.any():
                v = v / np.abs(v).max()
                units[i] = v / math.sqrt(v @ v)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "u"])


def single_lists(unit: DataFrame) -> DataFrame:
    """(entry, label, copies, u) -> LISTS, one list a label."""
    return unit.select("label", F.lit(0).alias("p"), F.lit(1).alias("q"), F.array(F.lit(0), F.lit(1)).alias("first"), F.lit(-1).alias("ball"), "entry", "copies", "u")


def pivot_lists(unit: DataFrame, pivots: np.ndarray, places: int = PLACES, threshold: float = THRESHOLD) -> DataFrame:
    """(entry, label, copies, u) -> LISTS: a row for each pair of the entry's first `places` pivots. Its ball is the nearest pivot, -1
    where that is further off than half of the threshold's angle."""
    if len(pivots) < 2:
        return single_lists(unit)
    within = math.sqrt((1 + threshold) / 2) + MARGIN

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array(batch.column("u").to_pylist(), float)
            cosines = vectors @ pivots.T
            first = np.sort(np.argsort(-cosines, axis=1, kind="stable")[:, :places], axis=1).astype(np.int32)
            ball = pa.array(np.where(cosines.max(axis=1) >= within, cosines.argmax(axis=1), -1).astype(np.int32)).take
            pairs = list(combinations(range(first.shape[1]), 2))
            at = pa.array(np.repeat(np.arange(len(vectors)), len(pairs)))
            p, q = (first[:, [x[i] for x in pairs]].reshape(-1) for i in (0, 1))
            taken = batch.take(at)
            firsts = pa.array(list(first), pa.list_(pa.int32())).take(at)
            yield pa.RecordBatch.from_arrays([taken.column("label"), pa.array(p), pa.array(q), firsts, ball(at), taken.column("entry"), taken.column("copies"), taken.column("u")], names=["label", "p", "q", "first", "ball", "entry", "copies", "u"])

    return unit.select("entry", "label", "copies", "u").mapInArrow(describe, LISTS)


def meeting_here(a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """Of pairs of rows of sorted pivots: are p and q the first two that both hold?"""
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
    so_far = shared.cumsum(axis=1)
    at = np.arange(len(a))
    return (a[at, shared.argmax(axis=1)] == p) & (a[at, (so_far == 2).argmax(axis=1)] == q) & (so_far[:, -1] >= 2)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches over the edges a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def ball_links(lists: DataFrame) -> DataFrame:
    """LISTS -> (entry, linked, bond) as verified_links, of the links within balls: an entry is linked with all others of its ball."""
    once = lists.where((F.col("ball") >= 0) & (F.col("p") == F.col("first")[0]) & (F.col("q") == F.col("first")[1])).select("label", "ball", "entry", "copies")
    once = materialize(once, "balls")
    whole = once.groupBy("label", "ball").agg(F.sum("copies").alias("_all"), F.min("entry").alias("bond"), F.count("*").alias("_n")).where("_n > 1")
    # A ball can hold much of the table: its entries stay where they lie while the balls are few, else a join splits hot ones.
    few = whole.limit(BALLS + 1).count() <= BALLS
    return once.join(F.broadcast(whole) if few else whole, ["label", "ball"]).select("entry", (F.col("_all") - F.col("copies")).alias("linked"), "bond")


def verified_links(lists: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """LISTS -> (entry, linked, bond): parts of an entry's number of links with cosine of `threshold` or more, each counted as
    often as the other end has copies, and an entry to which it is linked over such links, itself if it is the smallest. Links
    within a ball are left out."""
    # A list's groups are its balls of more than a block, and all else (-1); each has blocks of its own, numbered through the list.
    by_ball = lists.groupBy("label", "p", "q", "ball").agg(F.count("*").alias("n"))
    grouped = by_ball.withColumn("group", F.when(F.col("n") > block, F.col("ball")).otherwise(-1)).groupBy("label", "p", "q", "group").agg(F.sum("n").alias("n"))
    sizes = grouped.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).groupBy("label", "p", "q").agg(F.sum("n").alias("n"), F.sum("blocks").cast("int").alias("all"), F.array_sort(F.collect_list(F.struct("group", "blocks"))).alias("groups")).where("n > 1")
    of = lambda ball: F.get(F.filter("groups", lambda g: g["group"] == ball), F.lit(0))
    own = F.coalesce(of(F.col("ball")), of(F.lit(-1)))
    before = F.aggregate(F.filter("groups", lambda g: g["group"] < F.col("own.group")), F.lit(0), lambda n, g: n + g["blocks"])
    cut = lists.join(sizes.drop("n"), ["label", "p", "q"]).withColumn("own", own).withColumn("low", before)
    cut = cut.withColumn("mine", (F.col("low") + F.pmod(F.xxhash64("entry"), F.col("own.blocks"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda i: (F.col("own.group") < 0) | (i < F.col("low")) | (i >= F.col("low") + F.col("own.blocks")))
    meets = F.transform(others, lambda i: F.struct(F.least(i, "mine").alias("i"), F.greatest(i, "mine").alias("j")))
    dealt = cut.select("label", "p", "q", "first", "ball", F.explode(meets).alias("m"), "mine", "entry", "copies", "u").select("label", "p", "q", "m.i", "m.j", "mine", "first", "ball", "entry", "copies", "u")

    # Many lists are short: a task's call takes about GROUP rows of whole lists, dealt by a hash of the list.
    met = F.expr("aggregate(groups, 0L, (s, g) -> s + CAST(g.blocks AS BIGINT) * (all - IF(g.group >= 0, g.blocks, 0)))")
    rows = sizes.agg(F.sum(met * F.least(F.col("n"), F.lit(block)))).first()[0] or 0
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("label", "p", "q", "i", "j"), F.lit(max(1, rows // GROUP))))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "p", "q", "i", "j", "mine", "entry"], ignore_index=True)
        keys = rows[["label", "p", "q", "i", "j"]]
        starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
        mine, first, second, p, q, ball, copies = (rows[c].to_numpy() for c in ("mine", "i", "j", "p", "q", "ball", "copies"))
        vectors, pivots = rows["u"].to_numpy(), rows["first"].to_numpy()
        linked, bond = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for lo, hi in zip(starts, [*starts[1:], len(rows)]):
            same = first[lo] == second[lo]
            mid = lo if same else lo + int(np.searchsorted(mine[lo:hi], second[lo]))
            v, f = np.stack(vectors[lo:hi]), np.stack(pivots[lo:hi])
            found_a, found_b = [], []
            for k in range(lo, hi if same else mid, 256):
                to = min(k + 256, hi if same else mid)
                a, b = np.nonzero(v[k - lo : to - lo] @ v[mid - lo :].T >= threshold)
                a, b = a + k - lo, b + mid - lo
                keep = (ball[lo + a] != ball[lo + b]) | (ball[lo + a] < 0)
                keep &= (a < b) if same else True
                a, b = a[keep], b[keep]
                keep = meeting_here(f[a], f[b], p[lo], q[lo])
                found_a.append(a[keep])
                found_b.append(b[keep])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
            np.add.at(linked, lo + a, copies[lo + b])
            np.add.at(linked, lo + b, copies[lo + a])
            bond[lo:hi] = lo + roots(hi - lo, a, b)
        entry = rows["entry"].to_numpy()
        out = pd.DataFrame({"entry": entry, "linked": linked, "bond": entry[bond]})
        return out[(linked > 0)]

    return dealt.groupBy("g").applyInPandas(verify, "entry long, linked long, bond long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int | None = None, places: int = PLACES) -> DataFrame:
    """(vec_id, embedding, label, ...) -> one row per input row: vec_id, n_links, component_id, kept.

    Only vectors of equal, not null labels and equal dimension are compared. A vector that is null, zero, or holds a null
    or a non-finite component links with nothing: it is its own component. Equal vectors link with each other. A row
    whose vec_id is repeated is a further vector under the same id, and counts as a link. A null vec_id is linked like any
    other but never the smallest; where a whole component has none, component_id is null. Other columns are not read; an
    empty table gives an empty result.

    Each dimension has pivots of its own, a few jobs each; without two pivots that lie apart its vectors are one list a label.
    A vector is scaled by its largest component before its length is taken, so that no finite size overflows or vanishes.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("label"), F.when(F.col("label").isNotNull(), F.col("embedding").cast("array<double>")).alias("e"))
    held = materialize(rows.mapInArrow(scaled, "vec_id long, label string, u array<double>"), "unit")
    unique = held.where("u IS NOT NULL").groupBy("label", "u").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    # An entry is named by its smallest vec_id; equal ids of different vectors are told apart by a hash of the vector.
    unique = materialize(unique.select("*", F.xxhash64("vec_id", "label", "u").alias("entry")), "entries")
    sizes = {r["size"]: r["n"] for r in unique.groupBy(F.size("u").alias("size")).agg(F.count("*").alias("n")).collect()}
    lists = single_lists(unique.limit(0))
    for size, n in sizes.items():
        part = unique.where(F.size("u") == size)
        lists = lists.unionByName(pivot_lists(part, pivot_sample(part, pivots or pivot_number(n), threshold), places, threshold))
    found = materialize(verified_links(lists, threshold).unionByName(ball_links(lists)), "links")
    degree = found.groupBy("entry").agg(F.sum("linked").alias("linked"))
    members = connected_components(found.select(F.col("entry").alias("a"), F.col("bond").alias("b"))).withColumnRenamed("node", "entry")
    entries = unique.join(degree, "entry", "left").join(members, "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    smallest = entries.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    entries = entries.join(smallest, "component").select("label", "u", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    able = held.where("u IS NOT NULL").join(entries, ["label", "u"]).select("vec_id", "n_links", "component_id")
    alone = held.where("u IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return able.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_pivot_permutation(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
