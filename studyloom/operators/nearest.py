"""Exact nearest neighbours through clusters, by the triangle inequality.

Unit vectors are put with the nearest of a bounded number of centres, and keep their distance to it. For a query at distance q of
a centre, a vector at distance v of it is |q - v| away at least. A search first reads the clusters nearest to the query that hold
k rows which pass its filters; the k-th distance found there bounds all else: of other clusters only vectors that the bound
can't exclude are compared. Filters come before counting, so they never shorten an answer, and the answer is that of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import held, sized
from .relational import top_per

#: Centres at least and at most (between them the square root of the number of vectors), vectors drawn a centre, rounds of fitting, and
#: what distances may be off by in doubles.
LEAST, MOST, DRAWN, ROUNDS, SLACK = 8, 1024, 32, 6, 1e-7
#: Rows and queries of a table of products, and what a product of unit vectors may be off by.
PART, BLOCK, NEAR = 8192, 512, 1e-9


def unit_rows(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a list of vectors the places of those that have a cosine with one of `dim` components, and these scaled to length 1; by their
    largest component first, so that no square overflows or vanishes."""
    whole = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and None not in v]
    u = np.array([vectors[i] for i in whole], float).reshape(-1, dim)
    largest = np.abs(u).max(axis=1, initial=0)
    fine = np.isfinite(u).all(axis=1) & (largest > 0)
    u = u[fine] / largest[fine, None]
    return np.array(whole, np.int64)[fine], u / np.sqrt((u**2).sum(axis=1))[:, None]


def read_vectors(column: pa.ChunkedArray) -> list:
    """Vectors of one size without nulls as rows of a table of doubles, any others as lists."""
    vectors = column.combine_chunks()
    flat = vectors.flatten() if vectors.null_count == 0 else None
    if flat is None or flat.null_count or len(set(vectors.value_lengths().to_pylist())) != 1:
        return vectors.to_pylist()
    return flat.to_numpy().astype(float).reshape(len(vectors), -1)


def exact_cosines(a: np.ndarray, b: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """Row by row what `cosine` gives: the same sums of doubles in the same order. Where squares overflow or vanish, that of the scaled
    vectors."""

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for i in range(x.shape[1]):
            total += x[:, i] * y[:, i]
        return total

    with np.errstate(all="ignore"):
        norm = np.sqrt(dot(a, a) * dot(b, b))
        return np.clip(np.where((norm > 0) & (norm < np.inf), dot(a, b) / norm, scaled), -1.0, 1.0)


def compared_pairs(left: DataFrame, right: DataFrame, on: list[str], k: int, least: float = -1.0) -> DataFrame:
    """left (lid, lvec, `on` and, where bounded, far and bound) and right (rid, rvec, `on` and dist) -> (lid, rid, similarity, n): of rows
    that agree in `on`, at least the k nearest of each lid, itself not counted, that have `least` or more, with their cosine;
    and for each lid rows without rid that say how many vectors it was compared with.

    Right rows are dealt to parts of about PART, left ones go to each part of theirs. Products of unit vectors say which
    pairs can be among the k nearest of a part, or within a bound; only of those is the cosine taken. Of equal vectors in a part
    those of the smallest ids are enough. Only vectors of one size have a cosine.
    """
    bounded = "bound" in left.columns
    left, right = (t.where(F.size(v) > 0).withColumn("_size", F.size(v)) for t, v in ((left, "lvec"), (right, "rvec")))
    on = [*on, "_size"]
    parts = right.groupBy(*on).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    dealt = right.join(sized(parts), on).withColumn("_part", F.pmod(F.xxhash64("rid"), F.col("_parts")).cast("int")).drop("_parts")
    spread = left.join(sized(parts), on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    kinds = {f.name: f.dataType.simpleString() for f in (*left.schema, *right.schema)}
    columns = ["lid", "rid", "similarity", "n"]

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        lids, rids = ours.column("lid").combine_chunks(), theirs.column("rid").combine_chunks()
        schema = pa.schema([("lid", lids.type), ("rid", rids.type), ("similarity", pa.float64()), ("n", pa.int64())])
        if not len(lids) or not len(rids):
            return schema.empty_table()
        theirs = theirs.sort_by("rid")
        rids, lraw, rraw = theirs.column("rid").combine_chunks(), read_vectors(ours.column("lvec")), read_vectors(theirs.column("rvec"))
        (la, lu), (ra, ru) = (unit_rows(raw, len(raw[0])) for raw in (lraw, rraw))
        if not len(la) or not len(ra):
            return schema.empty_table()
        whole = lambda raw, at: np.array([raw[i] for i in at], float)
        lraw, rraw = whole(lraw, la), whole(rraw, ra)
        same = np.unique(rraw, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.argsort(same, kind="stable")
        starts = np.searchsorted(same[order], same[order])
        first = np.empty(len(ra), bool)
        first[order] = np.arange(len(ra)) - starts <= k  # one more, as the query itself may be among them
        if bounded:
            far, bound = (ours.column(c).to_numpy()[la] for c in ("far", "bound"))
            dist = theirs.column("dist").to_numpy()[ra]
        made = []
        for i in range(0, len(la), BLOCK):
            at = slice(i, i + BLOCK)
            s = lu[at] @ ru.T
            n = np.full(len(s), len(ra))
            floor = np.full(len(s), least)
            if bounded:
                reached = np.abs(far[at, None] - dist[None, :]) <= bound[at, None] + SLACK
                n, s = reached.sum(axis=1), np.where(reached, s, -2.0)
                floor = np.maximum(floor, 1 - (bound[at] + SLACK) ** 2 / 2)
            if len(ra) > k:
                floor = np.maximum(floor, np.partition(s, len(ra) - 1 - k, axis=1)[:, len(ra) - 1 - k])
            a, b = np.nonzero((s >= floor[:, None] - NEAR) & first & (s > -1.5))
            own = lids.take(pa.array(la[at]))
            made.append(pa.table([own.take(pa.array(a)), rids.take(pa.array(ra[b])), pa.array(exact_cosines(lraw[at][a], rraw[b], s[a, b])), pa.nulls(len(a), pa.int64())], schema=schema))
            made.append(pa.table([own, pa.nulls(len(own), rids.type), pa.nulls(len(own), pa.float64()), pa.array(n, pa.int64())], schema=schema))
        return pa.concat_tables(made)

    keys = [*on, "_part"]
    named = dealt.select(*(F.col(c).alias(f"_k{c}") for c in keys), "rid", "rvec", *(["dist"] if bounded else []))  # both sides may come from one table
    return spread.groupBy(*keys).cogroup(named.groupBy(*(f"_k{c}" for c in keys))).applyInArrow(compare, f"lid {kinds['lid']}, rid {kinds['rid']}, similarity double, n long").select(*columns)


def fitted_centres(vectors: DataFrame, number: int, dim: int) -> np.ndarray:
    """Centres of a bounded sample (DRAWN vectors a centre, by a hash), the same in every run."""
    rows = vectors.where(F.size("rvec") == dim).orderBy(F.xxhash64("rvec"), "rid").select("rvec").limit(DRAWN * number).collect()
    drawn = unit_rows([r["rvec"] for r in rows], dim)[1]
    centres = drawn[:number].copy()
    for _ in range(ROUNDS):
        near = (drawn @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = drawn[near == c].mean(axis=0)
    return centres if len(centres) else np.zeros((1, dim))


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cluster and dist to rows with a column rvec; rows without a unit vector go."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, u = unit_rows(batch.column("rvec").to_pylist(), centres.shape[1])
            cluster = (u @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            dist = np.sqrt(((u - centres[cluster]) ** 2).sum(axis=1))
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cluster, pa.int32()), pa.array(dist, pa.float64())], names=[*batch.schema.names, "cluster", "dist"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(near, ", ".join([*kept, "cluster int", "dist double"]))


def build_clusters(vectors: DataFrame, folder: str, dim: int, number: int | None = None) -> np.ndarray:
    """(rid, rvec and columns to filter by) -> the table of clusters in `folder`, written by cluster, and the centres. Vectors that
    have no cosine with one of `dim` components are left out: no search finds them."""
    number = number or min(MOST, max(LEAST, math.isqrt(vectors.count())))
    centres = fitted_centres(vectors, number, dim)
    assigned(vectors, centres).repartitionByRange("cluster", "rid").sortWithinPartitions("cluster", "dist").write.parquet(folder)
    return centres


def search_clusters(clusters: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, on: list[str] | None = None, least: float = -1.0) -> DataFrame:
    """Queries (lid, lvec and the columns of `on`) -> (lid, rid, similarity, rank, compared): of each the k nearest rows, by cosine,
    among those that agree with it in `on`, of similarity `least` or more, itself (rid = lid) left out; ties to the smaller
    rid. compared: vectors whose cosine was taken for the query."""
    on, dim = on or [], centres.shape[1]

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # a table of 64 queries and all centres at a time
                part = batch.slice(k, 64)
                at, u = unit_rows(part.column("lvec").to_pylist(), dim)
                far = np.sqrt(((u[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
                taken = pa.array(np.repeat(at, len(centres)))
                columns = [part.column(n).take(taken) for n in ("lid", *on)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(len(centres), dtype=np.int32), len(at))), pa.array(far.reshape(-1))], names=["lid", *on, "cluster", "far"])

    asked = queries.select("lid", "lvec", *on)
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in ("lid", *on)] + ["cluster int", "far double"])
    sizes = clusters.groupBy("cluster", *on).agg(F.count("*").alias("n"), F.min("dist").alias("near_edge"), F.max("dist").alias("far_edge"))
    plan = asked.mapInArrow(centred, schema).join(sized(sizes), ["cluster", *on])
    nearest = Window.partitionBy("lid").orderBy("far", "cluster")
    before = F.coalesce(F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = held(plan.withColumn("first", before < k + 1), "visits")  # one more, as the query itself may be a row
    vectors = asked.select("lid", "lvec")

    def compared(visits: DataFrame) -> DataFrame:
        asked_here = visits.join(vectors, "lid").select("lid", "lvec", "cluster", "far", "bound", *on)
        return held(compared_pairs(asked_here, clusters.select("rid", "rvec", "cluster", "dist", *on), ["cluster", *on], k, least), "compared")

    mine = (F.col("lid") != F.col("rid")) & (F.col("similarity") >= least)
    order = [F.desc("similarity"), F.col("rid")]
    start = compared(plan.where("first").withColumn("bound", F.lit(4.0)))
    # A query with fewer than k rows there has read all that pass its filters: nothing is left to visit.
    best = top_per(start.where(mine), ["lid"], order, k)
    kth = best.groupBy("lid").agg(F.count("*").alias("found"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("similarity"))).alias("bound"))
    floor = F.lit(4.0 if least <= -1 else math.sqrt(max(0.0, 2 - 2 * least)))
    bounds = vectors.join(kth, "lid", "left").select("lid", F.when(F.col("found") == k, F.least("bound", floor)).otherwise(floor).alias("bound"))
    gap = F.greatest(F.lit(0.0), F.col("far") - F.col("far_edge"), F.col("near_edge") - F.col("far"))
    rest = compared(held(plan.where(~F.col("first")).join(bounds, "lid").where(gap <= F.col("bound") + SLACK), "visits"))
    counts = start.unionByName(rest).groupBy("lid").agg(F.sum("n").alias("compared"))
    best = best.drop("n")
    final = top_per(best.drop("rank").unionByName(top_per(rest.where(mine), ["lid"], order, k).drop("rank", "n")), ["lid"], order, k)
    return final.join(counts, "lid")
