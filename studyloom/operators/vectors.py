"""Exact vector search: filter first, one scan, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import cosine
from ..functions.text import normal_title
from .nearest import compared_pairs
from .relational import top_per

#: Fixed value: the most rows that a search returns.
MOST = 200


def match_chunks(chunks: DataFrame, query: list[float], k: int, *, user: str, **filters: str | None) -> DataFrame:
    """The k chunks (1 to 200) nearest to the query by cosine, after the tenant's and the optional filters.

    The tenant is required: no search crosses tenants. Null vectors are left out. Ties go to the smaller id. Adds similarity
    as float.
    """
    if not user:
        raise ValueError("a search needs a tenant")
    rows = chunks.where(F.col("embedding").isNotNull() & (F.col("user_id") == F.lit(user)))
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.withColumn("similarity", cosine(F.col("embedding"), vector).cast("float"))
    return scored.orderBy(F.desc("similarity"), "id").limit(min(MOST, max(1, k)))


def nearest_of(left: DataFrame, right: DataFrame, on: str, k: int, least: float = -1.0) -> DataFrame:
    """Left rows (lid, lvec) with their k nearest right rows (rid, rvec) of similarity `least` or more among those that
    agree in `on`, themselves (rid = lid) left out; ties to the smaller rid. Pairs are compared as tables of products, part by part."""
    pairs = compared_pairs(left.select("lid", "lvec", on), right.select("rid", "rvec", on), [on], k, least).where("lid <> rid").where(F.col("similarity") >= least)
    return top_per(pairs.drop("n"), ["lid"], [F.desc("similarity"), F.col("rid")], k)


def guard_duplicates(proposals: DataFrame, existing: DataFrame, on: str, threshold: float = 0.85) -> DataFrame:
    """Proposals (lid, in their order; title, lvec, `on`) against existing topics (rid, rvec, `on`) -> decision, rid, similarity, into and
    unguarded.

    coerced-to-existing (rid, similarity) where a known topic's vector is near enough; of the others, merged-into-proposal
    (into: the lid of the first accepted one of the same title, in any case and spacing; similarity 1), else create.
    unguarded says why a proposal could not be compared: no-title-embedding, or no-comparable-existing-vectors where there are
    topics but none whose vector it has a cosine with.
    """
    has = F.coalesce(F.size("lvec") > 0, F.lit(False))
    near = nearest_of(proposals.where(has).select("lid", on, "lvec"), existing, on, 1, threshold).select("lid", "rid", "similarity")
    sound = F.coalesce(F.forall("rvec", lambda x: x.isNotNull()) & F.exists("rvec", lambda x: x != 0), F.lit(False))
    known = existing.select(on, F.col("rid").alias("_r"), F.when(sound, F.size("rvec")).alias("_n")).groupBy(on).agg(F.count("*").alias("_all"), F.collect_set("_n").alias("_sizes"))
    rows = proposals.withColumn("_key", normal_title(F.col("title"))).join(near, "lid", "left").join(known, on, "left")
    fresh = F.col("rid").isNull()
    first = rows.where(fresh).groupBy(on, "_key").agg(F.min("lid").alias("_first"))
    rows = rows.join(first, [on, "_key"], "left")
    kind = F.when(~fresh, "coerced-to-existing").when(F.col("lid") != F.col("_first"), "merged-into-proposal").otherwise("create")
    comparable = F.array_contains("_sizes", F.size("lvec")) & F.exists("lvec", lambda x: x != 0)
    reason = F.when(~has, "no-title-embedding").when((F.col("_all") > 0) & ~F.coalesce(comparable, F.lit(False)), "no-comparable-existing-vectors")
    merged = kind == "merged-into-proposal"
    return rows.select(*(c for c in proposals.columns if c != "lvec"), kind.alias("decision"), "rid", F.when(merged, 1.0).otherwise(F.col("similarity")).alias("similarity"), F.when(merged, F.col("_first")).alias("into"), reason.alias("unguarded"))
