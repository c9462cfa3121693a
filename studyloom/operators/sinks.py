"""Writes as transforms: each returns the table's next state. Plain Parquet has no MERGE, so rows are replaced by anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_wins, newest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of new replace those of the same key; with `order`, the last one of a key in new counts."""
    latest = newest(new, keys, *order) if order else new.dropDuplicates(keys)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of new whose key isn't there are added, the first of each key in `order`; a retry changes nothing."""
    first = first_wins(new, keys, *order) if order else new.dropDuplicates(keys)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def patch(old: DataFrame, changes: DataFrame, keys: list[str], fields: list[str], locks: str | None = None) -> DataFrame:
    """Not-null fields of changes replace those of old, but for fields named in a row's array of locks."""
    new = changes.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    both = old.join(new, keys, "left")
    held = lambda f: F.coalesce(F.array_contains(F.col(locks), f), F.lit(False)) if locks else F.lit(False)
    return both.select(*(F.when(held(c), F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))).alias(c) if c in fields else F.col(c) for c in old.columns))


def add_lock(locks: Column, name: str) -> Column:
    return F.array_sort(F.array_union(F.coalesce(locks, F.array().cast("array<string>")), F.array(F.lit(name))))


def replace_partition(old: DataFrame, new: DataFrame, part: list[str], hash_key: str, order: Column) -> DataFrame:
    """Parts (for instance a document's chunks) that new holds are replaced whole; the first row of a hash in a part wins."""
    return old.join(new.select(*part).distinct(), part, "left_anti").unionByName(first_wins(new, [*part, hash_key], order).select(*old.columns))


def bump_revision(current: DataFrame, history: DataFrame, merged: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(next current, next history): changed rows are snapshot at their revision, then replaced one revision up."""
    changed = current.join(merged.select(key), key, "left_semi")
    fields = [c for c in current.columns if c not in (key, "revision")]
    fresh = merged.join(changed.select(key, "revision"), key).select(key, (F.col("revision") + 1).alias("revision"), *fields)
    return upsert(current, fresh.select(*current.columns), [key]), history.unionByName(changed.select(*history.columns))


def upsert_provenance(old: DataFrame, cited: DataFrame) -> DataFrame:
    """(topic_id, document_id, pages) after a merge: what it cites of a document replaces what was known, its pages distinct and in
    order; a citation without a page keeps the document with no page. cited: topic_id, document_id, page."""
    fresh = cited.groupBy("topic_id", "document_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return upsert(old.select("topic_id", "document_id", "pages"), fresh, ["topic_id", "document_id"])


def log_rows(calls: DataFrame, price: Column) -> DataFrame:
    """Rows of the append-only call log: token counts that the provider didn't report are 0, and where it reported none, or the
    model has no price, cost_usd is null: unknown, not free.

    calls: call_id, user_id, model, outcome, created_at, latency_ms and the four token counts, null without a report.
    """
    counts = [f"{c}_tokens" for c in ("input", "output", "cache_read", "cache_write")]
    reported = F.coalesce(*(F.col(c) for c in counts)).isNotNull()
    return calls.select(
        "call_id", "user_id", "model", "outcome", "created_at", F.floor(F.col("latency_ms") + 0.5).cast("long").alias("latency_ms"),
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts), F.when(reported, price).cast("decimal(14,8)").alias("cost_usd"),
    )


def append_log(log: DataFrame, new: DataFrame, *order: Column, key: str = "call_id") -> DataFrame:
    """The log with new rows behind; a call that is logged already is not logged again (of several new rows of a call the first in
    `order` is), and no row is ever changed."""
    return insert_ignore(log, new, [key], *order)


def reuse_vectors(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """chunks (user_id, chunk_hash, ...) with the user's own stored vector of the same content, the first (by id) that is not null,
    and `fresh`: whether it has to be made. stored: id, user_id, chunk_hash, embedding."""
    known = first_wins(stored.where("embedding IS NOT NULL"), ["user_id", "chunk_hash"], F.col("id")).select("user_id", "chunk_hash", "embedding")
    return chunks.drop("embedding").join(known, ["user_id", "chunk_hash"], "left").withColumn("fresh", F.col("embedding").isNull())


# What the reference's triggers do, as steps of a write path ---------------------------------------------------------------


def touched(old: DataFrame, new: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """new with updated_at set to now where a row differs from the old one; others keep theirs."""
    fields = [c for c in new.columns if c not in (*keys, "updated_at")]
    before = old.select(*keys, F.struct(*fields).alias("_old"), F.col("updated_at").alias("_at"))
    rows = new.join(before, keys, "left")
    same = F.coalesce(F.col("_old") == F.struct(*fields), F.lit(False)) | F.col("_old").eqNullSafe(F.struct(*fields))
    return rows.select(*(F.when(same, F.col("_at")).otherwise(now).alias(c) if c == "updated_at" else F.col(c) for c in new.columns))


def unconfirmed(old: DataFrame, new: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """new with `confirmed` false for rows that are inserted or whose tag changed: only a later edit may confirm them."""
    before = old.select(*keys, F.col(tag).alias("_tag"), F.lit(True).alias("_known"))
    rows = new.join(before, keys, "left")
    keep = F.coalesce(F.col("_known"), F.lit(False)) & F.col("_tag").eqNullSafe(F.col(tag))
    return rows.select(*((keep & F.col("confirmed")).alias(c) if c == "confirmed" else F.col(c) for c in new.columns))


def append_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old that new lacks or changes: an append-only table allows none."""
    return old.join(new.select(*old.columns).intersect(old), keys, "left_anti")


def merged_once(merges: DataFrame) -> DataFrame:
    """(topic_id, document_id, n) that were merged more than once."""
    return not_unique(merges, ["topic_id", "document_id"])


def without_source(topics: DataFrame, sources: DataFrame) -> DataFrame:
    """Topics that no source backs any more; they go with their last one."""
    return topics.join(sources.select("topic_id"), "topic_id", "left_anti")


def without_topic(chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """Chunks that stay once topics are gone: those made of a topic's page go with it, a document's own stay."""
    gone = chunks.where("source = 'topic_page'").join(topics.select("topic_id"), "topic_id", "left_anti").select("chunk_id")
    return chunks.join(gone, "chunk_id", "left_anti")


#: SQLSTATE codes of a row that is there already, and of rows that never will be.
THERE, NEVER = "23505", ("23502", "23503", "23514", "22P02", "42501")


def write_error(code: Column) -> Column:
    """delivered (no error, or a row that is there already), rejected (never will be), or failed (try again)."""
    return F.when(code.isNull() | (code == THERE), "delivered").when(code.isin(*NEVER), "rejected").otherwise("failed")


def flush_queue(queue: DataFrame, results: DataFrame) -> DataFrame:
    """What stays in an offline queue: entries delivered or rejected go, failed ones count an attempt, others wait. Of several results
    of an entry the last in `ord` counts; without that column an entry has one."""
    known = (newest(results, ["client_id"], F.col("ord")) if "ord" in results.columns else results.dropDuplicates(["client_id"])).select("client_id", "outcome")
    left = queue.join(known, "client_id", "left").where(F.coalesce("outcome", F.lit("waiting")).isin("waiting", "failed"))
    return left.select(*(F.when(F.col("outcome") == "failed", F.col("attempts") + 1).otherwise(F.col("attempts")).alias(c) if c == "attempts" else F.col(c) for c in queue.columns))


# Constraints as queries: each returns the rows that break it ------------------------------------------------------------


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows whose not-null foreign key has no parent; keys: child column to parent column."""
    parents = parent.select(*(F.col(p).alias(c) for c, p in keys.items())).distinct()
    filled = child.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in keys)))
    return filled.join(parents, list(keys), "left_anti")


def violates(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which a check is false (an unknown check passes)."""
    return df.where(~F.coalesce(rule, F.lit(True)))
