"""Routing and merge planning: signals to topics, reprocessing, retries, frozen plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_title
from ..sources.tables import sized
from .relational import top_per
from .similarity import held_share
from .windows import first_wins

#: The least fuzzy score, and the segments from which a single target looks like an under-split document.
FUZZY, FUNNEL = 0.18, 12
FUNNELLED = "[routing] Whole document funnelled into a single topic on an empty index (%s sections → 1 topic) — likely under-split."


def map_signals(signals: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """(signal_id, topic_id, method, score): by page where topics cite the signal's page (the best of them by shared words
    if several), else by shared words over all topics from 0.18 on, else unmapped.

    signals: signal_id, document_id, page, tokens; topics: topic_id, ord, tokens; sources: topic_id, document_id, page.
    Over all topics a signal meets those that hold one of its rarer words (held_share); on its page the few that cite it are
    compared as they are. A signal's tokens are without repeats.
    """
    sets = topics.select(F.col("topic_id").alias("lid"), F.col("tokens").alias("words"))
    near = held_share(sets, signals.select(F.col("signal_id").alias("rid"), F.col("tokens").alias("words")), FUZZY)
    shared = near.select(F.col("rid").alias("signal_id"), F.col("lid").alias("topic_id"), "score").join(sized(topics.select("topic_id", "ord")), "topic_id")
    on_page = signals.join(sized(sources.distinct()), ["document_id", "page"]).select("signal_id", "topic_id", F.col("tokens").alias("_s")).dropDuplicates(["signal_id", "topic_id"]).join(sized(topics.select("topic_id", "ord", "tokens")), "topic_id")
    score = F.when(F.size("_s") > 0, F.size(F.array_intersect("_s", "tokens")) / F.size("_s")).otherwise(F.lit(0.0))
    scored = on_page.select("signal_id", "topic_id", "ord", score.alias("score"))
    several = on_page.groupBy("signal_id").agg(F.count("*").alias("pages"))
    best = lambda df: top_per(df, ["signal_id"], [F.desc("score"), F.col("ord")], 1).drop("rank")
    by_page = best(scored).join(several, "signal_id").select("signal_id", F.col("topic_id").alias("pt"), F.when(F.col("pages") == 1, 1.0).otherwise(F.col("score")).alias("ps"))
    by_words = best(shared).select("signal_id", F.col("topic_id").alias("wt"), F.col("score").alias("ws"))
    rows = signals.select("signal_id").join(by_page, "signal_id", "left").join(by_words, "signal_id", "left")
    close = F.col("ws") >= FUZZY
    return rows.select(
        "signal_id", F.coalesce("pt", F.when(close, F.col("wt"))).alias("topic_id"),
        F.when(F.col("pt").isNotNull(), "page").when(close, "fuzzy").otherwise("unmapped").alias("method"), F.coalesce("ps", "ws", F.lit(0.0)).alias("score"),
    )


def resolve_decisions(decisions: DataFrame, segments: DataFrame, topics: DataFrame) -> DataFrame:
    """(batch_id, segment_key, kind, topic_id, title, how), one row per segment and per decision that is not followed.

    decisions: batch_id, ord, segment_key, assign_to, new_title; segments: batch_id, segment_key, title; topics: topic_id.
    An assignment to a known topic is followed (assigned). One that names a title which the batch creates, in any case and
    spacing, creates that topic, in its first spelling (batch-local). One that names nothing creates the segment's topic
    (unresolvable), as a create without a title does (created). Of several decisions for a segment the first stands, the
    others are duplicate-segment; those for no segment are unknown-segment; a segment without any is no-decision. Blank
    strings count as none.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    known = segments.select("batch_id", "segment_key", F.col("title").alias("segment_title"))
    rows = decisions.select("batch_id", "ord", "segment_key", blank("assign_to").alias("assign_to"), blank("new_title").alias("new_title"))
    rows = rows.join(known, ["batch_id", "segment_key"], "full_outer")
    told, real = F.col("ord").isNotNull(), F.col("segment_title").isNotNull()
    place = F.row_number().over(Window.partitionBy("batch_id", "segment_key").orderBy("ord"))
    rows = rows.withColumn("_n", place)
    created = rows.where(told & real & F.col("assign_to").isNull() & F.col("new_title").isNotNull())
    titles = created.groupBy("batch_id", normal_title(F.col("new_title")).alias("_key")).agg(F.min_by("new_title", "ord").alias("_title"))
    rows = rows.withColumn("_key", normal_title(F.col("assign_to"))).join(titles, ["batch_id", "_key"], "left")
    rows = rows.join(topics.select(F.col("topic_id").alias("assign_to"), F.lit(True).alias("_topic")).distinct(), "assign_to", "left")
    how = (
        F.when(~told, "no-decision").when(~real, "unknown-segment").when(F.col("_n") > 1, "duplicate-segment").when(F.col("assign_to").isNull(), "created")
        .when(F.col("_topic"), "assigned").when(F.col("_title").isNotNull(), "batch-local").otherwise("unresolvable")
    )
    rows = rows.withColumn("how", how)
    made = F.col("how").isin("created", "batch-local", "unresolvable")
    kind = F.when(F.col("how") == "assigned", "assign").when(made, "create")
    title = F.when(F.col("how") == "batch-local", F.col("_title")).when(made, F.coalesce("new_title", "segment_title"))
    return rows.select("batch_id", "segment_key", kind.alias("kind"), F.when(kind == "assign", F.col("assign_to")).alias("topic_id"), title.alias("title"), "how")


def signals_per_topic(mapped: DataFrame) -> DataFrame:
    """(topic_id, signals) of map_signals; unmapped signals count for no topic."""
    return mapped.where("topic_id IS NOT NULL").groupBy("topic_id").agg(F.count("*").alias("signals"))


def reprocess_plan(targets: DataFrame, prior: DataFrame) -> DataFrame:
    """targets (target, topic_id, revision) with `work`: merge, or skip where this document is in the topic already; then also the
    revision that the earlier merge left, and whether its provenance is missing and has to be written.

    prior: topic_id, snapshot_revision, has_provenance. A new topic is merged; so is one whose snapshot is at or past its
    current revision (the earlier merge never landed), and one without snapshot and provenance.
    """
    known = prior.select("topic_id", F.lit(True).alias("_k"), "snapshot_revision", "has_provenance")
    rows = targets.join(known, "topic_id", "left")
    skip = F.col("_k") & F.when(F.col("snapshot_revision").isNull(), F.col("has_provenance")).otherwise(F.col("revision") > F.col("snapshot_revision"))
    skip = F.coalesce(skip, F.lit(False))
    at = F.when(skip, F.coalesce(F.col("snapshot_revision") + 1, "revision"))
    return rows.select(*targets.columns, F.when(skip, "skip").otherwise("merge").alias("work"), at.alias("merged_at_revision"), F.when(skip, ~F.col("has_provenance")).alias("provenance_missing"))


def funnelled(documents: DataFrame) -> DataFrame:
    """Documents (existing topics of the course, segments, targets) of 12 or more segments that all went to one target where there were
    no topics before, with a warning."""
    found = documents.where((F.col("existing") == 0) & (F.col("targets") == 1) & (F.col("segments") >= FUNNEL))
    return found.withColumn("warning", F.format_string(FUNNELLED, F.col("segments").cast("string")))


def attempts_outcome(attempts: DataFrame) -> DataFrame:
    """(call_id, attempts, status, reason): delivered, escalated (delivered by another model than the first), or dead_letter: by refusal,
    no-escalation-target (two attempts of one model, and none above it) or schema. attempts: call_id, attempt, model, outcome
    (success, refusal or any other failure)."""
    last = attempts.groupBy("call_id").agg(F.count("*").alias("attempts"), F.max_by("outcome", "attempt").alias("o"), F.max_by("model", "attempt").alias("m"), F.min_by("model", "attempt").alias("f"))
    status = F.when(F.col("o") != "success", "dead_letter").when(F.col("m") != F.col("f"), "escalated").otherwise("delivered")
    reason = F.when(F.col("o") == "refusal", "refusal").when((F.col("o") != "success") & (F.col("m") == F.col("f")), "no-escalation-target").when(F.col("o") != "success", "schema")
    return last.select("call_id", "attempts", status.alias("status"), reason.alias("reason"))


def freeze_plans(frozen: DataFrame, proposed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(plans to use, plans to append): a plan that is frozen under its key is used again, others are frozen now."""
    fresh = first_wins(proposed, keys, F.col("plan")).join(frozen.select(*keys), keys, "left_anti").select(*frozen.columns)
    used = frozen.join(proposed.select(*keys).distinct(), keys, "left_semi").unionByName(fresh)
    return used, fresh


def triage_objectives(objectives: DataFrame, topics: DataFrame) -> DataFrame:
    """(objective_id, action): covered ones are ignored; missing without coverage or with an unknown topic; gap if partial."""
    known = topics.select("topic_id").distinct().withColumn("_k", F.lit(True))
    rows = objectives.join(known, "topic_id", "left")
    action = F.when(F.col("coverage") == "full", "ignore").when((F.col("coverage") == "none") | F.col("_k").isNull(), "missing").otherwise("gap")
    return rows.select("objective_id", action.alias("action"))


def merge_targets(routed: DataFrame) -> DataFrame:
    """(target, segments): each target's segments in page order."""
    each = F.array_sort(F.collect_list(F.struct("from_page", "segment_key")))
    return routed.groupBy("target").agg(F.transform(each, lambda s: s["segment_key"]).alias("segments"))
