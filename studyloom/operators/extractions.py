"""Extraction lifecycle and bulk edits: fan-out, confirm, reject, topic creation, audits, staleness."""

from __future__ import annotations

from itertools import chain, count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import add_lock
from .windows import newest

COMPONENTS = "array<struct<title: string, weight: string, session: int, snippet: string>>"


def fan_out(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, components) of extractions with a JSON array `components`; components without a snippet are dropped, blank
    weights are null. extractions: extraction_id, course_id, components."""
    each = extractions.select("extraction_id", "course_id", F.posexplode(F.from_json("components", COMPONENTS)).alias("ord", "c"))
    weight = F.nullif(F.trim("c.weight"), F.lit("")).cast("decimal(5,2)")
    rows = each.where(F.trim("c.snippet") != "").select("extraction_id", "course_id", "ord", F.trim("c.title").alias("title"), weight.alias("weight_percent"), F.col("c.session").alias("session_number"), F.lit(False).alias("confirmed"))
    return extractions.select("extraction_id", "course_id", F.lit("pending").alias("state")), rows


def confirm(headers: DataFrame, courses: DataFrame, decided: DataFrame, at: Column, human: bool) -> tuple[DataFrame, DataFrame]:
    """(headers, courses) once decided extractions (extraction_id, sessions) are confirmed; only a human may confirm. A
    course takes the declared number of sessions; a null leaves it."""
    if not human:
        raise PermissionError("only a human confirms an extraction")
    chosen = headers.where("state = 'pending'").join(decided, "extraction_id")
    state = headers.join(chosen.select("extraction_id", F.lit(True).alias("_c")), "extraction_id", "left")
    done = state.select("extraction_id", "course_id", F.when(F.col("_c"), "confirmed").otherwise(F.col("state")).alias("state"), F.when(F.col("_c"), at).alias("confirmed_at"))
    declared = chosen.groupBy("course_id").agg(F.max("sessions").alias("_s"))
    after = courses.join(declared, "course_id", "left")
    return done, after.select(*(F.coalesce("_s", "total_sessions").alias(c) if c == "total_sessions" else F.col(c) for c in courses.columns))


def reject(headers: DataFrame, components: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and components without the rejected extractions; confirmed ones can't be rejected and stay."""
    gone = headers.where("state <> 'confirmed'").join(ids, "extraction_id", "left_semi").select("extraction_id")
    return headers.join(gone, "extraction_id", "left_anti"), components.join(gone, "extraction_id", "left_anti")


def create_topics(existing: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics to add, their revision 0): one after another, in order, each with its slug if that is free in its course, else with the
    first free number from 2 on behind it, so that (course_id, slug) stays unique.

    existing: course_id, slug; proposed: course_id, ord, title, slug. A slug may be taken by one that another got before it, so a
    course is named by one task: its topics are few.
    """

    def named(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(old["slug"]), []
        for base in new.sort_values(["ord", "title"])["slug"]:
            free = next(s for s in chain([base], (f"{base}-{n}" for n in count(2))) if s not in taken)
            taken.add(free)
            out.append(free)
        return new.sort_values(["ord", "title"]).assign(slug=out)[["course_id", "ord", "title", "slug"]]

    fresh = proposed.select("course_id", "ord", "title", "slug")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema)
    made = fresh.groupBy("course_id").cogroup(existing.select("course_id", "slug").groupBy("course_id")).applyInPandas(named, kinds)
    return made, made.select("course_id", "slug", F.lit(0).alias("revision"), "title")


def changed_since(snapshots: DataFrame, topics: DataFrame) -> DataFrame:
    """(review_id, changed, stale): topics of a review's snapshot that are gone or at a later revision.

    snapshots: review_id, topic_id, revision; topics: topic_id, revision.
    """
    now = topics.select("topic_id", F.col("revision").alias("_now"))
    per = snapshots.join(now, "topic_id", "left").groupBy("review_id").agg(F.count_if(F.col("_now").isNull() | (F.col("_now") > F.col("revision"))).alias("changed"))
    return per.withColumn("stale", F.col("changed") > 0)


def prior_contributions(revisions: DataFrame, sources: DataFrame) -> DataFrame:
    """(topic_id, snapshot_revision, has_provenance) of one document: its newest snapshot per topic and whether the topic
    names it as a source. revisions: topic_id, revision; sources: topic_id."""
    top = revisions.groupBy("topic_id").agg(F.max("revision").alias("snapshot_revision"))
    named = sources.select("topic_id").distinct().withColumn("_p", F.lit(True))
    return top.join(named, "topic_id", "full_outer").select("topic_id", "snapshot_revision", F.coalesce("_p", F.lit(False)).alias("has_provenance"))


def newest_flagged(reviews: DataFrame) -> DataFrame:
    """One row: how many topics' newest revision needs review."""
    return newest(reviews, ["topic_id"], F.col("revision")).agg(F.count_if("needs_review").alias("flagged"))


def materials_through(documents: DataFrame) -> DataFrame:
    """(course_id, label): the newest document's session label, or its file name where that is blank.

    documents: course_id, id, created_at, session_label, filename.
    """
    top = newest(documents.select("course_id", "id", "created_at", "session_label", "filename"), ["course_id"], F.col("created_at"), F.col("id"))
    return top.select("course_id", F.coalesce(F.nullif(F.trim("session_label"), F.lit("")), "filename").alias("label"))


def add_matcher(matchers: DataFrame, pattern: str, course_id: str) -> DataFrame:
    """The course's matchers with one for the pattern, unless it has one in any case. matchers: course_id, pattern."""
    new = matchers.sparkSession.createDataFrame([(course_id, pattern.strip())], "course_id string, pattern string")
    there = matchers.select("course_id", F.lower("pattern").alias("_p")).distinct()
    fresh = new.withColumn("_p", F.lower("pattern")).join(there, ["course_id", "_p"], "left_anti").select("course_id", "pattern")
    return matchers.select("course_id", "pattern").unionByName(fresh)


def bulk_file(items: DataFrame, pattern: str, course_id: str) -> DataFrame:
    """Unassigned items whose summary or title holds the pattern get the course and a lock on it."""
    low = F.lower(F.concat_ws(" ", "raw_summary", "title"))
    hit = F.col("course_id").isNull() & F.contains(low, F.lit(pattern.lower()))
    return items.withColumns({"course_id": F.when(hit, F.lit(course_id)).otherwise(F.col("course_id")), "locks": F.when(hit, add_lock(F.col("locks"), "course_id")).otherwise(F.col("locks"))})


#: The field that a decision locks, and the source of one made by hand.
EXAM_FIELD, BY_HAND = "is_exam_candidate", "manual"


def decide_exam(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items that a course's decision changes, as (id, course_id, is_exam, source, locks), those that are no exam any more first.

    items: id, course_id, is_exam, source, locks (array); decisions: course_id, intent, id. `set`: that item is the exam, by
    hand, and locked; the course's others that were flagged, or set by hand, are not, and locked. `reject`: no item is, the
    named one and those flagged are locked. `reset`: locked items lose lock, source and flag. Items that stay as they are are left
    out.
    """
    rows = items.join(decisions.select("course_id", "intent", F.col("id").alias("_c")), "course_id").withColumn("locks", F.coalesce("locks", F.array().cast("array<string>")))
    target = F.coalesce(F.col("id") == F.col("_c"), F.lit(False))
    locked = F.array_contains("locks", EXAM_FIELD)
    chosen = (F.col("intent") == "set") & target
    recorded = target | F.col("is_exam") | F.coalesce(F.col("source") == BY_HAND, F.lit(False))
    acts = F.when(F.col("intent") == "reset", locked).when(F.col("intent").isin("set", "reject"), recorded).otherwise(False)
    locks = F.when(F.col("intent") == "reset", F.array_remove("locks", EXAM_FIELD)).otherwise(add_lock(F.col("locks"), EXAM_FIELD))
    source = F.when(chosen, BY_HAND)
    same = (F.col("is_exam") == chosen) & F.col("source").eqNullSafe(source) & (F.size("locks") == F.size(locks)) & (F.size(F.array_except(locks, "locks")) == 0)
    return rows.where(acts & ~same).select("id", "course_id", chosen.alias("is_exam"), source.alias("source"), locks.alias("locks")).orderBy("is_exam", "id")


def audit_actions(verdicts: DataFrame, topics: DataFrame) -> DataFrame:
    """(verdict_id, action): covered ones skip, missing ones make a topic, refinements a note, conflicts a question; the last two
    need a topic that exists, else they are ignored."""
    known = topics.select("topic_id").distinct().withColumn("_k", F.lit(True))
    rows = verdicts.join(known, "topic_id", "left")
    action = F.when(F.col("verdict") == "covered", "skip").when(F.col("verdict") == "missing", "create-topic").when(F.col("_k").isNull(), "ignore").when(F.col("verdict") == "refine", "append-note").when(F.col("verdict") == "conflict", "open-question").otherwise("ignore")
    return rows.select("verdict_id", action.alias("action"))
