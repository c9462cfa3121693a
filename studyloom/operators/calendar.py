"""Calendar operators: week view, exam detection, snapshot diff, tombstones. `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_until, local_day, to_instant, week_start
from ..functions.math import item_weight, priority, tier, weight_source
from ..functions.text import EDGE
from .relational import within_any


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {n} HOURS")


def horizon(at: Column, now: Column, back_days: int = 30, ahead_days: int = 180) -> Column:
    """Within the rolling window around now."""
    return at.between(now - hours(24 * back_days), now + hours(24 * ahead_days))


def stale_feed(active: Column, synced_at: Column, now: Column, minutes: int = 30) -> Column:
    return active & (synced_at.isNull() | (F.unix_micros(now) - F.unix_micros(synced_at) >= minutes * 60_000_000))


def remaining_ms(window_ms: Column, elapsed_ms: Column) -> Column:
    """What is left of a rate limit's window; 0 where it can't be told."""
    left = window_ms - elapsed_ms
    return F.when(left.isNull() | F.isnan(left.cast("double")), 0).otherwise(F.greatest(left, F.lit(0)))


def visible(hidden: Column, missing_since: Column, status: Column, updated_at: Column, now: Column) -> Column:
    """Not hidden, gone from the feed for under 24 hours, cancelled for under 7 days."""
    gone = missing_since.isNotNull() & (missing_since + hours(24) <= now)
    old = (status == "cancelled") & (updated_at + hours(168) <= now)
    return ~hidden & ~gone & ~old


def week_view(rows: DataFrame, now: Column, zone: str) -> DataFrame:
    """Occurrences with weight, score, tier and the section they stand in: overdue, deadlines, class_days, horizon.

    rows: id, starts_at, status, updated_at, kind, hidden, missing_since, weight_override, assessment_weight,
    is_exam, completed_at. A class that is an exam counts as a deadline; tiers go by weight. The horizon is the 14 days after
    the local week, and holds what is no class, not completed and of tier medium at least; where it is empty, the first such
    row after it is `next_beyond_horizon`. Rows outside all sections are dropped.
    """
    shown = rows.where(visible(F.col("hidden"), F.col("missing_since"), F.col("status"), F.col("updated_at"), now))
    kind = F.when(F.col("is_exam"), "deadline").otherwise(F.col("kind"))
    shown = shown.withColumn("kind", kind)
    start = to_instant(week_start(now, zone), zone)
    end = to_instant(F.date_add(F.to_date(week_start(now, zone)), 7).cast("timestamp"), zone)
    far = to_instant(F.date_add(F.to_date(week_start(now, zone)), 21).cast("timestamp"), zone)
    days = days_until(F.col("starts_at"), now)
    weight = item_weight(F.col("weight_override"), F.col("assessment_weight"), F.col("kind"))
    late = (F.col("kind") == "deadline") & (F.col("starts_at") < now) & F.col("completed_at").isNull()
    scored = shown.select(
        "*", weight.alias("weight"), weight_source(F.col("weight_override"), F.col("assessment_weight")).alias("weight_source"),
        priority(weight, days).alias("score"), late.alias("overdue"),
    ).withColumn("tier", tier(F.col("overdue"), F.col("kind"), F.col("weight")))
    notable = (F.col("kind") != "class") & F.col("tier").isin("high", "medium") & F.col("completed_at").isNull()
    here = F.col("starts_at").between(start, end - F.expr("INTERVAL 1 MICROSECOND"))
    ahead = (F.col("starts_at") >= end) & (F.col("starts_at") < far)
    section = (
        F.when(F.col("overdue"), "overdue").when((F.col("kind") == "class") & here, "class_days").when((F.col("kind") != "class") & here & (F.col("starts_at") >= now), "deadlines")
        .when(ahead & notable, "horizon")
    )
    sections = scored.withColumn("section", section)
    held = sections.where("section IS NOT NULL")
    # At most one row beyond the horizon, so the join and the sort are of one row.
    beyond = sections.where(notable & (F.col("starts_at") >= far)).orderBy("starts_at", "id").limit(1)
    beyond = beyond.join(held.where("section = 'horizon'").select(F.lit(1).alias("_h")).limit(1), F.lit(True), "left_anti")
    held = held.unionByName(beyond.withColumn("section", F.lit("next_beyond_horizon")))
    return held.withColumn("local_day", local_day("starts_at", zone))


def rank_items(items: DataFrame, now: Column) -> DataFrame:
    """(id, weight, weight_source, days, score, overdue, tier) in order: overdue first, then score, then id as people sort it.

    items: id, kind, due, weight_override, assessment_weight, completed_at. Completed items are left out.
    """
    days = days_until(F.col("due"), now)
    weight = item_weight(F.col("weight_override"), F.col("assessment_weight"), F.col("kind"))
    open_ = items.where("completed_at IS NULL").select("id", "kind", weight.alias("weight"), weight_source(F.col("weight_override"), F.col("assessment_weight")).alias("weight_source"), days.alias("days"))
    scored = open_.select("*", priority(F.col("weight"), F.col("days")).alias("score"), (F.col("days") < 0).alias("overdue"))
    ranked = scored.withColumn("tier", tier(F.col("overdue"), F.col("kind"), F.col("weight"))).drop("kind")
    return ranked.orderBy(F.desc("overdue"), F.desc("score"), F.collate(F.col("id").cast("string"), "UNICODE"))


RETAKE = r"(?i)\b(?:retake|resit|convocatoria)\b"


def detect_exams(events: DataFrame, courses: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row per course: outcome (found, pending, unknown), source, session, uid, starts_at.

    events: course_id, uid, starts_at, session_from, session_to; courses: course_id, total_sessions; assessments:
    course_id, id, title, kind, session_number, confirmed. The session that holds the exam is the declared total, else
    that of a confirmed exam (explicit finals first, the largest session), else the feed's largest session. The earliest
    event that covers it is the exam; without one the exam is pending. An event without a first session has none, one without
    a last session has one.
    """
    exam = assessments.where(F.col("confirmed") & F.col("session_number").isNotNull() & F.col("kind").rlike(r"(?i)\bexam\b"))
    ranked = exam.groupBy("course_id").agg(F.max(F.struct(F.col("title").rlike(r"(?i)\bfinals?\b").alias("final"), "session_number")).alias("_a"))
    feed = events.groupBy("course_id").agg(F.max(F.when(F.col("session_from").isNotNull(), F.greatest("session_from", "session_to"))).alias("_m"))
    known = courses.join(ranked, "course_id", "left").join(feed, "course_id", "left")
    declared = F.when(F.col("total_sessions") > 0, F.col("total_sessions"))
    assessed = F.col("_a.session_number")
    source = F.when(declared.isNotNull(), "syllabus_total_sessions").when(assessed.isNotNull(), "assessment_session_number").when(F.col("_m").isNotNull(), "feed_max_session")
    known = known.select("course_id", source.alias("source"), F.coalesce(declared, assessed, "_m").cast("int").alias("session"))
    each = events.where(F.col("session_from").isNotNull()).select("course_id", F.explode(F.sequence("session_from", F.greatest("session_from", "session_to"))).alias("session"), F.struct("starts_at", "uid").alias("_e"))
    first = each.groupBy("course_id", "session").agg(F.min("_e").alias("_e"))
    found = known.join(first, ["course_id", "session"], "left")
    outcome = F.when(F.col("source").isNull(), "unknown").when(F.col("_e").isNull(), "pending").otherwise("found")
    return found.select("course_id", outcome.alias("outcome"), "source", "session", F.col("_e.uid").alias("uid"), F.col("_e.starts_at").alias("starts_at"))


def retakes(events: DataFrame, exams: DataFrame) -> DataFrame:
    """(course_id, uid, starts_at): events without a session number that name a re-sit, after the course's exam if it has one.

    events: course_id, uid, starts_at, session_from, raw_summary; exams: detect_exams.
    """
    rows = events.where(F.col("session_from").isNull() & F.col("raw_summary").rlike(RETAKE))
    after = exams.select("course_id", F.when(F.col("outcome") == "found", F.col("starts_at")).alias("_exam"))
    return rows.join(after, "course_id").where(F.col("_exam").isNull() | (F.col("starts_at") > F.col("_exam"))).select("course_id", "uid", "starts_at")


def semester_flags(exams: DataFrame, semesters: DataFrame, whole_last_day: bool = True) -> DataFrame:
    """exams with unbounded (no semester holds the date) and outside_semester (there are semesters, none of which does).

    semesters: starts_on, ends_on dates. The view counts the whole last day in UTC, to its last millisecond; the sync takes
    its first instant. Flags never drop an exam.
    """
    last = F.col("ends_on").cast("timestamp")
    bounds = semesters.select(F.col("starts_on").cast("timestamp").alias("_from"), (last + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND") if whole_last_day else last).alias("_to"))
    inside = within_any(exams, bounds, "starts_at", "_from", "_to", "_in")
    some = F.lit(bool(semesters.limit(1).count()))
    dated = F.col("starts_at").isNotNull()
    return inside.select(*exams.columns, (dated & ~F.col("_in")).alias("unbounded"), (dated & ~F.col("_in") & some).alias("outside_semester"))


def session_options(items: DataFrame) -> DataFrame:
    """(course_id, item_id, session, starts_at): the sessions a user could name instead; a range goes by its last session, an
    item by its earliest occurrence."""
    numbered = items.select("course_id", F.col("id").alias("item_id"), F.coalesce("session_to", "session_from").alias("session"), "starts_at").where("session IS NOT NULL")
    first = numbered.groupBy("course_id", "item_id").agg(F.min(F.struct("starts_at", "session")).alias("_f"))
    return first.select("course_id", "item_id", F.col("_f.session").alias("session"), F.col("_f.starts_at").alias("starts_at"))


def exam_statuses(courses: DataFrame, items: DataFrame, assessments: DataFrame, semesters: DataFrame) -> DataFrame:
    """What may be claimed of each course's exam, courses without events left out: outcome, source, confidence (syllabus, manual,
    feed_derived), decision (chosen, rejected, detected), confirmed, item_id, session, starts_at, declared and feed_max where
    they conflict, outside_semester.

    courses: course_id, title, total_sessions, total_sessions_source; items (pseudo rows left out): id, uid, course_id,
    starts_at, session_from, session_to, is_exam_candidate, detection_source, locked (array of field names). What the user chose by
    hand, or locked as no exam, stands before the detector's answer; of several chosen items the smallest id counts.
    """
    present = courses.join(items.select("course_id").distinct(), "course_id", "left_semi")
    exams = semester_flags(detect_exams(items, present.select("course_id", "total_sessions"), assessments), semesters)
    locked = F.array_contains(F.coalesce("locked", F.array().cast("array<string>")), "is_exam_candidate")
    said = items.groupBy("course_id").agg(
        F.min(F.when(F.col("is_exam_candidate") & (F.col("detection_source") == "manual"), F.struct("id", F.col("starts_at").alias("_at")))).alias("_chosen"),
        F.bool_or(~F.col("is_exam_candidate") & locked).alias("_rejected"),
    )
    by_uid = items.groupBy("course_id", "uid").agg(F.min("id").alias("_found"))
    feed = items.groupBy("course_id").agg(F.max(F.greatest("session_from", "session_to")).alias("_feed"))
    named = session_options(items).select(F.col("course_id").alias("_course"), F.col("item_id").alias("_item"), F.col("session").alias("_session"), F.col("starts_at").alias("_start"))
    rows = present.join(exams, "course_id").join(said, "course_id", "left").join(by_uid, ["course_id", "uid"], "left").join(feed, "course_id", "left")
    rows = rows.join(named, (F.col("course_id") == F.col("_course")) & (F.col("_chosen.id") == F.col("_item")), "left")
    chosen, found = F.col("_chosen").isNotNull(), (F.col("outcome") == "found") & F.col("_found").isNotNull()
    rejected = ~chosen & F.coalesce("_rejected", F.lit(False))
    confidence = (
        F.when(F.col("source") == "assessment_session_number", "syllabus")
        .when((F.col("source") == "syllabus_total_sessions") & F.col("total_sessions_source").isin("syllabus", "manual"), F.col("total_sessions_source"))
        .otherwise("feed_derived")
    )
    pick = lambda mine, theirs: F.when(chosen, mine).when(~rejected & found, theirs)
    conflict = F.col("total_sessions") != F.col("_feed")
    return rows.select(
        "course_id", "title", "outcome", "source", confidence.alias("confidence"), F.when(chosen, "chosen").when(rejected, "rejected").otherwise("detected").alias("decision"), chosen.alias("confirmed"),
        F.coalesce(pick(F.col("_chosen.id"), F.col("_found")), F.when(F.col("outcome") == "found", F.col("_found"))).alias("item_id"),
        pick(F.coalesce("_session", F.lit(0)), F.col("session")).alias("session"), pick(F.coalesce("_start", F.col("_chosen._at")), F.col("starts_at")).alias("starts_at"),
        F.when(conflict, F.col("total_sessions")).alias("declared"), F.when(conflict, F.col("_feed")).alias("feed_max"), F.col("outside_semester"),
    )


def snapshot_diff(stored: DataFrame, snapshot: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys with an action (added, changed, unchanged, missing) and the fields that changed; nulls compare as values."""
    old = stored.select(*keys, F.struct(*fields).alias("_old"))
    new = snapshot.select(*keys, F.struct(*fields).alias("_new"))
    both = old.join(new, keys, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col("_old")[f].eqNullSafe(F.col("_new")[f]), F.lit(f)) for f in fields)))
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "missing").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return both.select(*keys, action.alias("action"), F.when(action == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def plan_tombstones(items: DataFrame, present: DataFrame, now: Column, delete_after_hours: int = 168) -> DataFrame:
    """(id, action, write) for stored feed items: clear, retain_rolloff, retain_graded, mark, delete, keep; write is what happens
    to the mark (missing_since): `clear`, `set`, or null where it stays.

    items: id, feed_id, ics_uid, missing_since, latest_start, graded; present: ics_uid. Items without a feed are exempt;
    those present need an action only to clear a mark. An item whose last occurrence is past, or that has none, has rolled
    off the feed's window and is retained; its mark is cleared unless it was set before that occurrence, as only a
    cancellation is. One with graded history is retained, its mark set once.
    """
    seen = present.select("ics_uid").distinct().withColumn("_p", F.lit(True))
    rows = items.where(F.col("feed_id").isNotNull()).join(seen, "ics_uid", "left")
    rolled = F.col("latest_start").isNull() | (F.col("latest_start") < now)
    cancelled = F.coalesce(F.col("missing_since") < F.col("latest_start"), F.lit(False))
    action = (
        F.when(F.col("_p"), F.when(F.col("missing_since").isNotNull(), "clear"))
        .when(rolled, "retain_rolloff").when(F.col("graded"), "retain_graded").when(F.col("missing_since").isNull(), "mark")
        .when(F.col("missing_since") + hours(delete_after_hours) <= now, "delete").otherwise("keep")
    )
    marked = F.col("missing_since").isNotNull()
    write = (
        F.when(action == "clear", "clear").when((action == "retain_rolloff") & marked & ~cancelled, "clear")
        .when(action.isin("mark", "retain_graded") & ~marked, "set")
    )
    return rows.select("id", action.alias("action"), write.alias("write")).where("action IS NOT NULL")


def match_course(items: DataFrame, courses: DataFrame, matchers: DataFrame, block: int = 2_000) -> DataFrame:
    """(id, course_id, step): pinned course, matcher's substring, code as a whole word, equal title, title inside either way;
    the first step, then the first course in order. A text that is blank matches by its pin alone; blank codes, titles and patterns
    match nothing; all are trimmed and compared in any case. Pins and matchers of unknown courses count for nothing.

    items: id, pinned, text; courses: course_id, ord, code, title; matchers: course_id, ord, pattern. Substrings have no key to join
    by, so each item meets each course: those of one user, a few dozen rows, are broadcast at once, more in blocks.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), rf"\A[{EDGE}]+|[{EDGE}]+\z", ""))
    known = courses.select("course_id", "ord", plain(F.col("code")).alias("code"), plain(F.col("title")).alias("title"), F.lit(None).cast("string").alias("pattern"))
    rules = matchers.join(courses.select("course_id").distinct(), "course_id", "left_semi").select("course_id", "ord", F.lit("").alias("code"), F.lit("").alias("title"), plain(F.col("pattern")).alias("pattern")).where("pattern <> ''")
    said = known.unionByName(rules)
    text, told = items.select("id", "pinned", plain(F.col("text")).alias("text")), F.col("text") != ""
    word = F.regexp_like(F.col("text"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("code"), F.lit(r"\E(?![a-z0-9])")))
    title = told & (F.col("title") != "")
    step = (
        F.when(F.col("pattern").isNotNull(), F.when(told & F.contains("text", "pattern"), 2)).when(F.col("course_id") == F.col("pinned"), 1).when(told & (F.col("code") != "") & word, 3)
        .when(title & (F.col("text") == F.col("title")), 4).when(title & (F.contains("text", "title") | F.contains("title", "text")), 5)
    )
    blocks = max(1, -(-said.count() // block))
    part = F.pmod(F.xxhash64("course_id", "ord", "code", "title", "pattern"), F.lit(blocks))
    found = None
    for k in range(blocks):
        met = text.join(F.broadcast(said.where(part == k)), step.isNotNull()).groupBy("id").agg(F.min(F.struct(step.alias("step"), "ord", "course_id")).alias("_b"))
        found = met if found is None else found.unionByName(met)
    best = found if blocks == 1 else found.groupBy("id").agg(F.min("_b").alias("_b"))
    return best.select("id", F.col("_b.course_id").alias("course_id"), F.col("_b.step").alias("step"))
