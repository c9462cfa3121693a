"""Attendance and participation standings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import trailing_streak

#: The share of sessions that may be missed where a course says nothing, and how many left are a warning.
ABSENCE_PCT, WARNING_LEFT = 20.0, 1


def attendance_gate(attendance: DataFrame, courses: DataFrame) -> DataFrame:
    """Per course: present, absent and excused (whatever is neither), allowed absences, what is left of them, and the gate they give.

    attendance: course_id, status; courses: course_id, total_sessions, absence_fail_pct. Absences that are excused count for
    nothing. Without a total of 1 or more, or with a share outside 0 to 100, there is no gate: null.
    """
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = attendance.groupBy("course_id").agg(is_("present"), is_("absent"), F.count_if(~F.coalesce(F.col("status").isin("present", "absent"), F.lit(False))).alias("excused"))
    pct = F.coalesce(F.col("absence_fail_pct").cast("double"), F.lit(ABSENCE_PCT))
    sound = (F.col("total_sessions") > 0) & (F.col("total_sessions") == F.floor("total_sessions")) & ~F.isnan(pct) & pct.between(0, 100)
    allowed = F.when(sound, F.floor(F.col("total_sessions") * pct / 100))
    joined = courses.join(counts, "course_id", "left").fillna(0, ["present", "absent", "excused"])
    joined = joined.withColumn("allowed", allowed.cast("long")).withColumn("left", F.col("allowed") - F.col("absent"))
    gate = F.when(F.col("left") < 0, "failed").when(F.col("left") == 0, "at_limit").when(F.col("left") == WARNING_LEFT, "warning").when(F.col("left").isNotNull(), "ok")
    return joined.withColumn("gate", gate)


def participation(courses: DataFrame, sessions: DataFrame, logs: DataFrame) -> DataFrame:
    """Per course over its attended sessions: sessions, contributions, mean (0 without sessions), target, delta, on_pace, and the
    trailing streak.

    courses: course_id, target; sessions: course_id, occurrence_id, starts_at; logs: occurrence_id. A session without logs counts
    0. A target that isn't above 0 is none; without one, or without sessions, delta and on_pace are null. Every course has a row.
    """
    counts = logs.groupBy("occurrence_id").agg(F.count("*").alias("n"))
    each = sessions.join(counts, "occurrence_id", "left").fillna(0, ["n"])
    pace = each.groupBy("course_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("contributions"))
    streaks = trailing_streak(each, ["course_id"], [F.col("starts_at"), F.col("occurrence_id")], F.col("n") > 0)
    rows = courses.join(pace, "course_id", "left").join(streaks, "course_id", "left").fillna(0, ["sessions", "contributions", "streak"])
    target = F.when((F.col("target") > 0) & (F.col("target") < float("inf")) & ~F.isnan(F.col("target").cast("double")), F.col("target"))
    rows = rows.withColumn("target", target).withColumn("mean", F.coalesce(F.try_divide(F.col("contributions").cast("double"), F.col("sessions")), F.lit(0.0)))
    delta = F.when(F.col("sessions") > 0, F.col("mean") - F.col("target"))
    return rows.withColumn("delta", delta).withColumn("on_pace", F.col("delta") >= 0)


def course_standings(courses: DataFrame, attendance: DataFrame, logs: DataFrame) -> DataFrame:
    """Per course its gate and its pace: of attendance (course_id, occurrence_id, starts_at, status) the present ones are sessions.
    courses: course_id, total_sessions, absence_fail_pct, target; logs: occurrence_id."""
    gate = attendance_gate(attendance, courses.select("course_id", "total_sessions", "absence_fail_pct"))
    return gate.join(participation(courses.select("course_id", "target"), attendance.where("status = 'present'"), logs), "course_id")
