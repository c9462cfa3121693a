"""Study plans for exams: minutes available by day, and a deterministic schedule of each user's sessions.

Capacity is a table of a row for each user and day, resolved by joins. The schedule is a fold over a user's days, in order, as each
day's choice depends on what the days before it left: it runs on one task a user, whose exams and days are few; a task takes
its users one after another from rows sorted by user. Deadlines, final reviews and buffers are laid backwards from each exam first;
days are then filled forwards.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a day that is filled, minutes of a session and of the least one, courses of new material a day, days from a
#: first pass to its reviews, minutes of a review, stickiness, share of capacity for first passes within a short runway, and that runway.
FILL, SESSION, LEAST, COURSES, LADDER, REVIEW, STICK, CRAM_SHARE, CRAM = 0.9, 50, 25, 2, (1, 3, 7, 16), 15, 1.1, 0.6, 3
#: Minutes from Monday to Sunday, padding around an event, and the share of an exam's own day that is left.
WEEK, PADDING, EXAM_DAY = (120, 120, 120, 120, 120, 180, 0), 15, 0.5
PLAN = "user_id long, day date, ord int, kind string, exam_id long, topic_id long, minutes int, reason string"


def capacity(days: DataFrame, settings: DataFrame, busy: DataFrame, blackouts: DataFrame, overrides: DataFrame, exams: DataFrame, debt: DataFrame) -> DataFrame:
    """(user_id, day) rows -> user_id, day, minutes, blackout, exam_day.

    settings (user_id, week array<int> from Monday, most int) give a day's minutes, WEEK without a row; busy (user_id, day,
    minutes) takes its minutes and PADDING an event off; overrides (user_id, day, minutes) replaces what is left; blackouts
    (user_id, day) leave nothing; an exam (user_id, day) half; debt (user_id, day, minutes) of reviews comes off last. Never
    below 0; days that a table repeats count once, events each.
    """
    at = ["user_id", "day"]
    taken = busy.groupBy(*at).agg(F.sum(F.col("minutes") + PADDING).alias("_busy"))
    owed, set_by_hand = (t.groupBy(*at).agg(F.max("minutes").alias(name)) for t, name in ((debt, "_debt"), (overrides, "_set")))
    rows = days.join(settings, "user_id", "left").join(taken, at, "left").join(set_by_hand, at, "left").join(owed, at, "left")
    rows = rows.join(blackouts.select(*at).distinct().withColumn("blackout", F.lit(True)), at, "left").join(exams.select(*at).distinct().withColumn("exam_day", F.lit(True)), at, "left")
    week = F.coalesce(F.col("week"), F.array(*map(F.lit, WEEK)))
    base = F.element_at(week, F.weekday("day") + 1)
    left = F.greatest(F.least(base, F.coalesce("most", base)) - F.coalesce("_busy", F.lit(0)), F.lit(0))
    chosen = F.coalesce("_set", left) * F.when(F.col("exam_day"), EXAM_DAY).otherwise(1.0)
    minutes = F.when(F.col("blackout"), 0).otherwise(F.greatest(F.floor(chosen) - F.coalesce("_debt", F.lit(0)), F.lit(0)))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("user_id", "day", minutes.cast("int").alias("minutes"), flag("blackout"), flag("exam_day"))


@dataclass(slots=True)
class Topic:
    """Days are numbers of days since 1970, here and below."""

    exam: Exam
    id: int
    sequence: int
    left: float
    risk: float
    before: frozenset  # days on which it was in the plan before
    pinned: int | None
    pinned_minutes: int
    at_risk: str = ""
    done: int | None = None

    def value(self) -> float:
        return self.exam.weight * (1 + self.risk)

    def place(self) -> tuple:
        return bool(self.at_risk), self.sequence, self.exam.day, self.id


@dataclass
class Exam:
    """deadline: the last day of first passes; the last quarter of the runway, two days at least, is for reviews alone."""

    id: int
    course: int
    day: int
    weight: float
    today: int
    topics: list[Topic] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.runway = self.day - self.today
        self.cram = self.runway < CRAM
        self.deadline = self.day - (1 if self.cram else max(2, math.ceil(0.25 * self.runway)))
        n = 0 if self.runway < 5 else min(3, max(1, self.runway // 7))
        self.buffers = [self.day - 2 - k for k in range(n, 0, -1)]


class Planner:
    """One user's plan: rows in `out`."""

    def __init__(self, exams: list[Exam], minutes: dict[int, int], exam_days: set[int]):
        self.exams = sorted(exams, key=lambda e: (e.day, -e.weight, e.id))
        self.minutes, self.exam_days = minutes, exam_days
        self.room = {d: math.floor(FILL * m) for d, m in minutes.items()}
        self.reviews: list[tuple[int, int, int, Topic]] = []  # last day, due, step
        self.out: list[tuple] = []
        self.order = defaultdict(int)
        self.buffers = {d: e for e in self.exams for d in e.buffers if d in self.room}

    def put(self, day: int, kind: str, exam: Exam, topic: Topic | None, minutes: int) -> None:
        self.room[day] -= minutes
        self.order[day] += 1
        self.out.append((day, self.order[day], kind, exam.id, topic and topic.id, minutes, None))

    def triage(self) -> None:
        """What doesn't fit before an exam, with all that comes before it, is at risk: the least weight times risk first. It is still
        tried, after all else."""
        demand = 0.0
        for exam in self.exams:
            days = [d for d in self.room if d < exam.day and d not in self.buffers]
            supply = sum(self.room[d] for d in days)
            mine = sorted(exam.topics, key=lambda t: (t.value(), -t.sequence, t.id))
            need = {t.id: t.left + REVIEW * (len(LADDER) + 1) for t in mine}
            demand += sum(need.values())
            for t in mine:
                if demand <= supply:
                    break
                t.at_risk = "capacity"
                self.out.append((None, 0, "triaged", exam.id, t.id, math.ceil(t.left), t.at_risk))
                demand -= need[t.id]

    def finish(self, topic: Topic, day: int) -> None:
        """A first pass is done: its reviews, and one in the exam's last two days, are due."""
        topic.done, exam = day, topic.exam
        window = exam.day - 2
        for step, offset in enumerate(LADDER):
            due = day + offset
            if due < window:
                self.reviews.append((window - 1, due, step, topic))
        self.reviews.append((exam.day - 1, max(window, day + 1) if day < exam.day - 1 else day, len(LADDER), topic))

    def place_reviews(self, day: int) -> None:
        """Those that end soonest first; one that doesn't fit moves on by a day, up to its last."""
        if not self.reviews:
            return
        waiting = []
        for last, due, step, topic in sorted(self.reviews, key=lambda r: (r[0], r[1], r[3].id, r[2])):
            if due <= day and self.room[day] >= REVIEW and day <= last:
                self.put(day, "review", topic.exam, topic, REVIEW)
            elif day < last:
                waiting.append((last, due, step, topic))
            else:
                self.out.append((None, 0, "unplaced_review", topic.exam.id, topic.id, REVIEW, "no capacity"))
        self.reviews = waiting

    def chosen(self, day: int, courses: set[int], crammed: dict[int, int]) -> Topic | None:
        """The first-pass topic of highest priority, out of each course's next one in its sequence; one at risk holds no other up."""
        best = None
        heads = []
        for waiting in self.queues:
            # What is done, or past its deadline, stays so: it leaves the head of its course's queue for good.
            while waiting and (waiting[-1].done is not None or waiting[-1].left <= 0 or day > waiting[-1].exam.deadline):
                waiting.pop()
            heads += next(([t] for t in reversed(waiting) if t.done is None and t.left > 0 and day <= t.exam.deadline and not (t.pinned and t.pinned >= day)), [])
        for t in heads:
            exam = t.exam
            if (len(courses) >= COURSES and exam.course not in courses) or (exam.cram and crammed[exam.id] <= 0):
                continue
            urgency = 1 / max(1, exam.deadline - day)
            rank = (bool(t.at_risk), -t.value() * urgency * (STICK if day in t.before else 1.0), exam.day, -exam.weight, t.sequence, t.id)
            if best is None or rank < best[0]:
                best = rank, t
        return best and best[1]

    def study(self, day: int, courses: set[int], crammed: dict[int, int]) -> None:
        while topic := self.chosen(day, courses, crammed):
            room = min(self.room[day], crammed[topic.exam.id]) if topic.exam.cram else self.room[day]
            minutes = min(SESSION, room, math.ceil(topic.left))
            if minutes < min(LEAST, math.ceil(topic.left)):
                return
            self.put(day, "first_pass", topic.exam, topic, minutes)
            topic.left -= minutes
            courses.add(topic.exam.course)
            if topic.exam.cram:
                crammed[topic.exam.id] -= minutes
            if topic.left <= 0:
                self.finish(topic, day)

    def run(self) -> list[tuple]:
        self.triage()
        by_course = defaultdict(list)
        for exam in self.exams:
            by_course[exam.course] += exam.topics
        self.queues = [sorted(topics, key=Topic.place)[::-1] for topics in by_course.values()]
        pins = defaultdict(list)
        for exam in self.exams:
            for t in exam.topics:
                pins[t.pinned].append((exam, t))
                if t.left <= 0:
                    self.finish(t, exam.today - 1)
        for day in sorted(self.room):
            courses, crammed = set(), {e.id: math.floor(CRAM_SHARE * self.minutes[day]) for e in self.exams}
            for exam, t in pins.get(day, ()):
                if self.minutes[day] <= 0 or self.room[day] < t.pinned_minutes or day >= exam.day:
                    self.out.append((day, 0, "unplaced_pin", exam.id, t.id, t.pinned_minutes, "no capacity"))
                    continue
                self.put(day, "pinned", exam, t, t.pinned_minutes)
                t.left -= t.pinned_minutes
                courses.add(exam.course)
                if t.left <= 0 and t.done is None:
                    self.finish(t, day)
            self.place_reviews(day)
            if day in self.buffers:
                if self.room[day] > 0:
                    self.put(day, "buffer", self.buffers[day], None, self.room[day])
                continue
            if day not in self.exam_days:
                self.study(day, courses, crammed)
            for exam in self.exams:
                if day < exam.day and exam.topics and all(t.done for t in exam.topics) and self.room[day] >= SESSION:
                    self.put(day, "practice", exam, None, SESSION)
        for last, _, _, topic in self.reviews:
            self.out.append((None, 0, "unplaced_review", topic.exam.id, topic.id, REVIEW, "no capacity"))
        for exam in self.exams:
            for t in exam.topics:
                if t.done is None:
                    self.out.append((None, 0, "at_risk", exam.id, t.id, math.ceil(t.left), t.at_risk or "deadline"))
        return self.out


def plan_user(topics: list[tuple], minutes: dict[int, int]) -> list[tuple]:
    """One user's rows, without the user: topics as STACKED has them from exam_id on, after the day of their exam, in order."""
    if not minutes or not topics:
        return []
    today, exams = min(minutes), {}
    for day, exam_id, course_id, weight, topic_id, sequence, left, risk, pinned, pinned_minutes, before in topics:
        exam = exams.get(exam_id)
        if exam is None:
            exam = exams[exam_id] = Exam(exam_id, course_id, day, weight, today)
        if exam.day > today:
            exam.topics.append(Topic(exam, topic_id, sequence, left, risk, frozenset(before or ()), pinned, pinned_minutes if pinned else 0))
    total = sum(e.weight for e in exams.values()) or 1.0
    for e in exams.values():
        e.weight /= total
    return Planner([e for e in exams.values() if e.topics], minutes, {e.day for e in exams.values()}).run()


#: Users' days and topics as they are stacked for the planner, a user's days first.
STACKED = ("user_id", "side", "day", "minutes", "exam_id", "course_id", "weight", "topic_id", "sequence", "left", "risk", "pinned", "pinned_minutes", "before")
DAY, ROWS = 0, 10_000


def plan_stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of users whose rows follow one another, ROWS rows at a time and those of the last user among them."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    names = [c.split()[0] for c in PLAN.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
        columns[1] = columns[1].cast(pa.date32())
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    out: list[tuple] = []
    for user, own in groupby(rows, key=itemgetter(0)):
        minutes, topics = {}, []
        for _, side, day, available, *topic in own:
            if side == DAY:
                minutes[day] = available
            else:
                topics.append((day, *topic))
        out += [(user, *r) for r in plan_user(topics, minutes)]
        if len(out) >= ROWS:
            yield made(out)
            out = []
    if out:
        yield made(out)


def plan(topics: DataFrame, days: DataFrame, velocity: Column | None = None) -> DataFrame:
    """topics (user_id, exam_id, course_id, exam_date, weight, topic_id, sequence, est_minutes, difficulty, confidence, pinned_on date,
    pinned_minutes, planned_before array<date>) and days (user_id, day, minutes) from today on -> PLAN.

    kind is first_pass, pinned, review, practice or buffer, in order (ord) within a day that is never filled beyond its share;
    triaged names topics that the days before an exam have no room for, of the least weight times risk, tried after all others;
    at_risk (with what is left of the topic, and why), unplaced_review and unplaced_pin say what found no place: nothing is
    dropped in silence. Estimates are multiplied by velocity, within 0.5 and 2. A user without days or topics has no rows; exams
    of today or before are left out; equal input in any order gives the same plan.
    """
    speed = F.lit(1.0) if velocity is None else F.greatest(F.lit(0.5), F.least(F.lit(2.0), velocity))
    real = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    work = topics.select(
        "user_id", F.lit(DAY + 1).alias("side"), F.unix_date("exam_date").alias("day"), F.lit(None).cast("int").alias("minutes"), "exam_id", F.col("course_id").cast("long").alias("course_id"), real(F.col("weight")).alias("weight"),
        "topic_id", F.col("sequence").cast("int").alias("sequence"), real(F.coalesce("est_minutes", F.lit(0)) * speed).alias("left"), (real(F.col("difficulty")) * (1 - real(F.col("confidence")))).alias("risk"),
        F.unix_date("pinned_on").alias("pinned"), F.col("pinned_minutes").cast("int").alias("pinned_minutes"), F.transform("planned_before", lambda d: F.unix_date(d)).alias("before"),
    )
    free = days.select("user_id", F.lit(DAY).alias("side"), F.unix_date("day").alias("day"), F.col("minutes").cast("int").alias("minutes"))
    # A number of partitions is given, as a plan costs far more than its rows' bytes tell.
    parts = int(topics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = free.unionByName(work, allowMissingColumns=True).select(*STACKED).repartition(parts, "user_id").sortWithinPartitions("user_id", "side", "exam_id", "topic_id", "sequence", "left", "risk", "pinned")
    return rows.mapInArrow(plan_stacked, PLAN)
