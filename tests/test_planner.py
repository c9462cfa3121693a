"""Plans hold what they promise, whatever the exams."""

import collections
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from studyloom.operators import planner as P

TODAY = date(2026, 3, 2)
TOPIC = "user_id long, exam_id long, course_id long, exam_date date, weight double, topic_id long, sequence int, est_minutes double, difficulty double, confidence double, pinned_on date, pinned_minutes int, planned_before array<date>"


def users(n=40):
    topics, days = [], []
    for u in range(n):
        r = random.Random(u)
        for i in range(r.choice([10, 25, 40])):
            days.append((u, TODAY + timedelta(i), r.choice([0, 60, 120, 180, 240]) if u % 4 else 180))
        for e in range(r.randrange(1, 4)):
            exam = (u, 10 * u + e, r.randrange(3), TODAY + timedelta(r.randrange(1, 38)), r.choice([1.0, 2.0, 5.0]))
            for t in range(r.randrange(1, 9)):
                pinned = TODAY + timedelta(r.randrange(0, 8)) if r.random() < 0.1 else None
                topics.append((*exam, 1000 * u + 20 * e + t, t, float(r.randrange(20, 200)), r.random(), r.random(), pinned, 30, [TODAY + timedelta(3)] if r.random() < 0.3 else []))
    return topics, days


TOPICS, DAYS = users()


def planned(spark, topics=TOPICS, days=DAYS, **more):
    rows = P.plan(spark.createDataFrame(topics, TOPIC), spark.createDataFrame(days, "user_id long, day date, minutes int"), **more).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.user_id].append(r)
    return by


@pytest.fixture(scope="module")
def plans(spark):
    return planned(spark)


def test_equal_input_gives_the_same_plan(spark, plans):
    topics, days = TOPICS[:], DAYS[:]
    random.Random(1).shuffle(topics)
    random.Random(2).shuffle(days)
    assert planned(spark, topics, days) == plans


def test_days_are_never_overfilled(plans):
    room = {(u, d): int(P.FILL * m) for u, d, m in DAYS}
    used = collections.Counter()
    for u, rows in plans.items():
        for r in rows:
            if r.ord:
                used[u, r.day] += r.minutes
                assert r.minutes > 0
    assert all(used[k] <= room[k] for k in used)


def test_no_work_is_lost_and_none_is_made(plans):
    first = collections.Counter()
    for rows in plans.values():
        for r in rows:
            if r.kind in ("first_pass", "pinned", "at_risk"):
                first[r.topic_id] += r.minutes
    last = {u: max(d for v, d, _ in DAYS if v == u) for u in plans}
    for t in TOPICS:
        assert first[t[5]] >= t[7] if t[3] > TODAY else first[t[5]] == 0
        pinned = 30 if t[10] else 0
        assert first[t[5]] <= t[7] + pinned
    assert last


def test_first_passes_meet_their_deadline_and_their_course_order(plans):
    exam = {t[1]: t for t in TOPICS}
    for rows in plans.values():
        risky = {r.topic_id for r in rows if r.kind in ("at_risk", "triaged")}
        started, seen = {}, collections.defaultdict(set)
        for r in sorted((r for r in rows if r.ord), key=lambda r: (r.day, r.ord)):
            e = exam[r.exam_id]
            assert r.day < e[3]
            if r.kind == "first_pass":
                runway = (e[3] - TODAY).days
                assert r.day <= e[3] - timedelta(1 if runway < P.CRAM else max(2, -(-runway // 4)))
                assert not any(x[3] == r.day for x in TOPICS if x[0] == r.user_id)
                started.setdefault(r.topic_id, (r.day, r.ord))
                seen[r.day].add(e[2])
        assert all(len(c) <= P.COURSES + 1 for c in seen.values())  # one more where a pin is of another course
        by_course = collections.defaultdict(list)
        for t in TOPICS:
            if t[5] in started and t[5] not in risky and not t[10]:
                by_course[t[2], t[1]].append((t[6], started[t[5]]))
        for found in by_course.values():
            orders = [at for _, at in sorted(found)]
            assert orders == sorted(orders)


def test_reviews_follow_the_first_pass_and_end_before_the_exam(plans):
    exam = {t[5]: t[3] for t in TOPICS}
    for rows in plans.values():
        done = {}
        for r in rows:
            if r.kind in ("first_pass", "pinned"):
                done[r.topic_id] = max(done.get(r.topic_id, r.day), r.day)
        late = {r.topic_id for r in rows if r.kind == "unplaced_review"}
        risky = {r.topic_id for r in rows if r.kind == "at_risk"}
        ends = collections.defaultdict(set)
        for r in rows:
            if r.kind == "review":
                assert done[r.topic_id] <= r.day < exam[r.topic_id]
                ends[r.topic_id].add(r.day)
        for t in set(done) - risky - late:
            if exam[t] <= max(d for u, d, _ in DAYS if u == rows[0].user_id):
                assert any(exam[t] - timedelta(2) <= d for d in ends[t]), t


def test_pins_stay_and_closed_days_are_free(plans):
    closed = {(u, d) for u, d, m in DAYS if m == 0}
    for u, rows in plans.items():
        assert not [r for r in rows if r.ord and (u, r.day) in closed]
        for r in rows:
            if r.kind == "pinned":
                assert r.day == next(t[10] for t in TOPICS if t[5] == r.topic_id)


def test_three_weeks_and_ten_topics(spark):
    topics = [(1, 1, 1, TODAY + timedelta(21), 1.0, t, t, 60.0, 0.5, 0.5, None, 0, []) for t in range(10)]
    rows = planned(spark, topics, [(1, TODAY + timedelta(i), 120) for i in range(22)])[1]
    last = [r for r in rows if r.ord and r.day >= TODAY + timedelta(19)]
    assert last and {r.kind for r in last} <= {"review", "practice"}
    assert [r.day for r in rows if r.kind == "buffer"][-1] == TODAY + timedelta(18)
    assert min(collections.Counter(r.topic_id for r in rows if r.kind == "review").values()) >= 2
    assert not [r for r in rows if not r.ord]


def test_too_much_work_is_told(spark):
    topics = [(1, 1, 1, TODAY + timedelta(10), 1.0, t, t, 600.0, t / 10, 0.0, None, 0, []) for t in range(5)]
    rows = planned(spark, topics, [(1, TODAY + timedelta(i), 120) for i in range(11)])[1]
    assert {r.topic_id for r in rows if r.kind == "at_risk"} >= {0, 1, 2}  # the least at stake first
    assert sum(r.minutes for r in rows if r.kind in ("first_pass", "at_risk")) == 3000


def test_velocity_is_held_in_bounds(spark):
    topics = [(1, 1, 1, TODAY + timedelta(30), 1.0, 1, 1, 100.0, 0.5, 0.5, None, 0, [])]
    for speed, want in ((9.0, 200), (0.1, 50), (1.5, 150)):
        rows = planned(spark, topics, [(1, TODAY + timedelta(i), 240) for i in range(31)], velocity=F.lit(speed))[1]
        assert sum(r.minutes for r in rows if r.kind == "first_pass") == want


def test_nothing_to_plan(spark):
    assert planned(spark, TOPICS[:0], DAYS) == {} and planned(spark, TOPICS, DAYS[:0]) == {}
