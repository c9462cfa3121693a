"""Rollups, retention curves and grades by hand and against one batch."""

import collections
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from studyloom.operators import grades, retention
from studyloom.sources.tables import shared_folder
from studyloom.streaming import rollups

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(n=600):
    r = random.Random(1)
    rows = [(i, datetime(2026, 1, 1) + timedelta(minutes=r.randrange(4 * 1440)), r.randrange(40), r.choice("ab"), r.choice([None, 0.0, 1.0, 2.5, 4096.0, r.random() * 50])) for i in range(n)]
    return rows + [(n, None, 1, "a", 1.0)]


def told(df):
    return sorted((r.hour, r.event_type, r.n, r.cents, r.low, r.high, tuple(r.hist), r.u) for r in df.withColumn("u", F.hll_sketch_estimate("users")).collect())


def test_three_late_batches_are_one(spark):
    folder, rows = shared_folder(spark, "rollup"), events()
    for n in range(3):
        batch = spark.createDataFrame([r for r in rows if r[0] % 3 == n], EVENT)
        rollups.merge_batch(batch, folder, n)
        if n == 1:
            rollups.merge_batch(batch, folder, n)  # a batch that is repeated after a failure counts once
    whole = rollups.merged(rollups.partial(spark.createDataFrame(rows, EVENT)))
    assert told(rollups.read_rollup(spark, folder)) == told(whole)
    assert spark.read.schema(rollups.PARTIAL).parquet(folder).groupBy("day").agg(F.countDistinct("v").alias("n")).agg(F.max("n")).first()[0] <= 2


def test_a_batch_touches_its_own_days(spark):
    folder = shared_folder(spark, "rollup")
    rollups.merge_batch(spark.createDataFrame(events(), EVENT), folder, 0)
    rollups.merge_batch(spark.createDataFrame([(9, datetime(2026, 1, 2, 3), 1, "a", 1.0)], EVENT), folder, 1)
    rollups.merge_batch(spark.createDataFrame([], EVENT), folder, 2)
    versions = {str(r.day): r.v for r in rollups.read_rollup(spark, folder).select("day", "v").distinct().collect()}
    assert versions.pop("2026-01-02") == 1 and set(versions.values()) == {0}


def test_partial_results_by_hand(spark):
    got = {(r.hour, r.event_type): r for r in rollups.partial(spark.createDataFrame(events(), EVENT)).withColumn("u", F.hll_sketch_estimate("users")).withColumn("q", rollups.quantile(F.col("hist"), 0.5)).collect()}
    want = collections.defaultdict(list)
    for _, ts, user, kind, value in events():
        if ts:
            want[ts.replace(minute=0), kind].append((user, value))
    assert set(got) == set(want)
    for k, rows in want.items():
        values = sorted(v for _, v in rows if v is not None)
        r = got[k]
        assert (r.n, r.cents, r.low, r.high) == (len(rows), sum(round(v * 100) for v in values), min(values, default=None), max(values, default=None))
        assert r.u == len({u for u, _ in rows}) and sum(r.hist) == len(values)
        if values:
            middle = values[math.ceil(len(values) / 2) - 1]
            assert r.q == next((e for e in rollups.EDGES if middle < e), math.inf)


def test_retention_curve_finds_its_stability(spark):
    r, rows = random.Random(3), []
    for user in range(400):
        at = datetime(2026, 1, 1)
        for k in range(20):
            gap = r.randrange(1, 100)
            at += timedelta(hours=gap)
            rows.append((user, at, k, r.random() < math.exp(-gap / (40.0 if user % 2 else 120.0))))
    reviews = spark.createDataFrame(rows, "user_id long, at timestamp, id long, ok boolean")
    points = retention.curve(retention.recalls(reviews, ["user_id"]), F.col("user_id") % 2, 4)
    got = {r["group"]: r for r in retention.stability(points, 4).collect()}
    assert got[1].stability == pytest.approx(40, rel=0.15) and got[0].stability == pytest.approx(120, rel=0.15)
    assert got[0].n == got[1].n == 200 * 19 and got[0].error < 0.01


def test_gaps_belong_to_one_key(spark):
    reviews = spark.createDataFrame([(1, datetime(2026, 1, 1), 1, True), (2, datetime(2026, 1, 2), 1, True), (1, datetime(2026, 1, 1, 5, 59), 2, False), (1, datetime(2026, 1, 1, 5, 59), 3, True)], "user_id long, at timestamp, id long, ok boolean")
    assert sorted((r.user_id, r.gap, r.ok) for r in retention.recalls(reviews, ["user_id"]).collect()) == [(1, 0, True), (1, 5, False)]


@pytest.mark.parametrize(
    ("graded", "open_", "banked", "target", "case", "mark"),
    [
        (60.0, 40.0, 480.0, 9.0, "unreachable", None), (60.0, 40.0, 480.0, 8.0, "needed", 8.0), (60.0, 40.0, 480.0, 4.8, "secured", 0.0), (60.0, 40.0, 480.0, 1.0, "secured", 0.0),
        (60.0, 40.0, 480.0, 8.8, "needed", 10.0), (100.0, 0.0, 700.0, 7.0, "locked_met", None), (100.0, 0.0, 700.0, 7.1, "locked_missed", None), (0.0, 100.0, 0.0, 5.0, "needed", 5.0), (0.0, 0.0, 0.0, 5.0, None, None),
    ],
)
def test_required_score(spark, graded, open_, banked, target, case, mark):
    got = spark.range(1).select(*(c.alias(n) for c, n in zip(grades.required_score(*map(F.lit, (graded, open_, banked, target))), ("case", "mark")))).first()
    assert (got.case, got.mark) == (case, mark)


def test_standing_and_averages(spark):
    rows = [(1, 40.0, 80.0, 100.0), (1, 20.0, 30.0, 20.0), (1, 40.0, None, 100.0), (2, 100.0, None, 100.0), (3, None, 50.0, 100.0), (3, -5.0, 50.0, 100.0), (4, 10.0, 5.0, 0.0), (4, 30.0, -1.0, 10.0)]
    got = {r.c: (r.graded_weight, r.open_weight, r.banked, r.standing) for r in grades.standing(spark.createDataFrame(rows, "c int, weight double, score double, max_score double"), ["c"]).collect()}
    assert got == {1: (60.0, 40.0, 520.0, 520 / 60), 2: (0.0, 100.0, 0.0, None), 3: (0.0, 0.0, 0.0, None), 4: (30.0, 10.0, 0.0, 0.0)}
    courses = spark.createDataFrame([(1, 8.0, 6.0), (1, 4.0, 3.0), (1, None, 3.0), (2, None, 6.0)], "u int, grade double, credits double")
    assert {r.u: (r.average, r.earned, r.open) for r in grades.semester_average(courses, ["u"]).collect()} == {1: (60 / 9, 6.0, 3.0), 2: (None, 0.0, 6.0)}


def test_german_grade(spark):
    marks = [10.0, 5.0, 7.5, 12.0, 0.0, None]
    got = [r.g for r in spark.createDataFrame(list(enumerate(marks)), "i int, m double").orderBy("i").select(grades.german_grade(F.col("m")).alias("g")).collect()]
    assert got == [1.0, 4.0, 2.5, 1.0, 4.0, None]


def test_biggest_lever(spark):
    rows = [(1, 5, 1, 30.0, None, 6.0), (1, 4, 2, 60.0, None, 3.0), (1, 4, 1, 60.0, None, 3.0), (1, 9, 1, 90.0, 5.0, 6.0), (2, 1, 1, 10.0, 1.0, 6.0)]
    got = grades.biggest_lever(spark.createDataFrame(rows, "u int, course int, component int, weight double, score double, credits double"), ["u"], "course").collect()
    assert [tuple(r) for r in got] == [(1, 4, 1, 180.0)]
