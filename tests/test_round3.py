"""What the third round's findings showed."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from compare import differences, tables
from pyspark.sql import functions as F

from studyloom.functions import text
from studyloom.operators import nearest, planner, topics, vectors
from studyloom.plans import feeds, registry


def written(spark, folder, **named):
    """Tables of these rows in a folder."""
    for name, df in named.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same(spark, folder, query):
    return differences(registry.QUERIES[query](spark, folder), tables(folder), registry.ORACLES[query])


def test_a_feed_of_more_than_a_thousand_users(spark, tmp_path):
    rows = [(k, user, "error" if k % 5 == 0 else "view", 1.0) for k, user in enumerate([2, 4, 1002, 1004, 3, 1003, 2, 1002])]
    folder = written(spark, tmp_path, events=spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double"))
    assert same(spark, folder, "change_feed_view") == ""


@pytest.mark.parametrize(("weight", "shown"), [(0.845, "0.84"), (0.125, "0.12"), (0.375, "0.38"), (0.855, "0.85"), (1234.5, "1234.50"), (0.0, "0.00")])
def test_a_weight_is_rounded_by_its_value(spark, weight, shown):
    empty = F.array().cast("array<string>")
    shown_text = topics.topic_text(F.lit("t"), F.lit("x"), F.lit(weight).cast("double"), F.lit(""), empty, empty, empty, empty)
    assert f"  exam weight: {shown} (" in spark.range(1).select(shown_text.alias("t")).first()["t"]


def test_topics_of_one_number_are_planned_the_same_in_any_order(spark):
    today = date(2026, 1, 1)
    rows = [(1, 1, 1, today + timedelta(20), 1.0, 7, 1, float(m), 0.5, 0.5, None, 0, []) for m in (13, 11, 47, 29, 31)]
    kinds = "user_id long, exam_id long, course_id long, exam_date date, weight double, topic_id long, sequence int, est_minutes double, difficulty double, confidence double, pinned_on date, pinned_minutes int, planned_before array<date>"
    days = spark.createDataFrame([(1, today + timedelta(i), 60) for i in range(25)], "user_id long, day date, minutes int")
    plans = [[tuple(r) for r in planner.plan(spark.createDataFrame(rows[::step], kinds).coalesce(1), days).collect()] for step in (1, -1)]
    assert plans[0] and plans[0] == plans[1]


def test_nearest_rows_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 40)
    r = np.random.default_rng(3)
    rows = [(i, i % 2, r.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, 0, [1e-200, 1e-200, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(2000, 0, [1.0]), (2001, 0, None), (2002, None, [1.0] * 6)]
    table = spark.createDataFrame(rows, "rid long, g int, rvec array<double>")
    left = table.where("rid % 10 = 0").selectExpr("rid lid", "g", "rvec lvec")
    got = {(x.lid, x["rank"]): (x.rid, x.similarity) for x in vectors.nearest_of(left, table, "g", 4).collect()}
    whole = {i: (g, np.array(v) / np.abs(v).max()) for i, g, v in rows if v and len(v) == 6 and g is not None}
    for i, (g, v) in whole.items():
        if i % 10 == 0:
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, (h, w) in whole.items() if g == h and j != i)[:4]
            assert [(-round(got[i, k][1], 12), got[i, k][0]) for k in range(1, 5)] == near


def test_first_positions_need_no_shuffle_of_words(spark, tmp_path):
    rows = [(1, "b a  b a c"), (2, ""), (3, None), (4, "x"), (4, "y x"), (5, "é e é")]
    folder = written(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert same(spark, folder, "first_positions") == ""
    got = spark.range(1).select(text.word_places(F.split(F.lit("b a b"), " ")).alias("p")).first()["p"]
    assert [(x.word, x.places) for x in got] == [("a", [1]), ("b", [0, 2])]


def test_bytes_are_made_few_files_at_a_time():
    b = pd.DataFrame({"doc_id": range(1000), "text": ["x"] * 1000})
    assert max(len(x) for x in feeds.document_bytes([b])) <= 256 and sum(len(x) for x in feeds.document_bytes([b])) == 1000
