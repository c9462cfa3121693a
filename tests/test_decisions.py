"""Decisions of routing, exams, attendance, grounding and outcomes, case by case."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from studyloom.operators import calendar, documents, extractions, ledger, pages, routing, topics, vectors

A, B, NEAR = [1.0, 0.0], [0.0, 1.0], [0.99, 0.05]


def guarded(spark, proposals, existing):
    left = spark.createDataFrame([(i, t, 1, v) for i, (t, v) in enumerate(proposals)], "lid long, title string, course long, lvec array<double>")
    right = spark.createDataFrame([(100 + i, 1, v) for i, v in enumerate(existing)], "rid long, course long, rvec array<double>")
    rows = vectors.guard_duplicates(left, right, "course").orderBy("lid").collect()
    return [(r.decision, r.rid if r.rid is not None else r.into, r.unguarded) for r in rows]


@pytest.mark.parametrize(
    ("proposals", "existing", "want"),
    [
        ([("X", NEAR)], [A, B], [("coerced-to-existing", 100, None)]),
        ([("X", B), ("x ", B)], [A], [("create", None, None), ("merged-into-proposal", 0, None)]),
        ([("New  x", B), ("new x", B)], [], [("create", None, None), ("merged-into-proposal", 0, None)]),
        # A namesake that went to an existing topic is no accepted title.
        ([("X", NEAR), ("X", B), ("X", B)], [A], [("coerced-to-existing", 100, None), ("create", None, None), ("merged-into-proposal", 1, None)]),
        ([("X", None), ("Y", [])], [A], [("create", None, "no-title-embedding"), ("create", None, "no-title-embedding")]),
        ([("X", A)], [None, [], [1.0]], [("create", None, "no-comparable-existing-vectors")]),
        ([("X", [0.0, 0.0])], [A], [("create", None, "no-comparable-existing-vectors")]), ([("X", A)], [], [("create", None, None)]),
        ([("X", None), ("x", NEAR)], [A], [("create", None, "no-title-embedding"), ("coerced-to-existing", 100, None)]),
    ],
)
def test_duplicate_guard(spark, proposals, existing, want):
    assert guarded(spark, proposals, existing) == want


def test_slugs_stay_unique(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a-2"), (2, "b")], "course_id int, slug string")
    new = spark.createDataFrame([(1, 1, "A", "a"), (1, 2, "A", "a"), (1, 3, "A-3", "a-3"), (2, 1, "A", "a"), (3, 1, "T", "topic"), (3, 2, "T", "topic-2"), (3, 3, "T", "topic")], "course_id int, ord int, title string, slug string")
    made, snapshots = extractions.create_topics(old, new)
    assert {(r.course_id, r.ord): r.slug for r in made.collect()} == {(1, 1): "a-3", (1, 2): "a-4", (1, 3): "a-3-2", (2, 1): "a", (3, 1): "topic", (3, 2): "topic-2", (3, 3): "topic-3"}
    assert {r.revision for r in snapshots.collect()} == {0}


ITEMS = [("a", True, "detected", None), ("b", False, None, None), ("c", True, "manual", ["is_exam_candidate"]), ("d", False, "manual", ["title"]), ("e", False, None, ["is_exam_candidate", "title"])]


@pytest.mark.parametrize(
    ("intent", "target", "want"),
    [
        ("set", "b", [("a", False, None, ["is_exam_candidate"]), ("c", False, None, ["is_exam_candidate"]), ("d", False, None, ["is_exam_candidate", "title"]), ("b", True, "manual", ["is_exam_candidate"])]),
        ("set", "c", [("a", False, None, ["is_exam_candidate"]), ("d", False, None, ["is_exam_candidate", "title"])]),
        ("reject", "a", [("a", False, None, ["is_exam_candidate"]), ("c", False, None, ["is_exam_candidate"]), ("d", False, None, ["is_exam_candidate", "title"])]),
        ("reject", "b", [("a", False, None, ["is_exam_candidate"]), ("b", False, None, ["is_exam_candidate"]), ("c", False, None, ["is_exam_candidate"]), ("d", False, None, ["is_exam_candidate", "title"])]),
        ("reset", None, [("c", False, None, []), ("e", False, None, ["title"])]),
    ],
)
def test_exam_decisions(spark, intent, target, want):
    items = spark.createDataFrame([(i, 1, e, s, ls) for i, e, s, ls in ITEMS] + [("z", 2, True, "detected", None)], "id string, course_id int, is_exam boolean, source string, locks array<string>")
    got = extractions.decide_exam(items, spark.createDataFrame([(1, intent, target)], "course_id int, intent string, id string")).collect()
    assert [(r.id, r.is_exam, r.source, list(r.locks)) for r in got] == want


def matched(spark, text, pinned=None, block=2_000):
    courses = [(1, 1, " ACC ", "Accounting"), (2, 2, "", "Finance"), (3, 3, None, " "), (4, 4, "mkt", "Marketing basics")]
    rules = [(2, 1, " Cost "), (1, 2, "  "), (99, 0, "lecture")]
    found = calendar.match_course(
        spark.createDataFrame([(1, pinned, text)], "id int, pinned int, text string"), spark.createDataFrame(courses, "course_id int, ord int, code string, title string"), spark.createDataFrame(rules, "course_id int, ord int, pattern string"), block
    ).collect()
    return [(r.course_id, r.step) for r in found]


@pytest.mark.parametrize(
    ("text", "pinned", "want"),
    [
        ("", None, []), ("   ", None, []), (None, None, []), ("", 3, [(3, 1)]), ("anything", 98, []), ("costing", None, [(2, 2)]), ("Lecture ACC 101", None, [(1, 3)]), ("accx", None, []), ("  finance ", None, [(2, 4)]),
        ("Marketing", None, [(4, 5)]), ("all about accounting", None, [(1, 5)]), ("cost of MKT", None, [(2, 2)]), ("cost", 4, [(4, 1)]),
    ],
)
def test_course_match(spark, text, pinned, want):
    assert matched(spark, text, pinned) == matched(spark, text, pinned, block=2) == want


def grounded(spark, blocks, text, new=True):
    rows = spark.createDataFrame([(1, k, v) for k, v in blocks], "topic_id int, kind string, label string")
    found = pages.grounding(rows, spark.createDataFrame([(1, text, new)], "topic_id int, text string, is_new boolean"))
    return sorted((r.kind, r.subject) for r in found.collect())


def test_grounding(spark):
    formula, none = ("formula", "f"), "formulas-without-source-math"
    assert grounded(spark, [formula, formula], "x = y and $a$ inline") == [(none, "2 formulas")]
    assert grounded(spark, [formula], "prose") == [(none, "1 formula")]
    for maths in ("$$x$$", r"\[ x \]", r"\begin{align}", r"\begin{equation*}"):
        assert grounded(spark, [formula], maths) == []
    assert grounded(spark, [formula], r"\begin{itemize}") == [(none, "1 formula")]
    assert grounded(spark, [("keyTerm", "Net  Present\nValue"), ("keyTerm", " ab "), ("keyTerm", "Alpha")], "the NET PRESENT VALUE") == [("unanchored-key-term", "Alpha")]
    assert grounded(spark, [("keyTerm", "present")], "presentation") == []  # parts of words count
    assert grounded(spark, [formula, ("keyTerm", "Alpha")], "prose", new=False) == []


def test_attendance_and_pace(spark):
    courses = spark.createDataFrame([(1, 30, None, 1.5), (2, 0, None, 1.0), (3, 10, 101.0, 0.0), (4, None, 5.0, float("nan")), (5, 10, 10.0, 2.0)], "course_id int, total_sessions int, absence_fail_pct double, target double")
    at = datetime(2026, 1, 1)
    marks = [(1, f"o{i}", at.replace(day=i + 1), s) for i, s in enumerate(["present", "present", "absent", "excused", "present", "absent", "absent", "absent", "absent"])]
    logs = spark.createDataFrame([("o0",), ("o0",), ("o0",), ("o4",), ("o2",)], "occurrence_id string")
    got = {r.course_id: r for r in ledger.course_standings(courses, spark.createDataFrame(marks, "course_id int, occurrence_id string, starts_at timestamp, status string"), logs).collect()}
    r = got[1]
    assert (r.present, r.absent, r.excused, r.allowed, r.left, r.gate) == (3, 5, 1, 6, 1, "warning")
    assert (r.sessions, r.contributions, r.on_pace, r.streak) == (3, 4, False, 1) and r.mean == pytest.approx(4 / 3) and r.delta == pytest.approx(4 / 3 - 1.5)
    assert [got[c].gate for c in (2, 3, 4, 5)] == [None, None, None, "warning"]
    assert [(got[c].sessions, got[c].mean, got[c].delta, got[c].on_pace, got[c].streak) for c in (2, 3, 4, 5)] == [(0, 0.0, None, None, 0)] * 4
    assert (got[3].target, got[4].target) == (None, None)


def test_outcomes_of_documents(spark):
    documents_ = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False), (5, True), (6, None)], "document_id int, downgraded boolean")
    rows = [(3, "a", "failed", False), (3, "b", "failed", None), (4, "a", "merged", True), (4, "b", "failed", True), (5, "a", "merged", False), (6, "a", "merged", True)]
    got = {r.document_id: tuple(r)[1:] for r in topics.document_outcome(documents_, spark.createDataFrame(rows, "document_id int, topic_id string, outcome string, needs_review boolean")).collect()}
    assert got == {1: ("ready", 0, 0, 0, []), 2: ("partial", 0, 0, 0, []), 3: ("failed", 0, 0, 2, ["a", "b"]), 4: ("partial", 1, 1, 1, ["b"]), 5: ("partial", 1, 0, 0, []), 6: ("ready", 1, 1, 0, [])}


def test_dead_letters_and_funnels(spark):
    rows = [(1, 1, "m", "success"), (2, 1, "m", "refusal"), (3, 1, "m", "schema"), (3, 2, "m", "schema"), (4, 1, "m", "schema"), (4, 2, "m", "schema"), (4, 3, "n", "success"), (5, 1, "m", "schema"), (5, 2, "m", "schema"), (5, 3, "n", "schema"), (6, 1, "m", "schema"), (6, 2, "m", "schema"), (6, 3, "n", "refusal")]
    got = {r.call_id: (r.status, r.reason) for r in routing.attempts_outcome(spark.createDataFrame(rows, "call_id int, attempt int, model string, outcome string")).collect()}
    assert got == {1: ("delivered", None), 2: ("dead_letter", "refusal"), 3: ("dead_letter", "no-escalation-target"), 4: ("escalated", None), 5: ("dead_letter", "schema"), 6: ("dead_letter", "refusal")}
    docs = spark.createDataFrame([(1, 0, 12, 1), (2, 1, 12, 1), (3, 0, 11, 1), (4, 0, 12, 2)], "document_id int, existing int, segments int, targets int")
    assert [(r.document_id, r.warning[:60]) for r in routing.funnelled(docs).collect()] == [(1, "[routing] Whole document funnelled into a single topic on an")]


def test_strip_totals(spark):
    note = lambda k, *ds: '{"id":"%s","heading":"h","markdown":"m","sources":[%s]}' % (k, ",".join('{"documentId":"%s","page":1}' % d for d in ds))
    page = lambda summary, *ns: '{"summary":"%s","notes":[%s]}' % (summary, ",".join(ns))
    rows = [("gone", page("s", note("a", "d1"), note("b", "d1"))), ("cut", page("s", note("a", "d1"), note("b", "d2"), note("c"))), ("mixed", page(" ", note("a", "d1", "d2"))), ("same", page("s", note("a", "d2"), note("c"))), ("none", page(" ", note("a", "d1"), note("b", "d2")))]
    table = spark.createDataFrame(rows, "topic_id string, j string").select("topic_id", topics.parse_page(F.col("j")).alias("page"))
    backing = spark.createDataFrame([(t, d) for t in ("gone", "cut", "mixed", "same", "none") for d in ("d1", "d2") if (t, d) != ("gone", "d2")], "topic_id string, document_id string")
    plans = pages.strip_plan(backing, table, "d1")
    assert {r.topic_id: tuple(r)[1:] for r in plans.collect()} == {"gone": ("remove-topic", 0, 0, False), "cut": ("rewrite-page", 1, 1, True), "mixed": ("rewrite-page", 0, 0, False), "same": ("unchanged", 0, 0, False), "none": ("rewrite-page", 1, 0, False)}
    assert tuple(pages.delete_impact(plans, spark.createDataFrame([("d1",), ("d2",)], "document_id string"), "d1").first()) == (1, 3, 1, 2, 1, 1, 1)


def test_page_sections(spark):
    page = (
        '{"summary":" About ","notes":[{"id":"n1","heading":"H","markdown":"M"},{"id":"n2","heading":"","markdown":"M2"}],"keyTerms":[{"term":"T","definition":"D"},{"term":"U","definition":"E"}],'
        '"formulas":[{"name":"N","latex":"x","explanation":"X"}],"workedExamples":[{"problem":"P","solution":"S"},{"problem":"Q","solution":"R"}]}'
    )
    rows = spark.createDataFrame([(page,), ('{"summary":"  "}',)], "j string").select(F.inline(pages.page_sections(topics.parse_page(F.col("j"))))).collect()
    assert [tuple(r) for r in rows] == [
        ("summary", "Summary", " About "), ("note:n1", "H", "M"), ("note:n2", "", "M2"), ("keyTerms", "Key terms", "**T** — D\n\n**U** — E"), ("formulas", "Formulas", "**N**\n\n$$x$$\n\nX"), ("example:1", "Worked example", "P\n\nS"), ("example:2", "Worked example", "Q\n\nR"),
    ]


def test_segment_titles_and_unaccounted_pages(spark):
    rows = spark.createDataFrame([(1, 1, True, " Intro "), (1, 2, False, None), (1, 3, True, ""), (1, 4, False, "not a heading"), (1, 5, False, None), (1, 9, True, "End")], "doc_id int, page int, heading boolean, title string")
    got = documents.segments(rows, 2).orderBy("segment").collect()
    assert [(r.key, r.title, r.from_page, r.to_page) for r in got] == [("seg-1", "Intro", 1, 2), ("seg-2", "Pages 3–4", 3, 4), ("seg-3", "Page 5", 5, 5), ("seg-4", "End", 9, 9)]
    docs = spark.createDataFrame([(1, 10), (2, None)], "doc_id int, total int")
    read = spark.createDataFrame([(1, 2, 3), (2, 1, 1)], "doc_id int, lo int, hi int")
    assert [tuple(r) for r in documents.unaccounted(docs, read, spark.createDataFrame([(1, 8, 6)], "doc_id int, from_page int, to_page int")).orderBy("lo").collect()] == [(1, 1, 1), (1, 4, 5), (1, 9, 10)]
