import io
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from studyloom.operators import calendar, documents, intervals, ledger, relational, sinks, topics, windows
from studyloom.sources import files, ics
from studyloom.streaming import changes

FEED = """BEGIN:VCALENDAR
BEGIN:VEVENT
UID:w
DTSTART;TZID=Europe/Madrid:20260323T100000
DURATION:PT1H30M
RRULE:FREQ=WEEKLY;COUNT=4
EXDATE;TZID=Europe/Madrid:20260330T100000
SUMMARY:ECON  Intro\\, part
 one
END:VEVENT
BEGIN:VEVENT
UID:w
RECURRENCE-ID;TZID=Europe/Madrid:20260406T100000
DTSTART;TZID=Europe/Madrid:20260407T120000
DTEND;TZID=Europe/Madrid:20260407T130000
STATUS:CANCELLED
END:VEVENT
BEGIN:VEVENT
UID:d
DTSTART;VALUE=DATE:20260120
SUMMARY:Day
END:VEVENT
END:VCALENDAR
"""


def test_feed(spark):
    rows = [("a", FEED, "Europe/Madrid", datetime(2026, 1, 1), datetime(2026, 12, 31)), ("b", FEED.replace("Europe/Madrid", "Nowhere/At"), "Europe/Madrid", datetime(2026, 1, 1), datetime(2026, 12, 31))]
    got = ics.read_feeds(spark.createDataFrame(rows, "path string, content string, default_tz string, horizon_from timestamp, horizon_to timestamp")).collect()
    good = sorted((r.uid, str(r.starts_at), str(r.ends_at), r.status) for r in got if r.path == "a")
    assert good == [
        ("d", "2026-01-19 23:00:00", "None", "confirmed"), ("w", "2026-03-23 09:00:00", "2026-03-23 10:30:00", "confirmed"),
        ("w", "2026-04-07 10:00:00", "2026-04-07 11:00:00", "cancelled"), ("w", "2026-04-13 08:00:00", "2026-04-13 09:30:00", "confirmed"),
    ]
    assert [r.error is not None for r in got if r.path == "b"] == [True]


def deck():
    z = io.BytesIO()
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    slide = lambda t, b: f'<p:sld {ns}><p:sp><p:ph type="title"/><a:p><a:t>{t}</a:t></a:p></p:sp><p:sp><a:p><a:t>{b}</a:t></a:p></p:sp></p:sld>'
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:presentation>')
        f.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>')
        f.writestr("ppt/slides/slide1.xml", slide("One", "first body"))
        f.writestr("ppt/slides/slide2.xml", slide("Two", "second"))
    return z.getvalue()


def test_files(spark):
    pdf = b"%PDF-1.4 /Type /Pages /Count 2 /Type /Page /Type /Page %%EOF"
    df = spark.createDataFrame([("p", pdf), ("d", deck()), ("z", b"PK broken"), ("e", b"")], "path string, content binary")
    got = {r.path: r for r in files.probed(df).collect()}
    assert (got["p"].kind, got["p"].pages, got["p"].has_eof) == ("pdf", 2, True)
    assert (got["d"].kind, got["d"].entries, got["z"].damaged, got["e"].kind) == ("pptx", 4, True, "empty")
    slides = sorted((r.slide, r.title, r.words) for r in files.read_decks(df.where("path = 'd'")).collect())
    assert slides == [(1, "Two", 2), (2, "One", 3)]
    assert files.read_decks(df.where("path = 'z'")).first().error


def test_gate(spark):
    courses = spark.createDataFrame([(1, 30, None), (2, 30, 20.0), (3, 28, None)], "course_id int, total_sessions int, absence_fail_pct double")
    marks = spark.createDataFrame([(1, "absent")] * 6 + [(2, "absent")] * 7 + [(3, "present")], "course_id int, status string")
    got = {r.course_id: (r.gate, r.allowed) for r in ledger.attendance_gate(marks, courses).collect()}
    assert got == {1: ("at_limit", 6), 2: ("failed", 6), 3: ("ok", 5)}


def test_exam_detection(spark):
    at = datetime(2026, 5, 1)
    events = spark.createDataFrame([(1, "a", at, 29, 30), (2, "b", at, 5, 5), (4, "c", at, None, None)], "course_id int, uid string, starts_at timestamp, session_from int, session_to int")
    courses = spark.createDataFrame([(1, 30), (2, 9), (3, None), (4, None)], "course_id int, total_sessions int")
    none = spark.createDataFrame([], "course_id int, id string, title string, kind string, session_number int, confirmed boolean")
    got = {r.course_id: (r.outcome, r.uid, r.session) for r in calendar.detect_exams(events, courses, none).collect()}
    assert got == {1: ("found", "a", 30), 2: ("pending", None, 9), 3: ("unknown", None, None), 4: ("unknown", None, None)}


def test_week_view(spark):
    now = datetime(2026, 3, 25, 12)
    rows = [
        ("late", datetime(2026, 3, 24), "class", False, False), ("due", datetime(2026, 3, 20), "deadline", False, False), ("next", datetime(2026, 3, 27), "deadline", False, False),
        ("far", datetime(2026, 4, 2), "deadline", False, False), ("exam", datetime(2026, 3, 26), "class", False, True), ("gone", datetime(2026, 3, 26), "class", True, False),
    ]
    df = spark.createDataFrame(rows, "id string, starts_at timestamp, kind string, hidden boolean, is_exam boolean")
    df = df.select("*", F.lit("confirmed").alias("status"), F.col("starts_at").alias("updated_at"), *(F.lit(None).cast(t).alias(c) for c, t in (("missing_since", "timestamp"), ("weight_override", "double"), ("assessment_weight", "double"), ("completed_at", "timestamp"))))
    df = df.withColumn("weight_override", F.when(F.col("id") == "far", 80.0))
    got = {r.id: r.section for r in calendar.week_view(df, F.lit(now), "Europe/Madrid").collect()}
    assert got == {"late": "class_days", "due": "overdue", "next": "deadlines", "far": "horizon", "exam": "deadlines"}


@pytest.mark.parametrize("seed", range(3))
def test_runs_against_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, i, rnd.random() < 0.2) for k in range(20) for i in range(rnd.randrange(1, 30))]
    want, run, n, last = {}, 0, 0, None
    for k, i, b in rows:
        if k != last:
            run, n, last = 1, 0, k
        elif b or n == 4:
            run, n = run + 1, 0
        n += 1
        want[k, i] = run
    got = windows.runs(spark.createDataFrame(rows, "k int, i int, b boolean"), ["k"], "i", F.col("b"), 4)
    assert {(r.k, r.i): r.run for r in got.collect()} == want


def test_as_of_and_nearest(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 4, "c")], "k int, t int, v string")
    assert {(r.k, r.t): r.x for r in relational.as_of(left, right, "k", "t", "v", "x").collect()} == {(1, 5): "b", (1, 1): None, (2, 3): None}
    points = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (1, 9, False)], "g int, p int, b boolean")
    assert {r.p: r.near for r in relational.nearest(points, "g", "p", F.col("b"), "near").collect()} == {1: 3, 2: 1, 3: 1, 9: 3}


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, revision int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, revision int")
    state = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert state(sinks.upsert(old, new, ["id"], F.col("revision"))) == [(1, "a"), (2, "y"), (3, "z")]
    assert state(sinks.insert_ignore(old, new, ["id"], F.col("revision"))) == [(1, "a"), (2, "b"), (3, "z")]
    current, history = sinks.bump_revision(old, old.limit(0), spark.createDataFrame([(1, "n")], "id int, v string"), "id")
    assert sorted(map(tuple, current.collect())) == [(1, "n", 1), (2, "b", 0)] and [tuple(r) for r in history.collect()] == [(1, "a", 0)]
    queue = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0)], "client_id string, attempts int")
    results = spark.createDataFrame([("a", "delivered"), ("b", "failed")], "client_id string, outcome string")
    assert sorted(map(tuple, sinks.flush_queue(queue, results).collect())) == [("b", 2), ("c", 0)]


def covered(spark, total, read=(), cited=(), skips=()):
    docs = spark.createDataFrame([(1, total)], "doc_id int, total int")
    pages = lambda ps: spark.createDataFrame([(1, x, x) for x in ps], "doc_id int, lo int, hi int")
    said = spark.createDataFrame([(1, k, *s) for k, s in enumerate(skips)], "doc_id int, ord int, from_page int, to_page int, reason string")
    pieces = documents.coverage_segments(docs, pages(read), pages(cited), said)
    row = documents.coverage_warnings(documents.coverage(pieces, docs), pages(cited), said).first()
    gaps = documents.gap_reasons(documents.coverage_gaps(pieces), said).orderBy("first", "last").collect()
    return row, [(r.kind, r.first, r["last"], r.reason) for r in gaps]


def test_coverage(spark):
    row, gaps = covered(spark, 5, (1, 2), (1, 9), [(5, 4, "appendix only"), (3, 3, "n/a"), (0, 2, "cover"), (7, 8, "index pages")])
    assert gaps == [("unmapped", 2, 2, "read, but no topic page cites it"), ("undeclared", 3, 3, "reported skipped without a usable reason"), ("skipped", 4, 5, "appendix only")]
    assert (row.pages_mapped, row.pages_skipped, row.pages_unmapped, row.pages_undeclared, row.trustworthy) == (1, 2, 1, 1, False)
    assert row.warnings == [
        "Pages 3–3 were reported skipped with no usable reason (“n/a”), so they are counted as undeclared rather than as a reviewed omission.", "A skipped range (0–2) was not a page range and was ignored.",
        "A skipped range (7–8) lies outside this 5-page document and was ignored.", "1 citation point past the end of this 5-page document (9) and were not counted as covered.",
        "1 page was neither read nor declared skipped. Content on it is missing from your notes without anything saying so.",
        "2 of 5 pages were declared skipped — a large share for one document. The reasons are worth reading before trusting these notes as complete.",
        "Only 1 of 3 readable pages in this document are cited by any topic. The rest was read but did not reach your notes — treat these notes as incomplete until that is explained.",
    ]


def test_a_page_both_skipped_and_cited_is_mapped_and_a_gap(spark):
    row, gaps = covered(spark, 2, (1,), (1, 2), [(2, 2, "answer key"), (2, 2, "blank page"), (1, 1, "none")])
    assert (row.pages_mapped, row.pages_skipped) == (2, 1) and gaps == [("skipped", 2, 2, "answer key")]


def test_coverage_without_a_total(spark):
    row, gaps = covered(spark, None, (1, 3), (3, 4))
    assert (row.checked, row.pages_total, row.trustworthy) == (False, 4, False) and gaps == [("unmapped", 1, 1, "read, but no topic page cites it"), ("undeclared", 2, 2, "not read and not declared skipped")]
    assert row.warnings[0].startswith("This document's page count could not be established")


def test_a_read_page_is_in_no_skip_set(spark):
    declared = spark.createDataFrame([(1, 1, "n/a"), (1, 2, "n/a"), (1, 3, "cover page"), (1, 4, "cover page"), (1, 4, "-")], "doc_id int, page int, reason string")
    skips, bad = documents.skip_sets(declared, spark.createDataFrame([(1, 1), (1, 3)], "doc_id int, page int"))
    assert [tuple(r) for r in skips.collect()] == [(1, 4)] and [tuple(r) for r in bad.collect()] == [(1, 2)]


def test_intervals(spark):
    r = random.Random(4)
    rows = [(name, k, *sorted((r.randrange(60), r.randrange(60)), reverse=r.random() < 0.3)) for name in "ab" for k in range(3) for _ in range(r.randrange(1, 9))]
    part = lambda name: spark.createDataFrame([x[1:] for x in rows if x[0] == name] + [(0, None, 5)], "k int, lo int, hi int")
    held = lambda name, k: {i for n, j, a, b in rows if n == name and j == k for i in range(min(a, b), max(a, b) + 1)}
    for got, want in ((intervals.union(part("a"), ["k"]), lambda a, b: a), (intervals.intersection(part("a"), part("b"), ["k"]), lambda a, b: a & b), (intervals.difference(part("a"), part("b"), ["k"]), lambda a, b: a - b)):
        found = got.collect()
        for k in range(3):
            mine = sorted((x.lo, x.hi) for x in found if x.k == k)
            assert {i for a, b in mine for i in range(a, b + 1)} == want(held("a", k), held("b", k))
            assert all(a[1] + 1 < b[0] for a, b in zip(mine, mine[1:]))
    wide = spark.createDataFrame([(1, 1, 10**10), (1, 5 * 10**9, 2 * 10**10)], "k int, lo long, hi long")
    assert [tuple(x) for x in intervals.union(wide, ["k"]).collect()] == [(1, 1, 2 * 10**10)]
    points = spark.createDataFrame([(x,) for x in [*range(-2, 64), 5, None]], "at int")
    spans = spark.createDataFrame([(i, a, b) for i, (_, _, a, b) in enumerate(rows)] + [(99, None, 3)], "ord int, lo int, hi int")
    for x in intervals.first_covering(points, spans, "at", "lo", "hi", "ord", "ord", "found").collect():
        assert x.found == min((i for i, (_, _, a, b) in enumerate(rows) if x.at is not None and min(a, b) <= x.at <= max(a, b)), default=None)


def test_merge_loss(spark):
    block = lambda *rows: spark.createDataFrame([("t", *r) for r in rows], "topic_id string, key string, text string")
    gone = spark.createDataFrame([("t", "b"), ("t", "zz")], "topic_id string, key string")
    got = topics.merge_loss(block(("a", "x"), ("b", "x"), ("c", "x")), block(("c", "")), gone)
    assert sorted((r.kind, r.subject) for r in got.collect()) == [("emptied-block", "c"), ("phantom-removal", "zz"), ("undeclared-removal", "a")]


def test_change_stream(spark, tmp_path):
    rows = [(1, "a", "INSERT", "v1"), (2, "b", "INSERT", "v1"), (1, "a", "INSERT", "v1"), (3, "a", "UPDATE", "v2"), (4, "b", "DELETE", None)]
    df = spark.createDataFrame([(s, datetime(2026, 1, 1, 0, s), o, i, "c", b) for s, i, o, b in rows], changes.CHANGE)
    df.write.parquet(str(tmp_path / "in"))
    def run():
        stream = changes.once(changes.for_course(changes.source(spark, str(tmp_path / "in")), "c"))
        changes.keep_view(stream, str(tmp_path / "view"), str(tmp_path / "ck"), buckets=2).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, r.body) for r in changes.read_view(spark, str(tmp_path / "view")).collect())

    assert run() == [("a", "v2")]
    for k, more in enumerate(([(5, "b", "INSERT", "v3")], [(6, "a", "DELETE", None)], [(7, "c", "INSERT", "v1"), (8, "b", "UPDATE", "v4")], [(9, "c", "DELETE", None)]), 1):
        df = spark.createDataFrame([(s, datetime(2026, 1, 1, k, s), o, i, "c", b) for s, i, o, b in more], changes.CHANGE)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        want = [[("a", "v2"), ("b", "v3")], [("b", "v3")], [("b", "v4"), ("c", "v1")], [("b", "v4")]][k - 1]
        assert run() == want
    versions = {b.name: len(list(b.iterdir())) for b in (tmp_path / "view").glob("b=*")}
    assert versions and max(versions.values()) <= 2
    first = spark.createDataFrame([(s, datetime(2026, 1, 1, 0, s), o, i, "c", b) for s, i, o, b in rows], changes.CHANGE)
    batch = changes.apply_changes(spark.createDataFrame([("z", "c", "old", 0)], "id string, course_id string, body string, seq long"), first)
    assert sorted((r.id, r.body) for r in batch.collect()) == [("a", "v2"), ("z", "old")]
