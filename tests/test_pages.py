"""Topic pages and exams, case by case: identities of blocks, diffs, losses, citations, strips, folds and session ranges."""

import json

from pyspark.sql import functions as F

from studyloom.operators import calendar, pages, routing, sinks, topics

SCHEMA = "topic_id string, j string"


def parsed(spark, *rows):
    return spark.createDataFrame([(t, json.dumps(p)) for t, p in rows], SCHEMA).select("topic_id", topics.parse_page(F.col("j")).alias("page"))


def blocks(spark, **page):
    return topics.blocks(parsed(spark, ("t", page)))


def keys(spark, **page):
    return [(r.key, r.label, r.text) for r in blocks(spark, **page).orderBy("ord").collect()]


def test_identities(spark):
    got = keys(
        spark, notes=[{"id": " n1 ", "heading": "Zed", "markdown": " m "}, {"heading": " Caf\u00e9 \u2013 Law! "}, {"id": "n3", "heading": " "}, {}, None],
        keyTerms=[{"term": "CLT", "definition": " d "}, {"term": "  "}, {"term": "\u7d71\u8a08"}], formulas=[{"name": "Bayes' rule", "latex": "p", "explanation": "why"}, {"name": "", "latex": "\\\\bar{x}"}, {"explanation": " e "}],
        workedExamples=[{"problem": "One  two\nthree four five six seven Eight nine", "solution": "s"}, {}], openQuestions=[{"question": "q"}],
    )
    assert got == [
        ("note:n1", "Zed", "m"), ("note:cafe law", "Caf\u00e9 \u2013 Law!", ""), ("note:n3", "n3", ""), ("note:index:3", "note 4", ""), ("note:index:4", "note 5", ""),
        ("keyTerm:clt", "CLT", "d"), ("keyTerm:index:1", "key term 2", ""), ("keyTerm:", "\u7d71\u8a08", ""),
        ("formula:bayes rule", "Bayes' rule", "p why"), ("formula:bar x", "\\\\bar{x}", "\\\\bar{x}"), ("formula:index 2", "formula 3", "e"),
        ("workedExample:one two three four five six seven eight", "One two three four five six seven Eight", "s"), ("workedExample:index:1", "worked example 2", ""),
    ]
    assert keys(spark) == [] and keys(spark, notes=None, openQuestions=[{"question": "q"}]) == []


def test_sources_of_both_shapes(spark):
    sources = [{"documentId": "d", "page": 14, "locator": {"page": 2}}, {"documentId": "d", "locator": {"page": 3, "slide": 4}}, {"documentId": "d", "locator": {"slide": 9}}, {"documentId": "d"}, {"page": 1}]
    row = blocks(spark, notes=[{"id": "x", "sources": sources}]).first()
    assert [tuple(s) for s in row.sources] == [("d", 14), ("d", 3), ("d", 9), ("d", None), (None, 1)]


def test_diffs(spark):
    term = lambda t, d: {"term": t, "definition": d}
    before = blocks(spark, keyTerms=[term("CLT", "first"), term("LLN", "second"), term("Bias", "old"), term("bias!", "same")])
    after = blocks(spark, keyTerms=[term("lln", "second, rewritten"), term("BIAS", "same"), term("New", "n")])
    diff = topics.page_diff(before, after)
    got = {r.key: (r.label, r.status, r.rank, r.before, r.after) for r in diff.collect()}
    assert got == {
        "keyTerm:clt": ("CLT", "removed", 1, "first", None), "keyTerm:lln": ("lln", "changed", 2, "second", "second, rewritten"),
        "keyTerm:bias": ("BIAS", "unchanged", 4, "same", "same"), "keyTerm:new": ("New", "added", 3, None, "n"),
    }
    told = spark.createDataFrame([("t", "s", " s "), ("u", None, "new"), ("v", None, " ")], "topic_id string, before string, after string")
    totals = {r.topic_id: tuple(r)[1:] for r in topics.diff_totals(diff, told).collect()}
    assert totals == {"t": (1, 1, 1, 1, False, False), "u": (0, 0, 0, 0, True, False), "v": (0, 0, 0, 0, False, True)}


def test_diffs_sort_no_texts_before_the_shuffle(spark):
    page = blocks(spark, keyTerms=[{"term": "a", "definition": "first"}, {"term": "A", "definition": "last"}])
    diff = topics.page_diff(page, page)
    assert [(r.status, r.after) for r in diff.collect()] == [("unchanged", "last")]
    plan = diff._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" not in plan


def losses(spark, before, after, *removed):
    gone = spark.createDataFrame([("t", k) for k in removed], "topic_id string, key string")
    return sorted((r.kind, r.severity, r.subject, r.detail) for r in topics.merge_loss(blocks(spark, **before), blocks(spark, **after), gone).collect())


def test_losses(spark):
    page = {"notes": [{"id": "a", "heading": "Alpha", "markdown": "m"}, {"id": "b", "markdown": "m"}], "keyTerms": [{"term": "CLT", "definition": "d"}], "openQuestions": [{"question": "q"}]}
    kept = {"notes": [{"id": "a", "heading": "Alpha", "markdown": " "}], "keyTerms": [{"term": "clt", "definition": "other"}]}
    assert losses(spark, page, kept, "note:b") == [("emptied-block", "red", "note:a", "\u201cAlpha\u201d still exists but its content was emptied by this merge.")]
    got = losses(spark, page, {"notes": page["notes"][1:], "keyTerms": page["keyTerms"]}, "note:z")
    assert [x[:3] for x in got] == [("phantom-removal", "amber", "note:z"), ("undeclared-removal", "red", "note:a")]
    assert got[1][3].startswith("\u201cAlpha\u201d was in the page before this merge") and "\u201cnote:z\u201d" in got[0][3]
    assert len(losses(spark, page, {})) == 3 and losses(spark, {}, page) == [] and losses(spark, {"notes": [{"id": "a"}]}, {"notes": [{"id": "a"}]}) == []


def test_citations_outside_routed_pages(spark):
    cite = lambda d, *ps: [{"documentId": d, "page": p} for p in ps]
    b = blocks(spark, notes=[{"id": "x", "heading": "X", "sources": cite("d", 14, 14, 2) + cite("e", 9) + [{"documentId": "d"}]}, {"id": "y", "sources": cite("lost", 3) + cite("dark", 4)}])
    routed = spark.createDataFrame([("t", "d", 2)], "topic_id string, document_id string, page int")
    docs = spark.createDataFrame([("d", True, 0), ("lost", True, 1), ("dark", False, 0)], "document_id string, checked boolean, unaccounted int")
    got = {r.subject: (r.kind, r.severity, r.detail) for r in pages.citation_findings(b, routed, docs).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"note:x@14": ("phantom-locator", "red"), "note:y@3": ("unverifiable-locator", "amber"), "note:y@4": ("unverifiable-locator", "amber")}
    assert got["note:x@14"][2] == "\u201cX\u201d cites page 14 of this document, but no segment routed to this topic covers that page."


def test_routed_pages_that_nothing_cites(spark):
    b = blocks(spark, notes=[{"id": "x", "sources": [{"documentId": d, "page": 1} for d in ("d", "half", "few")] + [{"documentId": "half", "page": 2}]}])
    routed = spark.createDataFrame([("t", d, p) for d, n in (("d", 48), ("half", 4), ("few", 2), ("three", 3)) for p in range(1, n + 1)], "topic_id string, document_id string, page int")
    got = {r.document_id: (r.routed, r.cited, r.severity, r.subject, r.detail) for r in pages.uncited_pages(b, routed).collect()}
    assert {k: v[:4] for k, v in got.items()} == {"d": (48, 1, "red", "47 of 48 pages"), "three": (3, 0, "red", "3 of 3 pages")}
    assert "points at pages 2, 3, 4, 5, 6, 7, 8, 9, 10, 11\u2026 \u2014" in got["d"][4] and "pages 1, 2, 3 \u2014" in got["three"][4]


def test_strips_every_family(spark):
    one = [{"documentId": "d1", "page": 1}]
    full = {f: [{"sources": one}] for f in ("notes", "keyTerms", "formulas", "workedExamples", "openQuestions")}
    bare = {"notes": [{"id": "a", "sources": [{"documentId": None, "page": 1}]}, {"id": "b", "sources": one + [{"documentId": "", "page": 2}]}, {"id": "c", "sources": one + [{"documentId": "d2"}]}, {"id": "d", "sources": None}]}
    table = parsed(spark, ("full", {"summary": "s", **full}), ("bare", bare), ("asked", {"openQuestions": [{"question": "q", "sources": one}]}), ("empty", {}))
    backing = spark.createDataFrame([(t, d) for t in ("full", "bare", "asked", "empty") for d in ("d1", "d2")], "topic_id string, document_id string")
    got = {r.topic_id: tuple(r)[1:] for r in pages.strip_plan(backing, table, "d1").collect()}
    assert got == {"full": ("rewrite-page", 5, 0, True), "bare": ("rewrite-page", 0, 3, False), "asked": ("rewrite-page", 1, 0, False), "empty": ("unchanged", 0, 0, False)}
    left = {r.topic_id: r.page for r in topics.strip_document(table, "d1").collect()}
    assert all(left["full"][f] == [] for f in full) and left["full"].summary == "s" and left["empty"].notes is None
    assert [(n.id, n.sources and [s.documentId for s in n.sources]) for n in left["bare"].notes] == [("a", [None]), ("b", [""]), ("c", ["d2"]), ("d", None)]


def test_singletons(spark):
    rows = [("k", 1, "a", "create"), ("k", 2, "a", "create"), ("k", 4, "s", "create"), ("k", 6, "b", "create"), ("k", 7, "b", "create"), ("k", None, "lost", "create"), ("k", 3, "t1", "assign"), ("k", 5, "t1", "assign")]
    alone = [("z", 1, "a", "create"), ("z", 2, "b", "create"), ("y", 1, "a", "create"), ("y", 2, "t", "assign"), ("y", 3, "t", "assign")]
    got = {(r.deck_id, r.position): (r.into, r.reason) for r in topics.coalesce_singletons(spark.createDataFrame(rows + alone, "deck_id string, position int, proposal string, kind string")).collect()}
    none = (None, "no-multi-segment-receiver")
    assert got == {
        ("k", 1): (None, None), ("k", 2): (None, None), ("k", 3): (None, None), ("k", 4): ("a", None), ("k", 5): (None, None), ("k", 6): (None, None), ("k", 7): (None, None),
        ("k", None): (None, "segment-not-in-deck-order"), ("z", 1): none, ("z", 2): none, ("y", 1): none, ("y", 2): (None, None), ("y", 3): (None, None),
    }


def test_reprocessing_says_what_provenance_is_missing(spark):
    targets = spark.createDataFrame([("a", 1, 3), ("b", 2, 3), ("c", 3, 3), ("d", 4, 3), ("e", None, 0), ("f", 9, 1)], "target string, topic_id int, revision int")
    prior = spark.createDataFrame([(1, 1, False), (2, 1, True), (3, 3, True), (4, None, True)], "topic_id int, snapshot_revision int, has_provenance boolean")
    got = {r.target: tuple(r)[3:] for r in routing.reprocess_plan(targets, prior).collect()}
    assert got == {"a": ("skip", 2, True), "b": ("skip", 2, False), "c": ("merge", None, None), "d": ("skip", 3, False), "e": ("merge", None, None), "f": ("merge", None, None)}


def test_citation_labels(spark):
    b = blocks(spark, notes=[{"id": "x", "sources": [{"documentId": "d", "page": 2}, {"documentId": "d", "page": 9}, {"documentId": "d"}, {"documentId": " "}, {"documentId": "q", "page": 4}, {"documentId": " d ", "page": 2}]}])
    read = spark.createDataFrame([("d", 2)], "document_id string, page int")
    got = topics.citation_labels(topics.citations(b, read), spark.createDataFrame([("d", "Lecture 7")], "document_id string, label string"))
    assert sorted((r.label, r.status) for r in got.collect()) == sorted([
        ("Lecture 7 \u00b7 p. 2", "resolved"), ("Lecture 7 \u00b7 p. 9", "unread-page"), ("Lecture 7", "resolved"), ("Source unknown", "unknown-document"),
        ("Unknown source \u00b7 p. 4", "unknown-document"), ("Unknown source \u00b7 p. 2", "unknown-document"),
    ])


def test_unnamed_terms_are_not_looked_for(spark):
    b = blocks(spark, keyTerms=[{"term": " ", "definition": "d"}, {"term": "ab"}, {"term": "Absent"}], formulas=[{"name": "f"}])
    found = pages.grounding(b, spark.createDataFrame([("t", "a $x$ in prose", True)], "topic_id string, text string, is_new boolean"))
    got = {r.subject: (r.kind, r.detail) for r in found.collect()}
    assert set(got) == {"Absent", "1 formula"} and "only symbols mentioned inline in prose. It was not" in got["1 formula"][1]


def test_weights_and_queues(spark):
    rows = spark.createDataFrame([("a", 33.33), ("a", 33.33), ("a", 33.34), ("b", 60.0), ("b", 60.5), ("c", 99.99), ("d", 99.98), ("e", None)], "k string, percent double")
    assert {r.k: (r.verdict, r.delta) for r in topics.weight_verdict(rows, ["k"], "percent").collect()} == {"a": ("balanced", 0.0), "b": ("over", 20.5), "c": ("balanced", -0.01), "d": ("under", -0.02), "e": ("empty", -100.0)}
    queue = spark.createDataFrame([("a", 0), ("b", 1)], "client_id string, attempts int")
    results = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "delivered"), ("b", 2, "failed"), ("b", 1, "rejected")], "client_id string, ord int, outcome string")
    assert [tuple(r) for r in sinks.flush_queue(queue, results).collect()] == [("b", 2)]


def test_exam_of_a_feed_with_open_ranges(spark):
    events = spark.createDataFrame([(1, "a", 10, 4, None), (1, "b", 20, 9, None), (1, "c", 30, None, 99), (2, "d", 10, None, 7), (3, "e", 10, 3, 2)], "course_id int, uid string, starts_at int, session_from int, session_to int")
    courses = spark.createDataFrame([(1, None), (2, None), (3, 0)], "course_id int, total_sessions int")
    none = spark.createDataFrame([], "course_id int, id int, title string, kind string, session_number int, confirmed boolean")
    got = {r.course_id: tuple(r)[1:] for r in calendar.detect_exams(events, courses, none).collect()}
    assert got == {1: ("found", "feed_max_session", 9, "b", 20), 2: ("unknown", None, None, None, None), 3: ("found", "feed_max_session", 3, "e", 10)}
