import pytest
from pyspark.sql import functions as F

from studyloom.functions import dates, math, text
from studyloom.functions import math as M
from studyloom.operators import costs, documents, pages, topics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("wall", "utc"),
    [("2026-03-27 10:00", "2026-03-27 09:00"), ("2026-03-30 10:00", "2026-03-30 08:00"), ("2026-10-23 10:00", "2026-10-23 08:00"), ("2026-10-26 10:00", "2026-10-26 09:00"), ("2026-10-25 02:30", "2026-10-25 00:30")],
)
def test_wall_clock_to_instant(spark, wall, utc):
    got = one(spark, F.date_format(dates.to_instant(F.lit(wall).cast("timestamp"), "Europe/Madrid"), "yyyy-MM-dd HH:mm"))
    assert got == utc


def test_week_has_seven_local_midnights(spark):
    days = one(spark, F.transform(dates.week_days(F.lit("2026-03-27 12:00").cast("timestamp"), "Europe/Madrid"), lambda d: F.date_format(d, "dd HH")))
    assert days == ["22 23", "23 23", "24 23", "25 23", "26 23", "27 23", "28 23"]
    spring = one(spark, F.transform(dates.week_days(F.lit("2026-03-31 12:00").cast("timestamp"), "Europe/Madrid"), lambda d: F.date_format(d, "dd HH")))
    assert spring[0] == "29 22"


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 2.0, 3.0], [10.0, 20.0, 30.0], 1.0), ([0.0], [1.0], None), ([1.0], [1.0, 2.0], None)])
def test_cosine(spark, a, b, want):
    got = one(spark, math.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert got == want if want is None else abs(got - want) < 1e-12


@pytest.mark.parametrize(("x", "want"), [("", 1), ("a" * 400, 100), ("a" * 401, 101), ("  ab  ", 1)])
def test_token_estimate(spark, x, want):
    assert one(spark, text.token_estimate(F.lit(x))) == want == documents.tokens(x)


def test_half_up_is_not_round(spark):
    assert one(spark, math.half_up(F.lit(1.005))) == 1.0
    assert one(spark, math.half_up(F.lit(2.5), 0)) == 3.0


def test_parse_vector(spark):
    assert one(spark, math.parse_vector(F.lit("[1,2.5]"), 2)) == [1.0, 2.5]
    assert one(spark, math.parse_vector(F.lit("[1]"), 2)) is None


def test_identity_key_folds_accents(spark):
    assert one(spark, text.identity_key(F.lit("  Économía — Política! "))) == "economia politica"


@pytest.mark.parametrize(
    ("raw", "location", "want"),
    [
        ("MACRO  Monetary policy (Ses. 4-5)  T-05.02", "T-05.02", ("MACRO", "Monetary policy", 4, 5, "regular", None)),
        ("FINANCE  Extra session online", None, ("FINANCE", "Extra session", None, None, "extra", None)),
        ("STAT  Retake (Ses. 9-7)", "", ("STAT", "Retake", 9, 9, "retake", None)),
        ("LAW  | | , null", None, ("LAW", "", None, None, "regular", None)),
        ("** Last update today", None, ("** Last update today", "", None, None, "regular", "last_update")),
    ],
)
def test_normalize_summary(spark, raw, location, want):
    row = spark.createDataFrame([(raw, location)], "r string, l string").select(*text.normalize_summary(F.col("r"), F.col("l"))).first()
    assert tuple(row) == want


INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize(
    ("spent", "budget", "unpriced", "want"),
    [
        (1.0, 10.0, 0, "normal"), (10.0, 10.0, 0, "defer-deep"), (12.5, 10.0, 0, "defer-balanced"), (15.0, 10.0, 0, "halt"), (1.0, 10.0, 5, "normal"), (1.0, 10.0, 6, "defer-deep"), (10.0, 10.0, 6, "defer-balanced"),
        (12.5, 10.0, 99, "defer-balanced"), (15.0, 10.0, 9, "halt"), (1.0, 0.0, 0, "halt"), (1.0, -1.0, 0, "halt"), (1.0, None, 0, "halt"), (1.0, NAN, 0, "halt"), (1.0, INF, 0, "halt"),
        (None, 10.0, 0, "normal"), (NAN, 10.0, 9, "normal"), (INF, 10.0, 0, "normal"), (-5.0, 10.0, 0, "normal"), (1.0, 10.0, None, "normal"),
    ],
)
def test_posture(spark, spent, budget, unpriced, want):
    assert one(spark, costs.posture(F.lit(spent).cast("double"), F.lit(budget).cast("double"), F.lit(unpriced).cast("int"))) == want


@pytest.mark.parametrize(
    ("switch", "posture", "rank", "kind", "want"),
    [
        (True, "normal", "fast", "interactive", "kill-switch"), (True, "halt", "deep", "background", "kill-switch"), (False, "halt", "fast", "interactive", "budget-halt"), (False, "defer-balanced", "deep", "interactive", None),
        (False, "defer-balanced", "balanced", "background", "budget-defer-balanced"), (False, "defer-balanced", "fast", "background", None), (False, "defer-deep", "deep", "background", "budget-defer-deep"),
        (False, "defer-deep", "balanced", "background", None), (False, "normal", "deep", "background", None),
    ],
)
def test_guard(spark, switch, posture, rank, kind, want):
    assert one(spark, costs.guard(F.lit(switch), F.lit(posture), F.lit(rank), F.lit(kind))) == want


@pytest.mark.parametrize(
    ("size", "kind", "encrypted", "entries", "inflated", "damaged", "want"),
    [
        (0, "empty", False, None, None, False, "empty"), (None, "pdf", False, None, None, False, "empty"), (60 * 2**20, "pdf", True, None, None, False, "too-large"), (50 * 2**20, "pdf", False, None, None, False, None),
        (10, "pdf", True, None, None, False, "encrypted-pdf"), (10, "pdf", False, None, None, True, None), (10, "pptx", False, 1000, 200 * 2**20, False, None), (10, "pptx", False, 1001, 10, False, "archive-too-many-entries"),
        (10, "pptx", False, 10, 200 * 2**20 + 1, False, "archive-too-large"), (10, "docx", False, 10, 10, False, "unsupported-format"), (10, "xlsx", False, 10, 10, False, "unsupported-format"), (10, "zip", False, 10, 10, False, "unsupported-format"),
        (10, "zip", False, None, None, True, "damaged-archive"), (10, "txt", False, None, None, False, "unreadable-format"), (10, "other", False, None, None, False, "unreadable-format"), (10, "docx", False, 1001, 10, False, "archive-too-many-entries"),
    ],
)
def test_admission(spark, size, kind, encrypted, entries, inflated, damaged, want):
    got = one(spark, documents.admission(F.lit(size).cast("long"), F.lit(kind), F.lit(encrypted), F.lit(entries).cast("int"), F.lit(inflated).cast("long"), F.lit(damaged)))
    assert got == want


@pytest.mark.parametrize(
    ("name", "file_format", "want"),
    [
        ("Week 3 unit.pdf", "pdf", "slides"), ("notes.pdf", "pdf", "reading"), ("HBS 9-102.pdf", "pdf", "case"), ("course-guide.pdf", "pdf", "syllabus"), ("thread.pdf", "pdf", "reading"), ("notes.pptx", "pptx", "slides"), ("S12.pdf", "pdf", "slides"),
        ("s123.pdf", "pdf", "reading"), ("SYLLABUS case.pdf", "pdf", "syllabus"), ("showcase.pptx", "pptx", "slides"), ("Chapter 4.pptx", "pptx", "reading"), ("Programme guide.pdf", "pdf", "syllabus"), ("week_3.pdf", "pdf", "reading"), ("decks.pdf", "pdf", "reading"),
    ],
)
def test_kind_of_name(spark, name, file_format, want):
    assert one(spark, documents.kind_of_name(F.lit(name), F.lit(file_format))) == want


@pytest.mark.parametrize(("kind", "pages", "slides", "want"), [("pdf", 7, None, 7), ("pptx", None, 9, 9), ("pdf", None, 3, None), ("pptx", 4, 0, None), ("docx", 4, 4, None)])
def test_source_units(spark, kind, pages, slides, want):
    assert one(spark, documents.source_units(F.lit(kind), F.lit(pages).cast("int"), F.lit(slides).cast("int"))) == want


@pytest.mark.parametrize(("name", "want"), [("a/b%c.pdf", "a-b-c.pdf"), ("...", "upload"), ("", "upload"), (" .hidden\\x ", ".hidden-x"), ("..x\n.pdf\x7f", "x.pdf"), (".. y", "y"), ("z" * 300, "z" * 200)])
def test_safe_filename(spark, name, want):
    assert one(spark, text.safe_filename(F.lit(name))) == want


@pytest.mark.parametrize(("title", "want"), [("Neural Networks", "neural-networks"), ("  Éa -- b!", "ea-b"), ("日本", "topic"), ("", "topic"), ("a" * 70, "a" * 60)])
def test_slug(spark, title, want):
    assert one(spark, text.slug(F.lit(title))) == want


@pytest.mark.parametrize(("prose", "want"), [('He said (ok.) Then. "Hi."', ["He said (ok.)", "Then.", '"Hi."']), ("One. Two", ["One.", "Two"]), ("...", []), ("Wait?!” she said", ["Wait?!”", "she said"]), ("", [])])
def test_sentences(spark, prose, want):
    assert one(spark, text.sentences(F.lit(prose))) == want


@pytest.mark.parametrize(
    ("signals", "sources", "recency", "formulas", "override", "want"),
    [(None, None, 0.0, None, None, 0.05), (1, 2, 1.0, 3, 2.5, 1.0), (1, 2, 1.0, 3, -1.0, 0.0), (1, 2, 1.0, 3, 0.4, 0.4), (1, 2, 1.0, 3, None, 0.05 + 0.475 / 2 + 0.285 / 2 + 0.19 / 2), (0, 2, 9.0, 0, None, 0.05 + 0.285 / 2), (0, 2, None, 0, None, 0.05 + 0.285 / 4)],
)
def test_exam_weight(spark, signals, sources, recency, formulas, override, want):
    args = (F.lit(x).cast("double") for x in (signals, sources, recency, formulas, override))
    assert one(spark, M.exam_weight(*args)) == pytest.approx(want)


@pytest.mark.parametrize(("chars", "source", "new", "want"), [(90, 10, True, (9.0, True)), (80, 10, True, (8.0, False)), (90, 10, False, (9.0, False)), (5, 0, True, (INF, True)), (5, 0, False, (INF, False))])
def test_expansion(spark, chars, source, new, want):
    row = spark.range(1).select(*pages.expansion(F.lit("x" * chars), F.lit(source), F.lit(new))).first()
    assert tuple(row) == want


def test_chunks_merge_and_split():
    small = {"page": 1, "to_page": 1, "title": "A", "body": "x" * 100}
    merged = documents.merge_small([small, {**small, "page": 2, "to_page": 2, "title": "B", "body": "y" * 1200}])
    assert [(u["page"], u["to_page"], u["title"]) for u in merged] == [(1, 2, "A · B")]
    long = {"page": 3, "to_page": 3, "title": "", "body": "\n\n".join("z" * 390 for _ in range(12))}
    parts = documents.split_unit(long)
    assert [p[2] for p in parts] == list(range(1, len(parts) + 1)) and all(p[4] <= 600 for p in parts) and len(parts) > 2


def test_strip_document(spark):
    page = '{"notes":[{"id":"a","heading":"h","markdown":"m","sources":[{"documentId":"d1","page":1}]},{"id":"b","heading":"h","markdown":"m","sources":[{"documentId":"d1","page":1},{"documentId":"d2","page":2}]},{"id":"c","heading":"h","markdown":"m","sources":[]}]}'
    df = spark.createDataFrame([("t", page)], "topic_id string, j string").select("topic_id", topics.parse_page(F.col("j")).alias("page"))
    rows = {r.key: r.sources for r in topics.blocks(topics.strip_document(df, "d1")).collect()}
    assert set(rows) == {"note:b", "note:c"} and [s.documentId for s in rows["note:b"]] == ["d2"]
    assert topics.parse_page is not None and spark.createDataFrame([("t", "broken")], "topic_id string, j string").select("topic_id", topics.parse_page(F.col("j")).alias("page")).count() == 1
