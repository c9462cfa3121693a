"""Exam status, routing decisions, topic pages and their checks, on rows derived from the driver tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calendar, documents, routing, topics
from ..sources.tables import scan, scan_dealt
from . import study

SEMESTERS = (("1995-02-01", "1995-06-30"), ("1995-09-01", "1996-01-31"), ("1997-02-01", "1997-06-30"))


def feed_items(spark, folder):
    """Orders as feed items of their customer's course; every fifth has no session number and names a re-sit."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    numbered = F.col("o_orderkey") % 5 != 0
    first = (F.col("o_orderkey") % 12 + 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("uid"), F.col("o_custkey").alias("course_id"), F.col("o_orderdate").cast("timestamp").alias("starts_at"),
        F.when(numbered, first).alias("session_from"), F.when(numbered, first + (F.col("o_orderkey") % 2).cast("int")).alias("session_to"),
        F.when(numbered, F.lit("Class")).otherwise(F.concat(F.lit("Retake "), "o_orderpriority")).alias("raw_summary"),
        (F.col("o_orderkey") % 97 == 0).alias("is_exam_candidate"), F.when(F.col("o_orderkey") % 2 == 0, "manual").otherwise("feed").alias("detection_source"),
        F.when(F.col("o_orderkey") % 53 == 0, F.array(F.lit("is_exam_candidate"))).alias("locked"),
    )


def course_rows(spark, folder):
    c = scan(spark, folder, "customer", F.col("c_custkey").alias("course_id"), F.col("c_name").alias("title"))
    source = F.when(F.col("course_id") % 6 == 0, "syllabus").when(F.col("course_id") % 6 == 3, "manual")
    return c.withColumn("total_sessions", F.when(F.col("course_id") % 3 == 0, F.lit(10))).withColumn("total_sessions_source", source)


def exam_rows(spark, folder):
    o = scan(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").where("o_orderpriority = '1-URGENT'")
    return o.select(F.col("o_custkey").alias("course_id"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "The final").otherwise("Part").alias("title"), F.lit("Written exam").alias("kind"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("session_number"), (F.col("o_orderkey") % 2 == 0).alias("confirmed"))


def semester_rows(spark):
    return spark.createDataFrame(list(SEMESTERS), "a string, b string").select(F.to_date("a").alias("starts_on"), F.to_date("b").alias("ends_on"))


def exam_status(spark, folder):
    """What may be claimed of the exam of every course with events."""
    out = calendar.exam_statuses(course_rows(spark, folder), feed_items(spark, folder), exam_rows(spark, folder), semester_rows(spark))
    return out.select("course_id", "outcome", "source", "confidence", "decision", "confirmed", "item_id", F.col("session").cast("int").alias("session"), F.unix_timestamp("starts_at").alias("starts_at"), F.col("declared").cast("int").alias("declared"), "feed_max", "outside_semester")


def exam_retakes(spark, folder):
    """Re-sits after each course's exam."""
    items = feed_items(spark, folder)
    exams = calendar.detect_exams(items, course_rows(spark, folder), exam_rows(spark, folder))
    return calendar.retakes(items, exams).groupBy("course_id").agg(F.count("*").alias("n"), F.min("uid").alias("first"))


def semester_bounds(spark, folder):
    """Orders' times by whether a semester holds them, with its whole last day and with its first instant only."""
    o = scan(spark, folder, "orders", "o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT))")).alias("starts_at"))
    view = calendar.semester_flags(o, semester_rows(spark)).select("o_orderkey", F.col("outside_semester").alias("in_view"))
    sync = calendar.semester_flags(o, semester_rows(spark), whole_last_day=False).select("o_orderkey", F.col("outside_semester").alias("in_sync"))
    return view.join(sync, "o_orderkey").groupBy("in_view", "in_sync").agg(F.count("*").alias("n"))


def routing_decisions(spark, folder):
    """Orders of a customer as a batch's decisions, in order of their key, on five segments of which decisions name six."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_custkey")
    segment = F.col("o_orderkey") % 6
    decisions = o.select(
        F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("s"), segment).alias("segment_key"),
        F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("t"), F.col("o_orderkey") % 3)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("new  TITLE "), F.col("o_orderkey") % 2)).otherwise("").alias("assign_to"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" New Title "), F.floor(F.col("o_orderkey") / 4) % 2)).otherwise("").alias("new_title"),
    )
    segments = decisions.select("batch_id").distinct().select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("batch_id", F.concat(F.lit("s"), "k").alias("segment_key"), F.concat(F.lit("Segment "), "k").alias("title"))
    known = spark.createDataFrame([("t0",), ("t1",)], "topic_id string")
    return routing.resolve_decisions(decisions, segments, known)


def signals_per_topic(spark, folder):
    return routing.signals_per_topic(study.signal_mapping(spark, folder))


def turn_blocks(spark, folder):
    """Conversations as topics, their turns as blocks that cite a page: every fourth topic's all cite the same."""
    c = scan(spark, folder, "conversations", "conv_id", "turn", "role").dropDuplicates(["conv_id", "turn"])
    one = F.col("conv_id") % 4 == 0
    cite = F.struct(F.when(one, "d0").otherwise(F.concat(F.lit("d"), F.col("turn") % 3)).alias("documentId"), F.when(one, 1).otherwise(F.col("turn")).cast("int").alias("page"))
    empty = F.array().cast(f"array<{topics.SOURCE}>")
    sources = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0), empty).otherwise(F.array(cite))
    return c.select(F.col("conv_id").alias("topic_id"), F.col("turn").cast("string").alias("key"), F.lit("note").alias("kind"), sources.alias("sources"))


def provenance_report(spark, folder):
    """d0 and d1 have five pages read."""
    read = spark.range(0, 2).select(F.concat(F.lit("d"), "id").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("page"))
    return topics.provenance_report(turn_blocks(spark, folder), read)


def locator_units(spark, folder):
    p = scan(spark, folder, "part", "p_partkey", "p_size")
    at = F.struct(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).when(F.col("p_partkey") % 3 == 1, F.lit(float("nan"))).alias("page"), F.when(F.col("p_partkey") % 2 == 0, F.lit(7.0)).alias("slide"))
    return p.select("p_partkey", topics.locator_unit(at).alias("unit"))


def page_revert(spark, folder):
    """Customers as topics at revision 3 with two older pages; every second is put back to revision 1, every fifth to one that
    never was."""
    c = scan(spark, folder, "customer", F.col("c_custkey").alias("topic_id"), "c_name")
    current = c.select("topic_id", F.lit(3).alias("revision"), F.col("c_name").alias("page"))
    history = c.select("topic_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("revision"), "c_name").select("topic_id", "revision", F.concat_ws("/", "c_name", "revision").alias("page"))
    wanted = c.where("topic_id % 2 = 0 OR topic_id % 5 = 0").select("topic_id", F.when(F.col("topic_id") % 5 == 0, 9).otherwise(1).alias("revision"))
    after, kept = topics.revert(current, history, wanted)
    return after.withColumn("state", F.lit("current")).unionByName(kept.withColumn("state", F.lit("history")))


def snapshot_reader(spark, folder):
    """Snapshots of two spellings, one entry in seven of which can't be read."""
    c = scan(spark, folder, "customer", "c_custkey")
    entry = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"topicId":"t'), "c_custkey", F.lit('","revision":2}'))).otherwise(F.concat(F.lit('{"topic_id":"t'), "c_custkey", F.lit('","revision":4}')))
    bad = F.when(F.col("c_custkey") % 7 == 0, F.lit(',{"topicId":"x"}')).when(F.col("c_custkey") % 7 == 1, F.lit(",null")).otherwise("")
    json = F.when(F.col("c_custkey") % 11 == 0, entry).otherwise(F.concat(F.lit("["), entry, bad, F.lit("]")))
    pairs = topics.read_snapshot(json)
    return c.select("c_custkey", pairs.isNotNull().alias("read"), F.get(pairs, 0)["topicId"].alias("topic"), F.get(pairs, 0)["revision"].alias("revision"))


def diff_labels(spark, folder):
    """Each customer's orders by what remains of a diff's counts."""
    o = scan(spark, folder, "orders", "o_custkey", "o_orderkey")
    n = o.groupBy("o_custkey").agg(*(F.count_if(F.col("o_orderkey") % 3 == k).alias(name) for k, name in enumerate(("removed", "changed", "added"))), F.count("*").alias("n"))
    return n.select("o_custkey", topics.diff_label(F.col("added"), F.col("changed"), F.col("removed"), F.lit(True)).alias("label"), topics.counted(F.col("n"), "order").alias("orders"))


def chunk_units(spark, folder):
    """Documents' lines as pages, English ones as readings: their lines of under 40 characters are headings of level 1 to 3."""
    d = scan_dealt(spark, folder, "documents", "doc_id", "text", "lang").where("doc_id IS NOT NULL")
    lines = d.select("doc_id", F.when(F.col("lang") == "en", "reading").otherwise("slides").alias("kind"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "markdown")).select("doc_id", "kind", (F.col("i") + 1).alias("page"), F.lit(None).cast("string").alias("title"), "markdown")
    heads = lines.where((F.length("markdown") < 40) & (F.length("markdown") > 0)).select("doc_id", F.lit(1).alias("ord"), "page", (F.col("page") % 3 + 1).alias("level"), F.col("markdown").alias("text"))
    return documents.units_of(lines, heads).select("doc_id", "page", "to_page", F.length("title").alias("title_length"), F.sha2("markdown", 256).alias("hash"))


def topic_page_chunks(spark, folder):
    """Conversations as topic pages, their turns as sections; a section of up to 800 tokens is a single chunk."""
    c = scan(spark, folder, "conversations", "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").dropDuplicates(["conv_id", "turn"])
    rows = c.select(F.col("conv_id").alias("topic_id"), F.col("turn").cast("string").alias("section"), F.lit("").alias("heading"), F.concat_ws(" ", F.lit("Turn"), F.col("turn").cast("string"), "role").alias("markdown"))
    return documents.chunk_topic_pages(rows).select("topic_id", "section", "part", "content", "token_count")


def feed_summaries(spark, folder):
    """Parts as raw feed summaries: their names, a kind of session, its numbers, and the room that the location repeats."""
    p = scan(spark, folder, "part", "p_partkey", "p_name", "p_size")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("", "Extra", "Retake Exam June", "Final exam", "| | , null"))), (k % 5 + 1).cast("int"))
    numbers = F.when(k % 3 == 0, F.concat(F.lit("(Ses. "), "p_size", F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("(Ses. "), "p_size", F.lit("-"), F.col("p_size") + 1, F.lit(")"))).otherwise("")
    room = F.format_string("T-%02d.%02d", k % 20, k % 7)
    rows = p.select("p_partkey", F.concat(F.upper("p_name"), F.lit("    "), kind, F.lit(" "), numbers, F.lit(" "), room).alias("raw"), F.when(k % 2 == 0, room).alias("location"))
    out = rows.select("p_partkey", *T.normalize_summary(F.col("raw"), F.col("location")))
    return out.withColumn("label", T.occurrence_label(F.col("title"), F.col("session_from"), F.col("session_to"), F.col("descriptor")))


def item_kinds(spark, folder):
    """Orders as items, classified by the six rules."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    kind = T.item_kind(
        F.when(k % 3 == 0, "Paper due Friday").otherwise("Overdue talk"), F.when(k % 10 == 0, F.lit(4)), F.when(k % 13 == 0, "extra").otherwise("regular"), k % 7 == 0, k % 2 == 0, k % 8 == 0,
        F.when(k % 5 == 0, F.array(F.lit("Weekly QUIZ"))).otherwise(F.array(F.lit("other"))), k % 4 == 0,
    )
    return o.select("o_orderkey", kind.alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        exam_status, exam_retakes, semester_bounds, routing_decisions, signals_per_topic, provenance_report, locator_units, page_revert, snapshot_reader,
        diff_labels, chunk_units, topic_page_chunks, feed_summaries, item_kinds,
    )
}

ITEMS = """i AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS uid, o_custkey AS c, o_orderdate AS atx, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 12 + 1 AS INTEGER) END AS f, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 12 + 1 + o_orderkey % 2 AS INTEGER) END AS t,
 o_orderkey % 97 = 0 AND o_orderkey % 2 = 0 AS chosen, o_orderkey % 97 <> 0 AND o_orderkey % 53 = 0 AS rejected FROM orders)"""
DETECT = f"""{ITEMS}, x AS (SELECT o_custkey AS c, arg_max(CAST(o_orderkey % 12 + 1 AS INTEGER), (o_orderstatus = 'F', o_orderkey % 12)) AS s FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 GROUP BY 1), m AS (SELECT c, max(t) AS m FROM i GROUP BY 1),
 k AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 = 0 THEN 'syllabus_total_sessions' WHEN x.s IS NOT NULL THEN 'assessment_session_number' WHEN m.m IS NOT NULL THEN 'feed_max_session' END AS source, CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE coalesce(x.s, m.m) END AS session, m.m AS feed FROM customer LEFT JOIN x ON x.c = c_custkey LEFT JOIN m ON m.c = c_custkey),
 e AS (SELECT k.c, k.source, k.session, k.feed, arg_min(i.id, (i.atx, i.uid)) AS id, min(i.atx) AS atx FROM k LEFT JOIN i ON i.c = k.c AND k.session BETWEEN i.f AND i.t GROUP BY ALL)"""
_terms = ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in SEMESTERS)
TERMS = f"terms(a, b) AS (VALUES {_terms})"

ORACLES = {
    "exam_status": f"""WITH {DETECT}, {TERMS},
 u AS (SELECT c, min(CASE WHEN chosen THEN id END) AS mine, bool_or(rejected) AS rejected FROM i GROUP BY c),
 r AS (SELECT e.*, u.mine, u.mine IS NULL AND u.rejected AS gone, v.atx AS mine_at, v.t AS mine_session, e.c % 6 AS six, EXISTS (SELECT 1 FROM terms WHERE e.atx BETWEEN a AND b + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND) AS inside FROM e JOIN u USING (c) LEFT JOIN i v ON v.id = u.mine)
 SELECT c AS course_id, CASE WHEN source IS NULL THEN 'unknown' WHEN id IS NULL THEN 'pending' ELSE 'found' END AS outcome, source,
 CASE WHEN source = 'assessment_session_number' THEN 'syllabus' WHEN source = 'syllabus_total_sessions' AND six = 0 THEN 'syllabus' WHEN source = 'syllabus_total_sessions' AND six = 3 THEN 'manual' ELSE 'feed_derived' END AS confidence,
 CASE WHEN mine IS NOT NULL THEN 'chosen' WHEN gone THEN 'rejected' ELSE 'detected' END AS decision, mine IS NOT NULL AS confirmed, coalesce(mine, id) AS item_id,
 CASE WHEN mine IS NOT NULL THEN coalesce(mine_session, 0) WHEN NOT gone AND id IS NOT NULL THEN session END AS session, CAST(epoch(CASE WHEN mine IS NOT NULL THEN mine_at WHEN NOT gone THEN atx END) AS BIGINT) AS starts_at,
 CASE WHEN c % 3 = 0 AND feed <> 10 THEN 10 END AS declared, CASE WHEN c % 3 = 0 AND feed <> 10 THEN feed END AS feed_max, atx IS NOT NULL AND NOT inside AS outside_semester FROM r""",
    "exam_retakes": f"WITH {DETECT} SELECT c AS course_id, count(*) AS n, min(i.uid) AS first FROM i JOIN e USING (c) WHERE i.f IS NULL AND (e.id IS NULL OR i.atx > e.atx) GROUP BY c",
    "semester_bounds": f"""WITH {TERMS}, o AS (SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS atx FROM orders)
 SELECT NOT EXISTS (SELECT 1 FROM terms WHERE atx BETWEEN a AND b + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND) AS in_view, NOT EXISTS (SELECT 1 FROM terms WHERE atx BETWEEN a AND b) AS in_sync, count(*) AS n FROM o GROUP BY ALL""",
    "routing_decisions": r"""WITH d AS (SELECT o_custkey AS b, o_orderkey AS ord, o_orderkey % 6 AS k, CASE WHEN o_orderkey % 4 = 1 THEN 't' || o_orderkey % 3 WHEN o_orderkey % 4 = 2 THEN 'new  TITLE ' || o_orderkey % 2 END AS ref, CASE WHEN o_orderkey % 4 = 0 THEN ' New Title ' || (o_orderkey // 4) % 2 END AS made FROM orders),
 n AS (SELECT *, lower(trim(regexp_replace(ref, '\s+', ' ', 'g'))) AS rk, lower(trim(regexp_replace(made, '\s+', ' ', 'g'))) AS mk, row_number() OVER (PARTITION BY b, k ORDER BY ord) AS nth FROM d),
 t AS (SELECT b, mk, arg_min(made, ord) AS title FROM n WHERE k < 5 AND ref IS NULL AND made IS NOT NULL GROUP BY b, mk),
 r AS (SELECT n.*, t.title, CASE WHEN k = 5 THEN 'unknown-segment' WHEN nth > 1 THEN 'duplicate-segment' WHEN ref IS NULL THEN 'created' WHEN ref IN ('t0', 't1') THEN 'assigned' WHEN t.title IS NOT NULL THEN 'batch-local' ELSE 'unresolvable' END AS how FROM n LEFT JOIN t ON t.b = n.b AND t.mk = n.rk)
 SELECT b AS batch_id, 's' || k AS segment_key, CASE WHEN how = 'assigned' THEN 'assign' WHEN how IN ('created', 'batch-local', 'unresolvable') THEN 'create' END AS kind, CASE WHEN how = 'assigned' THEN ref END AS topic_id,
 CASE WHEN how = 'batch-local' THEN title WHEN how IN ('created', 'unresolvable') THEN coalesce(made, 'Segment ' || k) END AS title, how FROM r
 UNION ALL SELECT DISTINCT o_custkey, 's' || g, NULL, NULL, NULL, 'no-decision' FROM orders o, range(5) x(g) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.b = o.o_custkey AND d.k = g)""",
    "signals_per_topic": f"SELECT topic_id, count(*) AS signals FROM ({study.ORACLES['signal_mapping']}) WHERE topic_id IS NOT NULL GROUP BY 1",
    "provenance_report": """WITH k AS (SELECT DISTINCT conv_id AS c, turn FROM conversations), x AS (SELECT c, turn, c % 7 = 0 AND turn = 0 AS bare, CASE WHEN c % 4 = 0 THEN 'd0' ELSE 'd' || turn % 3 END AS d, CASE WHEN c % 4 = 0 THEN 1 ELSE turn END AS p FROM k),
 y AS (SELECT c, count(*) AS blocks, count(*) FILTER (NOT bare) AS citations, count(*) FILTER (bare) AS without_sources, count(*) FILTER (NOT bare AND NOT (d <> 'd2' AND p BETWEEN 0 AND 4)) AS broken, count(*) FILTER (NOT bare AND d <> 'd2' AND p BETWEEN 0 AND 4) AS good,
 count(DISTINCT CASE WHEN NOT bare AND d <> 'd2' AND p BETWEEN 0 AND 4 THEN d || '#' || p END) AS places, 5 * count(DISTINCT CASE WHEN NOT bare AND d <> 'd2' THEN d END) AS pages_available FROM x GROUP BY c)
 SELECT c AS topic_id, blocks, citations, places, pages_available, without_sources, broken, good >= 3 AND places = 1 AND pages_available >= 4 AS collapse,
 (good >= 3 AND places = 1 AND pages_available >= 4) OR without_sources > 0 OR broken > 0 OR citations = 0 AS weak FROM y""",
    "locator_units": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_partkey % 2 = 0 THEN 7.0::DOUBLE END AS unit FROM part",
    "page_revert": """WITH c AS (SELECT c_custkey AS t, c_name, c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AS back FROM customer)
 SELECT t AS topic_id, CASE WHEN back THEN 4 ELSE 3 END AS revision, CASE WHEN back THEN c_name || '/1' ELSE c_name END AS page, 'current' AS state FROM c UNION ALL SELECT t, r, c_name || '/' || r, 'history' FROM c, (VALUES (1), (2)) v(r) UNION ALL SELECT t, 3, c_name, 'history' FROM c WHERE back""",
    "snapshot_reader": """WITH c AS (SELECT c_custkey AS k, c_custkey % 11 <> 0 AND c_custkey % 7 > 1 AS ok FROM customer) SELECT k AS c_custkey, ok AS read, CASE WHEN ok THEN 't' || k END AS topic, CASE WHEN ok THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 4 END END AS revision FROM c""",
    "diff_labels": """WITH n AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0) AS a, count(*) FILTER (o_orderkey % 3 = 1) AS b, count(*) FILTER (o_orderkey % 3 = 2) AS c, count(*) AS n FROM orders GROUP BY 1)
 SELECT o_custkey, concat_ws(' · ', CASE WHEN c > 0 THEN c || ' added' END, CASE WHEN b > 0 THEN b || ' rewritten' END, CASE WHEN a > 0 THEN a || ' removed' END) AS label, n || CASE WHEN n = 1 THEN ' order' ELSE ' orders' END AS orders FROM n""",
    "chunk_units": """WITH l AS (SELECT doc_id, coalesce(lang = 'en', false) AS r, generate_subscripts(l, 1) AS page, unnest(l) AS m FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL)),
 h AS (SELECT *, r AND length(m) BETWEEN 1 AND 39 AND page % 3 + 1 <= 2 AS head FROM l), a AS (SELECT *, NOT (r AND bool_or(head) OVER (PARTITION BY doc_id)) AS alone FROM h),
 g AS (SELECT *, sum(CASE WHEN alone OR head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM a)
 SELECT doc_id, CAST(min(page) AS INTEGER) AS page, CAST(max(page) AS INTEGER) AS to_page, CAST(length(coalesce(max(CASE WHEN head AND NOT alone THEN trim(m) END), '')) AS INTEGER) AS title_length,
 sha256(CASE WHEN bool_and(alone) THEN min(m) ELSE coalesce(string_agg(trim(m), chr(10) || chr(10) ORDER BY page) FILTER (trim(m) <> ''), '') END) AS hash FROM g GROUP BY doc_id, run""",
    "topic_page_chunks": """SELECT conv_id AS topic_id, CAST(turn AS VARCHAR) AS section, 0 AS part, 'Turn ' || turn || ' ' || role AS content, CAST(ceil(length('Turn ' || turn || ' ' || role)::DOUBLE / 4) AS INTEGER) AS token_count FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL)""",
    "feed_summaries": """WITH p AS (SELECT p_partkey, upper(p_name) AS course_name, ['', 'Extra', 'Retake Exam June', 'Final exam', ''][CAST(p_partkey % 5 + 1 AS INTEGER)] AS title, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS a, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 END AS b,
 ['regular', 'extra', 'retake', 'final_exam', 'regular'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS descriptor FROM part)
 SELECT p_partkey, course_name, title, CAST(a AS INTEGER) AS session_from, CAST(b AS INTEGER) AS session_to, descriptor, NULL::VARCHAR AS pseudo, CASE WHEN title <> '' THEN title WHEN b > a THEN 'Sessions ' || a || '–' || b WHEN a IS NOT NULL THEN 'Session ' || a ELSE 'Class' END AS label FROM p""",
    "item_kinds": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 13 = 0 THEN 'class' WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 'class' WHEN (o_orderkey % 2 <> 0 OR o_orderkey % 8 = 0) AND o_orderkey % 3 = 0 THEN 'deadline' WHEN o_orderkey % 5 = 0 THEN 'deadline' WHEN o_orderkey % 4 = 0 AND o_orderkey % 2 = 0 THEN 'class' ELSE 'event' END AS kind FROM orders""",
}
