"""Extraction, review and page-check queries, on rows derived from the driver tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators import extractions as X
from ..operators import pages as P
from ..operators import topics as T
from ..sources.tables import scan
from . import star


def conversations(spark, folder):
    return scan(spark, folder, "conversations", "conv_id", "turn", "role").dropDuplicates(["conv_id", "turn"])


def page_blocks(spark, folder):
    """Conversations as topics; each turn is a note that cites page `turn` of document d0..d2."""
    c = conversations(spark, folder)
    cite = F.struct(F.concat(F.lit("d"), F.col("turn") % 3).alias("documentId"), F.col("turn").cast("int").alias("page"))
    return c.select(F.col("conv_id").alias("topic_id"), F.col("turn").cast("string").alias("key"), F.array(cite).alias("sources"))


def citation_findings(spark, folder):
    b = page_blocks(spark, folder)
    routed = b.select("topic_id", F.explode("sources").alias("s")).select("topic_id", F.col("s.documentId").alias("document_id"), F.col("s.page").alias("page")).where("(topic_id + page) % 4 <> 0")
    docs = spark.createDataFrame([("d0", True, 0), ("d1", False, 0), ("d2", True, 2)], "document_id string, checked boolean, unaccounted int")
    return P.citation_findings(b, routed, docs).groupBy("document_id", "kind", "severity").agg(F.count("*").alias("n"), F.count_distinct("topic_id").alias("topics"))


def uncited_pages(spark, folder):
    """Every topic was routed pages 0..7 of d1."""
    b = page_blocks(spark, folder)
    routed = b.select("topic_id").distinct().select("topic_id", F.lit("d1").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("page"))
    return P.uncited_pages(b, routed).select("topic_id", "routed", "cited", "subject")


def extraction_fan_out(spark, folder):
    o = scan(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    part = lambda k, w, s: F.struct(F.concat(F.lit(f" C{k} "), "o_orderkey").alias("title"), w.alias("weight"), F.lit(k).alias("session"), s.alias("snippet"))
    price = F.format_string("%d.00", F.floor(F.col("o_totalprice")) % 100)
    rows = o.select(F.col("o_orderkey").alias("extraction_id"), F.col("o_custkey").alias("course_id"), F.to_json(F.array(part(1, price, F.lit("s")), part(2, F.lit(" "), F.lit("t")), part(3, F.lit("5"), F.lit("  ")))).alias("components"))
    return X.fan_out(rows)[1].select("extraction_id", "ord", "title", F.col("weight_percent").cast("double").alias("weight"), "session_number")


def extraction_confirm(spark, folder):
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("extraction_id"), F.col("o_custkey").alias("course_id"))
    heads = o.withColumn("state", F.when(F.col("extraction_id") % 5 == 0, "confirmed").otherwise("pending"))
    courses = scan(spark, folder, "customer", F.col("c_custkey").alias("course_id")).withColumn("total_sessions", F.lit(7).cast("long"))
    decided = o.where("extraction_id % 10 IN (0, 3)").select("extraction_id", F.when(F.col("extraction_id") % 20 != 3, F.col("extraction_id") % 40).alias("sessions"))
    return X.confirm(heads, courses, decided, F.lit("2026-01-01").cast("timestamp"), human=True)[1]


def extraction_reject(spark, folder):
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("extraction_id"), F.col("o_custkey").alias("course_id"))
    heads = o.withColumn("state", F.when(F.col("extraction_id") % 5 == 0, "confirmed").otherwise("pending"))
    return X.reject(heads, o, o.where("extraction_id % 2 = 0").select("extraction_id"))[1].select("extraction_id")


def topic_creation(spark, folder):
    """Parts as topics of their brand; those under 40 are there already, a third of them with a number behind."""
    p = scan(spark, folder, "part", "p_partkey", "p_brand", "p_name")
    base = slug(F.col("p_name"))
    old = p.where("p_partkey < 40").select(F.col("p_brand").alias("course_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(base, F.lit("-2"))).otherwise(base).alias("slug")).distinct()
    new = p.where("p_partkey >= 40").select(F.col("p_brand").alias("course_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), base.alias("slug"))
    return X.create_topics(old, new)[0].select("course_id", F.col("ord").alias("p_partkey"), "slug")


def review_staleness(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    snaps = lines.select(F.col("l_orderkey").alias("review_id"), F.col("l_partkey").alias("topic_id"), F.col("l_linenumber").alias("revision"))
    now = scan(spark, folder, "part", F.col("p_partkey").alias("topic_id"), (F.col("p_size") % 6).alias("revision")).where("topic_id % 9 <> 0")
    return X.changed_since(snaps, now)


def prior_contributions(spark, folder):
    lines = scan(spark, folder, "lineitem", F.col("l_partkey").alias("topic_id"), F.col("l_linenumber").alias("revision"), "l_quantity")
    return X.prior_contributions(lines.where("l_quantity < 10"), lines.where("l_quantity > 45"))


def materials_through(spark, folder):
    """Customers as courses, their orders as documents: the label of the newest."""
    o = scan(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    rows = o.select(F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(" Session "), F.col("o_orderkey") % 20)).otherwise("  ").alias("session_label"), F.concat("o_orderpriority", F.lit(".pdf")).alias("filename"))
    return X.materials_through(rows)


def weight_recompute(spark, folder):
    """Topics (orders) whose weight of line items differs from the stored one, which every fourth has already."""
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    per = lines.groupBy(F.col("l_orderkey").alias("topic_id")).agg(F.count("*").alias("signals"), F.count_distinct("l_returnflag").alias("sources"), F.count_if(F.col("l_linestatus") == "F").alias("formulas"))
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("topic_id"), F.col("o_custkey").alias("course_id"), F.col("o_orderdate").alias("updated_at"))
    rows = o.join(per, "topic_id").select("*", F.lit(0).alias("examples"), F.lit(None).cast("double").alias("override"))
    now = T.topic_weights(rows).select(*rows.columns, F.when(F.col("topic_id") % 4 == 0, F.col("weight")).when(F.col("topic_id") % 4 == 1, F.col("weight") + 0.00005).when(F.col("topic_id") % 4 == 2, F.lit(0.0)).alias("exam_weight"))
    return T.recomputed_weights(now).select("topic_id", F.round("weight", 9).alias("weight"))


def matcher_rows(spark, folder):
    """Suppliers' matchers, and one more that is new for one course and there for another."""
    s = scan(spark, folder, "supplier", F.concat(F.lit("c"), F.col("s_suppkey") % 3).alias("course_id"), F.concat(F.lit("Word "), F.col("s_suppkey") % 2).alias("pattern"))
    return X.add_matcher(X.add_matcher(s, " word 1 ", "c0"), "word 7", "c1").groupBy("course_id", "pattern").agg(F.count("*").alias("n"))


def newest_flagged(spark, folder):
    o = scan(spark, folder, "orders", F.col("o_custkey").alias("topic_id"), F.col("o_orderkey").alias("revision"), (F.col("o_orderstatus") == "F").alias("needs_review"))
    return X.newest_flagged(o)


def bulk_file(spark, folder):
    p = scan(spark, folder, "part", "p_partkey", F.col("p_name").alias("raw_summary"), F.col("p_type").alias("title"), F.when(F.col("p_size") % 2 == 0, "c0").alias("course_id"))
    return X.bulk_file(p.withColumn("locks", F.array(F.lit("title"))), "WIDGET economy", "c9").select("p_partkey", "course_id", F.array_join("locks", ",").alias("locks"))


def exam_choice(spark, folder):
    """Orders as items: every seventh is flagged, every eleventh set by hand, every fifth locked; a third of the customers each set their last
    order, reject their first one, or reset."""
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("course_id"))
    items = o.select("id", "course_id", (F.col("id") % 7 == 0).alias("is_exam"), F.when(F.col("id") % 11 == 0, "manual").when(F.col("id") % 7 == 0, "detected").alias("source"), F.when(F.col("id") % 5 == 0, F.array(F.lit("is_exam_candidate"), F.lit("title"))).alias("locks"))
    intent = F.element_at(F.array(F.lit("set"), F.lit("reject"), F.lit("reset")), (F.col("course_id") % 3 + 1).cast("int"))
    decisions = o.groupBy("course_id").agg(F.max("id").alias("_last"), F.min("id").alias("_first")).select("course_id", intent.alias("intent"), F.when(F.col("course_id") % 3 == 0, F.col("_last")).otherwise(F.col("_first")).alias("id"))
    return X.decide_exam(items, decisions).select("id", "course_id", "is_exam", "source", F.array_join("locks", ",").alias("locks"))


def audit_verdicts(spark, folder):
    ev = scan(spark, folder, "events", F.col("event_id").alias("verdict_id"), F.col("user_id").alias("topic_id"), "event_type")
    names = F.create_map(*(F.lit(x) for x in ("click", "covered", "view", "refine", "purchase", "conflict", "error", "missing", "signup", "other")))
    return X.audit_actions(ev.withColumn("verdict", names[F.col("event_type")]), ev.where("topic_id % 4 <> 0").select("topic_id"))


def strip_plan(spark, folder):
    """Conversations as topics, what deleting document d1 would do to each."""
    c = conversations(spark, folder)
    cite = F.struct(F.concat(F.lit("d"), F.col("turn") % 2).alias("documentId"), F.lit(1).alias("page"))
    note = F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("heading"), F.lit("m").alias("markdown"), F.array(cite).alias("sources"))
    pages = c.groupBy(F.col("conv_id").alias("topic_id")).agg(F.to_json(F.struct(F.lit("s").alias("summary"), F.collect_list(note).alias("notes"))).alias("j")).select("topic_id", T.parse_page(F.col("j")).alias("page"))
    sources = c.select(F.col("conv_id").alias("topic_id"), F.concat(F.lit("d"), F.col("turn") % 2).alias("document_id")).where("document_id = 'd1' OR topic_id % 2 = 0")
    return P.strip_plan(sources, pages, "d1")


QUERIES = {
    f.__name__: f
    for f in (
        citation_findings, uncited_pages, extraction_fan_out, extraction_confirm, extraction_reject, topic_creation, review_staleness, prior_contributions,
        materials_through, weight_recompute, matcher_rows, newest_flagged, bulk_file, exam_choice, audit_verdicts, strip_plan,
    )
}
TURNS = "SELECT DISTINCT conv_id, turn FROM conversations"
ORACLES = {
    "citation_findings": f"""WITH c AS (SELECT conv_id, 'd' || turn % 3 AS document_id FROM ({TURNS}) WHERE (conv_id + turn) % 4 = 0)
 SELECT document_id, CASE document_id WHEN 'd0' THEN 'phantom-locator' ELSE 'unverifiable-locator' END AS kind, CASE document_id WHEN 'd0' THEN 'red' ELSE 'amber' END AS severity, count(*) AS n, count(DISTINCT conv_id) AS topics FROM c GROUP BY document_id""",
    "uncited_pages": f"SELECT conv_id AS topic_id, CAST(8 AS BIGINT) AS routed, count(*) FILTER (turn % 3 = 1 AND turn < 8) AS cited, CAST(8 - count(*) FILTER (turn % 3 = 1 AND turn < 8) AS VARCHAR) || ' of 8 pages' AS subject FROM ({TURNS}) GROUP BY conv_id",
    "extraction_fan_out": """SELECT o_orderkey AS extraction_id, CAST(k - 1 AS INTEGER) AS ord, 'C' || k || ' ' || o_orderkey AS title, CASE WHEN k = 1 THEN CAST(floor(o_totalprice) % 100 AS DOUBLE) END AS weight, CAST(k AS INTEGER) AS session_number FROM orders, range(1, 3) t(k)""",
    "extraction_confirm": """SELECT c_custkey AS course_id, CAST(coalesce((SELECT max(CASE WHEN o_orderkey % 20 <> 3 THEN o_orderkey % 40 END) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 10 = 3), 7) AS BIGINT) AS total_sessions FROM customer""",
    "extraction_reject": "SELECT o_orderkey AS extraction_id FROM orders WHERE o_orderkey % 2 <> 0 OR o_orderkey % 5 = 0",
    "topic_creation": """WITH p AS (SELECT *, replace(lower(p_name), ' ', '-') AS base FROM part), t AS (SELECT DISTINCT p_brand, base, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM p WHERE p_partkey < 40), k AS (SELECT p_brand, base, list(n) AS taken FROM t GROUP BY ALL),
 r AS (SELECT p_brand, p_partkey, p.base, row_number() OVER (PARTITION BY p_brand, p.base ORDER BY p_partkey) AS i, coalesce(taken, []) AS taken FROM p LEFT JOIN k USING (p_brand, base) WHERE p_partkey >= 40),
 f AS (SELECT *, list_filter(range(1, i + 4), lambda n: NOT list_contains(taken, n))[i] AS n FROM r) SELECT p_brand AS course_id, p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM f""",
    "review_staleness": """WITH c AS (SELECT l_orderkey AS review_id, count(*) FILTER (p_partkey IS NULL OR p_size % 6 > l_linenumber) AS changed FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 9 <> 0 GROUP BY 1) SELECT *, changed > 0 AS stale FROM c""",
    "prior_contributions": """WITH a AS (SELECT l_partkey AS k, max(l_linenumber) AS m FROM lineitem WHERE l_quantity < 10 GROUP BY 1), b AS (SELECT DISTINCT l_partkey AS k, true AS p FROM lineitem WHERE l_quantity > 45)
 SELECT k AS topic_id, m AS snapshot_revision, coalesce(p, false) AS has_provenance FROM a FULL JOIN b USING (k)""",
    "materials_through": """WITH l AS (SELECT o_custkey AS course_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1) SELECT course_id, CASE WHEN k % 3 <> 0 THEN 'Session ' || k % 20 ELSE p || '.pdf' END AS label FROM l""",
    "weight_recompute": f"SELECT topic_id, weight FROM ({star.ORACLES['exam_weight']}) WHERE topic_id % 4 IN (2, 3)",
    "matcher_rows": """WITH s AS (SELECT 'c' || s_suppkey % 3 AS course_id, 'Word ' || s_suppkey % 2 AS pattern FROM supplier UNION ALL SELECT 'c1', 'word 7') SELECT course_id, pattern, count(*) AS n FROM s GROUP BY ALL""",
    "newest_flagged": "SELECT count(*) FILTER (s = 'F') AS flagged FROM (SELECT arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey)",
    "bulk_file": """WITH h AS (SELECT *, p_size % 2 <> 0 AND contains(lower(p_name || ' ' || p_type), 'widget economy') AS hit FROM part) SELECT p_partkey, CASE WHEN hit THEN 'c9' WHEN p_size % 2 = 0 THEN 'c0' END AS course_id, CASE WHEN hit THEN 'course_id,title' ELSE 'title' END AS locks FROM h""",
    "exam_choice": """WITH i AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 7 = 0 AS e, CASE WHEN o_orderkey % 11 = 0 THEN 'manual' WHEN o_orderkey % 7 = 0 THEN 'detected' END AS s, o_orderkey % 5 = 0 AS locked,
 o_custkey % 3 AS k, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders),
 n AS (SELECT *, k = 0 AND id = last AS ne, CASE WHEN k = 0 AND id = last THEN 'manual' END AS ns, CASE WHEN k = 2 THEN CASE WHEN locked THEN 'title' ELSE '' END WHEN locked THEN 'is_exam_candidate,title' ELSE 'is_exam_candidate' END AS nl FROM i
 WHERE CASE WHEN k = 2 THEN locked ELSE e OR coalesce(s = 'manual', false) OR id = CASE WHEN k = 0 THEN last ELSE first END END)
 SELECT id, c AS course_id, ne AS is_exam, ns AS source, nl AS locks FROM n WHERE e <> ne OR s IS DISTINCT FROM ns OR nl <> CASE WHEN locked THEN 'is_exam_candidate,title' ELSE '' END""",
    "audit_verdicts": """SELECT event_id AS verdict_id, CASE WHEN event_type = 'click' THEN 'skip' WHEN event_type = 'error' THEN 'create-topic' WHEN user_id % 4 = 0 THEN 'ignore' WHEN event_type = 'view' THEN 'append-note' WHEN event_type = 'purchase' THEN 'open-question' ELSE 'ignore' END AS action FROM events""",
    "strip_plan": f"""WITH p AS (SELECT conv_id, conv_id % 2 = 0 AND count(*) FILTER (turn % 2 = 0) > 0 AS kept, count(*) FILTER (turn % 2 = 1) AS n FROM ({TURNS}) GROUP BY conv_id HAVING count(*) FILTER (turn % 2 = 1) > 0)
 SELECT conv_id AS topic_id, CASE WHEN kept THEN 'rewrite-page' ELSE 'remove-topic' END AS plan, CASE WHEN kept THEN n ELSE 0 END AS lost, CAST(0 AS BIGINT) AS unattributed, kept AS stale FROM p""",
}
