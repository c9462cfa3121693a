"""Page checks, frozen plans, write-path invariants, feed state and scalar functions, on rows derived from the driver tables."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import math as M
from ..functions import text as T
from ..operators import calendar, documents, pages, relational, routing, sinks, topics
from ..sources import files, provider
from ..sources.tables import exists, scan, shared_folder, sized, timers
from ..streaming import changes
from .feeds import FEEDS, OCCURRENCES, ZONE, order_events, write_feeds


def grounding(spark, folder):
    """Parts as blocks: their names are terms, every third is a formula; even topics are new, every fifth topic's source displays mathematics."""
    p = scan(spark, folder, "part", "p_partkey", "p_name", "p_size")
    rows = p.select((F.col("p_partkey") % 500).alias("topic_id"), F.when(F.col("p_partkey") % 3 == 0, "formula").otherwise("keyTerm").alias("kind"), F.concat(F.lit(" "), F.col("p_name")).alias("label"))
    words = p.groupBy((F.col("p_partkey") % 500).alias("topic_id")).agg(F.min("p_name").alias("name"))
    sources = words.select("topic_id", F.concat(F.lit("a = b "), F.upper(F.regexp_replace("name", " ", "  ")), F.when(F.col("topic_id") % 5 == 0, F.lit(" $$x$$")).otherwise("")).alias("text"), (F.col("topic_id") % 2 == 0).alias("is_new"))
    return pages.grounding(rows, sources).groupBy("topic_id", "kind", "subject").agg(F.count("*").alias("n"))


def merge_verification(spark, folder):
    """Orders as findings of their customer's topic, red, amber or flag by key."""
    o = scan(spark, folder, "orders", F.col("o_custkey").alias("topic_id"), "o_orderkey")
    of = lambda k, level: o.where(F.col("o_orderkey") % 40 == k).select("topic_id", F.lit(level).alias("severity"))
    return pages.verification(of(0, "red"), of(1, "flag"), o.where("o_orderkey % 3 = 0").select("topic_id", F.lit("amber").alias("severity")))


def page_expansion(spark, folder):
    d = scan(spark, folder, "pages", "page_id", "html", "url")
    return d.select("page_id", *pages.expansion(F.col("html"), F.length("url") * (F.col("page_id") % 4), F.col("page_id") % 2 == 0)).select("page_id", F.round("ratio", 9).alias("ratio"), "implausible")


def delete_impact(spark, folder):
    """Customers' order states as topics' plans; a status's orders as a document's chunks."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    plan = F.when(F.col("o_orderkey") % 5 == 0, "remove-topic").when(F.col("o_orderkey") % 5 < 3, "rewrite-page").otherwise("unchanged")
    return pages.delete_impact(o.select(plan.alias("plan"), (F.col("o_orderkey") % 4).alias("lost"), (F.col("o_orderkey") % 3).alias("unattributed"), (F.col("o_orderkey") % 7 == 0).alias("stale")), o.select(F.col("o_orderstatus").alias("document_id")), "F")


def frozen_plans(spark, folder):
    """Plans frozen for even customers; of the proposed ones of a key the first counts."""
    o = scan(spark, folder, "orders", "o_custkey", "o_orderkey")
    frozen = o.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.lit("frozen").alias("plan"))
    used, _ = routing.freeze_plans(frozen, o.select("o_custkey", F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("plan")), ["o_custkey"])
    return used


def objective_triage(spark, folder):
    o = scan(spark, folder, "orders", "o_orderkey")
    rows = o.select(F.col("o_orderkey").alias("objective_id"), F.element_at(F.array(*map(F.lit, ("full", "none", "partial"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("coverage"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 10).alias("topic_id"))
    return routing.triage_objectives(rows, spark.range(0, 6).select(F.col("id").alias("topic_id")))


def merge_targets(spark, folder):
    """Each customer's orders in order of their day of the month, then key."""
    o = scan(spark, folder, "orders", F.col("o_custkey").alias("target"), F.dayofmonth("o_orderdate").alias("from_page"), F.col("o_orderkey").alias("segment_key"))
    return routing.merge_targets(o).select("target", F.array_join(F.transform("segments", lambda s: s.cast("string")), ",").alias("segments"))


def page_markdown(spark, folder):
    """Customers as pages of a note each, and a key term for even ones."""
    c = scan(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    note = F.struct(F.lit("n").alias("id"), F.col("c_name").alias("heading"), F.lower("c_mktsegment").alias("markdown"), F.array().cast(f"array<{topics.SOURCE}>").alias("sources"))
    term = F.struct(F.col("c_mktsegment").alias("term"), F.lit("a segment").alias("definition"), F.array().cast(f"array<{topics.SOURCE}>").alias("sources"))
    page = F.struct(F.lit("About").alias("summary"), F.array(note).alias("notes"), F.when(F.col("c_custkey") % 2 == 0, F.array(term)).otherwise(F.array()).alias("keyTerms"), F.lit(None).alias("formulas"), F.lit(None).alias("workedExamples"))
    parsed = c.select("c_custkey", topics.parse_page(F.to_json(page)).alias("page"))
    return parsed.select("c_custkey", F.inline(pages.page_sections(F.col("page"))))


def completeness_index(spark, folder):
    p = scan(spark, folder, "part", F.col("p_size").alias("course_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("title"))
    return pages.index_text(p).select("course_id", F.sha2("index", 256).alias("hash"))


def append_once(spark, folder):
    """A note added to each customer's, unless one of that id is there."""
    c = scan(spark, folder, "customer", "c_custkey")
    items = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("n"), i))
    return c.select("c_custkey", F.array_join(pages.append_once(items, F.lit("n3"), F.array_contains(items, "n3")), ",").alias("notes"))


def revision_bump(spark, folder):
    """Merges of every third customer: the page goes one revision up, the old one into the history."""
    c = scan(spark, folder, "customer", F.col("c_custkey").alias("topic_id"), F.col("c_name").alias("page")).withColumn("revision", F.col("topic_id").cast("int") % 5)
    merged = c.where("topic_id % 3 = 0").select("topic_id", F.upper("page").alias("page"))
    now, history = sinks.bump_revision(c, c.limit(0), merged, "topic_id")
    return now.select("topic_id", "revision", "page", F.lit("current").alias("state")).unionByName(history.select("topic_id", "revision", "page", F.lit("history").alias("state")))


def feed_state(spark, folder):
    """Suppliers as feeds: is a sync due, what is left of the rate limit, is the feed's body the known one?"""
    s = scan(spark, folder, "supplier", "s_suppkey", "s_name")
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    synced = F.when(F.col("s_suppkey") % 5 != 0, now - F.expr("make_interval(0, 0, 0, 0, 0, CAST(s_suppkey % 60 AS INT))"))
    body = F.col("s_name").cast("binary")
    known = F.when(F.col("s_suppkey") % 3 == 0, F.sha2(body, 256)).when(F.col("s_suppkey") % 3 == 1, "other")
    k = F.col("s_suppkey")
    layer = files.fetch_layer(F.when(k % 2 == 0, "t0"), F.when(k % 6 == 0, "t0").otherwise("t1"), F.when(k % 5 == 0, now), F.when(k % 10 == 0, now).otherwise(now + F.expr("INTERVAL 1 DAY")), known, body)
    left = calendar.remaining_ms(F.lit(60_000), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") * 1000))
    inside = calendar.horizon(now + F.expr("make_interval(0, 0, 0, CAST(s_suppkey % 400 - 100 AS INT))"), now)
    return s.select("s_suppkey", calendar.stale_feed(F.col("s_suppkey") % 7 != 0, synced, now).alias("stale"), left.cast("long").alias("left_ms"), files.unchanged(body, known).alias("unchanged"), inside.alias("inside"), layer.alias("layer"))


def wall_instants(spark, folder):
    """Orders' dates at the hour of their key as a wall clock in Madrid: the instant, its offset, and back."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderdate")
    wall = F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT))")
    at = D.to_instant(wall, "Europe/Madrid")
    plain = F.when(~((F.month("o_orderdate").isin(3, 9, 10)) & (F.dayofmonth("o_orderdate") >= 22) & (F.dayofweek("o_orderdate") == 1)), at)  # days without a change of clocks
    return o.select("o_orderkey", F.unix_timestamp(plain).alias("instant"), D.offset_seconds(plain, "Europe/Madrid").alias("offset"))


def unfiled_items(spark, folder):
    """Customers of no nation's course, the first 2,000 by key, with their orders nested: the inbox's limit is the feature."""
    c = scan(spark, folder, "customer", F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")).alias("course_id"))
    orders = scan(spark, folder, "orders", "o_custkey", "o_orderkey")
    rows = relational.nest(c.where("course_id IS NULL").orderBy("o_custkey").limit(2000), orders, "o_custkey", "orders", "o_orderkey")
    return rows.select("o_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


def sourceless_topics(spark, folder):
    """Customers as topics, their open orders as sources: the topics that stay."""
    o = scan(spark, folder, "orders", F.col("o_custkey").alias("topic_id"), "o_orderstatus").where("o_orderstatus = 'O'")
    return sinks.without_source(scan(spark, folder, "customer", F.col("c_custkey").alias("topic_id")), o)


def orphaned_chunks(spark, folder):
    """Chunks of topic pages go with their topic, documents' own stay."""
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("topic_id"), F.when(F.col("o_orderkey") % 2 == 0, "topic_page").otherwise("document").alias("source"))
    kept = scan(spark, folder, "customer", F.col("c_custkey").alias("topic_id")).where("topic_id % 3 <> 0")
    return sinks.without_topic(o, kept).groupBy("source").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


def touched_rows(spark, folder):
    """Every third order changed state: only those get a new time."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderstatus").withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 10 != 1, F.col("o_orderstatus")).alias("o_orderstatus"), "updated_at")
    out = sinks.touched(o, new, ["o_orderkey"], F.lit("2026-02-01").cast("timestamp"))
    return out.groupBy("o_orderstatus", F.date_format("updated_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def confirmed_rows(spark, folder):
    """New rows and re-tagged ones are unconfirmed."""
    o = scan(spark, folder, "orders", "o_orderkey", F.col("o_orderpriority").alias("kind"))
    old = o.where("o_orderkey % 2 = 0").withColumn("confirmed", F.lit(False))
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, "syllabus").otherwise(F.col("kind")).alias("kind"), (F.col("o_orderkey") % 5 != 0).alias("confirmed"))
    return sinks.unconfirmed(old, new, ["o_orderkey"], "kind").groupBy("confirmed").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def log_violations(spark, folder):
    """Rows of an append-only table that a new state lacks or changes, and merges that were done twice."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_orderkey % 8 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    lost = sinks.append_only(o.select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"])
    twice = sinks.merged_once(o.select(F.col("o_custkey").alias("topic_id"), F.col("o_orderstatus").alias("document_id")))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    return count(lost, "append only").unionByName(count(twice, "merged once"))


def merge_provenance(spark, folder):
    """Orders' days as cited pages of a status as document, upserted into those of old orders: pages distinct and in order."""
    o = scan(spark, folder, "orders", "o_orderkey", F.col("o_custkey").alias("topic_id"), F.col("o_orderstatus").alias("document_id"), F.dayofmonth("o_orderdate").alias("page"))
    old = sinks.upsert_provenance(o.limit(0).select("topic_id", "document_id", F.array("page").alias("pages")), o.where("o_orderkey % 2 = 0"))
    return sinks.upsert_provenance(old, o.where("o_orderkey % 3 = 0")).select("topic_id", "document_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def effective_order(spark, folder):
    """Topics of a course by their effective weight, the override before the computed one."""
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("topic_id"), F.col("o_custkey").alias("course_id"), (F.col("o_totalprice") / 500000).cast("double").alias("weight"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.9)).alias("override"))
    return topics.by_effective_weight(o).select("topic_id", F.round("effective", 9).alias("effective"), "place")


def review_index(spark, folder):
    """The first three topics of each customer as text for a review, with the course's exam format."""
    c = scan(spark, folder, "customer", "c_custkey", "c_name", "c_acctbal")
    weight = F.abs(F.col("c_acctbal")) / 10000
    lines = topics.topic_text(F.concat(F.lit("t"), "c_custkey"), F.col("c_name"), weight.cast("double"), F.when(F.col("c_custkey") % 2 == 0, " sum ").otherwise("  "), F.array(F.lit("F = ma")), F.array(F.lit(" mass "), F.lit("")), F.array().cast("array<string>"), F.array().cast("array<string>"))
    json = F.when(F.col("c_custkey") % 4 == 0, '{"length":"2h","parts":["a",1]}').when(F.col("c_custkey") % 4 == 1, '"open book"').when(F.col("c_custkey") % 4 == 2, "{}")
    return c.select("c_custkey", lines.alias("topic"), topics.exam_format(json).alias("format"))


def weight_writes(spark, folder):
    """Orders' weights that are worth a write."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_totalprice")
    old = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice") + (F.col("o_orderkey") % 3) * 0.00006)
    return o.where(M.changed_enough(F.col("o_totalprice"), old)).select("o_orderkey")


def first_positions(spark, folder):
    """The first place of each word in a text; only texts of one id are brought together."""
    d = scan(spark, folder, "documents", "doc_id", "text")
    again = sized(d.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1"))
    same = F.col("doc_id").eqNullSafe(F.col("again"))

    def firsts(texts):
        words = texts.select("doc_id", F.explode(T.word_places(F.split("text", " "))).alias("p"))
        return words.select("doc_id", F.col("p.word").alias("word"), F.element_at("p.places", 1).alias("first")).where("word <> ''")

    several = firsts(d.join(again, same, "left_semi")).groupBy("doc_id", "word").agg(F.min("first").alias("first"))
    return firsts(d.join(again, same, "left_anti")).unionByName(several)


def skip_sets(spark, folder):
    """Declared skips by what becomes of them: credible but read all the same, or discredited by their reason."""
    o = scan(spark, folder, "orders", "o_orderkey", F.col("o_custkey").alias("doc_id"), F.dayofmonth("o_orderdate").alias("page"))
    declared = o.where("o_orderkey % 3 = 0").select("doc_id", "page", F.when(F.col("o_orderkey") % 2 == 0, "N/A").otherwise("cover page").alias("reason"))
    read = o.where("o_orderkey % 5 = 0").select("doc_id", "page")
    skips, discredited = documents.skip_sets(declared, read)
    return skips.withColumn("set", F.lit("skipped")).unionByName(discredited.withColumn("set", F.lit("discredited")))


def sentence_counts(spark, folder):
    return scan(spark, folder, "documents", "doc_id", "text").select("doc_id", F.size(T.sentences(F.coalesce("text", F.lit("")))).alias("n"))


def canonical_hashes(spark, folder):
    """The hash of a record's JSON with its keys in order, whatever order they came in."""
    o = scan(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    pair = lambda k, v: F.concat(F.lit(f'"{k}": '), v)
    a, b, c = pair("b", F.col("o_custkey").cast("string")), pair("a", F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))), pair("c", F.lit('{"z":1,"y":[true,null]}'))
    raw = F.concat(F.lit("{ "), F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(" ,", a, b, c)).otherwise(F.concat_ws(",", c, b, a)), F.lit("}"))
    return o.select("o_orderkey", T.canonical_hash(raw).alias("hash"))


def late_labels(spark, folder):
    o = scan(spark, folder, "orders", "o_orderkey")
    return o.select("o_orderkey", T.ago_label(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 5000 * 30_000)).alias("label"))


def decks(batches):
    """Presentations of conversations: a slide a turn, listed against the order of its parts; every tenth is cut short."""
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shape = lambda text, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda body: f'<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>'
    links = lambda *xs: '<Relationships xmlns="x">' + "".join(f'<Relationship Id="{i}" Type="{rel}/{t}" Target="{to}"/>' for i, t, to in xs) + "</Relationships>"
    for b in batches:
        made = []
        for conv, turns in zip(b["conv_id"], b["turns"]):
            z, n = io.BytesIO(), len(turns)
            with zipfile.ZipFile(z, "w") as f:
                f.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{p}" xmlns:r="{rel}"><p:sldIdLst>' + "".join(f'<p:sldId id="{i}" r:id="r{i}"/>' for i in range(n)) + "</p:sldIdLst></p:presentation>")
                f.writestr("ppt/_rels/presentation.xml.rels", links(*((f"r{i}", "slide", f"slides/slide{n - i}.xml") for i in range(n))))
                for i, t in enumerate(turns):
                    f.writestr(f"ppt/slides/slide{n - i}.xml", slide(shape(f"{t['chars']} characters in turn {t['turn']}") + shape(t["role"], '<p:ph type="title"/>')))
                    f.writestr(f"ppt/slides/_rels/slide{n - i}.xml.rels", links(("n", "notesSlide", f"../notesSlides/note{i}.xml")))
                    f.writestr(f"ppt/notesSlides/note{i}.xml", slide(shape(f"notes {conv}")))
            made.append(z.getvalue()[: 40 if conv % 10 == 0 else None])
        yield pd.DataFrame({"path": b["conv_id"].astype(str), "content": made})


def deck_slides(spark, folder):
    """Conversations as decks."""
    c = scan(spark, folder, "conversations", "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").dropDuplicates(["conv_id", "turn", "role"])
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("none")).alias("role"), F.length(F.col("role")).alias("chars")))).alias("turns"))
    out = files.read_decks(turns.mapInPandas(decks, "path string, content binary"))
    return out.select("path", "slide", "title", "body", "notes", "words", F.col("error").isNotNull().alias("failed"))


def provider_sync(spark, folder):
    """The feeds of orders through the calendar data source; those whose name is 3, 13, 23 or 33 are known by their hash."""
    provider.register(spark)
    at = shared_folder(spark, "feeds")
    write_feeds(order_events(spark, folder), at)
    known = [r["cursor"] for r in provider.cursors(spark, at, "name=[0-9]*3/").collect()]  # four feeds
    out = spark.read.format("calendar_feed").options(**{"path": at, "timezone": ZONE, "from": "1980-01-01", "to": "2040-01-01", "known": json.dumps(known)}).load()
    name = F.regexp_extract("path", "name=([0-9]+)", 1).cast("long").alias("name")
    return out.groupBy(name, "changed", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.count_distinct("cursor").alias("cursors"))


def failed_deliveries(spark, folder):
    """Events as results: errors of even ids may be tried again up to the third time."""
    ev = scan(spark, folder, "events", "event_id", "event_type")
    rows = ev.select(F.col("event_id").alias("id"), (F.col("event_id") % 4 + 1).cast("int").alias("attempt"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("event_id") % 2 == 0).alias("retriable"))
    done, again, dead = changes.split_failures(rows)
    count = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("attempt").alias("attempts")).select(F.lit(name).alias("part"), "n", "attempts")
    return count(done, "done").unionByName(count(again, "again")).unionByName(count(dead, "dead"))


def late_subscriber(spark, folder):
    """A live view from a snapshot of the first half of all events, and a feed from a quarter on, in files; it is stopped between
    two of them and started again."""
    source, out, checkpoint = shared_folder(spark, "feed"), shared_folder(spark, "view"), shared_folder(spark, "ck")
    ev = scan(spark, folder, "events", F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("id"), F.lit("c").alias("course_id"), F.col("event_type").alias("body"))
    half = ev.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("n")).first()["n"] // 2
    snapshot = ev.where(F.col("seq") <= half).groupBy("id").agg(F.first("course_id").alias("course_id"), F.max("seq").alias("seq"), F.max_by("body", "seq").alias("body"))
    feed = ev.withColumn("op", F.lit("UPDATE"))
    for low, high in ((half // 2, half + half // 2), (half + half // 2, 2 * half + 2)):
        feed.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(source)
        changes.keep_view_from(snapshot, half, stream, out, checkpoint, buckets=8).trigger(availableNow=True).start().awaitTermination()
    return changes.read_view(spark, out).select("id", "body")


def keyed_turns(spark, folder):
    """Events of a user as jobs of one key, each in its turn."""
    out = shared_folder(spark, "turns")
    jobs = spark.readStream.schema("event_id long, user_id long").parquet(f"{folder}/event[s].parquet").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"))
    with timers(spark):
        changes.in_turn(jobs).writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "ck")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("id string, seq long, turn long").parquet(out)


def disappearances(spark, folder):
    """Sightings of users as a stream, in one batch: who is hidden, a day and the watermark's delay after the last sighting."""
    out = shared_folder(spark, "gone")
    seen = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").parquet(f"{folder}/event[s].parquet").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    with timers(spark):
        changes.disappearances(seen).writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "ck")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("id string, action string, at timestamp").parquet(out).select("id", "action", F.unix_timestamp("at").alias("at"))


def outcome(key: str, attempt: int) -> tuple[str | None, bool]:
    """A delivery that fails as often as its key says; every eleventh key's error is not worth a retry."""
    failing = attempt <= int(key) % 7
    return ("unavailable" if failing else None), int(key) % 11 != 0


def retried_deliveries(spark, folder):
    """A delivery for each user of the events, tried up to five times; pauses are a hundredth of a second here, doubled up to eight."""
    out, wanted = shared_folder(spark, "attempts"), scan(spark, folder, "events", "user_id").distinct().count()
    asked = spark.readStream.schema("event_id long, user_id long").parquet(f"{folder}/event[s].parquet").select(F.col("user_id").cast("string").alias("id"))
    attempts = lambda: spark.read.schema(changes.ATTEMPT).parquet(out)
    with timers(spark):
        query = changes.retried(asked, outcome, first=0.01, longest=0.08).writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "ck")).trigger(processingTime="0 seconds").start(out)
        try:
            told = None
            while not query.awaitTermination(1):  # till all are settled; they are counted after a batch, not meanwhile
                progress = query.lastProgress
                batch = progress and progress.batchId
                if batch != told and exists(spark, f"{out}/_spark_metadata/0"):
                    told = batch
                    if attempts().where("outcome <> 'again'").count() >= wanted:
                        break
        finally:
            query.stop()
    return attempts().select("id", "attempt", "outcome", F.round(F.col("pause") * 100).cast("long").alias("pause"))


def review_invalidation(spark, folder):
    """Users as topics whose revision is the event's number, errors remove them; customers as reviews that saw a revision by their key."""
    out, source = shared_folder(spark, "flags"), shared_folder(spark, "topics")
    ev = scan(spark, folder, "events", F.col("user_id").alias("topic_id"), F.col("event_id").alias("revision"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "DELETE").otherwise("UPDATE").alias("op"))
    for k in (1, 0, 1):  # out of order, and a file twice
        ev.where(F.col("revision") % 2 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(source)
    reviews = scan(spark, folder, "customer", F.col("c_custkey").alias("review_id"), (F.col("c_custkey") % 100).alias("topic_id"), (F.col("c_custkey") * 7).alias("revision"))
    changes.invalidated(reviews, stream).writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "ck")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("review_id long").parquet(out)


def feed_changes(spark, folder):
    """Orders as calendar feeds by customer, followed while some of them change; then once more while none does."""
    provider.register(spark)
    at, log, view, checkpoint = (shared_folder(spark, n) for n in ("feeds", "log", "view", "ck"))
    o = scan(spark, folder, "orders", F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 20).alias("name"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"))

    def publish(rows, title):
        event = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), "k", F.lit("\r\nDTSTART;VALUE=DATE:"), "day", F.lit("\r\nSUMMARY:"), title, F.lit("\r\nEND:VEVENT\r\n"))
        write_feeds(rows.select("name", event.alias("value")), at)

    def follow():
        feeds = spark.readStream.format("calendar_feed").option("path", at).option("feed", "name=([0-9]+)").load()
        changes.keep_feed_changes(feeds, log, view, checkpoint, buckets=8).trigger(availableNow=True).start().awaitTermination()

    publish(o.where("k % 10 < 8"), F.lit("Order"))
    follow()
    publish(o.where("k % 10 >= 1 AND name < 15"), F.when(F.col("k") % 7 == 0, "Order, moved").otherwise("Order"))
    publish(o.where("k % 10 < 8 AND name >= 15"), F.lit("Order"))  # written anew, with the bytes that it had
    follow()
    follow()
    rows = spark.read.schema("op string, id string, course_id string, body string, seq long, batch int").parquet(log)
    return rows.select(F.split("id", "\\|")[1].cast("long").alias("k"), "op", F.col("course_id").cast("long").alias("feed"), F.col("batch").cast("long").alias("batch"))


QUERIES = {
    f.__name__: f
    for f in (
        grounding, merge_verification, page_expansion, delete_impact, frozen_plans, objective_triage, merge_targets, page_markdown, completeness_index,
        append_once, revision_bump, feed_state, wall_instants, unfiled_items, sourceless_topics, orphaned_chunks, touched_rows, confirmed_rows, log_violations,
        merge_provenance, effective_order, review_index, weight_writes, first_positions, skip_sets, sentence_counts, canonical_hashes, late_labels, deck_slides, provider_sync, failed_deliveries, late_subscriber, keyed_turns, disappearances,
        retried_deliveries, review_invalidation, feed_changes,
    )
}

ORACLES = {
    "grounding": r"""WITH s AS (SELECT p_partkey % 500 AS t, min(p_name) AS name FROM part GROUP BY 1), f AS (SELECT t, p_partkey, p_name, name FROM part JOIN s ON t = p_partkey % 500 WHERE t % 2 = 0)
 SELECT t AS topic_id, 'formulas-without-source-math' AS kind, count(*) || CASE WHEN count(*) = 1 THEN ' formula' ELSE ' formulas' END AS subject, CAST(1 AS BIGINT) AS n FROM f WHERE p_partkey % 3 = 0 AND t % 5 <> 0 GROUP BY t
 UNION ALL SELECT t, 'unanchored-key-term', p_name, count(*) FROM f WHERE p_partkey % 3 <> 0 AND NOT contains('a = b ' || lower(name), lower(p_name)) GROUP BY t, p_name""",
    "merge_verification": "SELECT o_custkey AS topic_id, bool_or(o_orderkey % 40 < 2) AS needs_review, bool_or(o_orderkey % 40 = 0) AS blocked FROM orders WHERE o_orderkey % 40 < 2 OR o_orderkey % 3 = 0 GROUP BY 1",
    "page_expansion": "WITH r AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'inf'::DOUBLE ELSE length(html)::DOUBLE / (length(url) * (page_id % 4))::DOUBLE END AS q FROM pages) SELECT page_id, round(q, 9) AS ratio, coalesce(page_id % 2 = 0 AND q > 8, false) AS implausible FROM r",
    "delete_impact": "SELECT count(*) FILTER (o_orderkey % 5 = 0) AS removed, count(*) FILTER (o_orderkey % 5 IN (1, 2)) AS rewritten, count(*) FILTER (o_orderkey % 5 > 2) AS unchanged, CAST(sum(o_orderkey % 4) FILTER (o_orderkey % 5 IN (1, 2)) AS BIGINT) AS lost, CAST(sum(o_orderkey % 3) FILTER (o_orderkey % 5 IN (1, 2)) AS BIGINT) AS unattributed, count(*) FILTER (o_orderkey % 5 IN (1, 2) AND o_orderkey % 7 = 0) AS stale, count(*) FILTER (o_orderstatus = 'F') AS chunks FROM orders",
    "frozen_plans": "SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'frozen' ELSE 'p' || lpad(CAST(min(o_orderkey) AS VARCHAR), 12, '0') END AS plan FROM orders GROUP BY o_custkey",
    "objective_triage": "SELECT o_orderkey AS objective_id, CASE WHEN o_orderkey % 3 = 0 THEN 'ignore' WHEN o_orderkey % 3 = 1 OR o_orderkey % 4 = 0 OR o_orderkey % 10 >= 6 THEN 'missing' ELSE 'gap' END AS action FROM orders",
    "merge_targets": "SELECT o_custkey AS target, string_agg(o_orderkey, ',' ORDER BY day(o_orderdate), o_orderkey) AS segments FROM orders GROUP BY 1",
    "page_markdown": """SELECT c_custkey, 'summary' AS section, 'Summary' AS heading, 'About' AS markdown FROM customer UNION ALL SELECT c_custkey, 'note:n', c_name, lower(c_mktsegment) FROM customer
 UNION ALL SELECT c_custkey, 'keyTerms', 'Key terms', '**' || c_mktsegment || '** — a segment' FROM customer WHERE c_custkey % 2 = 0""",
    "completeness_index": "SELECT p_size AS course_id, sha256(string_agg(t, chr(10) ORDER BY t)) AS hash FROM (SELECT p_size, p_name || ' ' || p_partkey AS t FROM part) GROUP BY 1",
    "append_once": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'n1,n3' WHEN 1 THEN 'n1,n2,n3' WHEN 2 THEN 'n1,n2,n3' ELSE 'n1,n2,n3,n4' END AS notes FROM customer",
    "revision_bump": "WITH c AS (SELECT c_custkey AS t, CAST(c_custkey % 5 AS INTEGER) AS r, c_name AS p, c_custkey % 3 = 0 AS m FROM customer) SELECT t AS topic_id, CASE WHEN m THEN r + 1 ELSE r END AS revision, CASE WHEN m THEN upper(p) ELSE p END AS page, 'current' AS state FROM c UNION ALL SELECT t, r, p, 'history' FROM c WHERE m",
    "feed_state": """SELECT s_suppkey, s_suppkey % 7 <> 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 60 >= 30) AS stale, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE greatest(60000 - s_suppkey * 1000, 0) END AS left_ms, s_suppkey % 3 = 0 AS unchanged, s_suppkey % 400 - 100 BETWEEN -30 AND 180 AS inside,
 CASE WHEN s_suppkey % 6 = 0 THEN 'etag' WHEN s_suppkey % 10 = 0 THEN 'last-modified' WHEN s_suppkey % 3 = 0 THEN 'hash' END AS layer FROM supplier""",
    "wall_instants": """WITH w AS (SELECT o_orderkey, CASE WHEN NOT (month(o_orderdate) IN (3, 9, 10) AND day(o_orderdate) >= 22 AND dayofweek(o_orderdate) = 0) THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS w FROM orders)
 SELECT o_orderkey, CAST(epoch(timezone('Europe/Madrid', w)) AS BIGINT) AS instant, CAST(epoch(w) - epoch(timezone('Europe/Madrid', w)) AS BIGINT) AS "offset" FROM w""",
    "unfiled_items": "WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey <= 9 ORDER BY 1 LIMIT 2000) SELECT c_custkey AS o_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS orders FROM c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "sourceless_topics": "SELECT c_custkey AS topic_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "orphaned_chunks": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'topic_page' ELSE 'document' END AS source, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_orderkey % 2 <> 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1",
    "touched_rows": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Z' WHEN o_orderkey % 10 <> 1 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 10 = 1 THEN '2026-02-01' ELSE '2026-01-01' END AS day, count(*) AS n FROM orders GROUP BY ALL",
    "confirmed_rows": "SELECT o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 AS confirmed, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1",
    "log_violations": "SELECT 'append only' AS rule, count(*) AS n FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey % 9 = 0 UNION ALL SELECT 'merged once', count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1)",
    "merge_provenance": """WITH p AS (SELECT DISTINCT o_custkey AS t, o_orderstatus AS d, CAST(day(o_orderdate) AS INTEGER) AS page FROM orders WHERE o_orderkey % 3 = 0), q AS (SELECT DISTINCT o_custkey AS t, o_orderstatus AS d, CAST(day(o_orderdate) AS INTEGER) AS page FROM orders WHERE o_orderkey % 2 = 0)
 SELECT t AS topic_id, d AS document_id, string_agg(page, ',' ORDER BY page) AS pages FROM (SELECT * FROM p UNION ALL SELECT * FROM q WHERE (t, d) NOT IN (SELECT t, d FROM p)) GROUP BY ALL""",
    "effective_order": "SELECT o_orderkey AS topic_id, round(e, 9) AS effective, row_number() OVER (PARTITION BY o_custkey ORDER BY e DESC, o_orderkey) AS place FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 0.9::DOUBLE ELSE (o_totalprice / 500000)::DOUBLE END AS e FROM orders)",
    "review_index": """WITH c AS (SELECT *, (abs(c_acctbal) / 10000)::DOUBLE AS w FROM customer)
 SELECT c_custkey, '[topic-id: t' || c_custkey || '] ' || c_name || chr(10) || '  exam weight: ' || printf('%.2f', w) || ' (' || CASE WHEN w >= 0.6 THEN 'HIGH' WHEN w >= 0.35 THEN 'MID' ELSE 'LOW' END || ')' || chr(10) || '  summary: ' || CASE WHEN c_custkey % 2 = 0 THEN 'sum' ELSE '(none)' END || chr(10) || '  formulas: F = ma' || chr(10) || '  key terms: mass' || chr(10) || '  worked examples: none' || chr(10) || '  open questions: none' AS topic,
 CASE c_custkey % 4 WHEN 0 THEN 'length: 2h' || chr(10) || 'parts: ["a",1]' WHEN 1 THEN 'open book' WHEN 2 THEN 'No exam-format profile recorded for this course.' ELSE 'No exam-format profile recorded for this course — assume a standard written final exam covering the whole course.' END AS format FROM c""",
    "weight_writes": "SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 OR abs(o_totalprice::DOUBLE - (o_totalprice::DOUBLE + (o_orderkey % 3)::DOUBLE * 0.00006::DOUBLE)) >= 1e-4",
    "first_positions": "WITH w AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS p, unnest(l) AS word FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)) SELECT doc_id, word, CAST(min(p) AS INTEGER) AS first FROM w WHERE word <> '' GROUP BY doc_id, word",
    "skip_sets": """WITH d AS (SELECT DISTINCT o_custkey AS doc_id, CAST(day(o_orderdate) AS INTEGER) AS page, o_orderkey % 2 <> 0 AS good FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT doc_id, page FROM d WHERE good), r AS (SELECT o_custkey, CAST(day(o_orderdate) AS INTEGER) FROM orders WHERE o_orderkey % 5 = 0)
 SELECT *, 'skipped' AS "set" FROM (SELECT * FROM c EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'discredited' FROM (SELECT doc_id, page FROM d WHERE NOT good EXCEPT SELECT * FROM c EXCEPT SELECT * FROM r)""",
    "sentence_counts": r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]+[\])''"`’”]*\s*|[^.!?]+\z'), lambda s: trim(s, ' ') <> '')) AS INTEGER) AS n FROM documents""",
    "canonical_hashes": """SELECT o_orderkey, sha256('{"a":"' || o_orderstatus || '","b":' || o_custkey || ',"c":{"y":[true,null],"z":1}}') AS hash FROM orders""",
    "late_labels": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'never synced' WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS label FROM (SELECT o_orderkey, o_orderkey % 5000 // 2 AS m FROM orders)""",
    "deck_slides": """WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'none') AS role, length(role) AS chars FROM conversations WHERE conv_id IS NOT NULL)
 SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INTEGER) AS slide, role AS title, chars || ' characters in turn ' || turn AS body, 'notes ' || conv_id AS notes, CAST(6 AS INTEGER) AS words, false AS failed FROM t WHERE conv_id % 10 <> 0
 UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), NULL::INTEGER, NULL, NULL, NULL, NULL::INTEGER, true FROM t WHERE conv_id % 10 = 0""",
    "provider_sync": f"""WITH n AS (SELECT DISTINCT o_custkey % {FEEDS} AS name FROM orders), o AS (SELECT name, count(*) AS n FROM ({OCCURRENCES}) GROUP BY 1)
 SELECT name, name % 10 <> 3 AS changed, name % 10 <> 3 AND name % 13 = 5 AS failed, CASE WHEN name % 10 = 3 OR name % 13 = 5 THEN 1 ELSE n END AS n, CAST(1 AS BIGINT) AS cursors FROM n LEFT JOIN o USING (name)""",
    "failed_deliveries": """WITH r AS (SELECT event_id % 4 + 1 AS a, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 2 <> 0 OR event_id % 4 + 1 >= 3 THEN 'dead' ELSE 'again' END AS part FROM events) SELECT part, count(*) AS n, CAST(sum(CASE WHEN part = 'again' THEN a + 1 ELSE a END) AS BIGINT) AS attempts FROM r GROUP BY part""",
    "keyed_turns": "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events",
    "disappearances": """WITH l AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1)
 SELECT CAST(user_id AS VARCHAR) AS id, 'hide' AS action, CAST(floor(epoch(seen + INTERVAL 24 HOUR)) AS BIGINT) AS at FROM l WHERE seen + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "late_subscriber": "SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS body FROM events GROUP BY 1",
    "retried_deliveries": """WITH u AS (SELECT DISTINCT user_id AS k FROM events), a AS (SELECT k, unnest(range(1, 6)) AS attempt FROM u), r AS (SELECT k, attempt, CASE WHEN attempt > k % 7 THEN 'done' WHEN k % 11 = 0 OR attempt = 5 THEN 'dead' ELSE 'again' END AS outcome FROM a),
 l AS (SELECT k, min(attempt) AS last FROM r WHERE outcome <> 'again' GROUP BY k) SELECT CAST(k AS VARCHAR) AS id, CAST(attempt AS INTEGER) AS attempt, outcome, CASE WHEN outcome = 'again' THEN least(1 << (attempt - 1), 8) END AS pause FROM r JOIN l USING (k) WHERE attempt <= last""",
    "review_invalidation": "SELECT DISTINCT c_custkey AS review_id FROM customer JOIN events ON user_id = c_custkey % 100 WHERE event_id > c_custkey * 7 OR (event_type = 'error' AND event_id % 50 = 0)",
    "feed_changes": """WITH o AS (SELECT o_orderkey AS k, o_custkey % 20 AS feed FROM orders) SELECT k, 'INSERT' AS op, feed, 0 AS batch FROM o WHERE k % 10 < 8
 UNION ALL SELECT k, CASE WHEN k % 10 = 0 THEN 'DELETE' WHEN k % 10 >= 8 THEN 'INSERT' ELSE 'UPDATE' END, feed, 1 FROM o WHERE feed < 15 AND (k % 10 = 0 OR k % 10 >= 8 OR k % 7 = 0)""",
}
