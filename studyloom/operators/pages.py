"""Checks and edits of topic pages: grounding, growth, unverifiable citations, strip plans, idempotent appends, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import trim
from .topics import PAGE, SOURCED, cited_places, entries

#: Growth of a new page beyond which it is implausible, and the share of routed pages that a new page must cite.
MOST_GROWTH, LEAST_CITED, LEAST_ROUTED = 8.0, 0.5, 3


def expansion(page_json: Column, source_chars: Column, is_new: Column) -> list[Column]:
    """ratio of a page's characters to its sources', infinite without a source, and whether that is implausible (new topics only)."""
    ratio = F.when(source_chars == 0, float("inf")).otherwise(F.try_divide(F.length(page_json).cast("double"), source_chars))
    return [ratio.alias("ratio"), F.coalesce(is_new & (ratio > MOST_GROWTH), F.lit(False)).alias("implausible")]


#: Displayed mathematics in a source, any at all, and the letters of the shortest term that is looked for.
ANY_MATHS = r"\$[^$\n]+\$|\$\$|\\\[|\\begin\{"
DISPLAY_MATHS, SHORTEST_TERM = r"\$\$|\\\[|\\begin\{(?:equation|align|gather|multline)", 3

#: What findings on grounding say.
UNBACKED = "This page states %s, but the source material it was built from contains no displayed mathematics%s. %s not taken from what this file provided."
UNANCHORED = "The key term “%s” does not appear anywhere in the source material this page was built from."


def grounding(block_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(topic_id, kind, subject, detail) of new topics: formulas-without-source-math, once a page, where the source displays none, and
    unanchored-key-term for each term that the source, in any case and spacing, doesn't hold.

    sources: topic_id, text, is_new. Terms without a name, or of under three characters, are not looked for.
    """
    spaced = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    fresh = sources.where("is_new").select("topic_id", F.col("text").alias("_source"))
    rows = block_rows.where(F.col("kind").isin("formula", "keyTerm")).join(fresh, "topic_id")
    without = rows.where((F.col("kind") == "formula") & ~F.col("_source").rlike(DISPLAY_MATHS)).groupBy("topic_id").agg(F.count("*").alias("n"), F.bool_or(F.col("_source").rlike(ANY_MATHS)).alias("_some"))
    one = F.col("n") == 1
    subject = F.concat(F.col("n").cast("string"), F.when(one, " formula").otherwise(" formulas"))
    only = F.when(F.col("_some"), " — only symbols mentioned inline in prose").otherwise(" at all")
    unbacked = F.format_string(UNBACKED, subject, only, F.when(one, "It was").otherwise("They were"))
    formulas = without.select("topic_id", F.lit("formulas-without-source-math").alias("kind"), subject.alias("subject"), unbacked.alias("detail"))
    name = F.trim("label")
    called = ~F.startswith(F.col("key"), F.lit("keyTerm:index:")) if "key" in block_rows.columns else F.lit(True)
    absent = (F.col("kind") == "keyTerm") & called & (F.length(name) >= SHORTEST_TERM) & ~F.contains(spaced(F.col("_source")), spaced(name))
    return formulas.unionByName(rows.where(absent).select("topic_id", F.lit("unanchored-key-term").alias("kind"), name.alias("subject"), F.format_string(UNANCHORED, name).alias("detail")))


#: What findings on citations say.
OUTSIDE = "“%s” cites page %s of this document, but no segment routed to this topic covers that page."
UNCHECKABLE = "“%s” cites page %s of this document, which no segment routed to this topic covers — and this document's extraction has pages it neither returned nor declared skipped, so the citation cannot be checked either way."
UNCITED = "%s pages of this document were routed to this topic, but the page only cites %s of them. Nothing on it points at page%s %s%s — that material was supplied and is not represented."


def citation_findings(block_rows: DataFrame, routed: DataFrame, documents: DataFrame) -> DataFrame:
    """(topic_id, document_id, kind, severity, subject, detail): a row per block and page that it cites though it was not routed to the
    topic; the subject is key@page.

    routed: topic_id, document_id, page; documents: document_id, checked, unaccounted (number of pages). Where a document's
    coverage is unchecked or has pages unaccounted for the citation is unverifiable (amber), else it is a phantom (red).
    """
    named = (F.col("label") if "label" in block_rows.columns else F.col("key")).cast("string")
    cited = block_rows.select("topic_id", "key", named.alias("_label"), F.explode("sources").alias("s")).select("topic_id", "key", "_label", F.col("s.documentId").alias("document_id"), F.col("s.page").alias("page"))
    cited = cited.where("page IS NOT NULL").groupBy("topic_id", "key", "document_id", "page").agg(F.min("_label").alias("_label"))
    loose = cited.join(documents, "document_id").join(routed, ["topic_id", "document_id", "page"], "left_anti")
    lossy = ~F.coalesce("checked", F.lit(False)) | (F.col("unaccounted") > 0)
    kind = F.when(lossy, "unverifiable-locator").otherwise("phantom-locator")
    page = F.col("page").cast("string")
    detail = F.when(lossy, F.format_string(UNCHECKABLE, "_label", page)).otherwise(F.format_string(OUTSIDE, "_label", page))
    return loose.select("topic_id", "document_id", kind.alias("kind"), F.when(lossy, "amber").otherwise("red").alias("severity"), F.concat_ws("@", F.col("key").cast("string"), page).alias("subject"), detail.alias("detail"))


def uncited_pages(block_rows: DataFrame, routed: DataFrame) -> DataFrame:
    """(topic_id, document_id, routed, cited, severity, subject, detail): first versions that cite under half of three or more routed
    pages; the detail names the first ten that are not cited."""
    cited = block_rows.select("topic_id", F.explode("sources").alias("s")).select("topic_id", F.col("s.documentId").alias("document_id"), F.col("s.page").alias("page")).distinct().withColumn("_c", F.lit(1))
    missed = F.array_sort(F.collect_list(F.when(F.col("_c").isNull(), F.col("page"))))
    per = routed.distinct().join(cited, ["topic_id", "document_id", "page"], "left").groupBy("topic_id", "document_id").agg(F.count("*").alias("routed"), F.count("_c").alias("cited"), missed.alias("_missed"))
    found = per.where((F.col("routed") >= LEAST_ROUTED) & (F.col("cited") / F.col("routed") < LEAST_CITED))
    n, text = F.size("_missed"), lambda c: c.cast("string")
    first = F.array_join(F.transform(F.slice("_missed", 1, 10), lambda p: p.cast("string")), ", ")
    detail = F.format_string(UNCITED, text(F.col("routed")), text(F.col("cited")), F.when(n == 1, "").otherwise("s"), first, F.when(n > 10, "…").otherwise(""))
    subject = F.concat(text(n), F.lit(" of "), text(F.col("routed")), F.lit(" pages"))
    return found.select("topic_id", "document_id", "routed", "cited", F.lit("red").alias("severity"), subject.alias("subject"), detail.alias("detail"))


def verification(*findings: DataFrame) -> DataFrame:
    """(topic_id, needs_review): any red finding; an implausible growth alone flags but doesn't block (severity flag)."""
    out = findings[0].select("topic_id", "severity")
    for f in findings[1:]:
        out = out.unionByName(f.select("topic_id", "severity"))
    return out.groupBy("topic_id").agg(F.bool_or(F.col("severity").isin("red", "flag")).alias("needs_review"), F.bool_or(F.col("severity") == "red").alias("blocked"))


def strip_plan(topic_sources: DataFrame, pages: DataFrame, document_id: str) -> DataFrame:
    """(topic_id, plan, lost, unattributed, stale): remove-topic where the document is the only source, else rewrite-page if an entry goes
    or loses a citation, else unchanged. Of a page that is rewritten: entries lost, entries that stay though no document that is named
    backs them, and whether its summary may be stale (it has one, and entries go). Open questions count as entries.
    topic_sources: topic_id, document_id."""
    backing = topic_sources.distinct().groupBy("topic_id").agg(F.count("*").alias("n"), F.bool_or(F.col("document_id") == document_id).alias("mine")).where("mine")
    backs = F.concat(*(F.transform(entries(F.col("page"), s), lambda b: F.transform(cited_places(b), lambda c: c["documentId"])) for s in SOURCED))
    mine = lambda d: d.eqNullSafe(F.lit(document_id))
    lost = lambda ds: (F.size(ds) > 0) & F.forall(ds, mine)
    other = lambda ds: F.exists(ds, lambda d: F.coalesce((d != "") & (d != document_id), F.lit(False)))
    n = lambda keep: F.size(F.filter("_backs", keep)).cast("long")
    summary = F.coalesce(trim(F.col("page")["summary"]), F.lit("")) != ""
    per = pages.select("topic_id", backs.alias("_backs"), summary.alias("_summary")).select(
        "topic_id", "_summary", n(lost).alias("_lost"), n(lambda ds: F.exists(ds, mine)).alias("_touched"), n(lambda ds: ~lost(ds) & ~other(ds)).alias("_bare")
    )
    plan = F.when(F.col("n") == 1, "remove-topic").when(F.col("_touched") > 0, "rewrite-page").otherwise("unchanged")
    rows = backing.join(per, "topic_id", "left").fillna(0, ["_lost", "_touched", "_bare"]).withColumn("plan", plan)
    rewritten = F.col("plan") == "rewrite-page"
    of = lambda c: F.when(rewritten, F.col(c)).otherwise(0)
    return rows.select("topic_id", "plan", of("_lost").alias("lost"), of("_bare").alias("unattributed"), F.coalesce(rewritten & F.col("_summary") & (F.col("_lost") > 0), F.lit(False)).alias("stale"))


def delete_impact(plans: DataFrame, chunks: DataFrame, document_id: str) -> DataFrame:
    """One row: topics by plan; of pages that are rewritten the blocks lost, blocks left without a source and stale summaries; chunks of
    the document."""
    of = lambda p: F.count_if(F.col("plan") == p)
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("plan") == "rewrite-page", F.col(c))), F.lit(0))
    totals = plans.agg(of("remove-topic").alias("removed"), of("rewrite-page").alias("rewritten"), of("unchanged").alias("unchanged"), kept("lost").alias("lost"), kept("unattributed").alias("unattributed"), F.count_if((F.col("plan") == "rewrite-page") & F.col("stale")).alias("stale"))
    n = chunks.where(F.col("document_id") == document_id).agg(F.count("*").alias("chunks"))
    return totals.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one").drop("_one")


def append_once(items: Column, new: Column, same: Column) -> Column:
    """items with `new` behind, unless one is there already (same: a predicate over items)."""
    return F.when(same, items).otherwise(F.array_append(items, new))


def page_sections(page: Column) -> Column:
    """A page as an array of (section, heading, markdown), in order: summary, each note under its id, key terms, formulas, and each
    worked example under its place; empty ones are left out. These are the sections that chunk_topic_pages takes."""
    row = lambda section, heading, markdown: F.struct(section.alias("section"), heading.alias("heading"), markdown.alias("markdown"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))
    none = F.array().cast("array<struct<section: string, heading: string, markdown: string>>")
    some = lambda c: F.coalesce(page[c], F.array().cast(dict(page_types())[c]))
    one = lambda there, section, heading, markdown: F.when(there, F.array(row(F.lit(section), F.lit(heading), markdown))).otherwise(none)
    joined = lambda c, of: F.array_join(F.transform(some(c), of), "\n\n")
    return F.concat(
        one(F.coalesce(F.trim(page["summary"]), F.lit("")) != "", "summary", "Summary", page["summary"]),
        F.transform(some("notes"), lambda b: row(text("note:", b["id"]), b["heading"], b["markdown"])),
        one(F.size(some("keyTerms")) > 0, "keyTerms", "Key terms", joined("keyTerms", lambda b: text("**", b["term"], "** — ", b["definition"]))),
        one(F.size(some("formulas")) > 0, "formulas", "Formulas", joined("formulas", lambda b: text("**", b["name"], "**\n\n$$", b["latex"], "$$\n\n", b["explanation"]))),
        F.transform(some("workedExamples"), lambda b, i: row(text("example:", (i + 1).cast("string")), F.lit("Worked example"), text(b["problem"], "\n\n", b["solution"]))),
    )


def page_types() -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(PAGE).fields]


def index_text(topics: DataFrame) -> DataFrame:
    """(course_id, index): the titles of a course, one a line, in order."""
    return topics.groupBy("course_id").agg(F.array_join(F.array_sort(F.collect_list("title")), "\n").alias("index"))
