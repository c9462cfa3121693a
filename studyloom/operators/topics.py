"""Topic pages: flattening, diffs, provenance, loss checks, routing and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.math import changed_enough, exam_weight, weight_band
from ..functions.text import first_words, identity_key, normal_title, trim
from .relational import nearest
from .windows import recency

SOURCE = "struct<documentId: string, page: int>"
#: A source as pages hold it: older pages name its page in a locator, by page or slide.
STORED = "struct<documentId: string, page: int, locator: struct<page: int, slide: int>>"
PAGE = (
    f"struct<summary: string, notes: array<struct<id: string, heading: string, markdown: string, sources: array<{STORED}>>>, "
    f"keyTerms: array<struct<term: string, definition: string, sources: array<{STORED}>>>, "
    f"formulas: array<struct<name: string, latex: string, explanation: string, sources: array<{STORED}>>>, "
    f"workedExamples: array<struct<problem: string, solution: string, sources: array<{STORED}>>>, "
    f"openQuestions: array<struct<question: string, context: string, kind: string, sources: array<{STORED}>>>>"
)
#: Sections, the kind of their blocks, and what a block without a name is called.
SECTIONS = (("notes", "note", "note"), ("keyTerms", "keyTerm", "key term"), ("formulas", "formula", "formula"), ("workedExamples", "workedExample", "worked example"))
#: The sections whose entries carry sources; open questions are no blocks, but are stripped with their document.
SOURCED = (*(s[0] for s in SECTIONS), "openQuestions")
#: Words of a problem that name a worked example.
NAMING_WORDS = 8


def parse_page(json: Column) -> Column:
    """A stored page; what can't be read gives an empty page."""
    return F.from_json(json, PAGE)


def entries(page: Column, section: str) -> Column:
    """A page's section, empty where it has none."""
    return F.coalesce(page[section], F.array().cast(StructType.fromDDL(f"x {PAGE}")[0].dataType[section].dataType))


def filled(entry: Column, *fields: str) -> Column:
    """The first of an entry's fields that isn't blank, trimmed; null where all are."""
    return F.coalesce(*(F.nullif(trim(entry[f]), F.lit("")) for f in fields))


def identified(section: str, entry: Column) -> tuple[Column, Column, Column, Column]:
    """Of an entry: an id that stands as it is, a name that is folded to an identity, its label and its text; null for none."""
    none = F.lit(None).cast("string")
    if section == "notes":
        return filled(entry, "id"), filled(entry, "heading"), filled(entry, "heading", "id"), filled(entry, "markdown")
    if section == "keyTerms":
        return none, filled(entry, "term"), filled(entry, "term"), filled(entry, "definition")
    if section == "formulas":
        return none, filled(entry, "name", "latex"), filled(entry, "name", "latex"), F.concat_ws(" ", filled(entry, "latex"), filled(entry, "explanation"))
    words = first_words(filled(entry, "problem"), NAMING_WORDS)
    return none, words, words, filled(entry, "solution")


def cited_places(entry: Column) -> Column:
    """An entry's sources as (documentId, page): the page named flat, else by the locator's page or slide."""
    held = F.coalesce(entry["sources"], F.array().cast(f"array<{STORED}>"))
    return F.transform(held, lambda s: F.struct(s["documentId"].alias("documentId"), F.coalesce(s["page"], locator_unit(s["locator"])).alias("page")))


def blocks(pages: DataFrame, page: str = "page") -> DataFrame:
    """(topic_id, page struct) -> (topic_id, ord, key, kind, label, text, sources): a row per block of the four sections.

    A block keeps its key while it is reworded: a note's own id, else its heading; a term; a formula's name, else its LaTeX; the
    first eight words of a problem; each folded (case, accents and punctuation don't count). A block without any is known by its
    place. The text leaves the name out, so that a block which kept only its name is seen to be empty. Open questions are none.
    """

    def rows(number: int, section: str, kind: str, unnamed: str) -> Column:
        def row(entry: Column, i: Column) -> Column:
            exact, named, label, text = identified(section, entry)
            place = F.concat(F.lit("index:"), i)
            # A formula's place is folded like its name would be.
            kept, folded = (exact, F.coalesce(named, place)) if section == "formulas" else (F.coalesce(exact, F.when(named.isNull(), place)), named)
            return F.struct(
                F.struct(F.lit(number).alias("section"), i.alias("place")).alias("ord"), kept.alias("_kept"), folded.alias("_folded"), F.lit(kind).alias("kind"),
                F.coalesce(label, F.concat(F.lit(f"{unnamed} "), i + 1)).alias("label"), F.coalesce(text, F.lit("")).alias("text"), cited_places(entry).alias("sources"),
            )

        return F.transform(entries(F.col(page), section), row)

    found = pages.select("topic_id", F.inline(F.concat(*(rows(n, *s) for n, s in enumerate(SECTIONS)))))
    key = F.concat("kind", F.lit(":"), F.coalesce("_kept", identity_key(F.col("_folded"))))
    return found.select("topic_id", "ord", key.alias("key"), "kind", "label", "text", "sources")


def last_of_key(block_rows: DataFrame) -> DataFrame:
    """One block a key: of several the last on its page. Rows without an `ord` have distinct keys.

    Nearly all keys are a block's own, so nothing is merged before the shuffle (which would sort all that a task reads, texts
    included); what follows it is sorted once, for this and for a join on the key.
    """
    if "ord" not in block_rows.columns:
        return block_rows
    after = F.lead(F.lit(True)).over(Window.partitionBy("topic_id", "key").orderBy("ord"))
    parts = int(block_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return block_rows.repartition(parts, "topic_id", "key").withColumn("_after", after).where("_after IS NULL").drop("_after")


def page_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(topic_id, key, label, status, rank, before, after): removed, changed, added, unchanged blocks of two versions with their texts,
    in that order of rank. The label (where the rows have one) is the later version's."""
    shown = [c for c in ("label", "text") if c in before.columns]
    old = last_of_key(before).select("topic_id", "key", F.struct(*shown).alias("o"))
    new = last_of_key(after).select("topic_id", "key", F.struct(*shown).alias("n"))
    both = old.join(new, ["topic_id", "key"], "full_outer")
    status = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(~F.col("o.text").eqNullSafe(F.col("n.text")), "changed").otherwise("unchanged")
    rank = F.array_position(F.array(*map(F.lit, ("removed", "changed", "added", "unchanged"))), status).cast("int")
    label = [F.coalesce("n.label", "o.label").alias("label")] if "label" in shown else []
    return both.select("topic_id", "key", *label, status.alias("status"), rank.alias("rank"), F.col("o.text").alias("before"), F.col("n.text").alias("after"))


def diff_totals(diff: DataFrame, summaries: DataFrame) -> DataFrame:
    """(topic_id, added, removed, changed, unchanged, summary_changed, identical) of every topic in summaries (topic_id, before, after:
    the two versions' summaries, of which blanks at the edges don't count)."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = diff.groupBy("topic_id").agg(of("added"), of("removed"), of("changed"), of("unchanged"))
    told = lambda c: trim(F.coalesce(c, F.lit("")))
    rows = summaries.select("topic_id", (told("before") != told("after")).alias("summary_changed")).join(counts, "topic_id", "left").fillna(0)
    same = (F.col("added") + F.col("removed") + F.col("changed") == 0) & ~F.col("summary_changed")
    return rows.select("topic_id", "added", "removed", "changed", "unchanged", "summary_changed", same.alias("identical"))


def citations(block_rows: DataFrame, pages_read: DataFrame) -> DataFrame:
    """A row per citation with its status: resolved, unread-page, unknown-document. pages_read: document_id, page (a row of
    null page for a document whose pages aren't known, all of which count as read)."""
    each = block_rows.select("topic_id", "key", "kind", F.explode("sources").alias("s")).select("topic_id", "key", "kind", F.when(trim(F.col("s.documentId")) != "", F.col("s.documentId")).alias("document_id"), F.col("s.page").alias("page"))
    known = pages_read.groupBy("document_id").agg(F.count("page").alias("n_read"))
    read = pages_read.where("page IS NOT NULL").select("document_id", "page").distinct().withColumn("_r", F.lit(True))
    rows = each.join(known, "document_id", "left").join(read, ["document_id", "page"], "left")
    status = F.when(F.col("n_read").isNull(), "unknown-document").when((F.col("n_read") == 0) | F.col("page").isNull() | F.col("_r"), "resolved").otherwise("unread-page")
    return rows.select("topic_id", "key", "kind", "document_id", "page", status.alias("status"))


def citation_labels(cited: DataFrame, documents: DataFrame) -> DataFrame:
    """citations' rows with `label`, as a reader sees them: the document's own (documents: document_id, label) and the page, or that the
    source isn't known."""
    paged = F.col("page").isNotNull()
    page = F.concat(F.lit(" \u00b7 p. "), F.col("page").cast("string"))
    rows = cited.join(documents.select("document_id", F.col("label").alias("_label")), "document_id", "left")
    unknown = F.when(paged, F.concat(F.lit("Unknown source"), page)).otherwise("Source unknown")
    known = F.when(paged, F.concat("_label", page)).otherwise(F.col("_label"))
    return rows.select(*cited.columns, F.when(F.col("status") == "unknown-document", unknown).otherwise(known).alias("label"))


def provenance(block_rows: DataFrame, pages_read: DataFrame) -> DataFrame:
    """(topic_id, key, citations, strength): absent, broken, single or corroborated (two distinct places)."""
    cited = citations(block_rows, pages_read)
    good = F.col("status") == "resolved"
    place = F.concat_ws("#", F.coalesce("document_id", F.lit("?")), F.coalesce(F.col("page").cast("string"), F.lit("?")))
    per = cited.groupBy("topic_id", "key").agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"), F.count_distinct(F.when(good, place)).alias("n_places"))
    rows = block_rows.select("topic_id", "key").join(per, ["topic_id", "key"], "left").fillna(0)
    strength = F.when(F.col("n") == 0, "absent").when(F.col("n_good") == 0, "broken").when(F.col("n_places") >= 2, "corroborated").otherwise("single")
    return rows.select("topic_id", "key", F.col("n").alias("citations"), strength.alias("strength"))


#: Citations and pages read from which a single cited place is a collapse.
COLLAPSE_CITATIONS, COLLAPSE_PAGES = 3, 4


def provenance_report(block_rows: DataFrame, pages_read: DataFrame) -> DataFrame:
    """One row per topic: blocks, citations, places (distinct, of resolved citations), pages_available (read, of the documents
    that it cites), without_sources, broken, collapse (3 citations or more, all of one place, though 4 pages or more were
    read) and weak."""
    cited = citations(block_rows, pages_read)
    good = F.col("status") == "resolved"
    place = F.concat_ws("#", F.coalesce("document_id", F.lit("?")), F.coalesce(F.col("page").cast("string"), F.lit("?")))
    per = cited.groupBy("topic_id").agg(F.count("*").alias("citations"), F.count_if(good).alias("_good"), F.count_if(~good).alias("broken"), F.count_distinct(F.when(good, place)).alias("places"))
    read = pages_read.where("page IS NOT NULL").groupBy("document_id").agg(F.count_distinct("page").alias("_pages"))
    available = cited.select("topic_id", "document_id").distinct().join(read, "document_id").groupBy("topic_id").agg(F.sum("_pages").alias("pages_available"))
    absent = block_rows.groupBy("topic_id").agg(F.count("*").alias("blocks"), F.count_if(F.size("sources") == 0).alias("without_sources"))
    rows = absent.join(per, "topic_id", "left").join(available, "topic_id", "left").fillna(0)
    collapse = (F.col("_good") >= COLLAPSE_CITATIONS) & (F.col("places") == 1) & (F.col("pages_available") >= COLLAPSE_PAGES)
    weak = collapse | (F.col("without_sources") > 0) | (F.col("broken") > 0) | ((F.col("blocks") > 0) & (F.col("citations") == 0))
    return rows.select("topic_id", "blocks", "citations", "places", "pages_available", "without_sources", "broken", collapse.alias("collapse"), weak.alias("weak"))


def locator_unit(locator: Column) -> Column:
    """The page that a locator names, else its slide, else null."""
    finite = lambda x: F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), x)
    return F.coalesce(finite(locator["page"]), finite(locator["slide"]))


def revert(current: DataFrame, history: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next current, next history): topics of wanted (topic_id, revision) get that revision's page back as a new revision; the
    page that they had is kept in the history under its own. A revision that the history doesn't hold changes nothing.

    current, history: topic_id, revision, page.
    """
    old = history.join(wanted, ["topic_id", "revision"]).groupBy("topic_id").agg(F.first("page").alias("_page"))
    rows = current.join(old, "topic_id", "left")
    hit = F.col("_page").isNotNull()
    after = rows.select("topic_id", (F.col("revision") + hit.cast("int")).alias("revision"), F.coalesce("_page", "page").alias("page"))
    kept = rows.where(hit).select("topic_id", "revision", "page").join(history.select("topic_id", "revision"), ["topic_id", "revision"], "left_anti")
    return after, history.unionByName(kept)


def read_snapshot(json: Column) -> Column:
    """A review's snapshot as an array of (topicId, revision); the id's key may be written topicId or topic_id. Null where the
    text is no array or any entry can't be read: such a review can't be shown to be fresh."""
    raw = F.from_json(json, "array<struct<topicId: string, topic_id: string, revision: double>>")
    pairs = F.transform(raw, lambda e: F.struct(F.coalesce(e["topicId"], e["topic_id"]).alias("topicId"), e["revision"].cast("long").alias("revision")))
    good = F.forall(pairs, lambda p: F.coalesce(p.isNotNull() & p["topicId"].isNotNull() & p["revision"].isNotNull(), F.lit(False)))
    return F.when(F.ltrim(json).startswith("[") & good, pairs)


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """`1 page`, `3 pages`."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def joined(parts: list[Column], empty: Column | None = None) -> Column:
    """The parts that are not null, joined by middle dots; `empty` (null unless given) where there are none."""
    some = F.array_compact(F.array(*parts))
    return F.when(F.size(some) > 0, F.array_join(some, " \u00b7 ")).otherwise(F.lit(None).cast("string") if empty is None else empty)


def diff_label(added: Column, changed: Column, removed: Column, summary_changed: Column) -> Column:
    """Counts of a page's diff that are not zero; null where nothing changed at all."""
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    return joined([part(added, "added"), part(changed, "rewritten"), part(removed, "removed")], F.when(summary_changed, "summary rewritten"))


def coverage_label(mapped: Column, total: Column, unmapped: Column, skipped: Column, undeclared: Column, n_topics: Column, checked: Column, because: dict[str, Column] | None = None) -> Column:
    """A document's coverage in a line; `because` gives by kind (unmapped, skipped) an array of reasons, of which three are named."""
    why = lambda kind: F.when(F.size(because[kind]) > 0, F.concat(F.lit(" ("), F.array_join(F.slice(because[kind], 1, 3), ", "), F.lit(")"))).otherwise("") if because else F.lit("")
    part = lambda n, word, reason: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), reason))
    across = F.concat(F.lit(" mapped across "), counted(n_topics, "topic"))
    head = F.concat(mapped.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" pages"), across)
    rest = [part(unmapped, "unmapped", why("unmapped")), part(skipped, "skipped", why("skipped")), part(undeclared, "unaccounted for", F.lit(""))]
    unknown = F.concat(counted(mapped, "page"), across, F.lit(" \u00b7 this document's length couldn't be verified, so coverage is unknown"))
    return F.when(checked, joined([head, *rest])).otherwise(unknown)


def outcome_label(outcome: Column, n_failed: Column) -> Column:
    """What a document's outcome means to its reader; null where it is ready."""
    none = n_failed == 0
    failed = F.when(none, "This file was read, but none of its material could be written into your topic pages. Try again.").otherwise(
        F.concat(F.lit("This file was read, but none of its "), counted(n_failed, "topic"), F.lit(" could be updated. Try again."))
    )
    partial = F.when(none, "Your topic pages were updated, but part of the indexing didn\u2019t finish. The pages are readable; search may lag.").otherwise(
        F.concat(F.lit("Your topic pages were updated, except for "), n_failed.cast("string"), F.lit(" of them. Retry to finish the rest."))
    )
    return F.when(outcome == "failed", failed).when(outcome == "partial", partial)


#: What the findings of a merge say.
UNDECLARED = "“%s” was in the page before this merge and is gone from the proposed page, but the merge did not declare it superseded."
EMPTIED = "“%s” still exists but its content was emptied by this merge."
NEVER_THERE = "The merge declared it removed “%s”, which was not in the page before the merge."


def merge_loss(before: DataFrame, after: DataFrame, removals: DataFrame) -> DataFrame:
    """(topic_id, kind, severity, subject, detail): blocks that a merge lost without declaring it, emptied, or removed in name only.

    before, after: topic_id, key, text, and label, by which the detail names a block (else by its key); removals: topic_id, key.
    """
    named = (F.col("label") if "label" in before.columns else F.col("key")).cast("string")
    old, new = before.select("topic_id", "key", named.alias("_label"), F.col("text").alias("o")), last_of_key(after).select("topic_id", "key", F.col("text").alias("n"))
    gone = old.join(new, ["topic_id", "key"], "left_anti").join(removals, ["topic_id", "key"], "left_anti")
    empty = old.join(new, ["topic_id", "key"]).where("length(o) > 0 AND length(n) = 0")
    phantom = removals.join(old, ["topic_id", "key"], "left_anti").withColumn("_label", F.col("key").cast("string"))
    finding = lambda df, kind, level, says: df.select("topic_id", F.lit(kind).alias("kind"), F.lit(level).alias("severity"), F.col("key").alias("subject"), F.format_string(says, "_label").alias("detail"))
    return (
        finding(gone, "undeclared-removal", "red", UNDECLARED).unionByName(finding(empty, "emptied-block", "red", EMPTIED))
        .unionByName(finding(phantom, "phantom-removal", "amber", NEVER_THERE))
    )


def strip_document(pages: DataFrame, document_id: str) -> DataFrame:
    """Pages without a document's share: entries that only it backs go, open questions too, others lose its citations, unattributed
    ones stay. A section that a page doesn't have stays null."""
    out = pages
    for section in SOURCED:
        mine = lambda s: s["documentId"] == document_id
        backed = lambda b: (F.size(b["sources"]) > 0) & F.forall(b["sources"], mine)
        kept = F.filter(F.col("page")[section], lambda b: ~F.coalesce(backed(b), F.lit(False)))
        pruned = F.transform(kept, lambda b: b.withField("sources", F.filter(b["sources"], lambda s: ~F.coalesce(mine(s), F.lit(False)))))
        out = out.withColumn("page", F.col("page").withField(section, pruned))
    return out


def coalesce_singletons(routed: DataFrame) -> DataFrame:
    """Adds `into`: a proposal with one segment folds into the nearest proposal with several, by position, ties to the one before;
    null where it stays, with the `reason` of those with one segment: segment-not-in-deck-order (no position), or
    no-multi-segment-receiver.

    routed: deck_id, position, proposal, and kind where there are others than `create`, which neither fold nor take any in. Sizes are
    those before any fold, so folds don't cascade.
    """
    creates = F.col("kind") == "create" if "kind" in routed.columns else F.lit(True)
    size = F.count(F.when(creates, 1)).over(Window.partitionBy("deck_id", "proposal"))
    sized = routed.withColumn("_size", F.when(creates, size))
    near = nearest(sized, "deck_id", "position", F.col("_size") >= 2, "_near")
    names = sized.where("_size >= 2").select("deck_id", F.col("position").alias("_near"), F.col("proposal").alias("_into"))
    single, placed = F.col("_size") == 1, F.col("position").isNotNull()
    reason = F.when(single & ~placed, "segment-not-in-deck-order").when(single & F.col("_into").isNull(), "no-multi-segment-receiver")
    return near.join(names, ["deck_id", "_near"], "left").select(*routed.columns, F.when(single & placed, F.col("_into")).alias("into"), reason.alias("reason"))


def topic_weights(topics: DataFrame) -> DataFrame:
    """topics: course_id, topic_id, updated_at, signals, sources, formulas, examples, override -> recency and weight."""
    aged = recency(topics, ["course_id"], [F.col("updated_at"), F.col("topic_id")])
    return aged.withColumn("weight", exam_weight(F.col("signals"), F.col("sources"), F.col("recency"), F.col("formulas") + F.col("examples"), F.col("override")))


def by_effective_weight(topics: DataFrame) -> DataFrame:
    """topics (course_id, topic_id, weight, override) with `effective`, the override where there is one, and their place by it in the
    course, the heaviest first, ties by id."""
    rows = topics.withColumn("effective", F.coalesce(F.col("override").cast("double"), F.col("weight").cast("double")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("effective"), "topic_id")))


def topic_text(topic_id: Column, title: Column, weight: Column, summary: Column, formulas: Column, terms: Column, examples: Column, questions: Column) -> Column:
    """A topic as text for a review: its weight with its band, its summary, and its lists of strings, blanks left out."""
    items = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    listed = lambda a: F.when(F.size(items(a)) == 0, "none").otherwise(F.array_join(items(a), "; "))
    # By the double's own value, a tie to the even digit, as printf rounds it; "%.2f" here would round the shortest decimal up.
    shown = F.coalesce(F.call_function("format_number", weight, F.lit("0.00")), F.lit("null"))
    head = F.concat(F.lit("[topic-id: "), topic_id, F.lit("] "), title)
    about = F.when(F.trim(summary) == "", "(none)").otherwise(F.trim(summary))
    lines = [head, F.concat(F.lit("  exam weight: "), shown, F.lit(" ("), weight_band(weight), F.lit(")")), F.concat(F.lit("  summary: "), about)]
    named = (("formulas", formulas), ("key terms", terms), ("worked examples", examples), ("open questions", questions))
    return F.concat_ws("\n", *lines, *(F.concat(F.lit(f"  {name}: "), listed(a)) for name, a in named))


def exam_format(json: Column) -> Column:
    """A course's exam-format profile (JSON) as text: a string as it is, an object's entries a line each."""
    none = "No exam-format profile recorded for this course"
    text = F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x")
    entries = F.transform(F.map_entries(F.from_json(json, "map<string, string>")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    lines = F.when(F.size(entries) > 0, F.array_join(entries, "\n")).otherwise(f"{none}.")
    missing = json.isNull() | (F.trim(json) == "null")
    return F.when(missing, f"{none} \u2014 assume a standard written final exam covering the whole course.").when(F.ltrim(json).startswith("{"), lines).when(F.trim(text) == "", f"{none}.").otherwise(text)


def recomputed_weights(topics: DataFrame) -> DataFrame:
    """(topic_id, weight): the topics whose recomputed weight is worth a write. topics: as topic_weights, and exam_weight."""
    fresh = topic_weights(topics)
    return fresh.where(changed_enough(F.col("weight"), F.col("exam_weight"))).select("topic_id", "weight")


def weight_verdict(weights: DataFrame, keys: list[str], percent: str) -> DataFrame:
    """(keys, total, verdict, delta): in whole hundredths; balanced within 0.01 of 100, empty without a row of weight; delta is what the
    total has over 100."""
    hundredths = F.sum(F.floor(F.col(percent).cast("double") * 100 + 0.5))
    total = weights.groupBy(*keys).agg(F.count(percent).alias("n"), F.coalesce(hundredths, F.lit(0)).alias("hundredths"))
    verdict = F.when(F.col("n") == 0, "empty").when(F.abs(F.col("hundredths") - 10_000) <= 1, "balanced").when(F.col("hundredths") < 10_000, "under").otherwise("over")
    return total.select(*keys, (F.col("hundredths") / 100).alias("total"), verdict.alias("verdict"), ((F.col("hundredths") - 10_000) / 100).alias("delta"))


def document_outcome(documents: DataFrame, topics: DataFrame) -> DataFrame:
    """(document_id, outcome, merged, needs_review, failed, failed_topics): ready, partial or failed from its topics' outcomes.

    documents: document_id, downgraded (degraded, or of a coverage that can't be trusted); topics: document_id, topic_id, outcome
    (failed, or merged), needs_review. A document without topics is ready, or partial where it is downgraded.
    """
    lost = F.coalesce(F.col("outcome") == "failed", F.lit(False))
    ids = F.array_sort(F.collect_list(F.when(lost, F.col("topic_id"))))
    per = topics.groupBy("document_id").agg(ids.alias("failed_topics"), F.count_if(~lost).alias("merged"), F.count_if(~lost & F.col("needs_review")).alias("needs_review"), F.count_if(lost).alias("failed"))
    rows = documents.join(per, "document_id", "left").fillna(0, ["merged", "needs_review", "failed"]).withColumn("failed_topics", F.coalesce("failed_topics", F.array().cast(dict(per.dtypes)["failed_topics"])))
    down = F.coalesce("downgraded", F.lit(False))
    outcome = F.when((F.col("failed") > 0) & (F.col("merged") == 0), "failed").when((F.col("failed") > 0) | down, "partial").otherwise("ready")
    return rows.select("document_id", outcome.alias("outcome"), "merged", "needs_review", "failed", "failed_topics")


def group_unassigned(items: DataFrame, now: Column) -> DataFrame:
    """Unassigned items by normalised name: count, sorted ids, first and last start, actionable (something still ahead)."""
    per = items.groupBy(normal_title(F.col("name")).alias("name")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"), F.min("starts_at").alias("first"), F.max("starts_at").alias("last"))
    return per.withColumn("actionable", F.col("last") >= now)
