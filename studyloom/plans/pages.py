"""Topic pages as they are stored: flattened to blocks, compared, cited."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topics
from ..sources.tables import scan


def part_pages(spark, folder):
    """Parts as topics with a stored page of every section: names in other cases and with marks, blank ids and names, older sources.
    The parts are dealt out first: a page is many times the size of its part, and a file of parts may be one task's."""
    p = scan(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition("p_partkey")
    k = F.col("p_partkey")
    flat = F.struct(p["p_brand"].alias("documentId"), (k % 7).alias("page"))
    older = F.struct(F.lit(" ").alias("documentId"), F.struct(F.when(k % 2 == 0, k % 5).alias("page"), (k % 3).alias("slide")).alias("locator"))
    older_type = "array<struct<documentId: string, locator: struct<page: bigint, slide: bigint>>>"
    note = F.struct(F.when(k % 3 == 0, F.lit(" n1 ")).otherwise(" ").alias("id"), F.when(k % 2 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit("! "))).alias("heading"), F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("markdown"), F.array(flat).alias("sources"))
    term = F.struct(F.initcap("p_type").alias("term"), F.col("p_brand").alias("definition"), F.array(older).alias("sources"))
    again = F.struct(F.concat(F.upper("p_type"), F.lit(".")).alias("term"), F.lit("").alias("definition"), F.lit(None).cast(older_type).alias("sources"))
    formula = F.struct(F.when(k % 5 != 0, F.concat(F.lit("F/"), F.col("p_size"))).otherwise("").alias("name"), F.when(k % 10 != 0, " x ").alias("latex"), F.when(k % 4 == 0, "why").alias("explanation"))
    example = F.struct(F.concat_ws("  ", "p_name", "p_type", F.lit("a b c d e f g h")).alias("problem"), F.when(k % 2 == 0, "done").alias("solution"))
    asked = F.struct(F.lit("?").alias("question"), F.array(flat).alias("sources"))
    page = F.struct(F.lit("s").alias("summary"), F.array(note).alias("notes"), F.array(term, again).alias("keyTerms"), F.array(formula).alias("formulas"), F.array(example).alias("workedExamples"), F.array(asked).alias("openQuestions"))
    return p.select(k.alias("topic_id"), topics.parse_page(F.to_json(page)).alias("page"))


def page_flatten(spark, folder):
    b = topics.blocks(part_pages(spark, folder))
    cited = F.array_join(F.transform("sources", lambda s: F.concat(s["documentId"], F.lit("@"), s["page"].cast("string"))), ",")
    return b.select("topic_id", F.col("ord.section").alias("section"), F.col("ord.place").alias("place"), "key", "label", "text", cited.alias("cited"))


def page_diff_totals(spark, folder):
    """A part's page against the same page as it reads with another definition of its term and, for every third, another note."""
    before = topics.blocks(part_pages(spark, folder))
    noted = (F.col("kind") == "note") & (F.col("topic_id") % 3 == 1)
    after = before.where((F.col("kind") != "formula") | (F.col("topic_id") % 4 != 0)).select("topic_id", "ord", F.when(noted, F.lit("note:other")).otherwise(F.col("key")).alias("key"), "kind", "label", F.when((F.col("kind") == "keyTerm") & (F.col("topic_id") % 5 == 0), F.lit("new")).otherwise(F.col("text")).alias("text"), "sources")
    told = scan(spark, folder, "part", F.col("p_partkey").alias("topic_id"), F.lit(" s").alias("before"), F.when(F.col("p_partkey") % 6 == 0, "t").otherwise("s ").alias("after"))
    return topics.diff_totals(topics.page_diff(before, after), told)


def citation_labels(spark, folder):
    """What the pages cite: brands are documents, of which those of an even number are known, with pages 1 to 3 read."""
    brands = scan(spark, folder, "part", F.col("p_brand").alias("document_id")).distinct().where("CAST(substr(document_id, 7) AS INT) % 2 = 0")
    read = brands.select("document_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    cited = topics.citations(topics.blocks(part_pages(spark, folder)), read)
    labelled = topics.citation_labels(cited, brands.select("document_id", F.concat(F.lit("Lecture "), "document_id").alias("label")))
    return labelled.select("topic_id", "key", "status", "label")


QUERIES = {f.__name__: f for f in (page_flatten, page_diff_totals, citation_labels)}
#: Each part's blocks: section, place, key, label, text, and the one source that it has.
BLOCKS = """SELECT p_partkey AS topic_id, 0 AS section, 0 AS place, 'note:' || CASE WHEN p_partkey % 3 = 0 THEN 'n1' WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE 'index:0' END AS key,
 CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || '!' WHEN p_partkey % 3 = 0 THEN 'n1' ELSE 'note 1' END AS label, p_brand AS text, p_brand AS d, p_partkey % 7 AS page FROM part
 UNION ALL SELECT p_partkey, 1, 0, 'keyTerm:' || lower(p_type), upper(p_type[1]) || lower(p_type[2:]), p_brand, ' ', CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 ELSE p_partkey % 3 END FROM part
 UNION ALL SELECT p_partkey, 1, 1, 'keyTerm:' || lower(p_type), upper(p_type) || '.', '', NULL, NULL FROM part
 UNION ALL SELECT p_partkey, 2, 0, 'formula:' || CASE WHEN p_partkey % 5 <> 0 THEN 'f ' || p_size WHEN p_partkey % 10 <> 0 THEN 'x' ELSE 'index 0' END, CASE WHEN p_partkey % 5 <> 0 THEN 'F/' || p_size WHEN p_partkey % 10 <> 0 THEN 'x' ELSE 'formula 1' END,
 trim(CASE WHEN p_partkey % 10 <> 0 THEN 'x' ELSE '' END || ' ' || CASE WHEN p_partkey % 4 = 0 THEN 'why' ELSE '' END), NULL, NULL FROM part
 UNION ALL SELECT p_partkey, 3, 0, 'workedExample:' || lower(w), w, CASE WHEN p_partkey % 2 = 0 THEN 'done' ELSE '' END, NULL, NULL FROM (SELECT p_partkey, array_to_string(string_split_regex(p_name || ' ' || p_type || ' a b c d e f g h', '\\s+')[1:8], ' ') AS w FROM part)"""
ORACLES = {
    "page_flatten": f"SELECT topic_id, section, place, key, label, text, CASE WHEN page IS NOT NULL THEN d || '@' || page ELSE '' END AS cited FROM ({BLOCKS})",
    "page_diff_totals": """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 = 1 AS noted, p_partkey % 4 = 0 AS gone, p_partkey % 5 = 0 AS worded, p_partkey % 6 = 0 AS told FROM part)
 SELECT k AS topic_id, CAST(noted AS BIGINT) AS added, CAST(noted AS BIGINT) + CAST(gone AS BIGINT) AS removed, CAST(worded AS BIGINT) AS changed, 4 - CAST(noted AS BIGINT) - CAST(gone AS BIGINT) - CAST(worded AS BIGINT) AS unchanged, told AS summary_changed, NOT (noted OR gone OR worded OR told) AS identical FROM p""",
    "citation_labels": f"""WITH c AS (SELECT topic_id, key, nullif(trim(d), '') AS d, page FROM ({BLOCKS}) WHERE page IS NOT NULL), k AS (SELECT *, d IS NOT NULL AND CAST(d[7:] AS INTEGER) % 2 = 0 AS known FROM c)
 SELECT topic_id, key, CASE WHEN NOT known THEN 'unknown-document' WHEN page BETWEEN 1 AND 3 THEN 'resolved' ELSE 'unread-page' END AS status, CASE WHEN known THEN 'Lecture ' || d ELSE 'Unknown source' END || ' \u00b7 p. ' || page AS label FROM k""",
}
