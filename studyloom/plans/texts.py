"""Queries over documents, conversations, pages and embeddings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import math as M
from ..functions import text as T
from ..operators import documents as D
from ..operators import intervals, relational, similarity, topics, vectors, windows
from ..sources.tables import scan, scan_dealt


def newest_turn_per_conv(spark, folder):
    c = scan(spark, folder, "conversations", "conv_id", "turn", "role")
    return windows.newest(c, ["conv_id"], F.col("turn"), F.col("role")).select("conv_id", "turn", "role")


def page_ranges(spark, folder):
    """Consecutive turn numbers of a conversation."""
    return windows.ranges(scan(spark, folder, "conversations", "conv_id", "turn"), ["conv_id"], "turn")


def lines_of(spark, folder):
    """The lines of every text as pages; a null text is an empty line."""
    d = scan_dealt(spark, folder, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("int").alias("page"), "line")


def segment_runs(spark, folder):
    """Lines as pages: a line of one sentence begins a run and titles it, as does every 5th line of a run."""
    pages = lines_of(spark, folder).withColumn("heading", F.length("line") < 40).withColumn("title", F.col("line"))
    return D.segments(pages, 5).select("doc_id", F.col("segment").cast("long").alias("segment"), "key", "title", "from_page", "to_page", "n")


def unaccounted_pages(spark, folder):
    """Lines as pages, of which there are two more than a document has: long ones were read, short ones of even documents declared skipped."""
    pages = lines_of(spark, folder)
    totals = pages.groupBy("doc_id").agg((F.count("*") + 2).cast("int").alias("total"))
    read = intervals.ranges_of(pages.where(F.length("line") >= 20).select("doc_id", "page"), "page")
    skips = pages.where((F.length("line") < 20) & (F.col("doc_id") % 2 == 0)).select("doc_id", F.col("page").alias("from_page"), F.col("page").alias("to_page"))
    return D.unaccounted(totals, read, skips)


def marked_pages(spark, folder, extra, reason):
    """Lines as pages: those of 20 characters or more were read, of them all but every third are cited, and every seventh of all; `reason`
    says why short ones were skipped. Totals, the coverage's pieces, what is cited and the skips."""
    pages = lines_of(spark, folder)
    totals = pages.groupBy("doc_id").agg((F.count("*") + extra).cast("int").alias("total"))
    read = pages.where(F.length("line") >= 20).select("doc_id", "page")
    cited = read.where("page % 3 <> 0").unionByName(pages.where("page % 7 = 0").select("doc_id", "page"))
    skips = pages.where(F.length("line") < 20).select("doc_id", F.col("page").alias("ord"), F.col("page").alias("to_page"), F.col("page").alias("from_page"), reason.alias("reason"))
    cited = intervals.ranges_of(cited, "page")
    return totals, D.coverage_segments(totals, intervals.ranges_of(read, "page"), cited, skips), cited, skips


def coverage_map(spark, folder):
    """The coverage of every document, with its label and warnings; the reason of a skip doesn't count on every tenth."""
    totals, pieces, cited, skips = marked_pages(spark, folder, F.col("doc_id") % 2, F.when(F.col("doc_id") % 10 == 0, "n/a").otherwise("cover page"))
    label = topics.coverage_label(*(F.col(f"pages_{c}") for c in ("mapped", "total", "unmapped", "skipped", "undeclared")), F.lit(2), F.col("checked"))
    told = D.coverage_warnings(D.coverage(pieces, totals), cited, skips)
    return told.select("doc_id", "pages_total", "pages_mapped", "pages_skipped", "pages_unmapped", "pages_undeclared", F.round("mapped_ratio", 9).alias("mapped_ratio"), "trustworthy", label.alias("label"), F.array_join("warnings", "\n").alias("warnings"))


def coverage_gaps(spark, folder):
    reason = F.when(F.col("page") % 5 == 0, "n/a").otherwise(F.concat(F.lit(" heading of page "), "page"))
    _, pieces, _, skips = marked_pages(spark, folder, F.lit(0), F.when(F.col("doc_id") % 2 == 0, reason).otherwise(F.lit(None)))
    return D.gap_reasons(D.coverage_gaps(pieces), skips.where("reason IS NOT NULL")).select("doc_id", "kind", "first", "last", "n", "reason")


def hash_normalise(spark, folder):
    return scan_dealt(spark, folder, "documents", "doc_id", "text").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


def chunk_identity(spark, folder):
    d = scan_dealt(spark, folder, "documents", "doc_id", "text")
    return d.select("doc_id", T.chunk_identity(F.concat(F.lit("page:"), F.col("doc_id")), F.col("text")).alias("chunk_hash"))


def token_estimate(spark, folder):
    return scan_dealt(spark, folder, "documents", "doc_id", "text").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def chunk_document(spark, folder):
    """Every document's lines as pages, merged and split into chunks; the chunk's hash stands for its content."""
    return D.chunk_texts(scan_dealt(spark, folder, "documents", "doc_id", "text")).select("doc_id", "page", "to_page", "part", "token_count", F.sha2("content", 256).alias("content_hash"))


def fuzzy_map(spark, folder):
    """Every document's nearest benchmark item by shared words, 0.18 at least, through lists of the items' rarer words."""
    items = scan(spark, folder, "benchmark", F.col("item_id").alias("rid"), T.token_set(F.col("text")).alias("words"))
    docs = scan_dealt(spark, folder, "documents", F.col("doc_id").alias("lid"), T.token_set(F.col("text")).alias("words"))
    best = relational.top_per(similarity.held_share(docs, items, 0.18), ["lid"], [F.desc("score"), F.col("rid")], 1)
    return best.select(F.col("lid").alias("doc_id"), F.col("rid").alias("item_id"), F.round("score", 9).alias("score"))


#: Dollars a million tokens in and out by role, for the price query.
RATES = {"user": (0.8, 4.0), "assistant": (3.0, 15.0), "system": (15.0, 75.0)}


def price_tokens(spark, folder):
    c = scan(spark, folder, "conversations", "conv_id", "role", F.length("text").alias("n"))
    rates = spark.createDataFrame([(r, a, b) for r, (a, b) in RATES.items()], "role string, rate_in double, rate_out double")
    tokens = F.ceil(F.col("n") / 4)
    cost = M.token_price(tokens, F.col("rate_in")) + M.token_price(tokens * 2, F.col("rate_out"))
    return c.join(F.broadcast(rates), "role").groupBy("role").agg(F.count("*").alias("calls"), F.round(F.sum(F.round(cost * 1e9)) / 1e9, 9).alias("usd"))


def chunks_of(spark, folder):
    e = scan(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.lit("u1").alias("user_id"), F.col("label").cast("string").alias("course_id"), "embedding")


def match_chunks(spark, folder):
    """The 10 nearest chunks of course 3 to a fixed query vector."""
    query = [((i * 37) % 11 - 5) / 5 for i in range(64)]
    return vectors.match_chunks(chunks_of(spark, folder), query, 10, user="u1", course_id="3").select("id", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


def topk_similar(spark, folder):
    """The 3 nearest vectors of the same label, for the queries: every row whose id is divisible by 100."""
    e = scan(spark, folder, "embeddings", "vec_id", "label", "embedding")
    left = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("lid"), "label", F.col("embedding").alias("lvec"))
    right = e.select(F.col("vec_id").alias("rid"), "label", F.col("embedding").alias("rvec"))
    return vectors.nearest_of(left, right, "label", 3).select("lid", "rid", F.col("rank").cast("long").alias("rank"))


def duplicate_guard(spark, folder):
    """Proposals (ids divisible by 100, every seventh of them without a vector) against all other vectors of their label, at the guard's
    own threshold; titles differ in case and spacing."""
    e = scan(spark, folder, "embeddings", "vec_id", "label", "embedding")
    title = F.concat(F.when(F.col("vec_id") % 200 == 0, "Topic  ").otherwise(" topic "), F.col("vec_id") % 300)
    left = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("lid"), title.alias("title"), "label", F.when(F.col("vec_id") % 700 != 0, F.col("embedding")).alias("lvec"))
    right = e.select(F.col("vec_id").alias("rid"), "label", F.col("embedding").alias("rvec"))
    return vectors.guard_duplicates(left, right, "label").select("lid", "decision", "rid", "into", "unguarded")


def coalesce_singletons(spark, folder):
    """Conversations as decks: a turn's role is its proposal."""
    c = scan(spark, folder, "conversations", F.col("conv_id").alias("deck_id"), "turn", "role")
    routed = c.withColumn("position", F.row_number().over(Window.partitionBy("deck_id").orderBy("turn", "role"))).select("deck_id", "position", F.col("role").alias("proposal"))
    return topics.coalesce_singletons(routed).select("deck_id", F.col("position").cast("long").alias("position"), "proposal", "into", "reason")


def provenance(spark, folder):
    """Conversations as topics, their turns as blocks that cite a document's page; documents have ten pages read."""
    c = scan(spark, folder, "conversations", "conv_id", "turn", "role")
    cite = F.struct(F.concat(F.lit("d"), (F.col("conv_id") + F.col("turn")) % 7).alias("documentId"), (F.col("turn") * 3).cast("int").alias("page"))
    second = F.struct(F.concat(F.lit("d"), F.col("turn") % 5).alias("documentId"), (F.col("turn") + 1).cast("int").alias("page"))
    rows = c.select(F.col("conv_id").alias("topic_id"), F.concat_ws(":", "role", "turn").alias("key"), F.lit("note").alias("kind"), F.when(F.col("role") == "system", F.array()).when(F.col("turn") % 2 == 0, F.array(cite)).otherwise(F.array(cite, second)).alias("sources")).dropDuplicates(["topic_id", "key"])
    read = spark.range(0, 6).select(F.concat(F.lit("d"), F.col("id")).alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page"))
    return topics.provenance(rows, read).groupBy("strength").agg(F.count("*").alias("n"), F.sum("citations").cast("long").alias("citations"))


def tail_turns(spark, folder):
    c = scan(spark, folder, "conversations", "conv_id", "turn", "role").where("role = 'user'")
    return relational.tail(c.withColumn("k", F.col("conv_id") * 1000 + F.col("turn")), "k", 40).select("k", "role")


def summary_normalise(spark, folder):
    """Raw feed summaries of parts: with sessions and room, extra, retake, pseudo row, final exam, or a course alone."""
    p = scan(spark, folder, "part", "p_partkey", "p_name", "p_size")
    course = F.concat(F.lit("COURSE"), F.expr("char(65 + p_size % 26)"))
    first, last = F.col("p_size") % 20 + 1, F.col("p_size") % 20 + 1 + F.col("p_size") % 3
    kind = F.col("p_partkey") % 6
    rest = (
        F.when(kind == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit(" (Ses. "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")  T-05.02"))).when(kind == 1, "  Extra session online")
        .when(kind == 2, "  Retake (Ses. 9-7)").when(kind == 4, "  Final exam").otherwise("")
    )
    rows = p.select("p_partkey", F.when(kind == 3, F.concat(F.lit("** Last update "), "p_size")).otherwise(F.concat(course, rest)).alias("raw"), F.when(kind == 0, "T-05.02|IE Tower").alias("location"))
    out = rows.select("p_partkey", "raw", *T.normalize_summary(F.col("raw"), F.col("location")))
    return out.withColumn("label", T.occurrence_label(F.col("title"), F.col("session_from"), F.col("session_to"), F.col("descriptor")))


QUERIES = {
    f.__name__: f
    for f in (
        newest_turn_per_conv, page_ranges, segment_runs, unaccounted_pages, coverage_map, coverage_gaps, hash_normalise, chunk_identity, token_estimate, chunk_document,
        fuzzy_map, price_tokens, match_chunks, topk_similar, duplicate_guard, coalesce_singletons, provenance, tail_turns, summary_normalise,
    )
}

LINES = "SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS page, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"
EDGE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '[ \t]+([\n\r\x{{2028}}\x{{2029}}]|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{EDGE}|{EDGE}$', '', 'g')"
COSINE = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
QUERY = "[" + ", ".join(str(((i * 37) % 11 - 5) / 5) for i in range(64)) + "]"

#: As NFKD does to Latin letters with a mark: the letter, then a character that is none.
_marked = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) == 2 and d[0].isascii() and unicodedata.combining(d[1]) and c == c.lower()]
_apart = "lower(text)"
for _c in _marked:
    _apart = f"replace({_apart}, '{_c}', '{unicodedata.normalize('NFKD', _c)[0]} ')"
TOKENS = f"list_distinct(list_filter(string_split_regex({_apart}, '[^a-z0-9]+'), lambda w: length(w) >= 3))"

ORACLES = {
    "newest_turn_per_conv": "SELECT conv_id, max(turn) AS turn, arg_max(role, (turn, role)) AS role FROM conversations GROUP BY conv_id",
    "page_ranges": """SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT DISTINCT conv_id, turn FROM conversations)) GROUP BY conv_id, g""",
    "segment_runs": f"""WITH b AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS g FROM ({LINES})),
 r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, g ORDER BY page) - 1) // 5 AS i FROM b),
 k AS (SELECT doc_id, g, i, min(page) AS from_page, max(page) AS to_page, count(*) AS n FROM r GROUP BY ALL),
 m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY from_page) AS segment, from_page, to_page, n FROM k)
 SELECT m.doc_id, segment, 'seg-' || segment AS key, CASE WHEN length(line) < 40 AND trim(line, ' ') <> '' THEN trim(line, ' ') WHEN from_page = to_page THEN 'Page ' || from_page ELSE 'Pages ' || from_page || '–' || to_page END AS title, from_page, to_page, n FROM m JOIN ({LINES}) l ON l.doc_id = m.doc_id AND l.page = from_page""",
    "unaccounted_pages": f"""WITH l AS ({LINES}), t AS (SELECT doc_id, page FROM l WHERE length(line) < 20 AND doc_id % 2 <> 0 UNION ALL SELECT doc_id, unnest([count(*) + 1, count(*) + 2]) FROM l GROUP BY doc_id),
 g AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM t) SELECT doc_id, CAST(min(page) AS BIGINT) AS lo, CAST(max(page) AS BIGINT) AS hi FROM g GROUP BY doc_id, g""",
    "coverage_map": f"""WITH l AS ({LINES}), t AS (SELECT doc_id, CAST(count(*) + doc_id % 2 AS INTEGER) AS total FROM l GROUP BY doc_id), p AS (SELECT doc_id, total, unnest(range(1, total + 1)) AS page FROM t),
 c AS (SELECT p.doc_id, total, line IS NOT NULL AND (p.page % 7 = 0 OR (length(line) >= 20 AND p.page % 3 <> 0)) AS cited, coalesce(length(line) >= 20, false) AS read, line IS NOT NULL AND length(line) < 20 AND p.doc_id % 10 <> 0 AS skip,
  CASE WHEN length(line) < 20 AND p.doc_id % 10 = 0 THEN 'Pages ' || p.page || '–' || p.page || ' were reported skipped with no usable reason (“n/a”), so they are counted as undeclared rather than as a reviewed omission.' END AS w, p.page FROM p LEFT JOIN l ON l.doc_id = p.doc_id AND l.page = p.page),
 n AS (SELECT doc_id, count(*) AS pages_total, count(*) FILTER (cited) AS pages_mapped, count(*) FILTER (skip) AS pages_skipped, count(*) FILTER (read AND NOT cited) AS pages_unmapped, count(*) FILTER (NOT read AND NOT cited AND NOT skip) AS pages_undeclared, string_agg(w, chr(10) ORDER BY page) AS told FROM c GROUP BY doc_id),
 r AS (SELECT *, pages_total - pages_skipped AS m, CASE WHEN pages_total = pages_skipped THEN 1.0::DOUBLE ELSE pages_mapped::DOUBLE / (pages_total - pages_skipped)::DOUBLE END AS q FROM n)
 SELECT doc_id, pages_total, pages_mapped, pages_skipped, pages_unmapped, pages_undeclared, round(q, 9) AS mapped_ratio, pages_undeclared = 0 AND q >= 0.6 AND pages_skipped::DOUBLE / pages_total::DOUBLE <= 0.3 AS trustworthy,
 concat_ws(' · ', pages_mapped || ' of ' || pages_total || ' pages mapped across 2 topics', CASE WHEN pages_unmapped > 0 THEN pages_unmapped || ' unmapped' END, CASE WHEN pages_skipped > 0 THEN pages_skipped || ' skipped' END, CASE WHEN pages_undeclared > 0 THEN pages_undeclared || ' unaccounted for' END) AS label,
 concat_ws(chr(10), told, CASE WHEN pages_undeclared = 1 THEN '1 page was neither read nor declared skipped. Content on it is missing from your notes without anything saying so.' WHEN pages_undeclared > 1 THEN pages_undeclared || ' pages were neither read nor declared skipped. Content on them is missing from your notes without anything saying so.' END,
  CASE WHEN pages_skipped::DOUBLE / pages_total > 0.3 THEN pages_skipped || ' of ' || pages_total || ' pages were declared skipped — a large share for one document. The reasons are worth reading before trusting these notes as complete.' END,
  CASE WHEN q < 0.6 THEN 'Only ' || pages_mapped || ' of ' || m || ' readable page' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' in this document are cited by any topic. The rest was read but did not reach your notes — treat these notes as incomplete until that is explained.' END) AS warnings FROM r""",
    "coverage_gaps": f"""WITH k AS (SELECT doc_id, page, CASE WHEN length(line) < 20 AND doc_id % 2 = 0 AND page % 5 <> 0 THEN 'skipped' WHEN page % 7 = 0 OR (length(line) >= 20 AND page % 3 <> 0) THEN 'mapped' WHEN length(line) >= 20 THEN 'unmapped' ELSE 'undeclared' END AS kind FROM ({LINES})),
 g AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, kind ORDER BY page) AS g FROM k WHERE kind <> 'mapped'),
 r AS (SELECT doc_id, kind, min(page) AS first, max(page) AS last, count(*) AS n FROM g GROUP BY doc_id, kind, g)
 SELECT *, CASE WHEN kind = 'skipped' THEN 'heading of page ' || first WHEN kind = 'unmapped' THEN 'read, but no topic page cites it' WHEN doc_id % 2 = 0 THEN 'reported skipped without a usable reason' ELSE 'not read and not declared skipped' END AS reason FROM r""",
    "hash_normalise": f"SELECT doc_id, sha256({NORMAL}) AS hash FROM documents",
    "chunk_identity": f"SELECT doc_id, sha256('page:' || doc_id || chr(10) || {NORMAL}) AS chunk_hash FROM documents",
    "token_estimate": rf"SELECT doc_id, CAST(greatest(1, ceil((length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')))::DOUBLE / 4)) AS INTEGER) AS tokens FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^{EDGE}|{EDGE}$', '', 'g') AS t FROM documents)",
    "fuzzy_map": f"""WITH i AS (SELECT item_id, unnest({TOKENS}) AS word FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
 d AS (SELECT doc_id, unnest({TOKENS}) AS word FROM documents),
 s AS (SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n)::DOUBLE AS score FROM d JOIN i USING (word) JOIN n USING (item_id) GROUP BY doc_id, item_id)
 SELECT doc_id, item_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM s WHERE score >= 0.18) WHERE r = 1""",
    "price_tokens": """WITH r(role, a, b) AS (VALUES ('user', 0.8::DOUBLE, 4.0::DOUBLE), ('assistant', 3.0::DOUBLE, 15.0::DOUBLE), ('system', 15.0::DOUBLE, 75.0::DOUBLE)), c AS (SELECT role, a, b, ceil(length(text)::DOUBLE / 4) AS t FROM conversations JOIN r USING (role))
 SELECT role, count(*) AS calls, round(sum(round((t * a / 1e6 + t * 2 * b / 1e6) * 1e9)) / 1e9, 9) AS usd FROM c GROUP BY role""",
    "match_chunks": f"SELECT vec_id AS id, round({COSINE.format('embedding', QUERY)}, 4) AS similarity FROM embeddings WHERE label = 3 AND embedding IS NOT NULL ORDER BY {COSINE.format('embedding', QUERY)} DESC, vec_id LIMIT 10",
    "topk_similar": f"""SELECT lid, rid, rank FROM (SELECT a.vec_id AS lid, b.vec_id AS rid, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE.format('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 3""",
    "duplicate_guard": f"""WITH l AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT l.vec_id AS lid, r.vec_id AS rid, row_number() OVER (PARTITION BY l.vec_id ORDER BY {COSINE.format('l.embedding', 'r.embedding')} DESC, r.vec_id) AS k
 FROM l JOIN embeddings r ON l.label = r.label AND l.vec_id <> r.vec_id WHERE l.vec_id % 700 <> 0 AND {COSINE.format('l.embedding', 'r.embedding')} >= 0.85), g AS (SELECT l.vec_id AS lid, label, vec_id % 300 AS t, rid FROM l LEFT JOIN s ON s.lid = l.vec_id AND k = 1),
 f AS (SELECT *, min(lid) FILTER (rid IS NULL) OVER (PARTITION BY label, t) AS first FROM g)
 SELECT lid, CASE WHEN rid IS NOT NULL THEN 'coerced-to-existing' WHEN lid <> first THEN 'merged-into-proposal' ELSE 'create' END AS decision, rid, CASE WHEN rid IS NULL AND lid <> first THEN first END AS into, CASE WHEN lid % 700 = 0 THEN 'no-title-embedding' END AS unguarded FROM f""",
    "coalesce_singletons": """WITH p AS (SELECT conv_id AS deck_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position, role AS proposal FROM conversations), s AS (SELECT *, count(*) OVER (PARTITION BY deck_id, proposal) AS n FROM p),
 w AS (SELECT *, max(CASE WHEN n >= 2 THEN position END) OVER (PARTITION BY deck_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, min(CASE WHEN n >= 2 THEN position END) OVER (PARTITION BY deck_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM s),
 c AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN b IS NULL OR position - a <= b - position THEN a ELSE b END END AS near FROM w)
 SELECT c.deck_id, c.position, c.proposal, r.proposal AS into, CASE WHEN c.n = 1 AND r.proposal IS NULL THEN 'no-multi-segment-receiver' END AS reason FROM c LEFT JOIN s r ON r.deck_id = c.deck_id AND r.position = c.near""",
    "provenance": """WITH k AS (SELECT DISTINCT conv_id, turn, role FROM conversations), c AS (SELECT conv_id, turn, role, 'd' || (conv_id + turn) % 7 AS d, turn * 3 AS page FROM k WHERE role <> 'system' UNION ALL SELECT conv_id, turn, role, 'd' || turn % 5, turn + 1 FROM k WHERE role <> 'system' AND turn % 2 <> 0),
 s AS (SELECT *, d <> 'd6' AND page BETWEEN 1 AND 10 AS ok FROM c), b AS (SELECT k.conv_id, k.turn, k.role, count(d) AS n, count(*) FILTER (ok) AS good, count(DISTINCT CASE WHEN ok THEN d || '#' || page END) AS places FROM k LEFT JOIN s USING (conv_id, turn, role) GROUP BY ALL)
 SELECT CASE WHEN n = 0 THEN 'absent' WHEN good = 0 THEN 'broken' WHEN places >= 2 THEN 'corroborated' ELSE 'single' END AS strength, count(*) AS n, CAST(sum(n) AS BIGINT) AS citations FROM b GROUP BY 1""",
    "summary_normalise": """WITH p AS (SELECT *, p_partkey % 6 AS k, 'COURSE' || chr(65 + p_size % 26) AS c, p_size % 20 + 1 AS a, p_size % 20 + 1 + p_size % 3 AS b FROM part)
 SELECT p_partkey, CASE k WHEN 0 THEN c || '  ' || p_name || ' (Ses. ' || a || '-' || b || ')  T-05.02' WHEN 1 THEN c || '  Extra session online' WHEN 2 THEN c || '  Retake (Ses. 9-7)' WHEN 3 THEN '** Last update ' || p_size WHEN 4 THEN c || '  Final exam' ELSE c END AS raw,
 CASE k WHEN 3 THEN '** Last update ' || p_size ELSE c END AS course_name, CASE k WHEN 0 THEN p_name WHEN 1 THEN 'Extra session' WHEN 2 THEN 'Retake' WHEN 4 THEN 'Final exam' ELSE '' END AS title, CAST(CASE k WHEN 0 THEN a WHEN 2 THEN 9 END AS INTEGER) AS session_from, CAST(CASE k WHEN 0 THEN b WHEN 2 THEN 9 END AS INTEGER) AS session_to,
 CASE k WHEN 1 THEN 'extra' WHEN 2 THEN 'retake' WHEN 4 THEN 'final_exam' ELSE 'regular' END AS descriptor, CASE WHEN k = 3 THEN 'last_update' END AS pseudo, CASE k WHEN 0 THEN p_name WHEN 1 THEN 'Extra session' WHEN 2 THEN 'Retake' WHEN 4 THEN 'Final exam' ELSE 'Class' END AS label FROM p""",
    "tail_turns": "SELECT * FROM (SELECT conv_id * 1000 + turn AS k, role FROM conversations WHERE role = 'user' ORDER BY 1 DESC LIMIT 40) ORDER BY k",
}
