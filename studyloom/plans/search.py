"""Search queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearest, search
from ..sources.tables import scan, scan_dealt, shared_folder


def documents_index(spark, folder, places: bool = False) -> str:
    at = shared_folder(spark, "text-index")
    search.build_index(scan_dealt(spark, folder, "documents", F.col("doc_id").alias("id"), "text"), at, places)
    return at


def vector_clusters(spark, folder):
    """Clusters of all embeddings, their centres, and as queries the vectors whose id is divisible by 100."""
    e, at = scan(spark, folder, "embeddings", "vec_id", "label", "embedding"), shared_folder(spark, "clusters")
    centres = nearest.build_clusters(e.select(F.col("vec_id").alias("rid"), "label", F.col("embedding").alias("rvec")), at, 64)
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("lid"), "label", F.col("embedding").alias("lvec"))
    return spark.read.parquet(at), centres, queries


def clustered_topk(spark, folder):
    """The 3 nearest vectors of the same label, through clusters."""
    clusters, centres, queries = vector_clusters(spark, folder)
    return nearest.search_clusters(clusters, centres, queries, 3, ["label"]).select("lid", "rid", F.col("rank").cast("long").alias("rank"))


def hybrid_search(spark, folder):
    """The 10 documents most like each whose id is divisible by 100: by its rarest terms, and by the vector of its id."""
    at = documents_index(spark, folder)
    ids = scan(spark, folder, "documents", F.col("doc_id").alias("id")).where("id % 100 = 0")
    text = search.rank_text(at, search.telling_terms(at, ids), others=True)
    clusters, centres, queries = vector_clusters(spark, folder)
    near = nearest.search_clusters(clusters, centres, queries.join(ids.distinct(), F.col("lid") == F.col("id"), "left_semi"), search.DEPTH)
    fused = search.fuse(text, near.select(F.col("lid").alias("query_id"), F.col("rid").alias("id"), "rank"), 10)
    return fused.select("query_id", "id", F.col("text_rank").cast("long").alias("text_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), F.round("score", 12).alias("score"), F.col("rank").cast("long").alias("rank"))


def text_search(spark, folder):
    """The 5 documents that fit each benchmark item best, by all of its terms."""
    at = documents_index(spark, folder)
    asked = scan(spark, folder, "benchmark", F.col("item_id").alias("query_id"), F.explode(search.terms(F.col("text"))).alias("term"))
    return search.rank_text(at, asked, 5).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def phrase_search(spark, folder):
    """Where the three terms from each benchmark item's longest term on stand together, in any document."""
    at = documents_index(spark, folder, places=True)
    words = search.terms(F.col("text"))
    items = scan(spark, folder, "benchmark", F.col("item_id").alias("query_id"), words.alias("w"))
    first = F.array_position(F.transform("w", F.length), F.array_max(F.transform("w", F.length))).cast("int")
    phrases = items.where(F.size("w") > 0).select("query_id", F.slice("w", first, F.lit(3)).alias("phrase"))
    return search.phrase_matches(at, phrases).select("query_id", "id", F.size("starts").cast("long").alias("n"), F.element_at("starts", 1).cast("long").alias("first"))


QUERIES = {f.__name__: f for f in (clustered_topk, hybrid_search, text_search, phrase_search)}

TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
#: Postings p, document frequencies t and totals m, and a score of q's terms over them, s.
INDEX = f"""d AS (SELECT doc_id AS id, {TERMS} AS w FROM documents), p AS (SELECT id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY id, term),
 t AS (SELECT term, count(*) AS df FROM p GROUP BY term), m AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT CAST(sum(tf) AS BIGINT) FROM p) AS words)"""
SCORE = f"""s AS (SELECT query_id, p.id, CAST(sum(CAST(floor(1000 * (ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {search.K1 + 1!r}::DOUBLE) / (tf + {search.K1!r}::DOUBLE * ({1 - search.B!r}::DOUBLE + {search.B!r}::DOUBLE * (len * n / words))))) AS BIGINT)) AS BIGINT) AS score
 FROM q JOIN p USING (term) JOIN t USING (term), m WHERE {{0}} GROUP BY query_id, p.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""
COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

ORACLES = {
    "clustered_topk": f"""SELECT lid, rid, rank FROM (SELECT a.vec_id AS lid, b.vec_id AS rid, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 3""",
    "hybrid_search": f"""WITH {INDEX}, q AS (SELECT id AS query_id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY df, tf DESC, term) AS k FROM p JOIN t USING (term) WHERE id % 100 = 0 AND df >= 2) WHERE k <= 8), {SCORE.format("query_id <> p.id")},
 v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND a.vec_id IN (SELECT doc_id FROM documents)),
 f AS (SELECT query_id, id, r.rank AS text_rank, v.rank AS vector_rank, coalesce(1::DOUBLE / ({search.RRF} + r.rank), 0) + coalesce(1::DOUBLE / ({search.RRF} + v.rank), 0) AS score FROM (SELECT * FROM r WHERE rank <= {search.DEPTH}) r FULL JOIN (SELECT * FROM v WHERE rank <= {search.DEPTH}) v USING (query_id, id))
 SELECT query_id, id, text_rank, vector_rank, round(score, 12) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "text_search": f"""WITH {INDEX}, q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark), {SCORE.format("true")} SELECT query_id, id, score, rank FROM r WHERE rank <= 5""",
    "phrase_search": f"""WITH d AS (SELECT doc_id AS id, {TERMS} AS w FROM documents), b AS (SELECT item_id AS query_id, {TERMS} AS w FROM benchmark),
 f AS (SELECT *, list_position(list_transform(w, lambda x: length(x)), list_max(list_transform(w, lambda x: length(x)))) AS i FROM b WHERE len(w) > 0), q AS (SELECT query_id, len(list_slice(w, i, i + 2)) AS n, array_to_string(list_slice(w, i, i + 2), ' ') AS phrase FROM f),
 g AS (SELECT DISTINCT n FROM q), x AS (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, g WHERE len(w) >= n), y AS (SELECT id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM x)
 SELECT query_id, id, count(*) AS n, min(i) - 1 AS first FROM q JOIN y USING (n, phrase) GROUP BY query_id, id""",
}
