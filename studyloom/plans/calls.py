"""Queries over model calls: prices, model resolution, the call log, reused vectors. Line items stand in for calls: a ship mode is
a model, quantities are token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices as R
from ..operators import sinks
from ..sources.tables import scan


def calls(spark, folder):
    """Line items as calls of five models and one that the card doesn't hold."""
    li = scan(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    names = F.array(*(F.lit(m[0]) for m in R.MODELS), F.lit("unlisted"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.element_at(names, (F.col("l_partkey") % 6 + 1).cast("int")).alias("model"), F.col("l_suppkey").alias("user_id"),
        (F.col("l_quantity") * 5000).cast("long").alias("input_tokens"), (F.col("l_quantity") * 300).cast("long").alias("output_tokens"),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_quantity") * 1000).cast("long")).alias("cache_read_tokens"), F.when(F.col("l_linenumber") % 3 == 0, (F.col("l_quantity") * 700).cast("long")).alias("cache_write_tokens"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"), F.when(F.col("l_linenumber") == 7, "error").otherwise("success").alias("outcome"), (F.col("l_quantity") + 0.5).alias("latency_ms"),
    )


def call_prices(spark, folder):
    """Each call's price at the durable rates, with the promotion on its date, and at batch rates."""
    c, card = calls(spark, folder), R.rate_card(spark)
    on = F.timestamp_seconds(F.lit(1785196800) + F.col("call_id") % 60 * 86400)  # 2026-07-28 and the 59 days after
    out = R.price_calls(c, card)
    out = R.price_calls(out, card, as_of=on, name="promo_usd")
    out = R.price_calls(out, card, batch=True, name="batch_usd")
    return out.groupBy("model").agg(F.count("*").alias("calls"), F.count("cost_usd").alias("priced"), *(F.round(F.sum(c), 6).alias(c) for c in ("cost_usd", "promo_usd", "batch_usd")))


def long_context_calls(spark, folder):
    """Calls whose whole prompt, cached or not, is over the bracket of their model, by their price a token."""
    c = R.price_calls(calls(spark, folder), R.rate_card(spark))
    prompt = F.col("input_tokens") + F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_write_tokens", F.lit(0))
    return c.where("model = 'gemini-3.1-pro-preview'").groupBy((prompt > 200_000).alias("over")).agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("usd"))


def embedding_prices(spark, folder):
    p = scan(spark, folder, "pages", "page_id", "html")
    return p.select("page_id", F.round(R.embedding_price(F.ceil(F.length("html") / 4)), 12).alias("usd"))


def model_resolution(spark, folder):
    """Suppliers as jobs, each with a model and a limit of rank."""
    s = scan(spark, folder, "supplier", F.col("s_suppkey").alias("job"))
    names = F.array(*(F.lit(m[0]) for m in R.MODELS))
    jobs = s.select("job", F.element_at(names, (F.col("job") % 5 + 1).cast("int")).alias("model"), F.when(F.col("job") % 4 != 3, (F.col("job") % 4).cast("int")).alias("max_rank"))
    return R.resolve_models(jobs, R.rate_card(spark))


def model_escalation(spark, folder):
    s = scan(spark, folder, "supplier", F.col("s_suppkey").alias("job"))
    names = F.array(*(F.lit(m[0]) for m in R.MODELS))
    jobs = s.select("job", F.element_at(names, (F.col("job") % 5 + 1).cast("int")).alias("model"), F.when(F.col("job") % 4 != 3, (F.col("job") % 4).cast("int")).alias("max_rank"))
    return R.escalation_targets(jobs, R.rate_card(spark)).select("job", "target")


def job_models(spark, folder):
    """Events as calls of jobs, each under a limit of rank: the model that every job gets under each, where it escalates to from there,
    and how many calls that serves."""
    card, jobs = R.rate_card(spark), R.job_registry(spark, (("own-job", "claude-haiku-4-5"), ("quick-add", "claude-opus-4-8")))
    out = None
    for rank in (0, 1, 2):
        at = R.resolve_models(jobs.withColumn("max_rank", F.lit(rank)), card).withColumn("max_rank", F.lit(rank))
        part = R.escalation_targets(at, card)
        out = part if out is None else out.unionByName(part)
    names = F.array(*(F.lit(j) for j, _ in R.JOBS), F.lit("own-job"))
    calls = scan(spark, folder, "events", F.element_at(names, (F.col("event_id") % (len(R.JOBS) + 1) + 1).cast("int")).alias("job"), (F.col("event_id") % 7 % 3).cast("int").alias("max_rank"))
    return calls.groupBy("job", "max_rank").agg(F.count("*").alias("calls")).join(F.broadcast(out), ["job", "max_rank"])


def call_log(spark, folder):
    """A log of even calls, to which all are appended; those without a reported count cost an unknown amount."""
    c = calls(spark, folder)
    counts = ("input", "output", "cache_read", "cache_write")
    silent = F.col("call_id") % 10 == 3
    c = c.select(*(F.when(~silent, F.col(x)).alias(x) if x.endswith("_tokens") else F.col(x) for x in c.columns))
    priced = c.join(F.broadcast(R.rate_card(spark).drop("provider", "rank")), "model", "left")
    rows = sinks.log_rows(priced, R.call_price())
    log = sinks.append_log(rows.where("call_id % 2 = 0"), rows, F.col("model"), F.col("latency_ms"))
    daily = log.groupBy("model", "outcome").agg(F.count("*").alias("calls"), *(F.sum(f"{x}_tokens").alias(f"{x}_tokens") for x in counts), F.sum("latency_ms").alias("latency_ms"), F.round(F.sum("cost_usd"), 3).cast("double").alias("usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"))
    return daily


def vector_reuse(spark, folder):
    """Documents as chunks of two users; every third document's vector is stored already."""
    d = scan(spark, folder, "documents", "doc_id", "text")
    chunks = d.select("doc_id", (F.col("doc_id") % 2).alias("user_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("chunk_hash"))
    stored = chunks.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), "user_id", "chunk_hash", F.when(F.col("doc_id") % 9 != 0, F.array(F.col("doc_id").cast("double"))).alias("embedding"))
    return sinks.reuse_vectors(chunks, stored).select("doc_id", "fresh", F.col("embedding")[0].alias("vector"))


QUERIES = {f.__name__: f for f in (call_prices, long_context_calls, embedding_prices, model_resolution, model_escalation, job_models, call_log, vector_reuse)}

_num = lambda x: "NULL::DOUBLE" if x is None else f"{x!r}::DOUBLE"
_rows = []
for _k, (_m, _p, _r, *_rates) in enumerate(R.MODELS, 1):
    _promo, _through = R.PROMOTIONS.get(_m, ((None,) * 4, None))
    _bracket, _long = R.LONG_CONTEXT.get(_m, (None, (None,) * 4))
    _cells = [f"'{_m}'", f"'{_p}'", f"{_r}", f"{_k}", *map(_num, _rates), *map(_num, _promo), f"DATE '{_through}'" if _through else "NULL::DATE", f"{_bracket or 'NULL'}::BIGINT", *map(_num, _long), _num(R.BATCH.get(_m, 1.0))]
    _rows.append(f"({', '.join(_cells)})")
CARD = f"card(model, provider, rank, place, ri, ro, rr, rw, pi, po, pr, pw, through, bracket, li, lo, lr, lw, batch) AS (VALUES {', '.join(_rows)})"
NAMES = "[" + ", ".join(f"'{m[0]}'" for m in R.MODELS) + "]"
CALLS = """calls AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, CASE WHEN l_partkey % 6 = 5 THEN 'unlisted' ELSE {names}[CAST(l_partkey % 6 + 1 AS INTEGER)] END AS model, CAST(l_quantity * 5000 AS BIGINT) AS i, CAST(l_quantity * 300 AS BIGINT) AS o,
 CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity * 1000 AS BIGINT) END AS r, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity * 700 AS BIGINT) END AS w, l_quantity + 0.5 AS latency, CASE WHEN l_linenumber = 7 THEN 'error' ELSE 'success' END AS outcome FROM lineitem)""".format(names=NAMES)
PRICED = f"""{CARD}, {CALLS}, priced AS (SELECT calls.*, i + coalesce(r, 0) + coalesce(w, 0) AS prompt, batch, bracket, DATE '2026-07-28' + CAST(call_id % 60 AS INTEGER) <= through AS promo,
 (i * ri + o * ro + coalesce(r, 0) * rr + coalesce(w, 0) * coalesce(rw, 0)) / 1e6 AS base, (i * pi + o * po + coalesce(r, 0) * pr + coalesce(w, 0) * coalesce(pw, 0)) / 1e6 AS lowered,
 (i * li + o * lo + coalesce(r, 0) * lr + coalesce(w, 0) * coalesce(lw, 0)) / 1e6 AS beyond FROM calls LEFT JOIN card USING (model)),
 costed AS (SELECT *, CASE WHEN prompt > bracket THEN beyond ELSE base END AS cost FROM priced)"""
JOBS = f"jobs AS (SELECT s_suppkey AS job, {NAMES}[CAST(s_suppkey % 5 + 1 AS INTEGER)] AS model, CASE WHEN s_suppkey % 4 <> 3 THEN s_suppkey % 4 END AS max_rank FROM supplier)"

ORACLES = {
    "call_prices": f"WITH {PRICED} SELECT model, count(*) AS calls, count(cost) AS priced, round(sum(cost), 6) AS cost_usd, round(sum(CASE WHEN promo THEN lowered ELSE cost END), 6) AS promo_usd, round(sum(cost * batch), 6) AS batch_usd FROM costed GROUP BY model",
    "long_context_calls": f"WITH {PRICED} SELECT prompt > 200000 AS over, count(*) AS calls, round(sum(cost), 6) AS usd FROM costed WHERE model = 'gemini-3.1-pro-preview' GROUP BY 1",
    "embedding_prices": "SELECT page_id, round(ceil(length(html)::DOUBLE / 4) * 0.02::DOUBLE / 1e6, 12) AS usd FROM pages",
    "model_resolution": f"""WITH {CARD}, {JOBS}, u AS (SELECT j.job, j.model, a.rank, j.max_rank, b.model AS m, row_number() OVER (PARTITION BY j.job ORDER BY b.provider = a.provider DESC, b.rank DESC, b.place) AS k FROM jobs j JOIN card a USING (model) JOIN card b ON b.rank <= coalesce(j.max_rank, 99))
 SELECT job, CASE WHEN max_rank IS NULL OR rank <= max_rank THEN model ELSE m END AS model FROM u WHERE k = 1""",
    "model_escalation": f"""WITH {CARD}, {JOBS}, u AS (SELECT j.job, b.model AS m, row_number() OVER (PARTITION BY j.job ORDER BY b.rank, b.provider = a.provider, b.place) AS k FROM jobs j JOIN card a USING (model) JOIN card b ON b.rank > a.rank AND b.rank <= coalesce(j.max_rank, 99))
 SELECT j.job, u.m AS target FROM jobs j LEFT JOIN u ON u.job = j.job AND k = 1""",
    "job_models": f"""WITH {CARD}, j AS (SELECT job, CASE job WHEN 'quick-add' THEN 'claude-opus-4-8' ELSE model END AS own FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in R.JOBS)}, ('own-job', 'claude-haiku-4-5')) t(job, model)),
 u AS (SELECT job, own, a.rank, m.r AS max_rank, b.model AS best, row_number() OVER (PARTITION BY job, m.r ORDER BY b.provider = a.provider DESC, b.rank DESC, b.place) AS k FROM j JOIN card a ON a.model = own, (VALUES (0), (1), (2)) m(r) JOIN card b ON b.rank <= m.r),
 v AS (SELECT job, max_rank, CASE WHEN rank <= max_rank THEN own ELSE best END AS model FROM u WHERE k = 1),
 x AS (SELECT v.*, b.model AS target, row_number() OVER (PARTITION BY job, max_rank ORDER BY b.rank, b.provider = a.provider, b.place) AS k FROM v JOIN card a USING (model) LEFT JOIN card b ON b.rank > a.rank AND b.rank <= max_rank)
 ,c AS (SELECT [{", ".join(f"'{a}'" for a, _ in R.JOBS)}, 'own-job'][CAST(event_id % {len(R.JOBS) + 1} + 1 AS INTEGER)] AS job, event_id % 7 % 3 AS max_rank, count(*) AS calls FROM events GROUP BY ALL)
 SELECT x.job, model, CAST(x.max_rank AS INTEGER) AS max_rank, target, calls FROM x JOIN c ON c.job = x.job AND c.max_rank = x.max_rank WHERE k = 1""",
    "call_log": f"""WITH {PRICED}, said AS (SELECT *, call_id % 10 = 3 AS silent FROM costed QUALIFY call_id % 2 = 0 OR row_number() OVER (PARTITION BY call_id ORDER BY model, latency) = 1)
 SELECT model, outcome, count(*) AS calls, CAST(sum(CASE WHEN silent THEN 0 ELSE i END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN silent THEN 0 ELSE o END) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN silent THEN 0 ELSE coalesce(r, 0) END) AS BIGINT) AS cache_read_tokens,
 CAST(sum(CASE WHEN silent THEN 0 ELSE coalesce(w, 0) END) AS BIGINT) AS cache_write_tokens, CAST(sum(CAST(floor(latency + 0.5) AS BIGINT)) AS BIGINT) AS latency_ms, CAST(round(sum(CASE WHEN NOT silent THEN CAST(cost AS DECIMAL(14, 8)) END), 3) AS DOUBLE) AS usd, count(*) FILTER (silent OR cost IS NULL) AS unpriced FROM said GROUP BY ALL""",
    "vector_reuse": """WITH c AS (SELECT doc_id, doc_id % 2 AS u, sha256(coalesce(text, '')) AS h FROM documents), s AS (SELECT u, h, min(doc_id) AS id FROM c WHERE doc_id % 3 = 0 AND doc_id % 9 <> 0 GROUP BY ALL)
 SELECT doc_id, id IS NULL AS fresh, id::DOUBLE AS vector FROM c LEFT JOIN s USING (u, h)""",
}
