"""Cost queries. The events table stands in for the call log: an `error` event has no price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import costs
from ..sources.tables import scan

#: The fixed "now" of the queries over events.
TODAY = "2024-01-30"


def calls(spark, folder) -> DataFrame:
    ev = scan(spark, folder, "events", "ts", "user_id", "event_type", "value")
    cost = F.when(F.col("event_type") != "error", F.col("value").cast("decimal(14,8)"))
    return ev.select(
        "user_id", F.col("ts").cast("timestamp").alias("created_at"), F.lit("p").alias("provider"),
        F.col("event_type").alias("model"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("outcome"),
        F.floor(F.col("value")).alias("input_tokens"), F.floor(F.col("value") * 2).alias("output_tokens"),
        F.floor(F.col("value") / 2).alias("cache_read_tokens"), F.floor(F.col("value") / 3).alias("cache_write_tokens"),
        cost.alias("cost_usd"), F.col("event_type").alias("job"),
    )


def daily_rollup_local_day(spark, folder):
    return costs.daily_cost(calls(spark, folder))


def month_to_date_spend(spark, folder):
    return costs.month_to_date(costs.daily_cost(calls(spark, folder)), F.lit(TODAY).cast("date"))


def spend_posture(spark, folder):
    """The month's spend against eight budgets, with few and many unpriced calls, for every kind and rank of call."""
    month = month_to_date_spend(spark, folder)
    budgets = spark.range(1, 9).select((F.col("id") * 100_000.0).alias("budget"), F.explode(F.array(F.lit(5), F.lit(6))).alias("unpriced"))
    each = lambda *xs: F.explode(F.array(*map(F.lit, xs)))
    rows = budgets.select("*", each("deep", "balanced", "fast").alias("rank")).select("*", each("interactive", "background").alias("kind")).select("*", each(True, False).alias("stopped"))
    rows = rows.join(F.broadcast(month.withColumn("one", F.lit(True))), F.col("one"))
    rows = rows.withColumn("posture", costs.posture(F.col("cost_usd").cast("double"), F.col("budget"), F.col("unpriced")))
    return rows.select("budget", "unpriced", "rank", "kind", "stopped", "posture", costs.guard(F.col("stopped"), F.col("posture"), F.col("rank"), F.col("kind")).alias("reason"))


def run_scoped_spend(spark, folder):
    return costs.run_spend(calls(spark, folder), ["purchase", "error"], F.lit("2024-01-15").cast("timestamp"))


DAILY = """SELECT user_id, CAST(timezone('Europe/Madrid', timezone('UTC', ts)) AS DATE) AS day, 'p' AS provider,
 event_type AS model, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS successes,
 CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(CAST(floor(value * 2) AS BIGINT)) AS BIGINT) AS output_tokens,
 CAST(sum(CAST(floor(value / 2) AS BIGINT)) AS BIGINT) AS cache_read_tokens, CAST(sum(CAST(floor(value / 3) AS BIGINT)) AS BIGINT) AS cache_write_tokens,
 CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(14,8)) END), 0) AS DECIMAL(14,8)) AS cost_usd,
 count(*) FILTER (event_type = 'error') AS unpriced_calls FROM events GROUP BY ALL"""
MONTH = f"""SELECT CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(22,8)) AS cost_usd, CAST(coalesce(sum(unpriced_calls), 0) AS BIGINT) AS unpriced_calls
 FROM ({DAILY}) WHERE day >= date_trunc('month', DATE '{TODAY}')"""

QUERIES = {f.__name__: f for f in (daily_rollup_local_day, month_to_date_spend, spend_posture, run_scoped_spend)}
ORACLES = {
    "daily_rollup_local_day": DAILY,
    "month_to_date_spend": MONTH,
    "spend_posture": f"""WITH r AS (SELECT b * 100000.0::DOUBLE AS budget, CAST(unpriced AS INTEGER) AS unpriced, rank, kind, stopped, CAST(cost_usd AS DOUBLE) / (b * 100000.0::DOUBLE) AS ratio
 FROM range(1, 9) t(b), (VALUES (5), (6)) n(unpriced), (VALUES ('deep'), ('balanced'), ('fast')) k(rank), (VALUES ('interactive'), ('background')) i(kind), (VALUES (true), (false)) q(stopped), ({MONTH})),
 p AS (SELECT *, CASE WHEN ratio >= 1.5 THEN 'halt' WHEN ratio >= 1.25 OR (ratio >= 1 AND unpriced > 5) THEN 'defer-balanced' WHEN ratio >= 1 OR unpriced > 5 THEN 'defer-deep' ELSE 'normal' END AS posture FROM r)
 SELECT budget, unpriced, rank, kind, stopped, posture, CASE WHEN stopped THEN 'kill-switch' WHEN posture = 'halt' THEN 'budget-halt' WHEN kind = 'interactive' THEN NULL WHEN posture = 'defer-balanced' AND rank <> 'fast' THEN 'budget-defer-balanced'
 WHEN posture = 'defer-deep' AND rank = 'deep' THEN 'budget-defer-deep' END AS reason FROM p""",
    "run_scoped_spend": """SELECT CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(14,8)) END) AS DECIMAL(22,8)) AS spent_usd,
 count(*) FILTER (event_type = 'error') AS unpriced_calls FROM events WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-15'""",
}
