"""Model-call cost rollups and budget decisions.

A null cost means "unpriced" and is counted apart: it is never read as zero before counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import local_day


def daily_cost(calls: DataFrame, zone: str = "Europe/Madrid") -> DataFrame:
    """One row per user, local day, provider and model.

    calls: user_id, created_at, provider, model, outcome, input_tokens, output_tokens, cache_read_tokens,
    cache_write_tokens, cost_usd (null: unpriced). cost_usd of a day is a lower bound, to be read with unpriced_calls.
    """
    priced = F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(14,8)")
    return calls.groupBy("user_id", local_day("created_at", zone).alias("day"), "provider", "model").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("outcome") == "success").alias("successes"),
        F.sum(F.col("input_tokens").cast("long")).alias("input_tokens"),
        F.sum(F.col("output_tokens").cast("long")).alias("output_tokens"),
        F.sum(F.col("cache_read_tokens").cast("long")).alias("cache_read_tokens"),
        F.sum(F.col("cache_write_tokens").cast("long")).alias("cache_write_tokens"),
        priced.alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_calls"),
    )


def month_to_date(daily: DataFrame, today: Column) -> DataFrame:
    """One row: cost and unpriced calls of the days from the first of today's month on."""
    return daily.where(F.col("day") >= F.trunc(today, "MM")).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(22,8)").alias("cost_usd"),
        F.coalesce(F.sum("unpriced_calls"), F.lit(0)).alias("unpriced_calls"),
    )


def run_spend(calls: DataFrame, jobs: list[str], since: Column) -> DataFrame:
    """One row: the priced sum (null where nothing is priced) and the unpriced calls of some jobs since a time."""
    mine = calls.where(F.col("job").isin(jobs) & (F.col("created_at") >= since))
    return mine.agg(F.sum("cost_usd").cast("decimal(22,8)").alias("spent_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_calls"))


#: Share of the budget from which each posture holds, mildest first, unpriced calls that are tolerated, the posture that
#: more of them lead to, and ranks of models.
POSTURES = (("normal", 0.0), ("defer-deep", 1.0), ("defer-balanced", 1.25), ("halt", 1.5))
UNPRICED_TOLERANCE = 5
ESCALATED = {"normal": "defer-deep", "defer-deep": "defer-balanced", "defer-balanced": "defer-balanced", "halt": "halt"}
RANK = {"fast": 0, "balanced": 1, "deep": 2}


def posture(spent: Column, budget: Column, unpriced: Column) -> Column:
    """Spend posture by the ratio spent/budget. A budget that is not a number above 0 halts; spend that is unknown or no number is
    normal, negative spend counts as 0. More than 5 unpriced calls lead one step further, but never to a halt."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    ratio = F.greatest(spent.cast("double"), F.lit(0.0)) / budget.cast("double")
    observed = F.lit("normal")
    for name, least in POSTURES[1:]:
        observed = F.when(ratio >= least, name).otherwise(observed)
    further = F.coalesce(*(F.when(observed == a, b) for a, b in ESCALATED.items()))
    return F.when(~(sound(budget) & (budget > 0)), "halt").when(~sound(spent), "normal").when(unpriced > UNPRICED_TOLERANCE, further).otherwise(observed)


def guard(kill_switch: Column, posture_name: Column, rank: Column, kind: Column) -> Column:
    """Why a call may not go out, or null: the kill switch, then a halt, stop all; interactive calls pass; background ones wait by
    their model's rank."""
    level = F.coalesce(*(F.when(rank == n, k) for n, k in RANK.items()))
    return (
        F.when(kill_switch, "kill-switch").when(posture_name == "halt", "budget-halt").when(kind == "interactive", F.lit(None).cast("string"))
        .when((posture_name == "defer-balanced") & (level >= RANK["balanced"]), "budget-defer-balanced")
        .when((posture_name == "defer-deep") & (level >= RANK["deep"]), "budget-defer-deep")
    )
