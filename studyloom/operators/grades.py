"""Grade maths: standings, what is still needed, averages and conversions. Closed forms, no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scale's best and pass marks, and the best and worst converted grade.
BEST, PASS, GERMAN_BEST, GERMAN_PASS = 10.0, 5.0, 1.0, 4.0
#: What rounding may add to a mark: a target that is met exactly is met.
NOISE = 1e-9


def standing(components: DataFrame, by: list[str]) -> DataFrame:
    """(by, weight, score, max_score) -> by, graded_weight, open_weight, banked, standing.

    score null: not graded yet. A score counts as its share of max_score on the scale of BEST, held within it. banked is the
    sum of weight times mark of what is graded, standing their mean by weight: null where nothing of weight is graded. A null
    or negative weight counts as 0; a null or non-positive max_score leaves a component ungraded.
    """
    mark = F.when(F.col("score").isNotNull() & (F.col("max_score") > 0), F.greatest(F.lit(0.0), F.least(F.lit(BEST), F.col("score") / F.col("max_score") * BEST)))
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = components.select(*by, weight.alias("w"), mark.alias("m"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = rows.groupBy(*by).agg(total(F.when(F.col("m").isNotNull(), F.col("w"))).alias("graded_weight"), total(F.when(F.col("m").isNull(), F.col("w"))).alias("open_weight"), total(F.col("w") * F.col("m")).alias("banked"))
    return sums.withColumn("standing", F.when(F.col("graded_weight") > 0, F.col("banked") / F.col("graded_weight")))


def required_score(graded: Column, open_: Column, banked: Column, target: Column) -> tuple[Column, Column]:
    """(case, mark) that all that is open needs on average for the whole to reach `target`: `needed` with the mark; `secured`, 0, where
    anything will do; `unreachable`, null, where not even BEST would; and with nothing open `locked`, null, as met or missed."""
    short = target * (graded + open_) - banked
    need = short / F.when(open_ > 0, open_)
    case = (
        F.when(graded + open_ <= 0, F.lit(None).cast("string")).when((open_ <= 0) & (short <= NOISE), "locked_met").when(open_ <= 0, "locked_missed")
        .when(need <= NOISE, "secured").when(need > BEST + NOISE, "unreachable").otherwise("needed")
    )
    return case, F.when(case == "needed", F.least(need, F.lit(BEST))).when(case == "secured", 0.0)


def semester_average(courses: DataFrame, by: list[str]) -> DataFrame:
    """(by, grade, credits) -> by, average (by credits, of courses with a grade), earned (credits of those passed) and open credits."""
    has = F.col("grade").isNotNull() & (F.col("credits") > 0)
    credits = lambda which: F.coalesce(F.sum(F.when(which, F.col("credits"))), F.lit(0.0))
    sums = courses.groupBy(*by).agg(credits(has).alias("_c"), F.sum(F.when(has, F.col("grade") * F.col("credits"))).alias("_g"), credits(F.col("grade") >= PASS).alias("earned"), credits(F.col("grade").isNull()).alias("open"))
    return sums.select(*by, F.when(F.col("_c") > 0, F.col("_g") / F.col("_c")).alias("average"), "earned", "open")


def german_grade(mark: Column) -> Column:
    """The Bavarian formula: BEST is 1.0, PASS 4.0, straight in between, held at both ends; null of none."""
    return F.when(mark.isNotNull(), F.greatest(F.lit(GERMAN_BEST), F.least(F.lit(GERMAN_PASS), 1 + 3 * (BEST - mark) / (BEST - PASS))))


def biggest_lever(components: DataFrame, by: list[str], course: str) -> DataFrame:
    """(by, course, component, weight, score, credits) -> of each the ungraded component of the largest weight times credits; ties to
    the smaller course, then component."""
    lever = F.col("weight") * F.col("credits")
    rows = components.where(F.col("score").isNull() & (lever > 0))
    best = F.max_by(F.struct(course, "component", lever.alias("lever")), F.struct(lever.alias("l"), (-F.col(course)).alias("c"), (-F.col("component")).alias("k")))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{course}", "b.component", "b.lever")
