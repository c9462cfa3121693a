"""Numbers: similarity, priorities, weights, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, within -1..1; null for empty, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(fits, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def parse_vector(x: Column, size: int) -> Column:
    """`[a,b,...]` text to an array; null where the size is another or a component isn't finite."""
    v = F.from_json(x, "array<double>")
    good = (F.size(v) == size) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.when(good, v)


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds halves up, toward positive infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def priority(weight: Column, days: Column) -> Column:
    """(weight + 1) over the days left, at least half a day."""
    return (weight + 1) / F.greatest(days, F.lit(0.5))


#: Weight of a kind without an assessment, and the least weight of each tier.
KIND_WEIGHT = {"deadline": 5.0, "event": 0.0, "class": 0.0}
TIERS = (("high", 15.0), ("medium", 5.0))


def finite(x: Column) -> Column:
    """A double, null where it is no finite number."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def item_weight(override: Column, assessment: Column, kind: Column) -> Column:
    """The override, else the assessment's weight, else the kind's default; an explicit 0 counts."""
    default = F.when(kind == "deadline", KIND_WEIGHT["deadline"]).otherwise(F.lit(0.0))
    return F.coalesce(finite(override), finite(assessment), default)


def weight_source(override: Column, assessment: Column) -> Column:
    return F.when(finite(override).isNotNull(), "override").when(finite(assessment).isNotNull(), "assessment").otherwise("kind_default")


def tier(overdue: Column, kind: Column, weight: Column) -> Column:
    """Badge of an item by its weight in percent; overdue ones and classes have badges of their own."""
    out = F.lit("low")
    for name, least in reversed(TIERS):
        out = F.when(weight >= least, name).otherwise(out)
    return F.when(overdue, "overdue").when(kind == "class", "info").otherwise(out)


def saturate(x: Column, half: float) -> Column:
    return x / (x + half)


def exam_weight(signals: Column, sources: Column, recency: Column, formulas_examples: Column, override: Column | None = None) -> Column:
    """A topic's weight in the exam, 0 to 1: saturating shares of its signals, sources (more if recent) and formulas, a null count as
    0; an override, held within 0 and 1, takes its place."""
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    count = lambda c: F.coalesce(c, F.lit(0))
    recent = held(F.coalesce(recency.cast("double"), F.lit(0.0)))
    w = held(0.05 + 0.475 * saturate(count(signals), 1.0) + 0.285 * saturate(count(sources), 2.0) * (0.5 + 0.5 * recent) + 0.19 * saturate(count(formulas_examples), 3.0))
    return F.when(override.isNotNull(), held(override.cast("double"))).otherwise(w) if override is not None else w


def weight_band(w: Column) -> Column:
    return F.when(w >= 0.6, "HIGH").when(w >= 0.35, "MID").otherwise("LOW")


def changed_enough(new: Column, old: Column, least: float = 1e-4) -> Column:
    """Is a write worth it? Yes where the old value is null or differs by at least `least`."""
    return old.isNull() | (F.abs(new - old) >= least)


def token_price(tokens: Column, rate_per_million: Column) -> Column:
    return tokens.cast("double") * rate_per_million / 1e6
