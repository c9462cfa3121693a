"""Quality classifier by hierarchical empirical Bayes.

Each document has classifier evidence from the shape of its text. Evidence is pooled by host and by path below it; a
host's rate of good documents is shrunk toward the global one, a path's toward its host's, the more the fewer documents
it has, with prior strengths estimated from the spread of the rates themselves. A document's score joins its own evidence
with its path's posterior, from which its own share is left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, table
from .toxicity import logistic

#: Labelled documents that the classifier's fit uses at most, and the bounds of the prior strengths.
SAMPLE, LEAST_STRENGTH, MOST_STRENGTH = 20_000, 2.0, 1_000.0
FEATURES = ("log_words", "word_length", "symbols", "bars", "marks", "upper", "digits", "again", "line_words")


def evidence_features(text: Column) -> list[Column]:
    """Shape of a text, each a bounded double, 0 for a text without words: length, mean word length, shares of words that
    end in symbols, are bars, end in exclamation marks, of upper-case letters and digits, of words equal to the one
    before, and words a line."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    share = lambda pattern: F.size(F.filter(words, lambda w: w.rlike(pattern))) / n
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    pairs = F.size(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words) + 1).alias("b")), lambda x: x["a"] == x["b"]))
    return [
        F.log1p(F.size(words).cast("double")).alias("log_words"),
        F.least(F.length(F.array_join(words, "")) / n, F.lit(30.0)).alias("word_length"),
        share(r"[#$%&*<>]{2,}$").alias("symbols"),
        share(r"^\|$").alias("bars"),
        share(r"!{2,}$").alias("marks"),
        (count("[A-Z]") / chars).alias("upper"),
        (count("[0-9]") / chars).alias("digits"),
        (pairs / n).alias("again"),
        F.log1p(n / F.size(F.split(t, "\n"))).alias("line_words"),
    ]


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def fit_evidence(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[float], list[float], list[float]] | None:
    """Mean, scale and weights of the document classifier, from at most about `sample` labelled documents, those of the
    smallest hash of their id. None where a class is missing."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, sample / max(n, 1)) * 1_000_003)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    got = rows.select("quality", F.array(*evidence_features(F.col("text"))).alias("f")).collect()  # nine numbers each
    y = np.array([r.quality for r in got], float)
    if len(set(y)) < 2:
        return None
    x = np.array([r.f for r in got], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    return mean.tolist(), scale.tolist(), logistic(np.column_stack([z, np.minimum(z * z, 9)]), y).tolist()


def strength(rate_mean: Column, rate_var: Column, mean_noise: Column) -> Column:
    """Prior strength (documents that the prior is worth) by moments: spread beyond sampling noise is spread of rates."""
    between = F.greatest(rate_var - mean_noise, F.lit(1e-6))
    return F.least(F.greatest(rate_mean * (1 - rate_mean) / between - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def hierarchical_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """(doc_id, text, host and path columns) -> one row per input row: doc_id, evidence, host_rate, path_rate, score, kept.

    evidence is the classifier's probability of good quality (0.5 for all without labels of both classes), of the whole text,
    however long; a null or empty text has the evidence of one without words. A null host or path is a group of its own; a
    document alone in its path gets its host's rate, alone in its host the global one. A repeated row is a further document
    of its group; rows that tie have equal scores. An empty table gives an empty result; labels are used for the fit alone;
    other columns are not read, and none is returned, so no name clashes.
    """
    fit = fit_evidence(docs, labels)
    features = evidence_features(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("h"), F.col(path).cast("string").alias("p"), *(f.alias(f"f{i}") for i, f in enumerate(features)))
    if fit:
        mean, scale, w = fit
        z = [(F.col(f"f{i}") - mean[i]) / scale[i] for i in range(len(mean))]
        terms = [a * b for a, b in zip([*z, *(F.least(x * x, F.lit(9.0)) for x in z)], w)]
        evidence = 1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + w[-1])))
    else:
        evidence = F.lit(0.5)
    rows = materialize(rows.select("doc_id", "h", "p", evidence.alias("evidence")), "evidence")
    paths = rows.groupBy("h", "p").agg(F.count("*").cast("double").alias("pn"), F.sum("evidence").alias("ps"))
    hosts = paths.groupBy(F.col("h").alias("hh")).agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"))

    def spread_of(groups: DataFrame, n: str, s: str, name: str) -> DataFrame:
        rate = F.col(s) / F.col(n)
        all_ = groups.agg(F.sum(s).alias("S"), F.sum(n).alias("N"), F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(rate * (1 - rate) / F.col(n)).alias("e"))
        return all_.select((F.col("S") / F.col("N")).alias(f"{name}_mean"), strength(F.col("m"), F.col("v"), F.col("e")).alias(f"{name}_k"))

    # Two one-row tables of global figures.
    top = spread_of(hosts, "hn", "hs", "global").join(F.broadcast(spread_of(paths, "pn", "ps", "path")))
    groups = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).select(F.col("h").alias("gh"), F.col("p").alias("gp"), "pn", "ps", "hn", "hs").join(F.broadcast(top))
    joined = rows.join(groups, F.col("h").eqNullSafe(F.col("gh")) & F.col("p").eqNullSafe(F.col("gp")))
    host_rate = (F.col("hs") - F.col("evidence") + F.col("global_k") * F.col("global_mean")) / (F.col("hn") - 1 + F.col("global_k"))
    scored = joined.withColumn("host_rate", host_rate)
    path_rate = (F.col("ps") - F.col("evidence") + F.col("path_k") * F.col("host_rate")) / (F.col("pn") - 1 + F.col("path_k"))
    scored = scored.withColumn("path_rate", path_rate)
    score = 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(F.col("path_rate")) - logit(F.col("global_mean")))))
    return scored.withColumn("score", score).select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))


def op2_empirical_bayes(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return hierarchical_quality(docs.select("doc_id", "text", "source", "lang"), labels.select("doc_id", "quality"))
