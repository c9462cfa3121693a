"""Fitted models on labels that the fit didn't see, and on texts that hold nothing."""

import pytest
from pyspark.sql import functions as F

from studyloom.llm import empirical_bayes, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(4)


def test_quality_of_documents_that_the_fit_did_not_see(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality IS NOT NULL")
    seen = labels.where(toxicity.fold(F.col("doc_id")) != 0)
    scored = empirical_bayes.hierarchical_quality(documents, seen.select("doc_id", "quality"))
    rest = scored.join(labels.where(toxicity.fold(F.col("doc_id")) == 0), "doc_id").select("quality", "kept").collect()
    assert len(rest) > 50 and {r.quality for r in rest} == {0, 1}
    assert sum(r.kept == (r.quality == 1) for r in rest) >= 0.95 * len(rest)


def test_texts_without_words_are_scored_by_a_fitted_model(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit_toxicity(documents, labels)
    assert model is not None
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n 12 !"), (4, "word " * 60_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(rows, model).collect()}
    assert set(got) == {1, 2, 3, 4} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[1].score == got[2].score == got[3].score < 0.5
