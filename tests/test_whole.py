"""Queries take their whole tables."""

from studyloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


def ids(spark, name, column):
    return {r[0] for r in registry.QUERIES[name](spark, FOLDER).select(column).collect()}


def test_documents_of_every_language_are_mapped(spark):
    other = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang <> 'en' OR lang IS NULL").collect()}
    assert ids(spark, "fuzzy_map", "doc_id") & other


def test_all_open_orders_are_ranked(spark):
    rows = registry.QUERIES["priority_rank"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_orderstatus <> 'F'").count()
    assert [(not r.overdue, -r.score) for r in rows] == sorted((not r.overdue, -r.score) for r in rows)


def test_all_orders_are_signals_targets_and_sessions(spark):
    orders = {r[0] for r in spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey").collect()}
    for name, column in (("signal_mapping", "signal_id"), ("reprocess_plan", "target")):
        assert ids(spark, name, column) == orders
    assert {k % 3 for k in ids(spark, "exam_detection", "uid") - {None}} == {0, 1, 2}


def test_chunks_of_every_document(spark):
    filled = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("trim(text) <> ''").collect()}
    assert ids(spark, "chunk_document", "doc_id") >= filled
