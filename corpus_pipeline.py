"""From raw documents to packed sequences: quality rules, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.common import SPACES, materialize, replaced_text, table, whole_row
from studyloom.llm.mixing import curriculum_mix, in_training_order
from studyloom.llm.packing import pack
from studyloom.llm.quality import quality_rules
from studyloom.llm.secrets import redact
from studyloom.llm.simhash import drop_near_duplicates
from studyloom.llm.tokens import default_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; from the others their failing lines go (n_chars follows). Those without such lines
    stay byte for byte. A null or empty text has too few words and is rejected; very long texts are read whole; repeated rows
    are judged each on its own; an empty table stays empty; rows ride as one struct, so no column name clashes."""
    rows = docs.select(whole_row(docs).alias("row"), "text")
    judged = quality_rules(rows, keep=["row"]).select("row", "kept", F.when(F.col("n_removed_lines") > 0, F.col("cleaned")).alias("text"))
    # One row made at a time, so that the filter is not moved into, and does not repeat, the rules' expressions.
    kept = judged.select(F.inline(F.array(F.struct("row", "kept", "text")))).where("kept")
    return replaced_text(kept.select("row", "text"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id (null last), then of the smallest
    hash of the whole row; of equal rows one stays. Null and empty texts are one group; a very long text is hashed whole; an
    empty table stays empty; columns keep their names, whatever they are."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span of a text, however long, is replaced by its kind (n_chars follows). A null or empty text stays;
    repeated rows are each redacted; an empty table stays empty; rows ride as one struct, so no column name clashes."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order; a copy taken in part holds that many words (n_chars follows).

    A null, empty or blank text has no words to take and no row. Repeated rows are mixed each on its own; ties are ordered by a hash
    of the text, then of the row; an empty table stays empty; rows ride as one struct, so no column name clashes."""
    copies = in_training_order(curriculum_mix(docs))
    words = F.filter(F.split(F.col("row.text").cast("string"), SPACES), lambda w: w != "")
    short = F.array_join(F.slice(words, 1, F.col("words").cast("int")), " ")
    return replaced_text(copies.select("row", F.when(F.col("words") < F.col("size"), short).alias("text")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 ids. A null or empty text is its end id alone; a very
    long one is cut into as many pieces as it needs; repeated rows are packed each on its own; an empty table gives no pieces;
    columns other than doc_id and text are not read."""
    return pack(docs, default_path())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scans", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can't express fingerprint components over a trie, the linear program or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else materialize(out, f"stage{k}")
    return docs
