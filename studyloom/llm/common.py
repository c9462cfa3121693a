"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scan, scan_dealt

#: ASCII white space, as the contracts of these operators count words.
SPACES = r"[\x20\x09-\x0D]+"
#: bytes.translate table: A-Z to a-z, everything else as it is.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies; the texts of a small one are dealt to all cores."""
    return scan_dealt(spark, sf_dir, name) if name == "documents" else scan(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. Where the session names none, a local session (tests) gets a temporary one and any
    other an error, as no machine's own folder is seen by the rest of a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="studyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder for the whole application, so that it can be removed at once."""
    return f"{shared_dir(spark)}/studyloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of shared_path that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read back, and its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, name)[0]


def few_texts(docs: DataFrame, most: int = 1_000) -> DataFrame:
    """docs, in a session whose Arrow batches hold at most `most` rows: whole texts go to Python and back in the memory beside the
    heap, on both sides, a batch at a time."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= most:
        conf.set(key, str(most))
    return docs


def named(column: str) -> Column:
    """The column of that very name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """docs' columns, or those given, as one struct: an operator that carries it has no names to clash with."""
    return F.struct(*(named(c) for c in (columns or docs.columns)))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which have no hash, by their JSON."""
    return F.xxhash64(*(F.to_json(F.struct(named(c))) if "map<" in kind else named(c) for c, kind in docs.dtypes))


def replaced_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(row, text) -> row's columns, with `text` as the row's text where it is not null; n_chars follows if row has it."""
    changed = F.col("row").withField("text", F.col("text"))
    if "n_chars" in columns:
        changed = changed.withField("n_chars", F.length("text").cast("long"))
    return rows.select(F.when(F.col("text").isNull(), F.col("row")).otherwise(changed).alias("row")).select("row.*")


def tree_merged(parts: DataFrame, read: Callable, merge: Callable, empty: Any) -> Any:
    """A row per partition of bounded size -> `merge` over what `read` makes of them, by treeReduce: no task, nor the driver, takes
    more than about 64 of them. `empty` where there is no partition."""
    rows = parts.rdd.map(read)
    number = rows.getNumPartitions()
    return rows.treeReduce(merge, max(2, math.ceil(math.log(number, 64)))) if number else empty


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) undirected edges -> (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder; the round before it is removed. Self
    links and repeats are harmless; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    current, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        low = smallest(large)
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        before = path
        current, path = written(small, "stars")
        remove(spark, before)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def spread(*columns: Column) -> Column:
    """A uniform non-negative long below 2**60 from the columns' values (null as empty), the same in every run."""
    joined = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def running_total(rows: DataFrame, narrow: DataFrame, name: str, carry: DataFrame | None = None) -> DataFrame:
    """(row, group, value long, at long, tie) -> row, group, value, at, `name` and carry's columns: `name` is the sum of value
    over the rows of the same group that come before in the order of (at, value, tie).

    narrow holds group, value and at of the same rows, so that wide rows move once. at is a uniform non-negative long below
    2**60 (see spread). A group is cut into equal ranges of at, about one for every 20,000 rows of the whole table, so that no
    task holds a group: ranges are summed first, their totals accumulated over a table of one row a range, and rows
    accumulated within their range only. Rows that tie in all three are interchangeable. A null group is a group. carry
    (group, further columns; one row per group) is added to the range totals first, so that its columns reach the rows of
    a hot group over all ranges.
    """
    count = narrow.count()
    ranges = max(256, 1 << max(0, (count // 20_000)).bit_length())
    keys = ["key", "no_key", "range"]  # plain columns: the join and the window share one exchange
    key, none = F.coalesce(F.col("group").cast("string"), F.lit("")).alias("key"), F.col("group").isNull().alias("no_key")
    place = F.expr(f"at div {(1 << 60) // ranges}").alias("range")
    totals = narrow.select("value", key, none, place).groupBy(*keys).agg(F.sum("value").alias("total"))
    before = Window.partitionBy("key", "no_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    if carry is not None:
        starts = starts.join(carry.select(key, none, *(c for c in carry.columns if c != "group")), ["key", "no_key"])
    inside = Window.partitionBy(*keys).orderBy("at", "value", "tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.select("row", "group", "value", "at", "tie", key, none, place).join(starts, keys)
    out = joined.withColumn(name, F.col("start") + F.coalesce(F.sum("value").over(inside), F.lit(0)))
    return out.select("row", "group", "value", "at", name, *([] if carry is None else [c for c in carry.columns if c != "group"]))
