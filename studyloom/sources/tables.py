"""Table scans over a folder of Parquet tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan one table, projected to `columns` where given, so that the reader prunes the rest."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes of a table up to which it may be dealt out anew.
SMALL = 256 * 1024 * 1024


def scan_dealt(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """As scan, for tables of texts that cost much a row: a small table of few files, whose row groups would keep few cores busy, is
    dealt to all of them; any other is read as it lies."""
    raw, cores = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"), spark.sparkContext.defaultParallelism
    df = raw.select(*columns) if columns else raw
    if 2 * len(raw.inputFiles()) > cores:
        return df
    size = raw.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0] or 0
    return df.repartition(cores) if size <= SMALL else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors see, below one folder for the whole application, so that it can be removed at
    once. Where the session names none, a local session (tests) gets a temporary one, any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="studyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/studyloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more; one that isn't there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def create(spark: SparkSession, path: str) -> None:
    """An empty file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at).close()


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession):
    """The session with the state store that keyed state and timers need; what was set before is set again, whatever happens."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


#: Rows up to which a side of a join is broadcast.
FEW_ROWS = 200_000


def sized(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df with a hint to broadcast it if it has at most `most` rows, else as it is, to be joined by a shuffle. The count stops at the
    first row beyond; df should be cheap to read twice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it is worked out once, whatever reads it, and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
