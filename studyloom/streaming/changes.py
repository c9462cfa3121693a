"""Change feeds on Structured Streaming: dedupe, latest view, windows, disappearance timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

from ..sources.tables import create, exists, remove_folder

CHANGE = "seq long, at timestamp, op string, id string, course_id string, body string"


def source(spark: SparkSession, folder: str, schema: str = CHANGE) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def once(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each seq once; a repeat is known for `late` of event time, which bounds the state."""
    return changes.withWatermark("at", late).dropDuplicatesWithinWatermark(["seq"])


def for_course(changes: DataFrame, course_id: str) -> DataFrame:
    return changes.where(F.col("course_id") == course_id)


def apply_changes(view: DataFrame, changes: DataFrame) -> DataFrame:
    """The view after a batch of changes: the last change of an id counts, DELETE removes."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("_n = 1")
    fresh = last.where("op <> 'DELETE'").select(*view.columns)
    return view.join(last.select("id"), "id", "left_anti").unionByName(fresh)


VIEW = "id string, course_id string, body string, seq long, b int, v long"


def read_view(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The view that keep_view wrote: of each bucket its last version (before batch `before`, where given)."""
    rows = spark.read.schema(VIEW).parquet(folder)
    rows = rows if before is None else rows.where(F.col("v") < before)
    last = rows.groupBy("b").agg(F.max("v").alias("v"))  # a row a bucket
    return rows.join(F.broadcast(last), ["b", "v"]).where("id IS NOT NULL").select("id", "course_id", "body", "seq")


def write_view(batch: DataFrame, folder: str, n: int, buckets: int) -> None:
    """The buckets that batch n of changes touches, as version n from those before it; a bucket keeps its last two versions."""
    spark, columns = batch.sparkSession, ["id", "course_id", "body", "seq"]
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    batch.persist()
    touched = batch.select(bucket.alias("b")).distinct()
    # A row without id keeps an emptied bucket's version; the schema is given, as there may be no file yet.
    blank = touched.select(*(F.lit(None).cast("long" if c == "seq" else "string").alias(c) for c in columns), "b")
    if exists(spark, folder):
        ours = touched.select(F.col("b").alias("_b"))
        before = read_view(spark, folder, n).join(F.broadcast(ours), bucket == F.col("_b"), "left_semi")
    else:
        before = batch.select(*columns).limit(0)
    after = apply_changes(before, batch).withColumn("b", bucket).unionByName(blank).withColumn("v", F.lit(n).cast("long"))
    after.repartition("b").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b", "v").parquet(folder)
    batch.unpersist()
    versions = spark.read.schema(VIEW).parquet(folder).groupBy("b").agg(F.array_sort(F.collect_set("v")).alias("v")).where(F.size("v") > 2)
    for row in versions.collect():  # a row a bucket at most
        for v in row.v[:-2]:
            remove_folder(spark, f"{folder}/b={row.b}/v={v}")


def keep_view(changes: DataFrame, folder: str, checkpoint: str, buckets: int = 64):
    """Writer of the latest view in `buckets` buckets of ids: a micro-batch rewrites the buckets that it changes, as version n
    from those before it, so that a repeated batch writes the same. A bucket keeps its last two versions."""
    return changes.writeStream.foreachBatch(lambda batch, n: write_view(batch, folder, n, buckets)).option("checkpointLocation", checkpoint)


def keep_view_from(snapshot: DataFrame, since: int, changes: DataFrame, folder: str, checkpoint: str, buckets: int = 64):
    """As keep_view, from a snapshot on (id, course_id, body, seq) that holds all changes up to seq `since`: those are dropped from the
    feed, so that none counts twice, and none between snapshot and feed is lost as long as the feed starts at `since` or before.

    The snapshot is the view's version before the first batch, written once: a mark beside it says that it is whole, so a
    restart neither reads nor writes it again.
    """
    spark, mark = snapshot.sparkSession, f"{folder}/_seeded"
    if not exists(spark, mark):
        write_view(snapshot.select(F.lit("UPDATE").alias("op"), "id", "course_id", "body", "seq"), folder, -1, buckets)
        create(spark, mark)
    return keep_view(changes.where(F.col("seq") > since), folder, checkpoint, buckets)


def backfill(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """What a late subscriber sees, as a batch: the snapshot's rows as changes (UPDATE, at their own seq) and the feed's, each (id,
    seq) once, so that a change which both hold counts once."""
    rows = snapshot.select(F.col("seq"), F.lit("UPDATE").alias("op"), "id", "body").unionByName(changes.select("seq", "op", "id", "body"))
    return rows.dropDuplicates(["id", "seq"])


def split_failures(results: DataFrame, attempts: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, again, dead) of a batch or stream of results (id, attempt, error, retriable): failures go back with an attempt
    more until `attempts` are used up; those not worth a retry are dead letters at once."""
    failed, last = F.col("error").isNotNull(), ~F.col("retriable") | (F.col("attempt") >= attempts)
    again = results.where(failed & ~last).withColumn("attempt", F.col("attempt") + 1)
    return results.where(~failed), again, results.where(failed & last)


def keep_failures(results: DataFrame, done: str, again: str, dead: str, checkpoint: str, attempts: int = 3):
    """Writer of a stream of results into three tables, a folder a micro-batch, so that a repeated batch rewrites its own."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        for part, folder in zip(split_failures(batch, attempts), (done, again, dead)):
            part.write.mode("overwrite").parquet(f"{folder}/batch={n}")
        batch.unpersist()

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def invalidated(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Stream of topic changes (topic_id, revision, op) against review snapshots (review_id, topic_id, revision), a table -> (review_id)
    once for each review of which a topic was removed or has a later revision than the snapshot's.

    A flag goes one way: what is kept of a review is that it was told, so a late, older or repeated change neither clears it
    nor tells it again. State grows with the reviews that are flagged, not with the changes.
    """
    seen = snapshots.select("review_id", "topic_id", F.col("revision").alias("_had"))
    later = (F.col("op") == "DELETE") | (F.col("revision") > F.col("_had"))
    return changes.join(seen, "topic_id").where(later).select("review_id").dropDuplicates(["review_id"])


OCCURRENCE = ("starts_at", "ends_at", "all_day", "summary", "location", "status")


def keep_feed_changes(feeds: DataFrame, log: str, view: str, checkpoint: str, buckets: int = 64):
    """Writer of a calendar_feed stream: into `log`, a folder a micro-batch, what changed in each feed that was read, as INSERT, UPDATE
    and DELETE of its occurrences; into `view` their latest state.

    A feed that fails to parse changes nothing; one that is gone loses its occurrences. A batch that is repeated compares with
    the view before itself and writes the same again.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        failed = rows.where("error IS NOT NULL").select("path").distinct()
        read = rows.join(failed, "path", "left_anti")
        body = F.to_json(F.struct(*OCCURRENCE), {"ignoreNullFields": "false"})
        now = read.where("uid IS NOT NULL").select(F.concat_ws("|", "path", "uid", F.unix_micros(F.col("recurrence_id").cast("timestamp")).cast("string")).alias("id"), F.col("path").alias("course_id"), body.alias("body")).dropDuplicates(["id"])
        if exists(spark, view):
            before = read_view(spark, view, n).join(read.select(F.col("path").alias("course_id")).distinct(), "course_id", "left_semi")
        else:
            before = now.withColumn("seq", F.lit(0).cast("long")).limit(0)
        was = before.select("id", F.col("course_id").alias("_course"), F.col("body").alias("_body"))
        op = F.when(F.col("_body").isNull(), "INSERT").when(F.col("body").isNull(), "DELETE").when(F.col("body") != F.col("_body"), "UPDATE")
        diff = now.join(was, "id", "full").select(op.alias("op"), "id", F.coalesce("course_id", "_course").alias("course_id"), "body", F.lit(n).cast("long").alias("seq")).where("op IS NOT NULL")
        diff.write.mode("overwrite").parquet(f"{log}/batch={n}")
        write_view(spark.read.schema("op string, id string, course_id string, body string, seq long").parquet(f"{log}/batch={n}"), view, n, buckets)
        rows.unpersist()

    return feeds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by event-time window and type, complete once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGHT = StructType([StructField("id", StringType()), StructField("action", StringType()), StructField("at", TimestampType())])


class Disappearance(StatefulProcessor):
    """Per item: `hide` after 24 hours without a sighting, `delete` after 7 days, `resurrect` when it is seen again."""

    HIDE_MS, DELETE_MS = 24 * 3_600_000, 7 * 24 * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("seen", TimestampType()), StructField("phase", StringType())]))

    def _set(self, seen: pd.Timestamp, phase: str, after_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((seen.to_pydatetime(), phase))
        self.handle.registerTimer(int(seen.timestamp() * 1000) + after_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = max(r["at"].max() for r in rows)
        before = self.state.get() if self.state.exists() else None
        last = pd.Timestamp(before[0]) if before else None
        if last is None or seen > last:
            self._set(seen, "seen", self.HIDE_MS)
        if before and before[1] == "hidden" and seen > last:
            yield pd.DataFrame({"id": [key[0]], "action": ["resurrect"], "at": [seen]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, phase = self.state.get()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        if phase == "seen":
            self._set(pd.Timestamp(seen), "hidden", self.DELETE_MS)
            yield pd.DataFrame({"id": [key[0]], "action": ["hide"], "at": [at]})
        else:
            self.state.clear()
            yield pd.DataFrame({"id": [key[0]], "action": ["delete"], "at": [at]})

    def close(self) -> None:
        pass


class Retry(StatefulProcessor):
    """Per id: deliveries until one succeeds, with a pause between attempts that doubles from `first` seconds up to `longest`; after `most`
    attempts, or an error that isn't worth another, it is a dead letter."""

    def __init__(self, deliver: Callable[[str, int], tuple[str | None, bool]], most: int, first: float, longest: float):
        self.deliver, self.most, self.first, self.longest = deliver, most, first, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "attempt int, settled boolean")

    def _attempt(self, key: str, attempt: int, now: int) -> pd.DataFrame:
        error, retriable = self.deliver(key, attempt)
        pause = min(self.first * 2 ** (attempt - 1), self.longest)
        outcome = "done" if error is None else "again" if retriable and attempt < self.most else "dead"
        if outcome == "again":
            self.handle.registerTimer(now + max(1, round(1000 * pause)))
        self.state.update((attempt, outcome != "again"))
        return pd.DataFrame({"id": [key], "attempt": [attempt], "outcome": [outcome], "error": [error], "pause": [pause if outcome == "again" else None]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.state.exists():  # an id that is asked for again is on its way, or settled
            yield self._attempt(key[0], 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, settled = self.state.get()
        if not settled:
            yield self._attempt(key[0], attempt + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


ATTEMPT = "id string, attempt int, outcome string, error string, pause double"


def retried(requests: DataFrame, deliver: Callable[[str, int], tuple[str | None, bool]], most: int = 5, first: float = 4.0, longest: float = 30.0) -> DataFrame:
    """(id string, ...) stream -> ATTEMPT, a row an attempt: outcome done, again (with the pause that follows, in seconds) or dead.

    deliver(id, attempt) returns (error or None, is it worth a retry); it runs in tasks, and again if a batch is repeated, so it
    should be idempotent. Pauses are timers of processing time in the state: they outlive a restart. Needs the RocksDB state
    store. An id counts once.
    """
    return requests.select("id").groupBy("id").transformWithStateInPandas(Retry(deliver, most, first, longest), ATTEMPT, "append", "processingTime")


class InOrder(StatefulProcessor):
    """Per key: its jobs one after another, by seq, each once, numbered from 1; one that comes after a later one was done is late and
    left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seqs = sorted({int(s) for r in rows for s in r["seq"]})
        last, n = self.state.get() if self.state.exists() else (None, 0)
        fresh = [s for s in seqs if last is None or s > last]
        if fresh:
            self.state.update((fresh[-1], n + len(fresh)))
            yield pd.DataFrame({"id": [key[0]] * len(fresh), "seq": fresh, "turn": range(n + 1, n + len(fresh) + 1)})

    def close(self) -> None:
        pass


def in_turn(jobs: DataFrame) -> DataFrame:
    """(id string, seq long) stream -> (id, seq, turn): a key's jobs are handled by one task at a time, in order. Needs the RocksDB
    state store."""
    return jobs.select("id", "seq").groupBy("id").transformWithStateInPandas(InOrder(), "id string, seq long, turn long", "append", "none")


def disappearances(sightings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(id string, at timestamp) stream -> actions. Needs the RocksDB state store."""
    return sightings.withWatermark("at", late).groupBy("id").transformWithStateInPandas(Disappearance(), SIGHT, "append", "eventTime")
