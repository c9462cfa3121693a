"""Streams that are stopped and started again: hand-off, feeds, retries, invalidation."""

import json
from datetime import datetime

import pytest

from studyloom.sources import provider
from studyloom.streaming import changes

FEED = "BEGIN:VCALENDAR\r\n{}END:VCALENDAR\r\n"
EVENT = "BEGIN:VEVENT\r\nUID:{}\r\nDTSTART:20260105T10000{}Z\r\nSUMMARY:{}\r\nEND:VEVENT\r\n"


def feed(*events):
    return FEED.format("".join(EVENT.format(*e) for e in events))


def test_view_from_a_snapshot(spark, tmp_path):
    source, view, checkpoint = (str(tmp_path / n) for n in ("in", "view", "ck"))
    snapshot = spark.createDataFrame([("a", "c", "a5", 5), ("b", "c", "b3", 3), ("z", "c", "z1", 1)], "id string, course_id string, body string, seq long")
    feed_rows = [[(4, "a", "UPDATE", "a4"), (5, "a", "UPDATE", "a5"), (6, "b", "UPDATE", "b6")], [(7, "z", "DELETE", None), (8, "n", "INSERT", "n8"), (2, "z", "UPDATE", "z2")]]

    def follow():
        stream = spark.readStream.schema(changes.CHANGE).parquet(source)
        changes.keep_view_from(snapshot, 5, stream, view, checkpoint, buckets=3).trigger(availableNow=True).start().awaitTermination()
        return {r.id: r.body for r in changes.read_view(spark, view).collect()}

    seen = []
    for rows in feed_rows:
        spark.createDataFrame([(s, datetime(2026, 1, 1), o, i, "c", b) for s, i, o, b in rows], changes.CHANGE).write.mode("append").parquet(source)
        seen.append(follow())
    assert seen == [{"a": "a5", "b": "b6", "z": "z1"}, {"a": "a5", "b": "b6", "n": "n8"}]
    assert follow() == seen[-1]


def test_feeds_are_followed(spark, tmp_path):
    provider.register(spark)
    folder = tmp_path / "feeds"
    folder.mkdir()
    log, view, checkpoint = (str(tmp_path / n) for n in ("log", "view", "ck"))

    def follow():
        feeds = spark.readStream.format("calendar_feed").option("path", str(folder)).option("feed", r"(.*)\.ics").load()
        changes.keep_feed_changes(feeds, log, view, checkpoint, buckets=2).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema("op string, id string, course_id string, body string, batch int").parquet(log).collect()
        return {(r.batch, r.op, r.course_id, r.id.split("|")[1], json.loads(r.body)["summary"] if r.body else None) for r in rows}

    (folder / "a.ics").write_text(feed(("u1", 0, "One"), ("u2", 0, "Two")), newline="")
    (folder / "b.ics").write_text(feed(("u1", 0, "Other")), newline="")
    first = {(0, "INSERT", "a", "u1", "One"), (0, "INSERT", "a", "u2", "Two"), (0, "INSERT", "b", "u1", "Other")}
    assert follow() == first
    (folder / "a.ics").write_text(feed(("u1", 0, "One"), ("u2", 0, "Two")), newline="")  # a new date, the same bytes
    assert follow() == first
    (folder / "a.ics").write_text(feed(("u2", 0, "Two, moved"), ("u3", 0, "Three")), newline="")
    (folder / "b.ics").write_text(feed(("u1", "x", "broken")), newline="")
    second = first | {(1, "DELETE", "a", "u1", None), (1, "UPDATE", "a", "u2", "Two, moved"), (1, "INSERT", "a", "u3", "Three")}
    assert follow() == second  # a feed that fails keeps what it had
    (folder / "b.ics").unlink()
    assert follow() == second | {(2, "DELETE", "b", "u1", None)}
    assert {r.id.split("|")[1] for r in changes.read_view(spark, view).collect()} == {"u2", "u3"}


def test_feed_options(spark):
    with pytest.raises(ValueError, match="feed"):
        provider.checked({"path": "x", "feed": "("})


class Handle:
    def __init__(self):
        self.timers, self.value = [], None

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at


def attempts_of(deliver, most=6):
    handle, retry = Handle(), changes.Retry(deliver, most, 4.0, 30.0)
    retry.init(handle)
    rows, now = list(retry.handleInputRows(("k",), iter([]), Now(0))), 0
    while handle.timers:
        now = handle.timers.pop()
        rows += list(retry.handleExpiredTimer(("k",), Now(now), None))
    again = list(retry.handleInputRows(("k",), iter([]), Now(now)))
    return [(r.attempt.iloc[0], r.outcome.iloc[0], r.pause.iloc[0]) for r in rows], now, again


def test_pauses_double_up_to_their_longest():
    rows, now, again = attempts_of(lambda k, n: ("down", True))
    assert rows == [(1, "again", 4.0), (2, "again", 8.0), (3, "again", 16.0), (4, "again", 30.0), (5, "again", 30.0), (6, "dead", None)]
    assert now == 88_000 and again == []


def test_success_and_hopeless_errors_end_it():
    assert attempts_of(lambda k, n: (None if n == 3 else "down", True))[0] == [(1, "again", 4.0), (2, "again", 8.0), (3, "done", None)]
    assert attempts_of(lambda k, n: ("rejected", False))[0] == [(1, "dead", None)]


def test_a_flag_goes_one_way(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    reviews = spark.createDataFrame([(1, "t", 3), (1, "u", 1), (2, "t", 5), (3, "v", 1)], "review_id int, topic_id string, revision int")
    flags = []
    for rows in ([("t", 4, "UPDATE"), ("t", 2, "UPDATE")], [("t", 4, "UPDATE"), ("u", 9, "UPDATE"), ("t", 1, "UPDATE")], [("v", 0, "DELETE")], [("t", 6, "UPDATE"), ("v", 0, "DELETE")]):
        spark.createDataFrame(rows, "topic_id string, revision int, op string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("topic_id string, revision int, op string").parquet(source)
        changes.invalidated(reviews, stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        flags.append(sorted(r.review_id for r in spark.read.schema("review_id int").parquet(out).collect()))
    assert flags == [[1], [1], [1, 3], [1, 2, 3]]


def test_large_feeds_are_read_in_chunks(spark, tmp_path, monkeypatch):
    """The memory that a reader takes doesn't grow with its feed, and the rows are those of the whole text; a feed that fails at its end gives
    its error alone."""
    import tracemalloc
    from datetime import timedelta

    from studyloom.sources import ics

    weekly = "BEGIN:VEVENT\r\nUID:w{0}\r\nDTSTART:20260105T100000Z\r\nRRULE:FREQ=WEEKLY;COUNT=3\r\nSUMMARY:Folded\r\n  at {0}, é\r\nEND:VEVENT\r\n"
    moved = "BEGIN:VEVENT\r\nUID:w{0}\r\nRECURRENCE-ID:20260112T100000Z\r\nDTSTART:20260113T100000Z\r\nEND:VEVENT\r\n"
    peaks = []
    for n in (2_000, 8_000):
        text = FEED.format("".join(weekly.format(k) + (moved.format(k) if k % 500 == 0 else "") for k in range(n)))
        (tmp_path / "a.ics").write_bytes(text.encode())
        monkeypatch.setattr(provider, "CHUNK", 1_001)  # through lines, folds and letters
        reader = provider.FeedReader({"path": str(tmp_path)})
        rows = reader.read(reader.partitions()[0])
        tracemalloc.start()
        total = sum(1 for _ in rows)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert total == 3 * n
    assert peaks[1] < 1.5 * peaks[0]
    names = [c.split()[0] for c in ics.SCHEMA.split(", ")]
    want, _ = ics.parse_feed(text, "UTC", datetime(1970, 1, 1), datetime(2100, 1, 1))
    got = [dict(zip(names, r)) for r in reader.read(reader.partitions()[0])]
    assert [{k: r[k] for k in want[0]} for r in got] == want
    assert sum(r["overridden"] for r in got) == 16 and got[1]["starts_at"] - got[0]["starts_at"] == timedelta(days=8)
    (tmp_path / "a.ics").write_bytes((text + EVENT.format("u", "x", "broken")).encode())
    assert [dict(zip(names, r))["error"] is not None for r in reader.read(reader.partitions()[0])] == [True]


def test_a_feed_in_parts(spark):
    """Rows of one path are one file: its events are spread over tasks, and a part that fails takes the others with it."""
    from studyloom.sources import ics

    part = lambda path, *event: (path, EVENT.format(*event), "UTC", datetime(2026, 1, 1), datetime(2026, 12, 31))
    rows = [part("a", "u1", 0, "One"), part("a", "u2", 0, "Two"), part("b", "u1", 0, "One"), part("b", "u2", "x", "broken")]
    files = spark.createDataFrame(rows, "path string, content string, default_tz string, horizon_from timestamp, horizon_to timestamp").repartition(4)
    assert sorted((r.path, r.uid, r.error is not None) for r in ics.read_feeds(files).collect()) == [("a", "u1", False), ("a", "u2", False), ("b", None, True)]
