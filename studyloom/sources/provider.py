"""Calendar providers as Spark data sources: `spark.read.format("calendar_feed")` reads a folder of feeds.

`spark.readStream` follows the folder: its offset is the hash of each feed, so that a feed whose bytes are what they were is not read
again, whatever its date, and one that is gone gives a row without cursor. Options are checked before anything is read. A feed whose bytes have a known hash (`known`, a JSON array) is not parsed; one that can't be parsed gives
a row with `error`. A task reads a feed chunk by chunk, whatever its size; its rows are handed on once it is known to parse. Files are
reached through the file system of their path's scheme.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import pickle
import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import ics

#: Options: name -> (how it is read, default; None where it is required). feed: a pattern whose first group, in a file's path below the
#: folder, names its feed.
OPTIONS = {"path": (str, None), "timezone": (str, "UTC"), "from": (datetime.fromisoformat, "1970-01-01"), "to": (datetime.fromisoformat, "2100-01-01"), "known": (json.loads, "[]"), "feed": (re.compile, "(.*)")}
ROWS = f"{ics.SCHEMA}, cursor string, changed boolean"


def checked(options: dict[str, str]) -> dict:
    """The options' values; an option that is missing, unknown or can't be read is an error."""
    given = {k.lower(): v for k, v in options.items()}
    if unknown := set(given) - set(OPTIONS):
        raise ValueError(f"unknown options {sorted(unknown)}")
    out = {}
    for name, (read, default) in OPTIONS.items():
        value = given.get(name, default)
        if value is None:
            raise ValueError(f"option {name} is required")
        try:
            out[name] = read(value)
        except (ValueError, re.error) as e:
            raise ValueError(f"option {name} can't be read: {value}") from e
    ics.zone_of(out["timezone"], "UTC")
    return out


#: Bytes of a feed that are read, and rows of it that are set aside, at a time.
CHUNK, ASIDE = 1 << 20, 1_000


def digest(chunks: Iterable[bytes]) -> str:
    found = hashlib.sha256()
    for part in chunks:
        found.update(part)
    return found.hexdigest()


def spooled(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The rows, once all of them are made without an error: till then they lie, packed, in a file of the task's machine."""
    with tempfile.TemporaryFile() as f:
        for some in batched(rows, ASIDE):
            pickle.dump(zlib.compress(pickle.dumps(some), 1), f)
        end = f.tell()
        f.seek(0)
        while f.tell() < end:
            yield from pickle.loads(zlib.decompress(pickle.load(f)))


class FeedFile(InputPartition):
    """A file; without a path, a feed that is gone."""

    def __init__(self, path: str | None, feed: str | None = None):
        self.path, self.feed = path, feed


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = checked(options)

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.options["path"])

    def partitions(self) -> list[FeedFile]:
        from pyarrow import fs

        store, path = self._files()
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        named = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [FeedFile(p) for p in named]

    def chunks(self, path: str) -> Callable[[], Iterator[bytes]]:
        """What gives a file's bytes, CHUNK of them at a time, as often as it is called; a file of one chunk is read but once."""
        store, _ = self._files()

        def every() -> Iterator[bytes]:
            with store.open_input_stream(path) as f:
                while part := f.read(CHUNK):
                    yield part

        with store.open_input_stream(path) as f:
            first = f.read(CHUNK)
            whole = not f.read(1)
        return (lambda: iter([first])) if whole else every

    def read(self, partition: FeedFile) -> Iterator[tuple]:
        _, root = self._files()
        chunks = self.chunks(partition.path)
        names = [c.split()[0] for c in ics.SCHEMA.split(", ")]
        name, cursor = partition.path.removeprefix(root).lstrip("/") or root.rpartition("/")[2], digest(chunks())
        row = lambda changed, **values: (*(values.get(c) for c in names), cursor, changed)
        if cursor in self.options["known"]:
            yield row(False, path=name)
            return

        def unchanged() -> Iterator[bytes]:
            seen = hashlib.sha256()
            for part in chunks():
                seen.update(part)
                yield part
            if seen.hexdigest() != cursor:
                raise OSError(f"{partition.path} changed while it was read")

        def made() -> Iterator[tuple]:
            found = dropped = 0
            for o in ics.occurrences(lambda: ics.lines_of(codecs.iterdecode(unchanged(), "utf-8")), self.options["timezone"], self.options["from"], self.options["to"]):
                if o is None:
                    dropped += 1
                else:
                    found += 1
                    yield row(True, path=name, **o)
            if dropped or not found:
                yield row(True, path=name, dropped=dropped)

        try:
            yield from spooled(made())
        except (ics.FeedError, KeyError, ValueError) as e:
            yield row(True, path=name, error=str(e))


class FeedStream(DataSourceStreamReader, FeedReader):
    """The changes of a folder of feeds. The driver lists it and hashes files whose size or date is new to it; tasks parse."""

    def __init__(self, options: dict[str, str]):
        FeedReader.__init__(self, options)
        self.hashes: dict[str, tuple[tuple, str]] = {}

    def initialOffset(self) -> dict:
        return {"feeds": {}}

    def latestOffset(self) -> dict:
        store, root = self._files()
        found = {}
        for path in (p.path for p in FeedReader.partitions(self)):
            info = store.get_file_info(path)
            seen = (info.size, info.mtime_ns)
            if self.hashes.get(path, (None,))[0] != seen:
                self.hashes[path] = (seen, digest(self.chunks(path)()))
            found[self.feed_of(path, root)] = [path, self.hashes[path][1]]
        return {"feeds": found}

    def feed_of(self, path: str, root: str) -> str:
        name = path.removeprefix(root).lstrip("/") or root.rpartition("/")[2]
        named = self.options["feed"].search(name)
        return named.group(1) if named else name

    def partitions(self, start: dict, end: dict) -> list[FeedFile]:
        before, after = start["feeds"], end["feeds"]
        changed = [FeedFile(path, feed) for feed, (path, cursor) in sorted(after.items()) if feed not in before or before[feed][1] != cursor]
        return changed + [FeedFile(None, feed) for feed in sorted(set(before) - set(after))]

    def read(self, partition: FeedFile) -> Iterator[tuple]:
        if partition.path is None:
            yield (partition.feed, *[None] * (len(ics.SCHEMA.split(", ")) - 1), None, True)
            return
        for row in FeedReader.read(self, partition):
            yield (partition.feed, *row[1:])


class CalendarFeed(DataSource):
    """A provider: its options' check, its rows' schema, its reader."""

    @classmethod
    def name(cls) -> str:
        return "calendar_feed"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CalendarFeed)


def cursors(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(path, cursor) of the feeds of a folder whose path below it holds the pattern: what a later read may name as `known`. The driver
    lists them, tasks hash them chunk by chunk."""
    reader = FeedReader({"path": path})
    _, root = reader._files()
    found = [p.path for p in reader.partitions() if re.search(pattern, p.path.removeprefix(root).lstrip("/"))]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "cursor": [digest(reader.chunks(p)()) for p in batch["path"]]})

    files = spark.createDataFrame([(p,) for p in found], "path string")
    return files.repartition(max(1, min(len(found), 1_000)), F.col("path")).mapInPandas(hashed, "path string, cursor string")
