"""Calendar files: a parser for VEVENT text with recurrence, run per file by mapInPandas.

One malformed event fails its file, which then gives one row with an error instead of events.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, time, timedelta, timezone, tzinfo
from heapq import merge
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PSEUDO_ROWS
from .tables import held, sized

#: The most occurrences of an event, and the order of weekdays in rules.
CAP, WEEKDAYS = 750, ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
SCHEMA = "path string, uid string, recurrence_id timestamp, starts_at timestamp, ends_at timestamp, all_day boolean, summary string, location string, status string, rrule string, sequence int, overridden boolean, error string, dropped int"


class FeedError(ValueError):
    pass


def unfolded(text: str) -> list[str]:
    return re.sub(r"\r?\n[ \t]", "", text).splitlines()


def properties(lines: list[str]) -> dict[str, list[tuple[dict[str, str], str]]]:
    out: dict[str, list[tuple[dict[str, str], str]]] = {}
    for line in lines:
        head, colon, value = line.partition(":")
        if not colon:
            continue
        name, *params = head.split(";")
        pairs = dict((p.split("=", 1)[0].upper(), p.split("=", 1)[1].strip('"')) for p in params if "=" in p)
        out.setdefault(name.upper(), []).append((pairs, value))
    return out


class FileZone(tzinfo):
    """A zone that a file defines itself: onsets of offsets, each with a yearly rule or dates."""

    def __init__(self, name: str, onsets: list[tuple[datetime, timedelta, str | None]]):
        self.name, self.onsets = name, sorted(onsets, key=lambda o: o[0])

    def utcoffset(self, when: datetime | None) -> timedelta:
        wall, last, offset = (when or datetime.max).replace(tzinfo=None), None, self.onsets[0][1]
        for start, to, rule in self.onsets:
            for at in recurrences(start, rule) if rule else [start]:
                if at > wall:
                    break
                if last is None or at >= last:
                    last, offset = at, to
        return offset

    def dst(self, when: datetime | None) -> None:
        return None

    def tzname(self, when: datetime | None) -> str:
        return self.name


def file_zones(lines: Iterable[str]) -> dict[str, FileZone]:
    """The VTIMEZONE blocks of a file, by their TZID."""
    zones, name, onsets, held = {}, None, [], None
    for line in lines:
        head, _, value = line.strip().partition(":")
        tag = (head.upper(), value.strip().upper())
        if tag == ("BEGIN", "VTIMEZONE"):
            name, onsets = None, []
        elif tag in (("BEGIN", "STANDARD"), ("BEGIN", "DAYLIGHT")):
            held = []
        elif tag in (("END", "STANDARD"), ("END", "DAYLIGHT")) and held is not None:
            e, held = properties(held), None
            m = re.fullmatch(r"([+-])(\d\d)(\d\d)(\d\d)?", e["TZOFFSETTO"][0][1].strip())
            if not m:
                raise FeedError("bad offset of a time zone")
            size = timedelta(hours=int(m[2]), minutes=int(m[3]), seconds=int(m[4] or 0))
            onsets.append((datetime.strptime(e["DTSTART"][0][1][:15], "%Y%m%dT%H%M%S"), -size if m[1] == "-" else size, e["RRULE"][0][1] if "RRULE" in e else None))
        elif tag == ("END", "VTIMEZONE"):
            if name and onsets:
                zones[name] = FileZone(name, onsets)
        elif held is not None:
            held.append(line)
        elif head.upper() == "TZID":
            name = value.strip()
    return zones


def instant(wall: datetime, zone: tzinfo) -> datetime:
    """Wall clock to UTC: the earlier of two instants; in a gap the later reading."""
    return wall.replace(tzinfo=zone, fold=0).astimezone(timezone.utc).replace(tzinfo=None)


def zone_of(name: str | None, default: str, own: dict[str, FileZone] | None = None) -> tzinfo:
    """A named zone, the profile's where none is named, the file's own where the name is no other's; else the file fails."""
    try:
        return ZoneInfo(name or default)
    except (ZoneInfoNotFoundError, ValueError, OSError) as e:
        if name and own and name in own:
            return own[name]
        raise FeedError(f"unknown time zone {name}") from e


def moment(params: dict[str, str], value: str, default: str, own: dict[str, FileZone] | None = None) -> tuple[datetime, bool, tzinfo]:
    """(wall clock, all day, zone). All-day dates are midnight in the profile's zone whatever their own."""
    if params.get("VALUE") == "DATE" or re.fullmatch(r"\d{8}", value):
        try:
            return datetime.combine(datetime.strptime(value[:8], "%Y%m%d").date(), time()), True, zone_of(None, default)
        except ValueError as e:
            raise FeedError(f"bad date {value}") from e
    zone = ZoneInfo("UTC") if value.endswith("Z") else zone_of(params.get("TZID"), default, own)
    try:
        return datetime.strptime(value.rstrip("Z"), "%Y%m%dT%H%M%S"), False, zone
    except ValueError as e:
        raise FeedError(f"bad time {value}") from e


def duration(value: str) -> timedelta:
    m = re.fullmatch(r"([+-]?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", value)
    if not m:
        raise FeedError(f"bad duration {value}")
    w, d, h, mi, s = (int(x or 0) for x in m.groups()[1:])
    return (-1 if m[1] == "-" else 1) * timedelta(weeks=w, days=d, hours=h, minutes=mi, seconds=s)


#: Parts of a rule that are read; a file with any other fails.
RULE_PARTS = {"FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "BYMONTH", "BYSETPOS", "WKST"}


def month_days(year: int, month: int) -> list[date]:
    return [date(year, month, d) for d in range(1, calendar.monthrange(year, month)[1] + 1)]


def chosen_days(days: list[date], by_day: list[tuple[int, int]], by_month_day: list[int]) -> list[date]:
    """Of the days of a month or year: those of the named weekdays (0: all of them, else the n-th, negative from the end), and those
    of the named days of the month (negative from its end)."""
    if by_day:
        of = {w: [d for d in days if d.weekday() == w] for _, w in by_day}
        days = sorted({d for n, w in by_day for d in (of[w] if n == 0 else of[w][n - 1 : n] if n > 0 else of[w][n : len(of[w]) + n + 1])})
    if by_month_day:
        last = lambda d: calendar.monthrange(d.year, d.month)[1]
        days = [d for d in days if d.day in by_month_day or d.day - last(d) - 1 in by_month_day]
    return days


def recurrences(start: datetime, rule: str, zone: tzinfo | None = None) -> Iterator[datetime]:
    """Wall clocks of a DAILY, WEEKLY, MONTHLY or YEARLY rule, in order, with the parts of RULE_PARTS. A rule with another part or
    frequency is an error. An UNTIL in UTC is compared as an instant, in `zone`."""
    parts = dict(p.split("=", 1) for p in rule.upper().split(";") if "=" in p)
    kind = parts.get("FREQ")
    if kind not in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY") or set(parts) - RULE_PARTS:
        raise FeedError(f"unsupported rule {rule}")
    step, count = int(parts.get("INTERVAL", 1)), int(parts["COUNT"]) if "COUNT" in parts else None
    until = parts.get("UNTIL")
    whole = until and "T" not in until
    end = datetime.strptime(until.rstrip("Z")[:15], "%Y%m%d" if whole else "%Y%m%dT%H%M%S") if until else None
    if whole:
        end = end.replace(hour=23, minute=59, second=59)
    past = lambda x: end is not None and (instant(x, zone) if until.endswith("Z") and zone else x) > end
    numbers = lambda name: [int(x) for x in parts.get(name, "").split(",") if x]
    months, month_day, positions = numbers("BYMONTH"), numbers("BYMONTHDAY"), numbers("BYSETPOS")
    by_day = [(int(d[:-2] or 0), WEEKDAYS.index(d[-2:])) for d in parts["BYDAY"].split(",")] if "BYDAY" in parts else []
    first = WEEKDAYS.index(parts.get("WKST", "MO"))

    def period(i: int) -> list[date]:
        day = start.date()
        if kind == "DAILY":
            return chosen_days([day + timedelta(days=i * step)], [(0, w) for _, w in by_day], month_day)
        if kind == "WEEKLY":
            begin = day - timedelta(days=(day.weekday() - first) % 7) + timedelta(weeks=i * step)
            named = {w for _, w in by_day} or {day.weekday()}
            return [d for d in (begin + timedelta(days=k) for k in range(7)) if d.weekday() in named]
        if kind == "MONTHLY":
            n = day.month - 1 + i * step
            days = month_days(day.year + n // 12, n % 12 + 1)
            return chosen_days(days, by_day, month_day) if by_day or month_day else [d for d in days if d.day == day.day]
        year = day.year + i * step
        named = months or ([day.month] if month_day or not by_day else list(range(1, 13)))
        if by_day and not months and not month_day:
            return chosen_days([d for m in named for d in month_days(year, m)], by_day, [])
        each = [month_days(year, m) for m in named]
        return [x for days in each for x in (chosen_days(days, by_day, month_day) if by_day or month_day else [d for d in days if d.day == day.day])]

    made = 0
    for i in range(10**5):
        days = [d for d in period(i) if not months or d.month in months]
        if positions:
            days = sorted({days[p - 1 if p > 0 else p] for p in positions if 0 < abs(p) <= len(days)})
        for d in days:
            x = datetime.combine(d, start.time())
            if x < start:
                continue
            if past(x) or (count is not None and made >= count) or x.year > 9000:
                return
            made += 1
            yield x
        if days and past(datetime.combine(days[-1], start.time())):
            return


def lines_of(chunks: Iterable[str]) -> Iterator[str]:
    """The unfolded lines of a text that comes in chunks; a line is whole once what follows is known not to continue it."""
    rest = ""
    for chunk in chunks:
        rest += chunk
        cut = rest.rfind("\n", 0, len(rest) - 1)
        while cut >= 0 and rest[cut + 1] in " \t":
            cut = rest.rfind("\n", 0, cut)
        if cut >= 0:
            yield from unfolded(rest[: cut + 1])
            rest = rest[cut + 1 :]
    yield from unfolded(rest)


def events_of(lines: Iterable[str]) -> Iterator[list[str]]:
    """The lines of each VEVENT."""
    held = None
    for line in lines:
        tag = line.strip().upper()
        if tag == "BEGIN:VEVENT":
            held = []
        elif tag == "END:VEVENT" and held is not None:
            yield held
            held = None
        elif held is not None:
            held.append(line)


def occurrences(read: Callable[[], Iterable[str]], default: str, low: datetime, high: datetime) -> Iterator[dict | None]:
    """The occurrences of a feed whose unfolded lines `read` gives, twice; None for a pseudo row left out. Those of rules and RDATEs
    lie between low and high (UTC); single events all count. Overrides replace an instance's start, end and status, and count
    for nothing without their master; EXDATEs drop instances. Of a feed its zones and overrides are held, its other events not."""
    one = lambda e, k: e[k][0] if k in e else None
    text_of = lambda e, k: one(e, k)[1].replace("\\,", ",").replace("\\;", ";").replace("\\n", "\n").strip() if k in e else None
    kept: list[str] = []

    def noting(lines: Iterable[str]) -> Iterator[str]:
        """The lines as they are; events among them that are overrides are kept."""
        event = None
        for line in lines:
            yield line
            tag = line.strip().upper()
            if tag == "BEGIN:VEVENT":
                event = []
            elif tag == "END:VEVENT" and event is not None:
                if any(x[:13].upper() == "RECURRENCE-ID" for x in event):
                    kept.append("\n".join(event))
                event = None
            elif event is not None:
                event.append(line)

    own = file_zones(noting(read()))

    def times(e: dict) -> tuple[datetime, datetime | None, bool, ZoneInfo]:
        if "DTSTART" not in e or "UID" not in e:
            raise FeedError("an event without start or id")
        wall, all_day, zone = moment(*one(e, "DTSTART"), default, own)
        if "DTEND" in e:
            end, _, end_zone = moment(*one(e, "DTEND"), default, own)
            return wall, instant(end, end_zone), all_day, zone
        return wall, instant(wall, zone) + duration(one(e, "DURATION")[1]) if "DURATION" in e else None, all_day, zone

    overrides: dict[tuple[str, datetime], str] = {}
    for text in kept:
        e = properties(text.split("\n"))
        if "RECURRENCE-ID" in e:
            wall, _, zone = moment(*one(e, "RECURRENCE-ID"), default, own)
            overrides[(one(e, "UID")[1], instant(wall, zone))] = text
    kept.clear()
    all_of = lambda e, k: [m for params, value in e.get(k, []) for m in (moment(params, v, default, own) for v in value.split(","))]
    for e in map(properties, events_of(read())):
        if "RECURRENCE-ID" in e:
            continue
        if any(re.search(pattern, text_of(e, "SUMMARY") or "") for _, pattern in PSEUDO_ROWS):
            yield None
            continue
        wall, end, all_day, zone = times(e)
        length = end - instant(wall, zone) if end else None
        gone = {instant(w, z) for w, _, z in all_of(e, "EXDATE")}
        rule, more = one(e, "RRULE"), sorted(w for w, _, _ in all_of(e, "RDATE"))
        repeats = bool(rule or more)
        walls = recurrences(wall, rule[1], zone) if rule else iter([wall])
        produced, last = 0, None
        for w in merge(walls, more):
            at = instant(w, zone)
            if at in gone or at == last:
                continue
            last = at
            told = overrides.get((one(e, "UID")[1], at)) if repeats else None
            change = properties(told.split("\n")) if told is not None else None
            starts, ends, status, overridden = at, at + length if length is not None else None, text_of(e, "STATUS"), change is not None
            if change:
                cw, ends, _, cz = times(change)
                starts, status = instant(cw, cz), text_of(change, "STATUS")
            if produced >= CAP or (repeats and starts > high):
                break
            produced += 1
            if not repeats or low <= starts:
                yield {"uid": one(e, "UID")[1], "recurrence_id": at, "starts_at": starts, "ends_at": ends, "all_day": all_day, "summary": text_of(change or e, "SUMMARY") or text_of(e, "SUMMARY"), "location": text_of(change or e, "LOCATION") or text_of(e, "LOCATION"), "status": (status or "CONFIRMED").lower(), "rrule": rule[1] if rule else None, "sequence": int(one(e, "SEQUENCE")[1]) if "SEQUENCE" in e else 0, "overridden": overridden}


def parse_feed(text: str, default: str, low: datetime, high: datetime) -> tuple[list[dict], int]:
    """(occurrences, pseudo rows left out) of a feed's text."""
    lines = unfolded(text)
    found = list(occurrences(lambda: lines, default, low, high))
    rows = [o for o in found if o is not None]
    return rows, len(found) - len(rows)


#: Rows that the parser's tasks send back at a time.
ROWS = 5_000


def read_feeds(files: DataFrame) -> DataFrame:
    """(path, content, default_tz, horizon_from, horizon_to) -> occurrences, a row with `error` for a file that fails, and one with
    `dropped` for a file with rows that are no events.

    A file comes whole, or in parts: rows of one path, each with whole events, all of a UID in one part, and the zones that they
    name. A part that can't be parsed fails its file. Tasks hold a batch of parts, never a file that comes in them.
    """
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns).astype(object)
        out = out.where(out.notna(), None)
        for c in ("recurrence_id", "starts_at", "ends_at"):
            out[c] = pd.to_datetime(out[c])
        return out.astype({"sequence": "Int32", "dropped": "Int32", "all_day": "boolean", "overridden": "boolean"})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                try:
                    found, dropped = parse_feed(f.content or "", f.default_tz, pd.Timestamp(f.horizon_from).to_pydatetime(), pd.Timestamp(f.horizon_to).to_pydatetime())
                    rows += [{"path": f.path} | o for o in found] + ([{"path": f.path, "dropped": dropped}] if dropped else [])
                except (FeedError, KeyError, ValueError) as e:
                    rows.append({"path": f.path, "error": str(e)})
                if len(rows) >= ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    dealt = files.select("path", "content", "default_tz", "horizon_from", "horizon_to").repartition(F.xxhash64("path", "content"))  # parts of one path too
    parsed = held(dealt.mapInPandas(parse, SCHEMA), "occurrences")
    told = parsed.where("error IS NOT NULL OR dropped IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"), F.sum("dropped").cast("int").alias("dropped"))
    failed = sized(told.where("error IS NOT NULL").select(F.col("path").alias("_failed")))
    good = parsed.where("error IS NULL AND dropped IS NULL").join(failed, F.col("path").eqNullSafe(F.col("_failed")), "left_anti")
    return good.unionByName(told.select("path", "error", F.when(F.col("error").isNull(), F.col("dropped")).alias("dropped")), allowMissingColumns=True).select(*columns)
