"""Date and time-zone functions. Timestamps are instants; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(ts: str | Column) -> Column:
    """An instant, also from a timestamp without time zone (read as UTC)."""
    return F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")


def wall_clock(ts: str | Column, zone: str | Column) -> Column:
    """UTC instant to the clock on the wall in a zone."""
    return F.from_utc_timestamp(instant(ts), zone)


def to_instant(wall: Column, zone: str | Column) -> Column:
    """Wall clock to instant: an hour that comes twice gives the earlier instant, one that is skipped the later."""
    return F.to_utc_timestamp(wall, zone)


def local_day(ts: str | Column, zone: str | Column) -> Column:
    return F.to_date(wall_clock(ts, zone))


def day_key(ts: str | Column, zone: str | Column) -> Column:
    return F.date_format(wall_clock(ts, zone), "yyyy-MM-dd")


def offset_seconds(ts: str | Column, zone: str | Column) -> Column:
    return F.unix_timestamp(wall_clock(ts, zone)) - F.unix_timestamp(instant(ts))


def week_start(ts: str | Column, zone: str | Column) -> Column:
    """Monday 00:00 of the local week, as a wall clock."""
    return F.date_trunc("week", wall_clock(ts, zone))


def week_days(ts: str | Column, zone: str) -> Column:
    """The instants of the seven local midnights of the week."""
    start = F.to_date(week_start(ts, zone))
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: to_instant(F.date_add(start, i).cast("timestamp"), zone))


def days_until(due: Column, now: Column) -> Column:
    """Fractional days from now to due."""
    return (F.unix_micros(due) - F.unix_micros(now)) / F.lit(86_400_000_000.0)
