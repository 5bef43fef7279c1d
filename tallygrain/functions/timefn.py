"""Dates and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def within_last_hours(ts: Column, now: Column, hours: int = 24) -> Column:
    return ts > now - F.make_dt_interval(hours=F.lit(hours))


def event_window(ts: Column, before: int, after: int) -> tuple[Column, Column, Column]:
    """Window start, event day and window end as UTC dates."""
    day = F.to_date(ts)
    return F.date_sub(day, before), day, F.date_add(day, after)


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), ISO_MILLIS)


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)
