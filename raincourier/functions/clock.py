"""Timestamp arithmetic on microseconds, independent of interval formatting."""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value) -> Column:
    """A Python datetime (naive means UTC), ISO text or Column as a timestamp."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    micros = round(value.timestamp() * 1_000_000)
    return F.timestamp_micros(F.lit(micros))


def _nearest(micros: Column) -> Column:
    """Half-up to a whole number in plain arithmetic; `round` goes through a decimal text per row."""
    return (F.signum(micros) * F.floor(F.abs(micros) + 0.5)).cast("bigint")


def plus_hours(ts: Column, hours) -> Column:
    hours = hours if isinstance(hours, Column) else F.lit(float(hours))
    return F.timestamp_micros(F.unix_micros(ts) + _nearest(hours * 3.6e9))


def plus_minutes(ts: Column, minutes) -> Column:
    minutes = minutes if isinstance(minutes, Column) else F.lit(float(minutes))
    return F.timestamp_micros(F.unix_micros(ts) + _nearest(minutes * 6e7))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def from_ntz(column: Column) -> Column:
    """Watermarks need TIMESTAMP; files carry TIMESTAMP_NTZ (session zone UTC)."""
    return column.cast("timestamp")
