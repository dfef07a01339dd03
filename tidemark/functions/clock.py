"""Time helpers. Every operator takes its clock as an argument, so runs can be repeated."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def ts(value: dt.datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def day(value: dt.date | dt.datetime | str) -> Column:
    return F.lit(str(value)[:10]).cast("date")


def day_start(as_of: dt.datetime, days: int = 0, months: int = 0) -> Column:
    """Midnight of the day ``days``/``months`` before ``as_of``."""
    start = F.date_sub(day(as_of), days)
    if months:
        start = F.add_months(start, -months)
    return start.cast("timestamp_ntz")


def ago(as_of: dt.datetime, **span: int) -> Column:
    """The instant ``span`` (as for timedelta) before ``as_of``."""
    return ts(as_of - dt.timedelta(**span))


def trunc(unit: str, moment: str | Column) -> Column:
    """Start of the hour, day, week, month, quarter or year of a zone-less time.

    date_trunc would go through the session zone, whose clock changes move some hours.
    """
    at = F.col(moment) if isinstance(moment, str) else moment
    date, unit = at.cast("date"), unit.lower()
    if unit == "hour":
        return F.timestamp_add("HOUR", F.hour(at), date.cast("timestamp_ntz")).cast("timestamp_ntz")
    return (date if unit == "day" else F.trunc(date, unit)).cast("timestamp_ntz")


def hours_crossed(start: Column | str, end: Column) -> Column:
    """Hour boundaries between two times (00:59 to 01:01 is one), not whole hours."""
    begin = F.col(start) if isinstance(start, str) else start
    return F.datediff(end.cast("date"), begin.cast("date")) * 24 + F.hour(end) - F.hour(begin)


def day_number(date: Column | str) -> Column:
    return F.datediff(F.col(date) if isinstance(date, str) else date, F.lit("1970-01-01").cast("date"))


def is_trading_day(date: Column) -> Column:
    """Monday to Friday; Sunday is 0 and Saturday 6 here."""
    return ~(F.dayofweek(date) - 1).isin(0, 6)


def instant(wall: Column | str) -> Column:
    """A zone-less time as an instant, read as UTC whatever the session zone; watermarks need instants."""
    at = F.col(wall) if isinstance(wall, str) else wall
    micros = (F.unix_date(at.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(at).cast("bigint") * 3_600_000_000
              + F.minute(at).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint"))
    return F.timestamp_micros(micros)


def wall(moment: Column | str) -> Column:
    """Inverse of :func:`instant`."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(moment), ts("1970-01-01 00:00:00")).cast("timestamp_ntz")
