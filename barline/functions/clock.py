"""Calendar and clock columns; every instant is UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000
MINUTE_US = 60 * US
HOUR_US = 3600 * US
DAY_US = 86_400 * US

# fixed values: trading sessions by UTC hour (start inclusive, end exclusive)
SESSIONS = [("asian", 0, 7), ("london", 7, 13), ("overlap", 13, 16), ("new_york", 16, 21), ("off", 21, 24)]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_ts(ts: Column | str, width_us: int, offset_us: int = 0) -> Column:
    """Start of the fixed-width bucket holding ``ts``."""
    us = F.unix_micros(_c(ts)) - F.lit(offset_us)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width_us)) + F.lit(offset_us))


def ceil_ts(ts: Column | str, width_us: int) -> Column:
    """End of the right-closed bucket (start, end] holding ``ts``."""
    us = F.unix_micros(_c(ts))
    return F.timestamp_micros(us + F.pmod(-us, F.lit(width_us)))


def shift(ts: Column | str, us: int | Column) -> Column:
    return F.timestamp_micros(F.unix_micros(_c(ts)) + (F.lit(us) if isinstance(us, int) else us))


def session_label(ts: Column | str) -> Column:
    hour = F.hour(_c(ts))
    out = None
    for name, a, b in SESSIONS:
        cond = (hour >= a) & (hour < b)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def hour_of_week(ts: Column | str) -> Column:
    """0 (Monday 00h) to 167 (Sunday 23h)."""
    return F.weekday(_c(ts)) * 24 + F.hour(_c(ts))


def clock_features(ts: Column | str, week_days: float = 7.0) -> dict[str, Column]:
    h = F.hour(_c(ts)) + F.minute(_c(ts)) / 60.0
    d = F.weekday(_c(ts))
    two_pi = 2.0 * math.pi
    return {
        "how": hour_of_week(ts),
        "hour_sin": F.sin(h * two_pi / 24.0),
        "hour_cos": F.cos(h * two_pi / 24.0),
        "dow_sin": F.sin(d * two_pi / week_days),
        "dow_cos": F.cos(d * two_pi / week_days),
    }


def to_local(ts: Column | str, tz: str) -> Column:
    return F.from_utc_timestamp(_c(ts), tz)


def local_instant(date: Column | str, tz: str, hour: int, minute: int = 0) -> Column:
    """UTC instant of a local wall-clock time on a date, DST aware."""
    d = _c(date)
    wall = F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), F.lit(hour), F.lit(minute), F.lit(0.0))
    return F.to_utc_timestamp(wall, tz)


def last_business_day(date: Column | str) -> Column:
    """Last Monday-to-Friday day of the month of ``date``."""
    end = F.last_day(_c(date))
    wd = F.weekday(end)
    return F.date_sub(end, F.greatest(wd - 4, F.lit(0)).cast("int"))
