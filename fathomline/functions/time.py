"""Time as columns.  Timestamps are UTC; numeric work is in microseconds since 1970."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def to_unix(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return micros(ts) / 1e6


def to_dnum(ts: Column) -> Column:
    """Days since 1970 as a double."""
    return micros(ts) / float(DAY)


def from_dnum(days: Column) -> Column:
    return from_micros(F.round(days * float(DAY)))


def matlab_to_time(days: Column) -> Column:
    """Matlab day numbers, which count from year 0."""
    return from_dnum(days - 719529)


def to_jdate(ts: Column) -> Column:
    """year * 1000 + day of year, the day counted from 0."""
    return F.year(ts) * 1000 + F.dayofyear(ts) - 1


def floor_time(ts: Column, seconds: float) -> Column:
    step = int(seconds * 1e6)
    return from_micros(F.floor(micros(ts) / step) * step)


def ceil_time(ts: Column, seconds: float) -> Column:
    step = int(seconds * 1e6)
    return from_micros(F.ceil(micros(ts) / step) * step)


def round_time(ts: Column, seconds: float) -> Column:
    """To the nearest step, halves to the even one."""
    step = int(seconds * 1e6)
    return from_micros(F.bround(micros(ts) / step, 0) * step)


def cf_time(text: Column) -> Column:
    """'N units since T' as a time; units are days, hours, minutes or seconds, T may end in Z."""
    part = F.regexp_extract(text, r"^\s*([-+0-9.eE]+)\s+(\w+?)s?\s+since\s+(.*?)\s*Z?$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*([-+0-9.eE]+)\s+(\w+?)s?\s+since\s+(.*?)\s*Z?$", 2)
    since = F.to_timestamp(F.regexp_extract(text, r"^\s*([-+0-9.eE]+)\s+(\w+?)s?\s+since\s+(.*?)\s*Z?$", 3))
    size = F.create_map(*(F.lit(x) for x in ("day", 86400.0, "hour", 3600.0, "minute", 60.0, "second", 1.0)))
    return from_micros(micros(since) + F.round(part * size[unit] * 1e6))


def equation_of_time(ts: Column) -> Column:
    """Minutes that solar time is ahead of mean time, from the earth's orbit."""
    d = 6.24004077 + 0.01720197 * ((micros(ts) - 946_684_800_000_000) / float(DAY))  # days since 2000
    return -7.659 * F.sin(d) + 9.863 * F.sin(2 * d + 3.5932)


def solar_radiation(ts: Column, peak: float = 1000.0, lat: float = 37.775, lon: float = -122.419, declination: bool = True) -> Column:
    """Idealised clear-sky radiation: peak times the sine of the sun's elevation, never negative; without ``declination`` as at an equinox."""
    us = micros(ts) + (equation_of_time(ts) * 60e6).cast("long")  # apparent time
    at = F.timestamp_micros(us)
    day = (us - F.unix_micros(F.date_trunc("year", at))) / float(DAY)  # of the year, from 0
    tilt = math.pi / 180 * 23.45 * F.sin(2 * math.pi / 365 * (day - 81)) if declination else F.lit(0.0)
    hour = F.pmod(us + int(86400 * lon / 360.0) * 1_000_000, F.lit(DAY)) / 3.6e9
    here = math.radians(lat)
    return F.greatest(F.lit(0.0), peak * (math.sin(here) * F.sin(tilt) + math.cos(here) * F.cos(tilt) * F.cos((hour - 12) * (math.pi / 12))))


def formatted(ts: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(ts, pattern)


def from_unix(seconds: Column) -> Column:
    """Seconds since 1970 as a time, to the microsecond."""
    return from_micros(F.round(seconds * 1e6))


def parsed_date(text: Column) -> Column:
    """YYYY and any of MM, DD, HH, mm and ss behind it as a time; null for another length."""
    part = lambda a, least: F.when(F.length(text) >= a + 1, F.substring(text, a, 2)).otherwise(F.lit(least))
    whole = F.concat_ws("", F.substring(text, 1, 4), part(5, "01"), part(7, "01"), part(9, "00"), part(11, "00"), part(13, "00"))
    return F.when(text.rlike(r"^\d{4}(\d{2}){0,5}$"), F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def parsed_offset(text: Column) -> Column:
    """``+3d``, ``-2.5h``, ``+10m`` or ``-1s`` in microseconds; null for another text.  The sign must be there."""
    size = F.create_map(*(F.lit(x) for x in ("d", 86_400e6, "h", 3600e6, "m", 60e6, "s", 1e6)))
    pattern = r"^([+-]\d*\.?\d+)([dhms])$"
    return F.round(F.regexp_extract(text, pattern, 1).try_cast("double") * size[F.regexp_extract(text, pattern, 2)]).cast("long")


def parsed_interval(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """``start:end``, ``:end``, ``start:`` or one of both as two times; what is missing is the default, an offset counts from the other end.

    A date alone begins an interval of the default's length; an offset alone ends at the default's end if negative and begins at its start if not.
    An interval that ends before it begins is null.
    """
    a, b = F.trim(F.split_part(text, F.lit(":"), F.lit(1))), F.trim(F.split_part(text, F.lit(":"), F.lit(2)))
    two = text.contains(":")
    first, second = micros(start), micros(end)
    ea, eb = F.coalesce(micros(parsed_date(b)), second), F.coalesce(micros(parsed_date(a)), first)
    two_a = F.when(parsed_offset(a).isNotNull(), ea + parsed_offset(a)).otherwise(eb)
    two_b = F.when(parsed_offset(b).isNotNull(), eb + parsed_offset(b)).otherwise(ea)
    at, off = micros(parsed_date(a)), parsed_offset(a)
    one_a = F.coalesce(at, F.when(off < 0, second + off), first)
    one_b = F.coalesce(at + (second - first), F.when(off >= 0, first + off), second)
    x, y = F.when(two, two_a).otherwise(one_a), F.when(two, two_b).otherwise(one_b)
    return F.when(x <= y, from_micros(x)), F.when(x <= y, from_micros(y))
