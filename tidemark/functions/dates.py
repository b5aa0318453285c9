"""Date and time functions. ``now`` is always a parameter, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip


def parse_date(c: Column | str) -> Column:
    """A date from the first ten characters, if they are a full ISO date."""
    head = F.substring(_col(c), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def parse_us_date(c: Column | str) -> Column:
    """'Sunday, June 1, 2025', 'June 1, 2025' or '6/1/2025'; null for anything else and for the year 9999."""
    text = F.regexp_replace(strip(c), r"(?i)^(mon|tues|wednes|thurs|fri|satur|sun)day, +", "")
    long, short = (F.try_to_timestamp(text, F.lit(f)) for f in ("MMMM d, yyyy", "M/d/yyyy"))
    long = F.when(text.rlike(r"^[A-Za-z]+ +\d{1,2}, +\d{4}$"), long)
    short = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") & (strip(c) == text), short)
    day = F.coalesce(long, short).cast("date")
    return F.when(F.year(day) < 9999, day)


def iso_z(ts: Column | str) -> Column:
    """ISO text ending in Z; microseconds only where there are any."""
    ts = _col(ts)
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def epoch_iso(seconds: Column | str) -> Column:
    """ISO text in UTC of epoch seconds; null for null and 0. The session runs in UTC."""
    seconds = _col(seconds)
    return F.when(seconds != 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end, with their fraction."""
    micros = [F.unix_micros(_col(c).cast("timestamp")) for c in (start, end)]
    return (micros[1] - micros[0]) / F.lit(1e6)


def plus_minutes(ts: Column | str, minutes: Column | str) -> Column:
    return _col(ts) + F.make_dt_interval(mins=_col(minutes).cast("int"))


def iso_week(c: Column | str) -> Column:
    """struct(year, week) of the ISO calendar."""
    return F.struct(F.date_part(F.lit("YEAROFWEEK"), _col(c)).alias("year"), F.date_part(F.lit("WEEK"), _col(c)).alias("week"))
