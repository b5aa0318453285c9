"""Number functions: lenient parsing, back-off, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip

#: Number syntax, back-off and drop test.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
MAX_DOUBLINGS, MAX_MINUTES = 4, 24 * 60
DROP_RATIO, DROP_MIN_MEDIAN = 0.5, 4


def to_number(c: Column | str) -> Column:
    """A double from text with dollar signs, commas and blanks; null for other text."""
    text = strip(F.regexp_replace(_col(c), "[$,]", ""))
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def to_integer(c: Column | str) -> Column:
    """``to_number`` rounded half to even."""
    return F.bround(to_number(c)).try_cast("int")


def variant_number(v: Column | str) -> Column:
    """``to_number`` of a JSON value; the number 0, false and null are no number, the text "0" is."""
    v = _col(v)
    kind, number = F.schema_of_variant(v), to_number(F.try_variant_get(v, "$", "string"))
    return F.when(kind == "STRING", number).when(~kind.isin("BOOLEAN", "VOID"), F.nullif(number, F.lit(0.0)))


def backoff_minutes(interval: Column | str, failures: Column | str) -> Column:
    """The interval doubled per failure, at most four times and at most a day."""
    doubled = _col(interval) * F.pow(F.lit(2), F.least(_col(failures), F.lit(MAX_DOUBLINGS)))
    return F.least(doubled, F.lit(MAX_MINUTES)).cast("int")


def percent(status: Column | str, done: Column | str, total: Column | str) -> Column:
    """Progress in percent; 100 once succeeded, null without a total."""
    part = F.when(_col(total) != 0, F.bround(F.least(F.lit(100.0), F.lit(100.0) * _col(done) / F.nullif(_col(total), F.lit(0))), 1))
    return F.when(_col(status) == "succeeded", F.lit(100.0)).otherwise(part)


def eta_seconds(status: Column | str, done: Column | str, total: Column | str, elapsed: Column | str) -> Column:
    """Seconds left at the pace so far, of a running job that has done something."""
    left = F.greatest(_col(total) - _col(done), F.lit(0))
    running = (_col(status) == "running") & (_col(total) != 0) & (_col(done) != 0)
    return F.when(running, F.bround(_col(elapsed) / _col(done) * left))


def gigabytes(size: Column | str) -> Column:
    return F.bround(_col(size) / F.lit(1e9), 1)
