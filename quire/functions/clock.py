"""Clock values and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = "-?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)"
#: Longest times that are written: a SMIL clock of 1000 hours, a duration of one year.
SMIL_MOST, DURATION_MOST = 3.6e6, 365 * 86400.0


def _number(c: Column) -> Column:
    return F.when(c.rlike(f"^{_NUMBER}$"), c.try_cast("double"))


def parse_clock_value(c: Column) -> Column:
    """Seconds of H:M:S, M:S or a number with ms, s, min, h or no unit, npt= before it or not; null if it is none."""
    usual = F.regexp_extract(c, "^(?:npt=)?([0-9]+(?:\\.[0-9]+)?)s?$", 1)  # most are, and need none of the rest
    body = F.regexp_replace(F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""), "^npt=", "")
    parts = F.split(body, ":")
    number = lambda i: _number(F.get(parts, F.lit(i)))
    unit = F.regexp_extract(body, "(ms|min|h|s)$", 1)
    value = _number(F.regexp_replace(body, "(ms|min|h|s)$", ""))
    plain = F.when(unit == "ms", value / 1000).when(unit == "min", value * 60).when(unit == "h", value * 3600).otherwise(value)
    return F.when(usual != "", usual.try_cast("double")).when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)).when(F.size(parts) == 2, number(0) * 60 + number(1)).when(F.size(parts) == 1, plain)


def _milliseconds(c: Column, most: float | None = None) -> Column:
    limited = c if most is None else F.least(F.greatest(c, F.lit(0.0)), F.lit(most))
    return F.round(limited * 1000).cast("long")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def format_clock_value(c: Column) -> Column:
    """npt=<seconds with three decimals>s, from whole milliseconds."""
    ms = _milliseconds(c)
    size = F.abs(ms)
    return F.concat(F.lit("npt="), F.when(ms < 0, "-").otherwise(""), F.floor(size / 1000).cast("string"), F.lit("."), F.lpad((size % 1000).cast("string"), 3, "0"), F.lit("s"))


def format_smil_clock(c: Column) -> Column:
    """H:MM:SS, with milliseconds if there are any."""
    ms = _milliseconds(c, SMIL_MOST)
    s = F.floor(ms / 1000)
    tail = F.when(ms % 1000 == 0, "").otherwise(F.concat(F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0")))
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), _two(F.floor(s / 60) % 60), F.lit(":"), _two(s % 60), tail)


def format_duration(c: Column) -> Column:
    """HH:MM:SS of the rounded seconds."""
    s = F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(DURATION_MOST))).cast("long")
    return F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), _two(F.floor(s / 60) % 60), F.lit(":"), _two(s % 60))


def centiseconds_to_seconds(c: Column) -> Column:
    return c / F.lit(100.0)
