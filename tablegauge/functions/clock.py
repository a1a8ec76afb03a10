"""Date arithmetic that counts unit boundaries crossed, and elapsed-time texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BASE = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"


def ntz(value) -> Column:
    """A timestamp without zone from a text or a column."""
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp_ntz")


def units_since_base(part: str, c: Column) -> Column:
    return F.timestamp_diff(part, F.expr(_BASE), c)


def boundaries(part: str, start: Column, end: Column) -> Column:
    """Number of ``part`` boundaries between two timestamps (whole-unit differences would miss 23:59 -> 00:01)."""
    if part.upper() == "YEAR":
        return (F.year(end) - F.year(start)).cast("long")
    return units_since_base(part, end) - units_since_base(part, start)


def minutes_text(minutes: Column) -> Column:
    """``XdYhrZmin`` for a number of minutes."""
    m = minutes.cast("long")
    day, hour = F.expr("1440L"), F.expr("60L")
    return F.concat(
        _idiv(m, day).cast("string"), F.lit("d "),
        (_idiv(m, hour) % 24).cast("string"), F.lit("hr "),
        (m % 60).cast("string"), F.lit("min"),
    )


def elapsed_text(start: Column, end: Column) -> Column:
    return minutes_text(boundaries("MINUTE", start, end))


def seconds_text(seconds: Column) -> Column:
    """``d:hh:mm:ss`` for a number of seconds."""
    s = seconds.cast("long")
    return F.format_string(
        "%d:%02d:%02d:%02d",
        _idiv(s, F.lit(86400)), _idiv(s, F.lit(3600)) % 24, _idiv(s, F.lit(60)) % 60, s % 60,
    )


def _idiv(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def idiv(a: Column, b: Column) -> Column:
    """Integer division that truncates; NULL where the divisor is 0."""
    return _idiv(a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
