"""Time columns: microseconds as whole numbers, and text stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def clock(seconds: Column) -> Column:
    """M:SS of a number of seconds; fractions are cut off."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def stamp(seconds: Column, comma: bool = True) -> Column:
    """HH:MM:SS,mmm (or with a point) of a number of seconds, as in subtitle files; negative counts as 0."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    parts = [F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000]
    return F.format_string(f"%02d:%02d:%02d{',' if comma else '.'}%03d", *parts)


def centi_stamp(seconds: Column) -> Column:
    """H:MM:SS.cc of a number of seconds."""
    cs = F.round(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    parts = [F.floor(cs / 360_000).cast("long"), F.floor(cs / 6000).cast("long") % 60, F.floor(cs / 100).cast("long") % 60, cs % 100]
    return F.format_string("%d:%02d:%02d.%02d", *parts)
