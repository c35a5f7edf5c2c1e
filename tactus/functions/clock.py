"""Elapsed time as hundredths of a second and '[mm:ss.hh]' stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMPED = r"^\[(\d+):([0-5]\d)\.(\d\d)\](.*)$"


def hundredths(seconds: Column) -> Column:
    """Seconds, as float32, to hundredths, half up; negative or not finite gives null."""
    single = seconds.cast("float").cast("double")
    return F.when((single >= 0) & (single < 2147483647 / 100), F.floor(single * 100 + 0.5).cast("int"))


def stamp(of: Column) -> Column:
    minutes, rest = F.floor(of / 6000).cast("int"), F.pmod(of, F.lit(6000))
    return F.format_string("[%02d:%02d.%02d]", minutes, F.floor(rest / 100).cast("int"), F.pmod(rest, F.lit(100)))


def parse_stamp(line: Column) -> Column:
    """Hundredths of a stamped line; null without a well-formed stamp or beyond 32 bits."""
    minutes, seconds, rest = (F.regexp_extract(line, STAMPED, k).try_cast("long") for k in (1, 2, 3))
    fits = minutes <= F.floor((2147483647 // 100 - seconds) / 60)
    return F.when(line.rlike(STAMPED) & fits, (minutes * 6000 + seconds * 100 + rest).cast("int"))


def stamp_length(of: Column) -> Column:
    """Characters of the stamp of some hundredths: two digits of minutes or more, and eight others."""
    return F.greatest(F.length(F.floor(of / 6000).cast("string")), F.lit(2)) + 8


def stamped_text(line: Column) -> Column:
    return F.regexp_extract(line, STAMPED, 4)
