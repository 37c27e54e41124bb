"""Times in centiseconds, ages and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_centiseconds(cs: Column) -> Column:
    """``m:ss.cc``, or ``s.cc`` under a minute; null and what isn't positive give an empty text."""
    cs = cs.cast("long")
    minutes, rest = F.floor(cs / 6000), cs % 6000
    seconds, hundredths = F.floor(rest / 100).cast("string"), F.lpad((rest % 100).cast("string"), 2, "0")
    text = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(":"), F.lpad(seconds, 2, "0"), F.lit("."), hundredths)).otherwise(F.concat(seconds, F.lit("."), hundredths))
    return F.when(cs > 0, text).otherwise(F.lit(""))


def parse_time(text: Column) -> Column:
    """Centiseconds of ``[m:]s.c[c]`` (comma or point; one digit is tenths); anything else is 0."""
    pattern = r"^\s*(?:(\d+):)?(\d{1,2})[.,](\d{1,2})\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    minutes = F.coalesce(part(1).try_cast("long"), F.lit(0))
    cs = minutes * 6000 + part(2).try_cast("long") * 100 + F.rpad(part(3), 2, "0").try_cast("long")
    return F.coalesce(cs, F.lit(0))


def points(base_seconds: Column, cs: Column) -> Column:
    """1000 times the cube of base time over time, cut to a whole number; 0 without a base time or a time."""
    return F.when(base_seconds.isNotNull() & (cs > 0), (1000.0 * F.pow(base_seconds / (cs / 100.0), F.lit(3))).cast("int")).otherwise(F.lit(0))


def age_on(birth_date: Column, birth_year: Column, on: Column) -> Column:
    """Age by the birthday, or by the year where that is all that is known."""
    before = F.date_format(on, "MMdd") < F.date_format(birth_date, "MMdd")
    return F.coalesce(F.year(on) - F.year(birth_date) - before.cast("int"), F.year(on) - birth_year)
