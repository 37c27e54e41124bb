"""Keys and clean-ups of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poolside.functions import once

# Characters that part words of a team's name, and what it can end with, in the order of removal.
PUNCTUATION = r"[-_.,/\\'’`´&()]+"
SUFFIXES = (r"\s+national team$", r"\s+team\s+[a-d]$", r"\s+team$", r"\s+[a-d]$", r"\s+\d{1,2}$")


def team_key(name: Column) -> Column:
    """One key for all spellings of a team: case, punctuation and squad suffixes don't count. Suffixes go until none is left."""

    def step(k: Column, _: Column) -> Column:
        for suffix in SUFFIXES:
            k = F.trim(F.regexp_replace(k, suffix, ""))
        return k

    # each step that changes anything takes a word at least
    stripped = lambda k: F.aggregate(F.sequence(F.lit(1), F.size(F.split(k, " "))), k, step)
    key = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), PUNCTUATION, " ")), r"\s+", " "))
    # without the word team the letters and numbers at the end go at once
    plain = lambda k: F.regexp_replace(k, r"(?:\s+(?:[a-d]|\d{1,2}))+$", "")
    return once(key, lambda k: F.when(~F.contains(k, F.lit("team")), plain(k)).when(k.rlike("|".join(SUFFIXES)), stripped(k)).otherwise(k))


def strip_squad_number(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+\d{1,2}$", "")


def match_key(name: Column) -> Column:
    """Upper case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def sorted_key(name: Column) -> Column:
    """The words of ``match_key`` in alphabetical order."""
    return F.array_join(F.array_sort(F.split(match_key(name), " ")), " ")


def one_edit_apart(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) <= 1
