"""Days and places out of a meet's heading, in English and French.

A heading is its tokens: numbers, words and single signs. Ways to write days are tried in the order of trust, each at
every place from the left; the first whose day can be one decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poolside.functions import once

# Names of months, and words that are of no place.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
NO_PLACE = ("petit bassin", "grand bassin", "short course", "long course", "liste résultats", "results", "résultats")
TO, DASHES, PARTS = ("to", "¤", "–", "-"), ("-", "–"), ("/", "-", ".")


def day(d: Column, m: Column, y: Column) -> Column:
    """yyyy-mm-dd of numbers that can be a day, else null."""
    fits = d.between(1, 31) & m.between(1, 12) & y.between(1900, 2100)
    return F.when(fits, F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))


def meet_days(text: Column) -> Column:
    """struct(start, end): days as yyyy-mm-dd, empty where there are none.

    Tried in this order: two full dates with "to" or a dash between them; two days of one month (19 - 22/1/2022); two
    days with a stroke (20/21-04-2024); days with a month's name, whose year may stand elsewhere; the first full date.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\d+|\p{L}+|[^\s\d\p{L}]"), F.lit(0))
    names = F.array(*map(F.lit, MONTHS))
    months = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))

    def told(t: Column) -> Column:
        at = lambda i: F.coalesce(F.get(t, i), F.lit(""))
        number = lambda i: at(i).try_cast("int")
        few = lambda i: at(i).rlike(r"^\d{1,2}$")
        year = lambda i: at(i).rlike(r"^\d{4}$")
        date = lambda i: few(i) & at(i + 1).isin(*PARTS) & few(i + 2) & at(i + 3).isin(*PARTS) & year(i + 4)
        days = lambda i: day(number(i), number(i + 2), number(i + 4))
        pair = lambda start, end: F.struct(start.alias("start"), F.coalesce(end, F.lit("")).alias("end"))
        places = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: few(i))
        first = lambda fits, value: F.get(F.filter(F.transform(F.filter(places, fits), value), lambda x: x["start"].isNotNull()), 0)
        # longer words count as the month that they begin with
        month = lambda i: F.try_element_at(months, F.coalesce(F.get(F.filter(names, lambda n: F.startswith(at(i), n)), 0), F.lit("")))
        any_year = F.get(F.filter(t, lambda x: x.rlike(r"^\d{4}$")), 0).try_cast("int")
        beside = lambda i: F.when(year(i), number(i)).when(at(i).isin(".", ",") & year(i + 1), number(i + 1)).otherwise(any_year)
        ranged = lambda i: at(i + 1).isin(*DASHES) & few(i + 2) & month(i + 3).isNotNull()
        named = lambda i: F.when(ranged(i), pair(day(number(i), month(i + 3), beside(i + 4)), day(number(i + 2), month(i + 3), beside(i + 4)))).otherwise(pair(day(number(i), month(i + 1), beside(i + 2)), F.lit("")))
        return F.coalesce(
            first(lambda i: date(i) & at(i + 5).isin(*TO) & date(i + 6), lambda i: pair(days(i), days(i + 6))),
            first(lambda i: at(i + 1).isin(*DASHES) & date(i + 2), lambda i: pair(day(number(i), number(i + 4), number(i + 6)), days(i + 2))),
            first(lambda i: (at(i + 1) == "/") & few(i + 2) & (at(i + 3) == "-") & at(i + 4).rlike(r"^\d{2}$") & (at(i + 5) == "-") & year(i + 6), lambda i: pair(day(number(i), number(i + 4), number(i + 6)), day(number(i + 2), number(i + 4), number(i + 6)))),
            first(lambda i: ranged(i) | month(i + 1).isNotNull(), named),
            first(date, lambda i: pair(days(i), F.lit(""))),
            pair(F.lit(""), F.lit("")),
        )

    return once(tokens, told)


def meet_place(text: Column) -> Column:
    """What is left of a heading without days, "to", pools' lengths and words that are of no place; dashes and commas at its ends go."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[.,]+$", ""))

    def kept(ws: Column) -> Column:
        at = lambda i: F.coalesce(bare(F.get(ws, i)), F.lit(""))
        month = lambda i: at(i).isin(*MONTHS)
        numbers = lambda i: at(i).rlike(r"^\d{1,2}([-–]\d{1,2})?$")
        dash = lambda i: at(i).isin(*DASHES)
        full = lambda i: at(i).rlike(r"\d{1,2}[-/.]\d{1,2}[-/.]\d{4}")
        of_month = lambda i: (month(i) & numbers(i - 1)) | (numbers(i) & (month(i + 1) | (dash(i + 1) & (numbers(i + 2) | full(i + 2))) | dash(i - 1) & month(i + 1))) | (at(i).rlike(r"^\d{4}$") & month(i - 1))
        pool = lambda i: at(i).rlike(r"^(25|50)m$") | (at(i).isin("25", "50") & (at(i + 1) == "m")) | ((at(i) == "m") & at(i - 1).isin("25", "50"))
        return F.array_join(F.filter(F.transform(ws, lambda w, i: F.when(full(i) | of_month(i) | pool(i) | at(i).isin("to", "¤"), "").otherwise(w)), lambda w: w != ""), " ")

    place = once(words, kept)
    for words_of_none in NO_PLACE:
        place = F.regexp_replace(place, rf"(?iu){words_of_none}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r"\s*[-–](\s*[-–])+\s*", " - "), r"^[\s,–-]+|[\s,–-]+$", ""), r"\s+", " "))
