"""Result books as text, read set by set: lines, what they are, and the context that they inherit.

A book is a row (book, text). Its lines get numbers; headers are carried forward to the lines below them by a
window over the book, so no state runs through Python. Read so far: individual results and statuses of the
French meet-manager layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolside.functions import events
from poolside.functions.times import parse_time

DESCRIBED = r"(?iu)(\d+\s*x\s*)?\d+\s*m\s+[\p{L}\d][\p{L}\d ]*"
ROUND = r"(?iu)^\s*(s[ée]ries?|finales?|demi-finales?)\b"
TIME = r"^(\d{1,2}:)?\d{1,2}\.\d{2}$"
#: What a line without a result begins with, and its status; words that begin so count too.
STATES = {"disq": "DSQ", "dsq": "DSQ", "forf": "DNS", "dns": "DNS", "abandon": "DNF", "dnf": "DNF"}
GENDERS = ("messieurs", "dames", "garçons", "garcons", "filles", "mixte")
SKIPPED = r"(?i)^\s*minima\b"
#: Two-digit years from here on are of the last century.
PIVOT = 30


def swimmer_name(text: Column) -> Column:
    """'SURNAME, Given' as 'Given SURNAME'; without a comma as it is."""
    surname, given = F.regexp_extract(text, r"^([^,]+),\s*(.+)$", 1), F.regexp_extract(text, r"^([^,]+),\s*(.+)$", 2)
    return F.when(given != "", F.concat(F.initcap(F.trim(given)), F.lit(" "), F.upper(F.trim(surname)))).otherwise(F.trim(text))


def birth_year(digits: Column) -> Column:
    two = digits.try_cast("int")
    return F.coalesce(F.when(two < PIVOT, 2000 + two).otherwise(1900 + two), F.lit(0))


def lines_of(books: DataFrame) -> DataFrame:
    return books.select("book", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def words_of(line: Column) -> Column:
    """What the words of a line are: struct(header, place, mark, status, named, year, club, time, points, is_result).

    A line is its words: a place ("3.") or a mark or status first, then the swimmer, a birth year of two digits
    (also at the end of the name's last word), the club, the time and points. ``header`` is the gender of an event's header.
    """
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\d]", ""))
    word = lambda of, i: F.coalesce(F.try_element_at(of, i), F.lit(""))
    first, second = word(plain, F.lit(1)), word(words, F.lit(2))
    numbered = (first == "epreuve") & word(plain, F.lit(2)).rlike(r"^\d+$")
    header = F.when(numbered, F.try_element_at(F.filter(F.slice(plain, 3, 2), lambda w: w.isin(*GENDERS)), F.lit(1)))
    place = F.regexp_extract(word(words, F.lit(1)), r"^(\d+)\.$", 1).try_cast("int")
    mark = F.when(first.isin("hc", "nc"), F.upper(first))
    status = F.when(second.rlike(r"^\p{Lu}"), F.coalesce(*(F.when(first.startswith(begin), F.lit(state)) for begin, state in STATES.items())))
    at = F.array_position(F.transform(words, lambda w: w.rlike(TIME)), True).cast("int")
    start = F.when(place.isNotNull() | mark.isNotNull() | status.isNotNull(), 2).otherwise(1)
    end = F.when(at > 0, at).otherwise(F.size(words) + 1)
    body = F.slice(words, start, F.greatest(end - start, F.lit(0)))
    born = F.array_position(F.transform(body, lambda w: w.rlike(r"^(.*[\p{L}.'])?\d{2}$")), True).cast("int")
    until = F.greatest(born, F.lit(1))
    named = F.trim(F.array_join(F.concat(F.slice(body, F.lit(1), until - 1), F.array(F.regexp_replace(word(body, until), r"\d{2}$", ""))), " "))
    dated = (born > 0) & (named != "")
    return F.struct(
        header.alias("header"),
        place.alias("place"),
        mark.alias("mark"),
        status.alias("status"),
        F.when(dated, named).otherwise(F.array_join(body, " ")).alias("named"),
        F.when(dated, F.right(word(body, until), F.lit(2))).otherwise("").alias("year"),
        F.when(dated, F.array_join(F.slice(body, until + 1, F.greatest(F.size(body) - until, F.lit(0))), " ")).otherwise("").alias("club"),
        word(words, F.greatest(at, F.lit(1))).alias("time"),
        F.coalesce(F.when(word(words, at + 1).rlike(r"^\d{1,4}$"), word(words, at + 1).try_cast("int")), F.lit(0)).alias("points"),
        (status.isNull() & (at > start) & ((start == 2) | word(words, F.lit(1)).rlike(r"^\p{Lu}"))).alias("is_result"),
    )


def read_books(books: DataFrame) -> DataFrame:
    """Per result: book, line_no, event, gender, round_type, rank (0: none), swimmer, birth_year, club, time_cs, points, status."""
    order = Window.partitionBy("book").orderBy("line_no")
    rows = lines_of(books).withColumn("_w", words_of(F.col("line"))).withColumn("_header", F.col("_w.header")).withColumn("_event_no", F.count("_header").over(order))
    # an event's description stands in its header or on a line of its own before the first result
    bare = F.col("line").rlike(DESCRIBED) & ~F.col("_w.is_result")
    rows = rows.withColumn("_described", F.when(bare, F.regexp_extract("line", DESCRIBED, 0)))
    name = F.lower(F.regexp_extract("line", ROUND, 1))
    heat = F.when(name != "", F.when(F.startswith(name, F.lit("s")), "Heats").when(F.startswith(name, F.lit("d")), "Semis").otherwise("Finals"))
    rows = rows.withColumn("_round", heat)
    event = Window.partitionBy("book", "_event_no").orderBy("line_no")
    kept = ~F.col("line").rlike(SKIPPED) & F.col("_w.header").isNull() & ~F.col("line").rlike(ROUND)
    for column in ("_header", "_described", "_round"):
        rows = rows.withColumn(column, F.last(column, ignorenulls=True).over(event))
    status = F.col("_w.status")
    rows = rows.filter(kept & (status.isNotNull() | F.col("_w.is_result")))
    # a line without a place shares the one before it, and must have a birth year to be a result
    rows = rows.withColumn("_own", F.when(status.isNotNull() | F.col("_w.mark").isNotNull(), F.lit(0)).otherwise(F.col("_w.place")))
    rows = rows.filter(F.col("_own").isNotNull() | (F.col("_w.year") != ""))
    last = F.last(F.when(F.col("_own") > 0, F.col("_own")), ignorenulls=True).over(event)
    stroke, metres = events.stroke(F.regexp_replace("_described", r"(?i)^(\d+\s*x\s*)?\d+\s*m\s+", "")), events.distance(F.col("_described"))
    return rows.select(
        "book",
        "line_no",
        events.event_name(metres, stroke, events.is_relay(F.col("_described"))).alias("event"),
        F.when(F.col("_header") == "mixte", "X").otherwise(events.gender(F.col("_header"))).alias("gender"),
        F.coalesce("_round", F.lit("")).alias("round_type"),
        F.coalesce("_own", last, F.lit(0)).alias("rank"),
        swimmer_name(F.col("_w.named")).alias("swimmer"),
        birth_year(F.col("_w.year")).alias("birth_year"),
        F.col("_w.club").alias("club"),
        F.when(status.isNotNull(), F.lit(0)).otherwise(parse_time(F.col("_w.time"))).alias("time_cs"),
        F.when(status.isNotNull(), F.lit(0)).otherwise(F.col("_w.points")).alias("points"),
        F.coalesce(status, F.when(F.col("_w.mark") == "HC", "HC"), F.lit("OK")).alias("status"),
    )
