"""Scalar functions against tables of expected values."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolside import refdata
from poolside.functions import events, names, times, written


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "cs"), [("2:25.94", 14594), ("29.26", 2926), ("2:25,94", 14594), ("", 0), ("DSQ", 0), ("58.5", 5850), (None, 0)])
def test_parse_time(spark, text, cs):
    assert value(spark, times.parse_time(F.lit(text).cast("string"))) == cs


@pytest.mark.parametrize(("cs", "text"), [(14594, "2:25.94"), (2926, "29.26"), (6000, "1:00.00"), (905, "9.05"), (0, ""), (None, "")])
def test_format_time(spark, cs, text):
    assert value(spark, times.format_centiseconds(F.lit(cs).cast("int"))) == text


def test_points(spark):
    assert refdata.base_seconds("4x50 M Freestyle Relay", "X", "SCM") == 87.33
    assert value(spark, times.points(F.lit(87.33), F.lit(10000))) == int(1000 * (87.33 / 100) ** 3)
    assert value(spark, times.points(F.lit(None).cast("double"), F.lit(10000))) == 0
    assert value(spark, times.points(F.lit(20.0), F.lit(0))) == 0
    assert all(refdata.base_seconds(name, sex, pool) for name, _, _ in refdata.EVENTS for sex in "MFX" for pool in ("LCM", "SCM") if sex != "X" or refdata.base_seconds(name, "M", pool))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Al-Ahly", "AL AHLY", True), ("MC ALGER 2", "MC ALGER", True), ("Bahrain Team A", "bahrain", True), ("Club 2000", "Club", False), ("Alger B 2 team a", "alger", True), ("Bahrain National Team", "Bahrain", True), ("", None, True)],
)
def test_team_key(spark, a, b, same):
    key = lambda x: value(spark, names.team_key(F.lit(x).cast("string")))
    assert (key(a) == key(b)) == same


@pytest.mark.parametrize(("name", "stripped"), [("BAHIA NAUTIQUE 2", "BAHIA NAUTIQUE"), ("Club 2000", "Club 2000"), (None, "")])
def test_squad_number(spark, name, stripped):
    assert value(spark, names.strip_squad_number(F.lit(name).cast("string"))) == stripped


def test_match_keys(spark):
    assert value(spark, names.match_key(F.lit("Ben-Ali,  Élodie"))) == "BEN ALI ÉLODIE"
    assert value(spark, names.sorted_key(F.lit("Elodie BEN ali"))) == "ALI BEN ELODIE"
    assert value(spark, names.one_edit_apart(F.lit("GRENOBLE"), F.lit("GRENOBsLE")))


def test_age(spark):
    on = F.lit("2020-06-15").cast("date")
    assert value(spark, times.age_on(F.lit("2000-06-16").cast("date"), F.lit(None).cast("int"), on)) == 19
    assert value(spark, times.age_on(F.lit("2000-06-15").cast("date"), F.lit(None).cast("int"), on)) == 20
    assert value(spark, times.age_on(F.lit(None).cast("date"), F.lit(2001), on)) == 19


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (events.stroke, "NAGE LIBRE", "Freestyle"), (events.stroke, "4 NAGES", "Individual Medley"), (events.stroke, "4 na ges", "Individual Medley"), (events.stroke, "Brasse", "Breaststroke"),
        (events.stroke, "Dos", "Backstroke"), (events.stroke, "Papillon", "Butterfly"), (events.stroke, " Diving ", "Diving"),
        (events.distance, "4x200m Freestyle", 800), (events.distance, "4 × 50 NL", 200), (events.distance, "100 metres dos", 100), (events.distance, "200 libre", 200), (events.distance, "final", 0), (events.distance, "Epreuve 7 100m Brasse", 100), (events.distance, "50 papillon", 50), (events.distance, None, 0),
        (events.gender, "Women 50m", "F"), (events.gender, "Messieurs", "M"), (events.gender, "Mixed", ""),
        (events.category, "JUNIORS SENIORS", "Seniors/Juniors"), (events.category, "MINIMES", "Minimes"), (events.category, "toutes  catégories", "Toutes Catégories"), (events.category, "foo juniors", "Foo Juniors"), (events.category, None, ""),
        (events.source_rank, "1er", 1), (events.source_rank, "DSQ", None), (events.source_rank, "0", None), (events.band, "Open", ""), (events.band, "Cadets", "Cadets"),
        (events.relay_name, "4x100 M Freestyle Relay Men", "4x100 M Freestyle Relay"), (events.relay_name, "Dames 4x50 M  Medley Relay (Women)", "4x50 M Medley Relay"), (events.relay_name, "4x50 M Mixte Relay", "4x50 M Relay Mixed"), (events.relay_name, "4×100 M Medley Relay", "4x100 M Medley Relay"), (events.relay_name, "4x50 M Medley Relay Mixed", "4x50 M Medley Relay Mixed"),
    ],
)
def test_book_text(spark, function, text, expected):
    assert value(spark, function(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(("metres", "expected"), [(4100, 400), (450, 200), (800, 800), (999, 0)])
def test_relay_distance(spark, metres, expected):
    assert value(spark, events.relay_distance(F.lit(metres))) == expected


def test_event_name(spark):
    assert value(spark, events.event_name(F.lit(100), F.lit("Freestyle"), F.lit(False))) == "100 M Freestyle"
    assert value(spark, events.event_name(F.lit(400), F.lit("Individual Medley"), F.lit(True))) == "4x100 M Medley Relay"


@pytest.mark.parametrize(
    ("a", "b", "conflict"),
    [("Cadets", "Minimes", True), ("13-14", "14-15", False), ("12-13", "19+", True), ("17-18", "18+", False), ("Cadets", "Open", False), ("Juniors", "Seniors/Juniors", False), ("foo", "Cadets", False)],
)
def test_bands(spark, a, b, conflict):
    assert value(spark, events.bands_conflict(F.lit(a), F.lit(b))) == conflict


@pytest.mark.parametrize(
    ("text", "expected"),
    [("DORA BUKLU", "Dora BUKLU"), ("Malak MEQDAR", "Malak MEQDAR"), ("maha van der al shehhi", "Maha VAN DER AL SHEHHI"), ("john mcdonald", "John MCDONALD"), ("louis xiv d'alger smith", "Louis XIV D'Alger SMITH"), ("abdul", "Abdul"), ("", ""), (None, "")],
)
def test_swimmer_name(spark, text, expected):
    assert value(spark, written.swimmer_name(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(
    ("texts", "metres", "expected"),
    [
        (["50m: 00:25.77", "100m 54.00", "x", ""], 100, [(50, 2577, None), (100, 2823, 246)]), (["25.77", "54.00"], 100, [(50, 2577, None), (100, 2823, 246)]),
        (["25.77 (50m)", "1:06.56 (100m)"], 0, [(50, 2577, None), (100, 4079, 1502)]), (["25.77", "54.00", "1:20.00"], 100, [(None, 2577, None), (None, 2823, 246), (None, 2600, -223)]), ([], 100, []), (None, 100, None),
    ],
)
def test_laps(spark, texts, metres, expected):
    column = F.lit(None).cast("array<string>") if texts is None else F.array(*map(F.lit, texts)).cast("array<string>")
    got = value(spark, written.laps(written.split_times(column, F.lit(metres))))
    assert (got and [tuple(r) for r in got]) == expected


def test_relay_legs_text(spark):
    got = value(spark, written.relay_legs(F.array(F.lit("Ali TAMER SAYED 0:50.38"), F.lit(" Sami 49.10 "), F.lit("No Time"), F.lit(""))))
    assert [tuple(r) for r in got] == [("Ali TAMER SAYED", 5038), ("Sami", 4910), ("No Time", 0), ("", 0)]


def test_splits_of_a_batch():
    """A batch's splits, read at once, against the rule word by word on random texts; null lists and sliced batches."""
    time, pick = r"(?:\d{1,2}:)?\d{1,2}\.\d{2}", random.Random(11).choice

    def rule(texts, metres):
        read = []
        for t in texts:
            words = re.split(r"[ \t-\r]+", re.sub(r"(\d)[ \t-\r]+m\b", r"\1m", (t or "").replace("m:", "m "), flags=re.ASCII))
            words = [w for w in (re.sub(r"^[(:]+|[):]+$", "", w) for w in words) if w]
            swum = [w for w in words if re.fullmatch(time, w)]
            if len(swum) == 1 and len(words) <= 2 and all(re.fullmatch(time + r"|\d{2,4}m", w) for w in words):
                minutes, _, seconds = swum[0].rpartition(":")
                place = next((int(w[:-1]) for w in words if w.endswith("m")), None)
                read.append((place, int(minutes or 0) * 6000 + int(seconds.replace(".", ""))))
        return [(metres * (i + 1) // len(read) if p is None and (metres or 0) > 0 and metres % len(read) == 0 else p, cs) for i, (p, cs) in enumerate(read)]

    pieces = ("50m", "100 m", "50", "m", "25.77", "1:06.56", "(", ")", ":", " ", "  ", "\t", "x", "25.7", "8m", "é", "")
    lists = [None if pick(range(20)) == 0 else [None if pick(range(20)) == 0 else "".join(pick(pieces) for _ in range(pick(range(7)))) for _ in range(pick(range(5)))] for _ in range(4000)]
    metres = [pick((None, 0, 50, 100, 400)) for _ in lists]
    for first in (0, 7):
        got = written.batch_splits(pa.array(lists, pa.list_(pa.string()))[first:], pa.array(metres, pa.int32())[first:]).to_pylist()
        assert [x and [(s["distance"], s["time_cs"]) for s in x] for x in got] == [x and rule(x, m) for x, m in zip(lists[first:], metres[first:])]


def test_team_key_of_random_texts(spark):
    """Letters and numbers that go at once, against the removal of one suffix after the other."""

    def rule(name):
        key = re.sub(r"[ \t-\r]+", " ", re.sub(names.PUNCTUATION, " ", name, flags=re.ASCII).lower()).strip(" ")
        before = None
        while key != before:
            before = key
            for suffix in names.SUFFIXES:
                key = re.sub(suffix, "", key, flags=re.ASCII).strip(" ")
        return key

    pick = random.Random(14).choice
    pieces = ("a", "B", "e", "7", "12", "123", "team", "Team", "national", "club", "ab", "-", "(a)", "")
    texts = [" ".join(pick(pieces) for _ in range(pick(range(8)))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.team_key(F.col("t")).alias("k")).collect()
    assert [(r["t"], r["k"]) for r in got if r["k"] != rule(r["t"])] == []
