"""Workbooks: cells in all their shapes, sheets told apart, columns by their headers; meets' clean-up, splits and warnings."""

import datetime
import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from poolside.functions import headings
from poolside.functions.dates import meet_days, meet_place
from poolside.operators import meet_cleanup, meet_warnings
from poolside.plans.sheets import nationality_changes
from poolside.sources import sheets
from poolside.sources.tables import held


def cells(spark, *tables, book=1):
    """Sheets (name, rows of values): texts as they are, numbers and timedeltas by their kind."""
    rows = []
    for number, (name, table) in enumerate(tables):
        for r, values in enumerate(table):
            for c, v in enumerate(values):
                kind = "duration" if isinstance(v, datetime.timedelta) else "number" if isinstance(v, (int, float)) else "text"
                text = None if v is None else str(v.total_seconds()) if kind == "duration" else str(v)
                rows.append((book, number, name, r, c, text, kind))
    return spark.createDataFrame(rows, "book long, sheet_no int, sheet string, row int, col int, cell string, kind string")


TIMES = [
    ("7:57.54", "7:57.54"), ("1:02,45", "1:02.45"), (datetime.time(7, 57, 54), "7:57.54"), (datetime.time(0, 25, 43), "25.43"), (datetime.time(0, 2, 5, 300000), "2:05.30"), (datetime.timedelta(minutes=2, seconds=5.3), "2:05.30"),
    (125.3, "2:05.30"), (57.54, "57.54"), (0.001, "1:26.40"), *((s, "") for s in ("DQ", "dsq", "DNS", "NT", "N.C", "H.C", "-", "/", "nan", "", None)),
]


def test_cells(spark):
    got = cells(spark, ("x", [[v] for v, _ in TIMES])).orderBy("row").select(sheets.cell_time(F.struct("cell", "kind")).alias("v")).collect()
    assert [r["v"] for r in got] == [t for _, t in TIMES]
    numbers = [("1er", 1), ("2nd", 2), (" 3 ", 3), (2.0, 2), ("DSQ", None), (None, None)]
    got = cells(spark, ("x", [[v] for v, _ in numbers])).orderBy("row").select(sheets.cell_int(F.struct("cell", "kind")).alias("v")).collect()
    assert [r["v"] for r in got] == [n for _, n in numbers]
    told = [*((v, "M") for v in ("M", "Male", "Men", "Men's", "Homme", "Boys", "garcons")), *((v, "F") for v in ("F", "Female", "Women", "Women's", "Filles", "Dames")), ("Mixed", "X"), ("??", "")]
    got = cells(spark, ("x", [[v] for v, _ in told])).orderBy("row").select(sheets.cell_gender(F.struct("cell", "kind")).alias("v")).collect()
    assert [r["v"] for r in got] == [g for _, g in told]


def test_workbook(spark):
    """Every sheet is read, categories and relays are kept apart, titles above a header don't matter, notes do nothing."""
    individual = [["Official results"], [None], ["Events", "Category", "Round", "Swimmer Name", "Time", "Rank", "YoB", "Nationality", "Gender", "Pool", "Championships Name", "Meet City", "Date"]]
    rest = ["LCM", "Test Cup", "Cairo", "12/05/2026"]
    individual += [
        ["50 M Freestyle", "Junior", "Final", "Omar KAMAL", datetime.time(0, 25, 43), "1er", 2008, "EGY", "Male", *rest], ["50 M Freestyle", "Junior", "Final", "Ali HASSAN", "26.10", 2, 2008.0, "egy", "M", *rest],
        ["50 M Freestyle", "Senior", "Final", "Sami NOUR", 26.55, 1, "2001", "EGY", "Men's", *rest[:1], "Test Cup ", "Cairo", "14/05/2026"], ["50 M Freestyle", "Senior", "Final", "Zed DQED", "DQ", "DSQ", 2000, "EGY", "M", *rest],
    ]
    extra = [["Events", "Category", "Round", "Swimmer Name", "Time", "Gender"], ["100 M Backstroke", "Junior", "Séries", "Nada FAWZY", "1:05.20", "Female"], ["4x50 M Medley Relay", "Mixed", "", "Cairo Club", "2:05.20", "Female"], [None, "Junior", "Final", "No EVENT", "1:00.00", "M"]]
    legs = lambda who, time, splits, c: [["4x100 M Freestyle Relay", "Men's", c, "Final", time, f"{who} Club", f"Swimmer {i} {who.upper()}", s, "Male"] for i, s in enumerate(splits, 1)]
    relay = [["Events", "Relay", "Category", "Round", "Team Time", "Team Name", "Swimmer Name", "Split Time", "Gender"], *legs("Cairo", "3:30.00", [datetime.time(0, 52, 30), "52.50", "52.60", None], "Junior"), *legs("Alex", "3:25.00", ["51.10", "51.20", "51.30", "51.40"], "Senior")]
    book = cells(spark, ("Individual", individual), ("More Results", extra), ("Relay", relay), ("Notes", [["Time of the last bus"], ["late"]]))
    got = {r["name"]: r.asDict() for r in sheets.read_sheets(book).collect()}
    assert got.keys() == {"Omar KAMAL", "Ali HASSAN", "Sami NOUR", "Nada FAWZY", "Cairo Club", "Alex Club"} and len(sheets.read_sheets(book).collect()) == 7
    omar, sami, nada = got["Omar KAMAL"], got["Sami NOUR"], got["Nada FAWZY"]
    assert (omar["time_text"], omar["time_cs"], omar["rank"], omar["birth_year"], omar["category"], omar["gender"], omar["round_type"]) == ("25.43", 2543, 1, 2008, "Junior", "M", "Finals")
    assert (sami["time_text"], sami["birth_year"], sami["category"], sami["nationality"], got["Ali HASSAN"]["nationality"]) == ("26.55", 2001, "Senior", "EGY", "EGY")
    assert (nada["gender"], nada["round_type"], nada["stroke"], nada["distance"]) == ("F", "Prelims", "Backstroke", 100)
    teams = {(r["name"], r["category"]): r for r in sheets.read_sheets(book).filter("is_relay").collect()}
    assert teams["Cairo Club", "Junior"]["legs"] == ["Swimmer 1 CAIRO 52.30", "Swimmer 2 CAIRO 52.50", "Swimmer 3 CAIRO 52.60", "Swimmer 4 CAIRO"]
    assert teams["Cairo Club", "Junior"]["time_cs"] == 21000 and len(teams["Alex Club", "Senior"]["legs"]) == 4
    assert (teams["Cairo Club", "Mixed"]["gender"], teams["Cairo Club", "Mixed"]["club"]) == ("X", "Cairo Club")
    meets = [r for r in sheets.book_meets(book).collect() if r["meet"]]
    assert [(r["meet"], r["city"], r["pool"], str(r["first_date"]), str(r["last_date"])) for r in meets] == [("Test Cup", "Cairo", "LCM", "2026-05-12", "2026-05-14")]
    assert sheets.read_sheets(book.limit(0)).collect() == []


def test_held_tables_are_small(spark):
    """What is held is stored by columns, so texts that rows repeat take no space; it reads back as it was."""
    df = spark.range(20000).selectExpr("id", "'the same words in each row' AS text", "array(named_struct('col', 1, 'cell', 'x')) AS cells")
    kept = held(df)
    files = kept.inputFiles()
    assert files and sum(os.path.getsize(urlparse(f).path) for f in files) < 20000 * 15
    assert kept.schema.fieldNames() == df.columns and kept.exceptAll(df).isEmpty() and kept.count() == 20000


READ = "meet_id long, row long, event_id int, sex string, round_type string, category string, name string, time_cs long, rank int, status string"


def read(spark, rows):
    return spark.createDataFrame([(1, i, e, "M", r, c, n, t, 1, "OK") for i, (e, r, c, n, t) in enumerate(rows)], READ)


def test_clean_up(spark):
    """Finalists with other times keep their heats; the same list twice goes; lone heats become finals; general lists that repeat go."""
    heats = [(1, "Heats", "", f"S{i}", 5000 + i) for i in range(24)] + [(1, "Finals", "", f"S{i}", 4900 + i) for i in range(8)]
    (r,) = meet_cleanup.heat_overlap(read(spark, heats)).collect()
    assert (r["heats"], r["shared"], r["repeated"]) == (24, 0, False)
    twice = [(2, r, "", f"S{i}", 5000 + i) for r in ("Prelims", "Finals") for i in range(10)] + [(2, "Prelims", "", "late", 6000)]
    lone = [(3, "Prelims", "Cadets", "A", 5000), (3, "Prelims", "Cadets", "a", 5000), (3, "Prelims", "", "A", 5000), (3, "Prelims", "", "B", 5100), (4, "", "", "A", 1), (4, "Semis", "", "A", 2)]
    got = sorted(tuple(r)[2:8] for r in meet_cleanup.cleaned_meet(read(spark, heats + twice + lone)).collect())
    assert len([r for r in got if r[0] == 1]) == 32
    assert [r for r in got if r[0] == 2] == [(2, "M", "Finals", "", f"S{i}", 5000 + i) for i in range(10)]
    assert [r for r in got if r[0] > 2] == [(3, "M", "Finals", "", "B", 5100), (3, "M", "Finals", "Cadets", "A", 5000), (4, "M", "Finals", "", "A", 1), (4, "M", "Semis", "", "A", 2)]


def test_split_profiles(spark):
    """Conflicting bands at one meet are two swimmers; a band later on is none; bands that go together stay together."""
    day = datetime.date(2020, 1, 1)
    after = lambda n: day + datetime.timedelta(days=n)
    rows = [(1, 1, "Cadets", day), (1, 1, "Minimes", day), (1, 2, "Minimes", after(100)), (1, 3, "Minimes", after(500)), (2, 1, "Minimes", day), (2, 9, "Cadets", after(730)), (3, 1, "Juniors", day), (3, 1, "Seniors/Juniors", day), (3, 1, "Open", day), (4, 1, "13-14", day), (4, 1, "15-16", day), (4, 1, "14-15", day)]
    df = spark.createDataFrame(rows, "swimmer_id long, meet_id long, category string, date date")
    got = {(r["swimmer_id"], r["band"]): (r["part"], r["moves"]) for r in meet_cleanup.split_swimmers(df).collect()}
    assert got == {(1, "Cadets"): (0, True), (1, "Minimes"): (1, False), (4, "13-14"): (0, False), (4, "14-15"): (0, False), (4, "15-16"): (1, True)}
    moved = {(r["swimmer_id"], r["meet_id"], r["category"]): r["profile"] for r in meet_cleanup.moved_results(df).collect()}
    assert len(moved) == len(rows) and {k for k, p in moved.items() if p is not None} == {(1, 1, "Cadets"), (4, 1, "15-16")}


def test_duplicate_meets(spark):
    day = datetime.date(2026, 5, 1)
    stored = spark.createDataFrame([(1, "Arab Swimming Championship 2026", day, "LCM", ["a", "b"]), (2, "Winter Cup", day, "SCM", ["a"])], "meet_id long, name string, date date, pool string, events array<string>")
    files = [(1, "arab  swimming championship, 2026", day, "LCM", ["a"]), (2, "2026 Championships Arab Swimming", day, "", ["a", "c"]), (3, "Arab Swimming Championship 2026", day, "SCM", ["a"]), (4, "Arab Swimming Championship 2025", None, "LCM", ["a"]), (5, "Spring Open", day, "LCM", ["a"]), (6, "", day, "LCM", None)]
    got = meet_warnings.meet_warnings(spark.createDataFrame(files, "file_id long, name string, date date, pool string, events array<string>"), stored).collect()
    assert {(r["file_id"], r["meet_id"], r["kind"], r["new_events"]) for r in got} == {(1, 1, "exact_duplicate", 0), (2, 1, "partial_new", 1), (3, 1, "different_pool", 0), (4, 1, "similar_name", 0)}


def test_nationality_changes(spark):
    day = lambda n: datetime.date(2020, 1, n)
    known = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "swimmer_id long, nationality_id int")
    results = spark.createDataFrame([(1, day(5)), (2, day(20))], "swimmer_id long, date date")
    log = spark.createDataFrame([(3, day(10))], "swimmer_id long, effective date")
    told = spark.createDataFrame([(1, day(4), 8), (1, day(5), 8), (1, day(9), None), (1, day(12), 9), (1, day(13), 9), (2, day(12), 8), (3, day(9), 8), (3, day(11), 7)], "swimmer_id long, date date, nationality_id int")
    got = sorted(tuple(r) for r in nationality_changes(known, results, told, log).collect())
    assert got == [(1, 7, 8, day(5), day(12)), (1, 8, 9, day(12), None)]


DAYS = [
    ("EL BEZ SETIF, 19 - 22/1/2022", "2022-01-19", "2022-01-22"), ("Hamilton Aquatics Short Course - 21/10/2023 to 22/10/2023", "2023-10-21", "2023-10-22"), ("4EME CHAMPIONNATS ARABE - 28/08/2025 to 01/09/2025 CHAMP ARABE: 25.24 * 25/08/2024 ZYAD", "2025-08-28", "2025-09-01"),
    ("2nd Open Winter Championship 2025 - 09/05/2025 to 12/05/2025", "2025-05-09", "2025-05-12"), ("Arab Championships - 28-31 August 2025 - Rabat", "2025-08-28", "2025-08-31"), ("Championnat - 10 mai 2026 - Marrakech", "2026-05-10", ""), ("COUPE DU TRONE - 10/05/2026 - MARRAKECH", "2026-05-10", ""),
    ("20/21-04-2024 Tunis", "2024-04-20", "2024-04-21"), ("Cup 2024, 3 Sept. and 5 sep", "2024-09-03", ""), ("45/13/2024 then 1.2.2024", "2024-02-01", ""), ("no day", "", ""), ("", "", ""), (None, "", ""),
]


def test_days_of_headings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(DAYS)], "i int, t string")
    got = {r["i"]: (r["d"]["start"], r["d"]["end"]) for r in df.select("i", meet_days(F.col("t")).alias("d")).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(DAYS)}


@pytest.mark.parametrize(("text", "place"), [("EL BEZ SETIF, 19 - 22/1/2022", "EL BEZ SETIF"), ("COUPE DU TRONE - 10/05/2026 - MARRAKECH", "COUPE DU TRONE - MARRAKECH"), ("Arab Championships - 28-31 August 2025 - Rabat", "Arab Championships - Rabat"), ("Results 25 M Tunis, 3 mars 2020", "Tunis"), (None, "")])
def test_places_of_headings(spark, text, place):
    assert spark.range(1).select(meet_place(F.lit(text).cast("string")).alias("v")).first()["v"] == place


def test_pools_and_countries(spark):
    pools = [("Petit bassin", "", "SCM"), ("long course", "x-scm.pdf", "SCM"), ("Event 1 Girls 100 SC Metre Free", None, "SCM"), ("Championnat du Liban 25 M", "", "SCM"), ("50m Libre 25 m", "", "LCM"), ("حوض صغير", "", "SCM"), ("", "", "LCM"), (None, None, "LCM")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pools)], "i int, t string, f string, p string")
    assert [r["i"] for r in df.filter(headings.pool(F.col("t"), F.col("f")) != F.col("p")).collect()] == []
    places = [("Coupe du Trone", None, "MAR"), ("Open", "Doha, Jordan", "JOR"), ("Roman Cup", "", "OMA"), ("Open", "Paris", None), (None, None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, n string, l string, c string")
    assert [r["i"] for r in df.filter(~headings.meet_country(F.col("n"), F.col("l")).eqNullSafe(F.col("c"))).collect()] == []
    times = [(1499, 50, False, False), (1500, 50, True, True), (21999, 400, False, True), (2000, 1500, False, False), (0, 100, True, True), (2000, 0, True, True), (18001, 50, True, False)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(times)], "i int, t long, d int, p boolean, b boolean")
    assert [r["i"] for r in df.filter((headings.plausible(F.col("t"), F.col("d")) != F.col("p")) | (headings.in_bounds(F.col("t"), F.col("d")) != F.col("b"))).collect()] == []


def test_notes_are_written_from_held_rows(spark, monkeypatch):
    """Which books there are comes from the rows that are held, so swims are computed once for the sheet of individual results and the notes."""
    from types import SimpleNamespace

    from poolside.plans import sheets as plan

    swims = spark.createDataFrame(
        [(b, "50 M Freestyle", "F", "Finals", "Open", f"Customer#{k}", 1990, 3000 + k, k, relay, "2000-01-01", "LCM") for b, k, relay in ((1, 1, False), (1, 2, False), (2, 3, False), (3, 37, True), (None, 4, False))],
        "meet_id int, event string, sex string, round_type string, category string, swimmer string, birth_year int, time_cs long, swimmer_id long, is_relay_team boolean, date string, pool string",
    )
    plans, held = [], plan.held
    monkeypatch.setattr(plan, "held", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), held(df))[1])
    rows = plan.workbooks(SimpleNamespace(swims=swims.withColumn("date", F.to_date("date"))), 0, 2).collect()
    assert ["LogicalRDD" in p for p in plans] == [True, False]
    assert sorted((str(r["book"]), r["sheet"]) for r in rows if r["row"] == 0 and r["sheet"] == "Notes") == [("1", "Notes"), ("2", "Notes"), ("None", "Notes")]
    assert len([r for r in rows if r["sheet"] == "Individual"]) == 6 + 2 + 2
