"""Names, clubs, identities and imports against the cases that they must tell apart."""

import datetime
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from poolside.functions import events, resolve, written
from poolside.operators import importing, meet_cleanup, similar
from poolside.plans import matching
from poolside.sources import books

DAY = datetime.date(2026, 6, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (resolve.relay_team, "Algeria E", "Algeria"), (resolve.relay_team, "Algeria b", "Algeria b"), (resolve.relay_team, "MC  ALGER 2", "MC ALGER"), (resolve.relay_team, "UAE-AD", "UAE"),
        (resolve.relay_team, "Oman National Team B", "Oman"), (resolve.relay_team, "Kuwait 1 A", "Kuwait"), (resolve.relay_team, "A", "A"), (resolve.relay_team, " 7 ", "7"), (resolve.relay_team, "El-Bez", "El-Bez"),
        (resolve.is_team_name, "BAHIA NAUTIQUE 2", True), (resolve.is_team_name, "4LSA", True), (resolve.is_team_name, "3:37.01", False), (resolve.is_team_name, "58.31", False), (resolve.is_team_name, "CLUB X 3.40.68", False),
        (resolve.is_team_name, "Sta1if2ia", False), (resolve.is_team_name, "Wo5s8t.a68 446", False), (resolve.is_team_name, "X", False), (resolve.is_team_name, None, False), (resolve.is_team_name, "Eu1l:m0a", False), (resolve.is_team_name, "Club 1. 2", True),
        (resolve.event_lookup, "4×100m Freestyle Relay Men", "4x100 M Freestyle Relay"), (resolve.event_lookup, "4 X 50 meters Medley Relay", "4x50 M Medley Relay"), (resolve.event_lookup, "200 m. IM", "200 M Individual Medley"),
        (resolve.event_lookup, "100 Metres  Medley women", "100 M Individual Medley"), (resolve.event_lookup, "400 Individual Medley", "400 Individual Medley"), (resolve.event_lookup, "Men", "Men"),
        (events.age_range, "12-13 ans", (12, 13)), (events.age_range, "18+", (18, 99)), (events.age_range, "13 - 14", (13, 14)), (events.age_range, "Cadets", None), (events.age_range, "16 & + 17", None),
    ],
)
def test_names(spark, function, text, expected):
    got = value(spark, function(F.lit(text).cast("string")))
    assert (tuple(got) if isinstance(expected, tuple) else got) == expected


@pytest.mark.parametrize(("text", "expected"), [("50m:25.77", (50, 2577)), ("50m : 25.77", (50, 2577)), ("25.77 (50 m)", (50, 2577)), ("25.77 26.00", None), ("lane 4", None), ("50m", None), ("1500m 15:01.20", (1500, 90120))])
def test_split_words(spark, text, expected):
    got = [tuple(r) for r in value(spark, written.split_times(F.array(F.lit(text)), F.lit(0)))]
    assert got == ([expected] if expected else [])


GULF = {"KWT": "Kuwait", "BHR": "Bahrain", "KSA": "Saudi Arabia", "UAE": "UAE", "OMA": "Oman", "LBN": "Lebanon", "PLE": "Palestine", "LBY": "Libya", "ALG": "Algeria", "SUD": "Sudan", "MTN": "Mauritania", "MAR": "Morocco", "EGY": "Egypt", "QAT": "Qatar", "SYR": "Syria", "TUN": "Tunisia"}
FOUND = {
    "LBA": "LBY", "lba": "LBY", "LIB": "LBN", "BAH": "BHR", "U.A.E.": "UAE", "E.A.U": "UAE", "u a e": "UAE", "Égypte": None, "Egypte": "EGY", "Kuwait Swimming": "KWT", "Bahrain Aquatics": "BHR", "Saudi Swimming Federation": "KSA",
    "Uae Aquatics Federation": "UAE", "Oman National Team": "OMA", "Qatar Swimming Association": "QAT", "Tunisian National Team": "TUN", "Syrian-AD": "SYR", "United Arab  Emirates": "UAE", "Kuwait Club": None, "Alexandria Swimming": None, "Swimming": None, "": None,
}


def test_countries(spark):
    known = spark.createDataFrame([(i, code, name) for i, (code, name) in enumerate(GULF.items())], "nationality_id int, code string, country string")
    names = spark.createDataFrame([(i, t) for i, t in enumerate([*FOUND, *resolve.COUNTRY_ALIASES])], "row long, text string")
    got = {r["text"]: r["code"] for r in matching.resolved_countries(names, known).join(known, "nationality_id", "left").collect()}
    assert {t: got[t] for t in FOUND} == FOUND
    assert all(got[a] == c for a, c in resolve.COUNTRY_ALIASES.items() if c in GULF)


def test_ratios():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("ABC", k=rng.randint(0, 14))) for _ in range(2))
        assert similar.ratio(a, b, "block") == SequenceMatcher(None, a, b).ratio()
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similar.common_in_order(a, b) == table[-1][-1]


@pytest.mark.parametrize(("kind", "least"), [("block", 0.85), ("order", 0.8)])
def test_similar_pairs_are_all_pairs(spark, kind, least):
    rng, texts = random.Random(3), {"", "A", "AB", "ABC"}
    for _ in range(60):
        base = "".join(rng.choices("ABCDE FG", k=rng.randint(1, 22))).strip()
        for _ in range(4):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(0, len(near))
                near[k : k + rng.randint(0, 1)] = rng.choices("ABCDEFG", k=rng.randint(0, 1))
            texts.add("".join(near))
    want = {(a, b) for a in texts for b in texts if a < b and a and similar.ratio(a, b, kind) >= least}
    got = similar.similar_pairs(spark.createDataFrame([(t,) for t in texts] * 2, "name string"), "name", least, kind).collect()
    assert len(got) == len(want) > 50
    assert {(r["left"], r["right"]) for r in got} == want


@pytest.mark.parametrize(("a", "b", "same"), [("GRENOBLE ALP'38", "GRENOBsLE ALP'38", True), ("CA", "OLYMPICA", False), ("C.A.", "ca", True), ("", "", False), ("É", "É", False), (None, "CA", False)])
def test_clubs(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert similar.clubs_equivalent(df, "a", "b", "same").first()["same"] == same


PARSED = "meet_id long, date date, row long, event_id int, round_type string, category string, name string, birth_year int, club string, sex string, is_relay boolean, time_cs long, rank int, points int"
SWIMMER = "swimmer_id long, name string, birth_year int, club string, sex string, is_relay_team boolean"
STORED = "swimmer_id long, meet_id long, event_id int, round_type string, category string, team string, time_cs long, rank int, points int, date date"


def parsed(spark, rows, relay=False, meet=1, date=DAY):
    """Rows (name, year, category, club, time) in order."""
    return spark.createDataFrame([(meet, date, i, 1, "Finals", c, n, y, club, "M", relay, t, i + 1, 500) for i, (n, y, c, club, t) in enumerate(rows)], PARSED)


def tables(spark, swimmers=(), results=()):
    return spark.createDataFrame(list(swimmers), SWIMMER), spark.createDataFrame(list(results), STORED)


def run(spark, rows, swimmers=(), results=(), **more):
    out = importing.import_results(parsed(spark, rows, **more), *tables(spark, swimmers, results))
    return [tuple(r) for r in out["swimmers"].collect()], sorted((tuple(r) for r in out["results"].collect()), key=str), {r["row"]: r for r in out["log"].collect()}


CASES = {
    "conflicting bands": ([("Youssef TRABELSI", 0, "Cadets", "", 5740), ("Youssef TRABELSI", 0, "Minimes", "", 6496)], 2, 2),
    "compatible": ([("Youssef TRABELSI", 0, "Cadets", "", 5740), ("Youssef TRABELSI", 0, "Cat. générale", "", 5740)], 1, 2),
    "broad first": ([("A B", 0, "Open", "", 5740), ("A B", 0, "Cadets", "", 5750), ("A B", 0, "Minimes", "", 5760)], 2, 3),
    "different years": ([("Lina MAHI", 2007, "15-16", "EL AMEL BLIDA", 8163), ("Lina MAHI", 2006, "15-16", "SN EL BIER", 8730)], 2, 2),
    "same year, different club": ([("Mohamed Amine DRIDI", 2010, "Minimes", "CA", 6595), ("Mohamed Amine DRIDI", 2010, "Minimes", "OLYMPICA", 7106)], 2, 2),
    "same year, club misread": ([("A B", 2010, "", "GRENOBLE ALP'38", 6595), ("A B", 2010, "", "GRENOBsLE ALP'38", 6500)], 1, 1),
    "no time, no name": ([("A B", 2010, "", "CA", 0), ("  ", 2010, "", "CA", 7000), (None, 2010, "", "CA", 7000)], 1, 0),
}


def test_identities(spark):
    """How many swimmers and results each case gives in a meet of its own, and that a second import changes nothing."""
    batch = None
    for k, (rows, _, _) in enumerate(CASES.values(), 1):
        one = parsed(spark, [(n and n.strip() and f"{n} {k}" or n, *more) for n, *more in rows], meet=k)
        batch = one if batch is None else batch.union(one)
    batch = batch.coalesce(2)
    out = importing.import_results(batch, *tables(spark))
    swimmers, results, log = ([tuple(r) for r in out[t].collect()] for t in ("swimmers", "results", "log"))
    assert len(log) == batch.count()
    for k, (case, (_, people, n)) in enumerate(CASES.items(), 1):
        assert (sum(s[1].endswith(f" {k}") for s in swimmers), sum(r[1] == k for r in results)) == (people, n), case
    out = importing.import_results(batch, *tables(spark, swimmers, results))
    assert sorted(map(str, map(tuple, out["swimmers"].collect()))) == sorted(map(str, swimmers))
    assert sorted(map(str, map(tuple, out["results"].collect()))) == sorted(map(str, results))
    assert {r["action"] for r in out["log"].collect()} <= {"same time", "slower", "no time", "no name"}


def test_known_swimmers(spark):
    """Years of 0 are unknown, a year's own profile comes before a near one, and equal ones are told by their clubs."""
    known = [(1, "Ali TAMER", 2006, "CA", "M", False), (2, "Lina MAHI", 2006, "X", "F", False), (3, "Lina MAHI", 2007, "Y", "F", False), (4, "Sam DRIDI", 2010, "CA", "M", False), (5, "Sam DRIDI", 2010, "OLYMPICA", "M", False), (6, "No YEAR", None, "", "M", False), (7, "EGYPT", None, "", "M", True)]
    rows = [("Ali TAMER", 0, "", "", 1), ("TAMER, ali", 2007, "", "", 1), ("Lina MAHI", 2007, "", "", 1), ("Lina MAHI", 2008, "", "", 1), ("Lina MAHI", 2010, "", "", 1), ("SAM DRIDI", 2010, "", "OLYMPsICA", 1), ("Sam DRIDI", 2010, "", "", 1), ("No YEAR", 1999, "", "", 1), ("EGYPT", 2008, "", "", 1), ("", 0, "", "", 1)]
    swimmers, results = tables(spark, known)
    got = {r["row"]: tuple(r)[1:] for r in importing.match_profiles(parsed(spark, rows), swimmers, results).collect()}
    assert got == {0: (1, 95, "exact"), 1: (1, 100, "exact"), 2: (3, 100, "exact"), 3: (3, 100, "exact"), 4: (None, 0, "new"), 5: (5, 100, "exact"), 6: (4, 100, "exact"), 7: (6, 95, "exact"), 8: (None, 0, "new"), 9: (None, 0, "skip")}


def test_bands_near_the_meet_rule_profiles_out(spark):
    """A conflicting band rules out within 400 days, unless a compatible swim is nearby, too."""
    days = lambda n: DAY - datetime.timedelta(days=n)
    known = [(i, f"Name {w}", 2010, "", "M", False) for i, w in enumerate(["CLOSE", "FAR", "BOTH", "EDGE"], 1)]
    swim = lambda s, c, n: (s, 90 + s, 1, "", c, "", 6000, 1, 1, days(n))
    results = [swim(1, "Cadets", 30), swim(2, "Cadets", 401), swim(3, "Cadets", 30), swim(3, "Seniors/Minimes", 300), swim(4, "Cadets", 400)]
    rows = [(n, 0, "Minimes", "", 6000) for _, n, *_ in known]
    got = {r["row"]: r["swimmer_id"] for r in importing.match_profiles(parsed(spark, rows), *tables(spark, known, results)).collect()}
    assert got == {0: None, 1: 2, 2: 3, 3: None}


def test_book_rows_find_their_swimmers(spark):
    """What the book reader reads, with 0 where a year is missing, matches known swimmers."""
    text = "Epreuve 1 Messieurs, 100m Nage Libre\n1. TAMER, Ali 06 CA 57.40 500\nh.c. RAHMOUNI, Mahdi Union 58.23 350"
    read = books.read_books(spark.createDataFrame([(1, text)], "book long, text string"))
    rows = [(r["line_no"], r["swimmer"], r["birth_year"], r["club"], "", DAY) for r in read.collect() if "TAMER" in r["swimmer"]]
    frame = lambda rows: spark.createDataFrame(rows, "row long, name string, birth_year int, club string, category string, date date")
    swimmers, results = tables(spark, [(1, "Ali TAMER", 2006, "CA", "M", False), (2, "Ali TAMER", 1990, "CA", "M", False)])
    assert [(r["swimmer_id"], r["confidence"]) for r in importing.match_profiles(frame(rows), swimmers, results).collect()] == [(1, 100)]
    no_year = importing.match_profiles(frame([(*r[:2], 0, *r[3:]) for r in rows]), swimmers, results).collect()
    assert [(r["swimmer_id"], r["confidence"]) for r in no_year] == [(1, 95)]


def test_better_times_win(spark):
    known = [(1, "Ali TAMER", 2006, "CA", "M", False)]
    stored = [(1, 1, 1, "Finals", "", "CA", 5999, 4, 400, DAY), (1, 2, 1, "Finals", "", "CA", 1, 1, 1, DAY)]
    rows = [("Ali TAMER", 2006, "", "", 6100), ("Ali TAMER", 2006, "", "NEW CLUB 2", 5850), ("Ali TAMER", 2006, "", "", 5900), ("Ali TAMER", 2006, "", "lp", 5850)]
    swimmers, results, log = run(spark, rows, known, stored)
    assert swimmers == known
    assert results == sorted([(1, 1, 1, "Finals", "", "NEW CLUB", 5850, 2, 500, DAY), stored[1]], key=str)
    assert [log[i]["action"] for i in range(4)] == ["slower", "improved", "slower", "same time"]


PLACEHOLDER = [(7, "MC ALGER", None, "MC ALGER", "M", True)]
SQUADS = {
    "two squads": ([], [("MC ALGER 1", 21000), ("MC ALGER 2", 22000)], [("MC ALGER 1", 21000), ("MC ALGER 2", 22000)], ["inserted", "inserted"]),
    "identical names": ([], [("MC ALGER", 24246), ("MC ALGER", 25133)], [("MC ALGER", 24246), ("MC ALGER", 25133)], ["inserted", "inserted"]),
    "older row adopted": ([("MC ALGER", 24246)], [("MC ALGER 1", 24246), ("MC ALGER 2", 25133)], [("MC ALGER 1", 24246), ("MC ALGER 2", 25133)], ["renamed", "inserted"]),
    "stale row": ([("MC ALGER", 24000)], [("MC ALGER", 24246), ("MC ALGER 2", 25133)], [("MC ALGER", 24246), ("MC ALGER 2", 25133)], ["updated", "inserted"]),
    "junk name": ([], [("3:37.01", 24246)], [], ["no name"]),
}


def test_squads(spark):
    stored, batch = [], None
    for k, (before, rows, _, _) in enumerate(SQUADS.values(), 1):
        stored += [(7, k, 1, "Finals", "", team, t, 1, 1, DAY) for team, t in before]
        one = parsed(spark, [(n, 0, "", "", t) for n, t in rows], relay=True, meet=k)
        batch = one if batch is None else batch.union(one)
    batch = batch.coalesce(2)
    out = importing.import_results(batch, *tables(spark, PLACEHOLDER, stored))
    results, log = [tuple(r) for r in out["results"].collect()], {(r["meet_id"], r["row"]): r["action"] for r in out["log"].collect()}
    assert [tuple(r) for r in out["swimmers"].collect()] == PLACEHOLDER
    for k, (case, (_, rows, after, actions)) in enumerate(SQUADS.items(), 1):
        assert sorted((r[5], r[6]) for r in results if r[1] == k) == sorted(after), case
        assert [log[k, i] for i in range(len(rows))] == actions, case
    again = importing.import_results(batch, *tables(spark, PLACEHOLDER, results))["results"].collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, results))


def test_new_swimmers_are_known_to_later_meets(spark):
    """Of a batch, later meets find what earlier ones made; a band two years on is no conflict."""
    first = parsed(spark, [("Nora X", 2010, "Minimes", "CA", 6000), ("Nora X", 2010, "Minimes", "OLYMPICA", 6100), ("Omar Y", 0, "Minimes", "", 6000)])
    later = parsed(spark, [("NORA X", 2010, "Minimes", "OLYMPICA", 5900), ("Omar Y", 0, "Cadets", "", 5900)], meet=2, date=DAY + datetime.timedelta(days=30))
    last = parsed(spark, [("Omar Y", 0, "Juniors", "", 5800)], meet=3, date=DAY + datetime.timedelta(days=900))
    log = {(r["meet_id"], r["row"]): r for r in importing.import_results(first.union(later).union(last), *tables(spark))["log"].collect()}
    who = {k: r["swimmer_id"] for k, r in log.items()}
    assert who[2, 0] == who[1, 1] != who[1, 0]
    assert who[2, 1] not in (who[1, 2], None) and who[3, 0] == who[1, 2]


def test_empty_batch(spark):
    swimmers, results, log = run(spark, [])
    assert (swimmers, results, log) == ([], [], {})


def test_import_reads_profiles_once(spark):
    swimmers, results = tables(spark, [(1, "Dora BUKLU", 2001, "Tunis", "F", False), (2, "Maha AL SHEHHI", None, "Oran", "F", False)])
    seen = spark.sparkContext.accumulator(0)

    def read(name):
        seen.add(1)
        return name

    rows = parsed(spark, [("DORA BUKLU", 2001, "Tunis", "", 6000), ("maha al shehhi", 0, "Oran", "", 6100)])
    out = importing.import_results(rows, swimmers.withColumn("name", F.udf(read, "string")("name")), results)
    # three keys of a name, whatever is asked for by year, club or band
    assert 0 < seen.value <= 3 * swimmers.count()
    assert sorted(r["match"] for r in out["log"].collect()) == ["exact", "exact"]


def test_cleaned_meet_deals_rows_once(spark):
    """Steps are told by windows within an event: rows are read and shuffled once. Null keys are equal to nothing."""
    rows = [
        (1, 1, "M", "Prelims", "Cadets", "Ali", 5000, "OK"), (1, 1, "M", "Prelims", "Cadets", "ALI", 5000, "OK"), (1, 1, "M", "Prelims", "", "ali", 5000, "OK"), (1, 1, "M", "Prelims", "", "Sami", 5100, "OK"),
        (1, 1, "M", "Finals", "Cadets", "Ali", 5000, "OK"), (1, 2, "M", "Prelims", "", None, 5000, "OK"), (1, 2, "M", "Prelims", "Cadets", None, 5000, "OK"), (2, 2, None, "Prelims", "", "Ali", 5000, "OK"), (2, 2, "M", "Prelims", None, "Ali", 5000, "OK"),
    ]
    meets = spark.createDataFrame([(*r, i, 1) for i, r in enumerate(rows)], "meet_id int, event_id int, sex string, round_type string, category string, name string, time_cs long, status string, row int, rank int")
    cleaned = meet_cleanup.cleaned_meet(meets)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Scan ExistingRDD") == 1
    got = sorted((r["row"], r["round_type"]) for r in cleaned.collect())
    assert got == [(3, "Prelims"), (4, "Finals"), (5, "Finals"), (6, "Finals"), (7, "Finals")]
    told = [tuple(r) for r in meet_cleanup.heat_overlap(meets.filter("row < 6")).orderBy("category").collect()]
    assert told == [(1, 1, "M", "Prelims", "", 2, 0, False), (1, 1, "M", "Prelims", "Cadets", 2, 1, False)]
