"""Whose results are these: swimmers, countries, teams and events behind names as sources write them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.functions import bound, resolve
from poolside.functions.names import team_key
from poolside.functions.times import format_centiseconds
from poolside.operators.importing import match_profiles
from poolside.plans.rankings import TIME
from poolside.sources.tables import held
from poolside.sources.tpch import Meets, sql_text


CLUBS = ("North", "South", "East", "West")


def matched(m: Meets) -> DataFrame:
    """Swimmers under names that ten share, against rows of the same people as sources may write them."""
    people = m.swimmers.filter("not is_relay_team")
    name, i = F.regexp_replace("swimmer", r"\d$", ""), F.col("swimmer_id")
    club = F.element_at(F.array(*map(F.lit, CLUBS)), (i % 4 + 1).cast("int"))
    known = people.select("swimmer_id", name.alias("name"), "birth_year", club.alias("club"))
    written = F.when(i % 3 == 0, F.upper(name)).when(i % 3 == 1, F.replace(name, F.lit("#"), F.lit(" - "))).otherwise(F.concat(F.substring_index(name, "#", -1), F.lit(" "), F.lower(F.substring_index(name, "#", 1))))
    year = F.when(i % 5 != 0, F.col("birth_year") + F.element_at(F.array(*map(F.lit, (1, 0, -1, 5))), F.greatest(i % 5, F.lit(1)).cast("int")))
    rows = people.select(i.alias("row"), written.alias("name"), year.alias("birth_year"), F.upper(club).alias("club"), F.lit("").alias("category"), F.lit(None).cast("date").alias("date"))
    return match_profiles(rows, known.withColumn("is_relay_team", F.lit(False)), m.swims)


def country_names(countries: DataFrame, aliases: dict[str, str] = resolve.COUNTRY_ALIASES) -> DataFrame:
    """candidate, nationality_id: codes, names and aliases of countries; an alias wins over a name, and a name over a code."""
    of_code = F.upper("code")
    rows = countries.select(F.explode(F.array(F.struct(F.lit(2).alias("order"), of_code.alias("candidate")), F.struct(F.lit(1).alias("order"), F.upper("country").alias("candidate")))).alias("x"), "nationality_id").select("x.*", "nationality_id")
    alias = F.create_map(*(F.lit(x) for code in sorted(set(aliases.values())) for x in (code, [a for a, c in aliases.items() if c == code])))
    more = countries.select(F.lit(0).alias("order"), F.explode(F.try_element_at(alias, of_code)).alias("candidate"), "nationality_id")
    return rows.union(more).groupBy("candidate").agg(F.min(F.struct("order", "nationality_id")).alias("x")).select("candidate", "x.nationality_id")


def resolved_countries(names: DataFrame, countries: DataFrame, aliases: dict[str, str] = resolve.COUNTRY_ALIASES) -> DataFrame:
    """``names`` (row, text) with nationality_id, of the first candidate that is a country's name, code or alias."""
    known = country_names(countries, aliases)
    each = names.select("row", F.posexplode(resolve.country_candidates(F.col("text"))).alias("place", "candidate"))
    first = each.join(known, "candidate").groupBy("row").agg(F.min_by("nationality_id", "place").alias("nationality_id"))
    return names.join(first, "row", "left")


#: How sources write a country, and whether it is found.
WRITTEN = [("{0}", True), (" {0} ", True), ("{0} National Team", True), ("{0}-AD", True), ("{0}n National Team", True), ("{0} Swimming Federation", True), ("{0} Aquatics", True), ("{0} Club", False), ("Club of {0}", False)]
#: How sources write a national team, and whether it is one.
TEAMS = [("{0}", True), ("{0} Team A", True), ("{1} {0}", True), ("{0} National Team", True), ("{0} {1} B", True), ("{0} Stars", False)]
#: How sources write a relay squad of a country.
SQUADS = ["{0}", "{0} A", "{0} 2", "{0} National Team", "{0}-AD", "{0} National Team B"]
#: Names that aren't a team's, made of one that is.
JUNK = [("{0}", True), ("{0} 3:40.68", False), ("{0}1a", False), ("{0} 2", True), ("12 34 {0} 56", False), ("{0}: x", False)]


def spelled(m: Meets) -> DataFrame:
    """The countries, whose names end in numbers here, with letters in their place; codes are the last two and a Q, so each has its own."""
    named = m.countries.withColumn("country", F.upper(F.translate("country", "_0123456789", "xbcdfghjklm")))
    return named.withColumn("own_code", F.concat(F.lit("Q"), F.right("country", F.lit(2))))


def written(m: Meets, forms: list[str]) -> DataFrame:
    """row, form, text: countries as sources write them."""
    low = F.initcap("country")
    texts = F.array(*(F.format_string(f.replace("{0}", "%1$s").replace("{1}", "%2$s"), low, F.col("code")) for f in forms))
    return spelled(m).select("nationality_id", "country", F.posexplode(texts).alias("form", "text")).withColumn("row", F.col("nationality_id") * 100 + F.col("form"))


def countries_found(m: Meets) -> DataFrame:
    rows = written(m, [f for f, _ in WRITTEN]).select("row", "text")
    return resolved_countries(rows, spelled(m)).select("row", "nationality_id")


#: How sources write a country's code, and whether it is found: as it is, with points and spaces, under an older code, of a federation.
CODES = [("{1}", True), (" {1} ", True), ("{1}.", True), ("{1} Swimming Federation", True), ("{1} National Team", True), ("{1}-AD", True), ("{1} Club", False), ("old {1}", True), ("X{1}", False)]


def countries_by_code(m: Meets) -> DataFrame:
    """Codes as sources write them: also in small letters, with points between letters, and by an alias of each."""
    known = spelled(m).drop("code").withColumnRenamed("own_code", "code")
    texts = [F.lower(F.format_string(f.replace("{1}", "%1$s"), "code")) for f, _ in CODES] + [F.concat_ws(".", *(F.substring("code", k, 1) for k in (1, 2, 3)))]
    rows = known.select("nationality_id", F.posexplode(F.array(*texts)).alias("form", "text")).select((F.col("nationality_id") * 100 + F.col("form")).alias("row"), "text")
    # an alias for each country, as sources use older codes
    names = known.select(F.concat(F.lit("OLD "), F.upper("code")).alias("country"), "code", "nationality_id")
    return resolved_countries(rows, known.select("country", "code", "nationality_id").union(names.select("country", "code", "nationality_id"))).select("row", "nationality_id")


def national_teams(m: Meets) -> DataFrame:
    """The country whose national team a name is."""
    rows = written(m, [f for f, _ in TEAMS]).select("row", team_key(F.col("text")).alias("key"))
    own, code = team_key(F.col("country")), F.lower("code")
    known = spelled(m).select("nationality_id", F.explode(F.array(own, code, F.concat_ws(" ", code, own), F.concat_ws(" ", own, code))).alias("key"))
    return rows.join(known, "key", "left").groupBy("row").agg(F.min("nationality_id").alias("nationality_id"))


def relay_teams(m: Meets) -> DataFrame:
    return written(m, SQUADS).select("row", F.upper(resolve.relay_team(F.col("text"))).alias("team"))


def valid_teams(m: Meets) -> DataFrame:
    return written(m, [f for f, _ in JUNK]).select("row", resolve.is_team_name(F.col("text")).alias("valid"))


#: How sources write an event: what is replaced by what, what is added.
EVENT_FORMS = [("", "", ""), (" M ", "m ", ""), (" M ", " Meters ", " Women"), ("x", " × ", ""), ("Individual Medley", "IM", " men"), (" M ", " m. ", " Mixed"), (" ", "  ", "")]


def event_names(m: Meets) -> DataFrame:
    """Every swim's event as sources may write it, brought to the name that base times have; which form, by the swimmer."""
    form, text = F.col("swimmer_id") % len(EVENT_FORMS), F.col("event")
    for k, (old, new, end) in enumerate(EVENT_FORMS):
        text = F.when(form == k, F.concat(F.replace("event", F.lit(old), F.lit(new)) if old else F.col("event"), F.lit(end))).otherwise(text)
    rows = m.swims.select("event", "swimmer_id", text.alias("text")).groupBy("text").agg(F.count("*").alias("swims"))
    return rows.select(resolve.event_lookup(F.col("text")).alias("event"), resolve.is_mixed(F.col("text")).alias("mixed"), "swims").groupBy("event", "mixed").agg(F.sum("swims").alias("swims"))


def read_back(m: Meets) -> DataFrame:
    """Times, dates and texts as sources write them, read again."""
    rows = held(m.swims.select("time_cs", "date", "team").distinct())
    # the same times and days come back in many rows, so each is written and read once
    time, day = format_centiseconds(F.col("time_cs")), F.when(F.month("date") % 2 == 0, F.date_format("date", "d.M.yyyy")).otherwise(F.date_format("date", "yyyy/MM/dd"))
    times = bound(rows.select("time_cs").distinct(), F.col("time_cs").alias("cs"), time.alias("time"))
    times = times.select("cs", "time", resolve.strict_centiseconds(F.col("time")).alias("read_cs"), resolve.strict_centiseconds(F.substring("time", F.lit(1), F.length("time") - 1)).alias("short_cs"))
    days = bound(rows.select("date").distinct(), F.col("date").alias("on"), day.alias("day")).select("on", resolve.iso_date(F.col("day")).alias("read_date"))
    full = rows.join(times, F.col("time_cs").eqNullSafe(F.col("cs"))).join(days, F.col("date").eqNullSafe(F.col("on")))
    untidy = F.concat(F.lit("  "), F.replace("team", F.lit("#"), F.lit("  # ")), F.lit("\t"))
    return full.select("time_cs", "date", "read_cs", "short_cs", "read_date", resolve.clean_text(untidy).alias("text"), F.size(resolve.parts_of(F.concat_ws(",", "team", F.lit(" "), "time"))).cast("long").alias("parts"))


QUERIES = {
    "cl01_matched_swimmers": matched,
    "sc31_countries_found": countries_found,
    "sc31_countries_by_code": countries_by_code,
    "st09_national_teams": national_teams,
    "st07_relay_teams": relay_teams,
    "st08_valid_teams": valid_teams,
    "sc02_event_names": event_names,
    "sc05_read_back": read_back,
}


def flags(forms: list[tuple[str, bool]]) -> str:
    return ", ".join(f"({k}, {sql_text(ok)})" for k, (_, ok) in enumerate(forms))


MATCH_KEY = r"trim(regexp_replace(regexp_replace(upper(name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
CLUB_CASE = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CLUBS))
SHIFTED = "CASE {0} % 5 WHEN 1 THEN birth_year + 1 WHEN 2 THEN birth_year WHEN 3 THEN birth_year - 1 WHEN 4 THEN birth_year + 5 END"
SQL = {
    "cl01_matched_swimmers": f""", people AS (SELECT swimmer_id, regexp_replace(swimmer, '\\d$', '') AS name, birth_year, CASE swimmer_id % 4 {CLUB_CASE} END AS club FROM swimmers WHERE NOT is_relay_team),
rows_in AS (SELECT swimmer_id AS row, CASE swimmer_id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, '#', ' - ') ELSE split_part(name, '#', 2) || ' ' || lower(split_part(name, '#', 1)) END AS name, {SHIFTED.format("swimmer_id")} AS birth_year, club FROM people),
known AS (SELECT *, lower(name) AS k0, {MATCH_KEY} AS k1, list_sort(string_split({MATCH_KEY}, ' ')) AS k2 FROM people), asked AS (SELECT *, lower(name) AS k0, {MATCH_KEY} AS k1, list_sort(string_split({MATCH_KEY}, ' ')) AS k2 FROM rows_in),
pairs AS (SELECT row, a.birth_year AS y, k.birth_year AS z, k.club = a.club AS same, k.swimmer_id, CASE WHEN a.k0 = k.k0 THEN 0 WHEN a.k1 = k.k1 THEN 1 ELSE 2 END AS tier FROM asked a JOIN known k ON a.k2 = k.k2),
best AS (SELECT * FROM pairs QUALIFY tier = min(tier) OVER (PARTITION BY row)),
ranked AS (SELECT *, CASE WHEN y IS NULL THEN 95 WHEN z = y THEN 100 WHEN abs(z - y) <= 1 THEN 100 WHEN z IS NULL THEN 95 ELSE 0 END AS score,
row_number() OVER (PARTITION BY row ORDER BY CASE WHEN y IS NULL THEN 0 WHEN z = y AND same THEN 0 WHEN z = y THEN 1 WHEN z IS NULL OR abs(z - y) <= 1 THEN 2 ELSE 3 END, swimmer_id) AS k FROM best)
SELECT r.row, CASE WHEN score > 0 THEN swimmer_id END AS swimmer_id, coalesce(score, 0) AS confidence, CASE WHEN score > 0 THEN 'exact' ELSE 'new' END AS "match" FROM rows_in r LEFT JOIN ranked x ON x.row = r.row AND k = 1""",
    "sc31_countries_found": f"SELECT nationality_id * 100 + form AS row, CASE WHEN ok THEN nationality_id END AS nationality_id FROM countries, (VALUES {flags(WRITTEN)}) AS f(form, ok)",
    "sc31_countries_by_code": f"SELECT nationality_id * 100 + form AS row, CASE WHEN ok THEN nationality_id END AS nationality_id FROM countries, (VALUES {flags([*CODES, ('', True)])}) AS f(form, ok)",
    "st09_national_teams": f"SELECT nationality_id * 100 + form AS row, CASE WHEN ok THEN nationality_id END AS nationality_id FROM countries, (VALUES {flags(TEAMS)}) AS f(form, ok)",
    "st07_relay_teams": f"SELECT nationality_id * 100 + form AS row, upper(translate(country, '_0123456789', 'xbcdfghjklm')) AS team FROM countries, range(0, {len(SQUADS)}) AS f(form)",
    "st08_valid_teams": f"SELECT nationality_id * 100 + form AS row, ok AS valid FROM countries, (VALUES {flags(JUNK)}) AS f(form, ok)",
    "sc02_event_names": f"SELECT event, swimmer_id % {len(EVENT_FORMS)} = 5 AS mixed, count(*) AS swims FROM swims GROUP BY ALL",
    "sc05_read_back": f"SELECT time_cs, date, time_cs AS read_cs, NULL::BIGINT AS short_cs, date AS read_date, replace(team, '#', ' # ') AS text, 2 AS parts FROM (SELECT DISTINCT time_cs, date, team, {TIME.format('time_cs')} AS t FROM swims)",
}
