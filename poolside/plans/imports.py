"""Imports of results: who is who within a meet, tables after a batch, clean-up of a read meet, split profiles, duplicate meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolside.operators.importing import RESULT, identities, import_results, near_bands
from poolside.operators.meet_cleanup import EVENT, cleaned_meet, heat_overlap, split_swimmers
from poolside.operators.meet_warnings import meet_warnings
from poolside.plans.matching import CLUB_CASE, CLUBS
from poolside.sources.tables import held
from poolside.sources.tpch import CATEGORIES, Meets

CATEGORY_NO = {c: k for k, c in enumerate(["", *sorted(CATEGORIES.values())])}
ROUND_NO = {"": 0, "Finals": 1, "Prelims": 2}
#: The meets that a batch brings, and the last one that is stored already.
BATCH, STORED = (36, 45), 40


def number(column: str, of: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col(column)), F.lit(0)).cast("long")


def sql_number(column: str, of: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in of.items()) + " ELSE 0 END"


def club_of(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLUBS)), (i % 4 + 1).cast("int"))


def shared_names(m: Meets) -> DataFrame:
    """Swims under names that ten swimmers share; two in three without a year, clubs of odd meets with a stray letter."""
    swims, i = m.swims.filter("not is_relay_team"), F.col("swimmer_id")
    club = club_of(i)
    row = ((F.col("time_cs") * 100 + F.col("event_id")) * 10 + number("category", CATEGORY_NO)) * 4 + i % 4
    return swims.select(
        "meet_id", "date", row.alias("row"), "event_id", "round_type", F.when(F.col("event_id") % 3 == 0, "Open").otherwise(F.col("category")).alias("category"),
        F.regexp_replace("swimmer", r"\d$", "").alias("name"), F.when(i % 3 == 0, F.col("birth_year")).otherwise(0).alias("birth_year"),
        F.when(F.col("meet_id") % 2 == 1, F.concat(F.left(club, F.lit(2)), F.lit("s"), F.substr(club, F.lit(3)))).otherwise(club).alias("club"),
    )


def bearers(m: Meets) -> DataFrame:
    """Who of a name's bearers the rows of a meet are, and how many rows each has."""
    return identities(shared_names(m)).groupBy("meet_id", "upper_name", "identity").agg(F.count("*").alias("swims"))


def batch(m: Meets) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a batch under written names, a little faster or slower than what is stored; swimmers, of whom one in four isn't known; stored results."""
    i = F.col("swimmer_id")
    people = m.swimmers.filter("not is_relay_team").select("swimmer_id", F.col("swimmer").alias("name"), F.coalesce("birth_year", F.lit(1985)).cast("int").alias("birth_year"), club_of(i).alias("club"), "sex")
    is_stored, is_new = (F.col("meet_id") <= STORED) & (i % 4 != 0), F.col("meet_id").between(*BATCH)
    # read twice, and made of all lines
    swims = held(m.swims.filter("not is_relay_team").filter(is_stored | is_new).select(*RESULT, "time_cs", "date").distinct())
    stored = swims.filter(is_stored).groupBy(*RESULT, "date").agg(F.min("time_cs").alias("time_cs"))
    results = stored.select(*RESULT, F.lit("").alias("team"), "time_cs", F.lit(0).alias("rank"), (F.col("time_cs") % 1000).cast("int").alias("points"), "date")
    again = swims.filter(is_new).join(people, "swimmer_id")
    row = (((i * 32 + F.col("event_id")) * 4 + number("round_type", ROUND_NO)) * 8 + number("category", CATEGORY_NO)) * (1 << 20) + F.col("time_cs")
    time = F.col("time_cs") + F.when(i % 2 == 0, -10).otherwise(10)
    rows = again.select(
        "meet_id", "date", row.alias("row"), "event_id", "round_type", "category", F.when(i % 3 == 0, F.upper("name")).otherwise(F.replace("name", F.lit("#"), F.lit(" - "))).alias("name"),
        "birth_year", "club", "sex", F.lit(False).alias("is_relay"), time.alias("time_cs"), F.lit(1).alias("rank"), (time % 1000).cast("int").alias("points"),
    )
    return rows, held(people.filter(i % 4 != 0).withColumn("is_relay_team", F.lit(False))), held(results)


def imported_results(m: Meets) -> DataFrame:
    """All results after the batch, under names, as new swimmers' ids are new."""
    out = import_results(*batch(m))
    name = F.upper(F.replace("name", F.lit(" - "), F.lit("#")))
    return out["results"].join(out["swimmers"].select("swimmer_id", name.alias("name")), "swimmer_id").select("name", *RESULT[1:], "time_cs", "points")


def import_log(m: Meets) -> DataFrame:
    """What was done with the rows of the batch, by meet."""
    return import_results(*batch(m))["log"].groupBy("meet_id", "match", "action").agg(F.count("*").alias("rows"))


def wide_categories(swims: DataFrame) -> DataFrame:
    """Swims with Juniors in a category of theirs and the Seniors'."""
    return swims.withColumn("category", F.when(F.col("category") == "Juniors", "Seniors/Juniors").otherwise(F.col("category")))


def split_profiles(m: Meets) -> DataFrame:
    return split_swimmers(wide_categories(m.swims.filter("not is_relay_team")))


def ruled_out(m: Meets) -> DataFrame:
    """For each swimmer and the age band of one of the meets: whether swims of other bands within 400 days conflict, and whether one fits."""
    swims = wide_categories(m.swims.filter("category != '' and not is_relay_team"))
    asked = swims.filter("meet_id % 8 = 0").select("swimmer_id", "meet_id", F.col("category").alias("band"), "date").distinct().withColumn("ask", F.concat_ws("|", "meet_id", "band"))
    return near_bands(asked, swims.filter("meet_id % 8 != 0")).select("swimmer_id", "meet_id", "band", "conflicts", "fits")


def read_meets(m: Meets) -> DataFrame:
    """Swims as a reader may give them: with lists over all categories, and in every fifth meet heats printed as finals once more."""
    base = m.swims.groupBy("meet_id", "event_id", "sex", "round_type", "category", F.col("swimmer").alias("name"), "time_cs", (F.col("swimmer_id") % 3).alias("k")).agg(F.lit("OK").alias("status"))
    # a row is written as it stands, in the general list, and as a final once more
    again = F.col("meet_id") % 5 == 0
    as_read = lambda when, round_type, category: F.when(when, F.struct(round_type.alias("round_type"), category.alias("category")))
    own = as_read(~F.coalesce(again & (F.col("round_type") == "Finals"), F.lit(True)), F.col("round_type"), F.col("category"))
    general = as_read(F.col("k") == 0, F.col("round_type"), F.lit(""))
    repeat = as_read(again & (F.col("round_type") == "Prelims"), F.lit("Finals"), F.col("category"))
    rows = base.select("meet_id", "event_id", "sex", "name", "time_cs", "status", F.explode(F.array_compact(F.array(own, general, repeat))).alias("r"))
    rows = rows.select("meet_id", "event_id", "sex", "r.round_type", "r.category", "name", "time_cs", "status")
    return rows.withColumns({"rank": F.lit(1), "row": F.col("time_cs")})


def cleaned(m: Meets) -> DataFrame:
    return cleaned_meet(read_meets(m)).groupBy(*EVENT, "round_type", "category").agg(F.count("*").alias("rows"), F.sum("time_cs").alias("time_cs"))


def overlap(m: Meets) -> DataFrame:
    return heat_overlap(read_meets(m).filter("category != ''"))


def files(m: Meets) -> DataFrame:
    """Files of the stored meets, read again: as they were, with an event more, in the other pool, or of another day; names in another order of words and with another letter."""
    stored = stored_meets(m)
    form = F.col("meet_id") % 4
    return stored.select(
        F.col("meet_id").alias("file_id"), F.concat(F.lit("The "), F.initcap("city"), F.lit("x, Open")).alias("name"), F.when(form == 3, F.date_add("date", 7)).otherwise(F.col("date")).alias("date"),
        F.when(form == 2, "Other").otherwise(F.col("pool")).alias("pool"), F.when(form == 1, F.array_append("events", F.lit("25 M Freestyle"))).otherwise(F.col("events")).alias("events"),
    )


def stored_meets(m: Meets) -> DataFrame:
    """Meets with a city of 24 letters for a name."""
    meets = m.swims.groupBy("meet_id", "date", "pool").agg(F.collect_set("event").alias("events"))
    city = F.substring(F.md5(F.col("meet_id").cast("string").cast("binary")), 1, 24)
    return meets.withColumn("city", city).withColumn("name", F.concat(F.lit("Open of the "), F.col("city")))


def duplicate_meets(m: Meets) -> DataFrame:
    return meet_warnings(held(files(m)), held(stored_meets(m)))


QUERIES = {
    "cl02_identities": bearers,
    "cl03_imported_results": imported_results,
    "cl03_import_log": import_log,
    "cl06_cleaned_meets": cleaned,
    "ag20_heat_overlap": overlap,
    "cl11_split_swimmers": split_profiles,
    "jn15_ruled_out": ruled_out,
    "qy38_duplicate_meets": duplicate_meets,
}

INDIVIDUALS = ", own AS (SELECT * FROM swims WHERE NOT is_relay_team)"
IMPORT = f"""{INDIVIDUALS}, results AS (SELECT swimmer_id, meet_id, event_id, round_type, category, time_cs, date FROM own GROUP BY ALL),
stored AS (SELECT swimmer_id, meet_id, event_id, round_type, category, min(time_cs) AS time_cs, -1 AS row FROM results WHERE meet_id <= {STORED} AND swimmer_id % 4 <> 0 GROUP BY ALL),
batch AS (SELECT swimmer_id, meet_id, event_id, round_type, category, time_cs + CASE WHEN swimmer_id % 2 = 0 THEN -10 ELSE 10 END AS time_cs, time_cs AS row FROM results WHERE meet_id BETWEEN {BATCH[0]} AND {BATCH[1]}),
every AS (SELECT * FROM stored UNION ALL SELECT * FROM batch)"""
WIDE = "CASE WHEN category = 'Juniors' THEN 'Seniors/Juniors' ELSE category END"
#: Cadets, Minimes and Seniors (with Juniors) exclude each other.
GROUP_OF = "CASE WHEN band LIKE 'Seniors%' THEN 'Seniors' ELSE band END"
READ = """, base AS (SELECT meet_id, event_id, sex, round_type, category, swimmer AS name, time_cs, swimmer_id % 3 AS k FROM swims GROUP BY ALL),
read AS (SELECT meet_id, event_id, sex, round_type, category, name, time_cs FROM base WHERE NOT (meet_id % 5 = 0 AND round_type = 'Finals') UNION SELECT meet_id, event_id, sex, round_type, '', name, time_cs FROM base WHERE k = 0
UNION SELECT meet_id, event_id, sex, 'Finals', category, name, time_cs FROM base WHERE meet_id % 5 = 0 AND round_type = 'Prelims'),"""
OVERLAP = """(SELECT meet_id, event_id, sex, round_type, category, count(*) AS heats, count(*) FILTER (f.name IS NOT NULL) AS shared FROM {rows} r
JOIN (SELECT DISTINCT meet_id, event_id, sex FROM {rows} WHERE round_type = 'Finals') USING (meet_id, event_id, sex)
LEFT JOIN (SELECT DISTINCT meet_id, event_id, sex, name, time_cs FROM {rows} WHERE round_type = 'Finals') f USING (meet_id, event_id, sex, name, time_cs) WHERE round_type = 'Prelims' GROUP BY ALL)"""
SQL = {
    "cl02_identities": f"""{INDIVIDUALS}, named AS (SELECT meet_id, upper(regexp_replace(swimmer, '\\d$', '')) AS upper_name, CASE WHEN swimmer_id % 3 = 0 THEN birth_year END AS year,
CASE WHEN event_id % 3 = 0 THEN '' ELSE category END AS band, CASE swimmer_id % 4 {CLUB_CASE} END AS club, ((time_cs * 100 + event_id) * 10 + {sql_number("category", CATEGORY_NO)}) * 4 + swimmer_id % 4 AS row FROM own),
dated AS (SELECT *, first_value(club) OVER (PARTITION BY meet_id, upper_name, year ORDER BY row) AS first_club FROM named WHERE year IS NOT NULL),
bands AS (SELECT meet_id, upper_name, band, count(*) AS n, min(row) AS began FROM named WHERE year IS NULL GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY meet_id, upper_name ORDER BY began) AS k, first_value(band) OVER (PARTITION BY meet_id, upper_name ORDER BY began) AS first_band FROM bands)
SELECT meet_id, upper_name, 'Y|' || year || CASE WHEN club <> first_club THEN '|' || upper(CASE WHEN meet_id % 2 = 1 THEN substr(club, 1, 2) || 's' || substr(club, 3) ELSE club END) ELSE '' END AS identity, count(*) AS swims FROM dated GROUP BY ALL
UNION ALL SELECT meet_id, upper_name, 'B|' || CASE WHEN band = '' THEN first_band WHEN first_band = '' AND k = 2 THEN '' ELSE band END AS identity, sum(n)::BIGINT AS swims FROM ordered GROUP BY ALL""",
    "cl03_imported_results": IMPORT + """, best AS (SELECT swimmer_id, meet_id, event_id, round_type, category, min(time_cs) AS time_cs FROM every GROUP BY ALL)
SELECT upper(swimmer) AS name, meet_id, event_id, round_type, category, time_cs, CASE WHEN time_cs % 1000 = 0 THEN coalesce((SELECT max(s.time_cs % 1000) FROM stored s WHERE (s.swimmer_id, s.meet_id, s.event_id, s.round_type, s.category) = (b.swimmer_id, b.meet_id, b.event_id, b.round_type, b.category)), NULL)
ELSE time_cs % 1000 END::INT AS points FROM best b JOIN swimmers USING (swimmer_id)""",
    "cl03_import_log": IMPORT + """, told AS (SELECT *, min(time_cs) OVER (PARTITION BY swimmer_id, meet_id, event_id, round_type, category ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM every),
firsts AS (SELECT swimmer_id, min(meet_id) AS first FROM batch WHERE swimmer_id % 4 = 0 GROUP BY ALL)
SELECT meet_id, CASE WHEN meet_id = first THEN 'new' ELSE 'exact' END AS "match", CASE WHEN before IS NULL THEN 'inserted' WHEN time_cs < before THEN 'improved' WHEN time_cs = before THEN 'same time' ELSE 'slower' END AS action, count(*) AS rows
FROM told LEFT JOIN firsts USING (swimmer_id) WHERE row >= 0 GROUP BY ALL""",
    "cl06_cleaned_meets": READ + f"""
specific AS (SELECT * FROM read r WHERE category <> '' OR NOT EXISTS (SELECT 1 FROM read s WHERE s.category <> '' AND (s.meet_id, s.event_id, s.sex, s.round_type, s.name, s.time_cs) = (r.meet_id, r.event_id, r.sex, r.round_type, r.name, r.time_cs))),
final AS (SELECT meet_id, event_id, sex, CASE WHEN round_type IN ('', 'Prelims') AND NOT bool_or(round_type = 'Finals') OVER (PARTITION BY meet_id, event_id, sex) THEN 'Finals' ELSE round_type END AS round_type, category, name, time_cs FROM specific),
gone AS (SELECT * FROM {OVERLAP.format(rows="final")} WHERE shared >= 0.8 * heats)
SELECT meet_id, event_id, sex, round_type, category, count(*) AS rows, sum(time_cs)::BIGINT AS time_cs FROM final ANTI JOIN gone USING (meet_id, event_id, sex, round_type, category) GROUP BY ALL""",
    "ag20_heat_overlap": READ + f"aged AS (SELECT * FROM read WHERE category <> '') SELECT *, shared >= 0.8 * heats AS repeated FROM {OVERLAP.format(rows='aged')}",
    "cl11_split_swimmers": f"""{INDIVIDUALS}, banded AS (SELECT swimmer_id, meet_id, date, {WIDE} AS band FROM own WHERE category <> ''),
days AS (SELECT swimmer_id, date FROM banded GROUP BY swimmer_id, meet_id, date HAVING count(DISTINCT {GROUP_OF}) > 1),
near AS (SELECT swimmer_id, band, count(*) AS n FROM banded b WHERE EXISTS (SELECT 1 FROM days d WHERE d.swimmer_id = b.swimmer_id AND abs(d.date - b.date) <= 400) GROUP BY ALL),
weighed AS (SELECT *, {GROUP_OF} AS g, sum(n) OVER (PARTITION BY swimmer_id, {GROUP_OF}) AS weight FROM near),
parts AS (SELECT *, dense_rank() OVER (PARTITION BY swimmer_id ORDER BY g) - 1 AS part FROM weighed),
kept AS (SELECT swimmer_id, arg_min(part, -weight * 100 + part) AS keep, count(DISTINCT part) AS n_parts FROM parts GROUP BY ALL)
SELECT swimmer_id, band, part::INT AS part, part <> keep AS moves FROM parts JOIN kept USING (swimmer_id) WHERE n_parts > 1""",
    "jn15_ruled_out": f"""{INDIVIDUALS}, banded AS (SELECT swimmer_id, meet_id, date, {WIDE} AS band FROM own WHERE category <> ''),
asked AS (SELECT DISTINCT swimmer_id, meet_id, band, date FROM banded WHERE meet_id % 8 = 0), has AS (SELECT DISTINCT swimmer_id, date AS other_date, band AS other FROM banded WHERE meet_id % 8 <> 0)
SELECT a.swimmer_id, meet_id, a.band, coalesce(bool_or({GROUP_OF.replace("band", "a.band")} <> {GROUP_OF.replace("band", "h.other")}), FALSE) AS conflicts, coalesce(bool_or({GROUP_OF.replace("band", "a.band")} = {GROUP_OF.replace("band", "h.other")}), FALSE) AS fits
FROM asked a LEFT JOIN has h ON a.swimmer_id = h.swimmer_id AND abs(a.date - other_date) <= 400 GROUP BY ALL""",
    "qy38_duplicate_meets": """SELECT DISTINCT meet_id AS file_id, meet_id, CASE meet_id % 4 WHEN 0 THEN 'exact_duplicate' WHEN 1 THEN 'partial_new' WHEN 2 THEN 'different_pool' ELSE 'similar_name' END AS kind, CASE WHEN meet_id % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS new_events FROM swims""",
}
