"""Medals, derived from results, and tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolside.functions.names import team_key
from poolside.sources.tables import held
from poolside.sources.tpch import Meets

GROUP = ["meet_id", "event_id", "sex", "category"]


def with_source_rank(swims: DataFrame) -> DataFrame:
    """The place that the source gives: every third meet has one."""
    place = F.rank().over(Window.partitionBy(*GROUP).orderBy("time_cs"))
    return swims.withColumn("original_rank", F.when(F.col("meet_id") % 3 == 0, place))


def award(results: DataFrame) -> DataFrame:
    """Results that win a medal, with it.

    Of each meet, event, sex and category, without HC: the finals if there are any; nothing if there are several
    rounds without finals. If any row has a source rank, that alone counts; else ties share a place and the
    next one is left out.
    """
    w = Window.partitionBy(*GROUP)
    rows = results.filter(~F.col("is_hc"))
    rows = rows.withColumn("_finals", F.max(F.col("round_type") == "Finals").over(w)).withColumn("_one", F.min("round_type").over(w) == F.max("round_type").over(w))
    rows = rows.filter(F.when(F.col("_finals"), F.col("round_type") == "Finals").otherwise(F.col("_one")))
    place = F.when(F.max(F.coalesce("original_rank", F.lit(0))).over(w) > 0, F.col("original_rank")).otherwise(F.rank().over(w.orderBy("time_cs")))
    rows = rows.withColumn("_place", place).filter("_place between 1 and 3")
    return rows.withColumn("medal", F.element_at(F.array(F.lit("GOLD"), F.lit("SILVER"), F.lit("BRONZE")), F.col("_place").cast("int"))).drop("_finals", "_one", "_place")


def with_legs(medals: DataFrame, swimmers: DataFrame) -> DataFrame:
    """Each medal of a relay squad, and one for each of its athletes that is known by name; matched: an athlete was.

    Of several swimmers of a name, those of the squad's country come first, then by name and id.
    """
    names = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.format_string("customer#%09d", F.col("swimmer_id") + i))
    squads = medals.filter("is_relay_team").withColumn("legs", names)
    keys = ["nationality_id", "legs"]
    # the same legs of the same country are the same athletes, however many medals they have
    legs = squads.select(*keys).distinct().withColumn("leg", F.explode("legs"))
    known = swimmers.select(F.lower("swimmer").alias("leg"), F.col("swimmer_id").alias("athlete"), F.col("nationality_id").alias("of"))
    best = F.min_by("athlete", F.struct((F.col("of") != F.col("nationality_id")).alias("other"), F.col("athlete").alias("id")))
    athletes = legs.join(known, "leg").groupBy(*keys, "leg").agg(best.alias("athlete")).groupBy(*keys).agg(F.collect_set("athlete").alias("athletes"))
    squads = squads.join(athletes, keys, "left").drop("legs")
    own = squads.withColumn("matched", F.col("athletes").isNotNull()).drop("athletes")
    people = squads.withColumn("swimmer_id", F.explode("athletes")).withColumn("is_relay_team", F.lit(False)).withColumn("matched", F.lit(False)).drop("athletes")
    return medals.filter("not is_relay_team").withColumn("matched", F.lit(False)).unionByName(own).unionByName(people)


def medals_of(m: Meets) -> DataFrame:
    columns = [*GROUP, "round_type", "time_cs", "is_hc", "original_rank", "swimmer_id", "nationality_id", "country", "region", "is_relay_team", "team", "classification"]
    return award(with_source_rank(m.swims).select(*columns))


def medals_with_legs(m: Meets) -> DataFrame:
    """``with_legs`` of the medals of all meets. Medals are read four times there, so they are ranked once and held."""
    return with_legs(held(medals_of(m)), m.swimmers)


def tally(*keys: str):
    """Counts by medal and in all."""

    def count(df: DataFrame) -> DataFrame:
        each = [F.count_if(F.col("medal") == x.upper()).alias(x) for x in ("gold", "silver", "bronze")]
        return df.groupBy(*keys).agg(*each, F.count("*").alias("total"))

    return count


def individual(m: Meets) -> DataFrame:
    """Medals that count in tables: athletes' and squads' without a known athlete; Arab countries."""
    return medals_with_legs(m).filter("not matched and region != 'OTHER'")


def club_summary(m: Meets) -> DataFrame:
    """By club; spellings of a club are summed up, and the name in capitals is preferred."""
    by_name = tally("team")(medals_of(m).filter("region != 'OTHER'"))
    keyed = by_name.withColumn("key", team_key(F.col("team")))
    best = F.min_by("team", F.struct((F.col("team") != F.upper("team")).alias("a"), F.col("team").alias("b"))).alias("club")
    return keyed.groupBy("key").agg(best, *(F.sum(c).alias(c) for c in ("gold", "silver", "bronze", "total")))


QUERIES = {
    "qy06_medals": lambda m: medals_with_legs(m).select(*GROUP, "swimmer_id", "medal", "time_cs", "is_relay_team", "matched"),
    "qy07_medal_table": lambda m: tally("country")(individual(m)),
    "qy08_swimmer_medals": lambda m: tally("swimmer_id")(individual(m)).orderBy(F.desc("gold"), F.desc("silver"), F.desc("bronze"), "swimmer_id").limit(10),
    "qy09_club_medals": club_summary,
    "qy21_medals_by_level": lambda m: tally("swimmer_id", "classification")(individual(m)),
}

AWARDED = """, ranked AS (SELECT *, CASE WHEN meet_id % 3 = 0 THEN rank() OVER (PARTITION BY meet_id, event_id, sex, category ORDER BY time_cs) END AS original_rank FROM swims),
rounds AS (SELECT *, bool_or(round_type = 'Finals') OVER w AS finals, min(round_type) OVER w = max(round_type) OVER w AS one FROM ranked WHERE NOT is_hc WINDOW w AS (PARTITION BY meet_id, event_id, sex, category)),
placed_in AS (SELECT *, CASE WHEN max(coalesce(original_rank, 0)) OVER (PARTITION BY meet_id, event_id, sex, category) > 0 THEN original_rank ELSE rank() OVER (PARTITION BY meet_id, event_id, sex, category ORDER BY time_cs) END AS place
FROM rounds WHERE CASE WHEN finals THEN round_type = 'Finals' ELSE one END),
medal_rows AS (SELECT *, row_number() OVER () AS k, CASE place WHEN 1 THEN 'GOLD' WHEN 2 THEN 'SILVER' ELSE 'BRONZE' END AS medal FROM placed_in WHERE place BETWEEN 1 AND 3),
legs AS (SELECT DISTINCT k, s.swimmer_id AS athlete FROM medal_rows r, range(1, 5) AS t(i) JOIN swimmers s ON lower(s.swimmer) = printf('customer#%09d', r.swimmer_id + i) WHERE r.is_relay_team),
medals AS (SELECT r.* EXCLUDE (swimmer_id, is_relay_team), swimmer_id, is_relay_team, is_relay_team AND EXISTS (SELECT 1 FROM legs l WHERE l.k = r.k) AS matched FROM medal_rows r
UNION ALL SELECT r.* EXCLUDE (swimmer_id, is_relay_team), athlete, FALSE, FALSE FROM medal_rows r JOIN legs USING (k))
"""
COUNTS = "count(*) FILTER (medal = 'GOLD') AS gold, count(*) FILTER (medal = 'SILVER') AS silver, count(*) FILTER (medal = 'BRONZE') AS bronze, count(*) AS total"
KEY = "trim(regexp_replace(lower(regexp_replace(team, '[-_.,/\\\\''’`´&()]+', ' ', 'g')), '\\s+', ' ', 'g'))"
for _ in range(2):
    for _suffix in ("\\s+national team$", "\\s+team\\s+[a-d]$", "\\s+team$", "\\s+[a-d]$", "\\s+\\d{1,2}$"):
        KEY = f"trim(regexp_replace({KEY}, '{_suffix}', ''))"
INDIVIDUAL = "FROM medals WHERE NOT matched AND region <> 'OTHER'"
SQL = {
    "qy06_medals": AWARDED + "SELECT meet_id, event_id, sex, category, swimmer_id, medal, time_cs, is_relay_team, matched FROM medals",
    "qy07_medal_table": AWARDED + f"SELECT country, {COUNTS} {INDIVIDUAL} GROUP BY ALL",
    "qy08_swimmer_medals": AWARDED + f"SELECT swimmer_id, {COUNTS} {INDIVIDUAL} GROUP BY ALL ORDER BY gold DESC, silver DESC, bronze DESC, swimmer_id LIMIT 10",
    "qy09_club_medals": AWARDED
    + f""", named AS (SELECT team, {KEY} AS key, {COUNTS} FROM medal_rows WHERE region <> 'OTHER' GROUP BY team)
SELECT key, arg_min(team, (team <> upper(team), team)) AS club, sum(gold)::BIGINT AS gold, sum(silver)::BIGINT AS silver, sum(bronze)::BIGINT AS bronze, sum(total)::BIGINT AS total FROM named GROUP BY key""",
    "qy21_medals_by_level": AWARDED + f"SELECT swimmer_id, classification, {COUNTS} {INDIVIDUAL} GROUP BY ALL",
}
