"""Cleaning and identity: duplicate swimmers, orphan clubs, club spellings, points, placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.functions.names import sorted_key, team_key
from poolside.functions.times import format_centiseconds
from poolside.plans.medals import KEY
from poolside.plans.rankings import TIME
from poolside.sources.tpch import Meets


def duplicate_swimmers(m: Meets) -> DataFrame:
    """Groups of swimmers with the same words in the name, the same sex and the same birth year (unknown is one of its own).

    A narrower question than ``duplicate_pairs``: a group's size and its first and last id stand for its pairs.
    """
    return named(m.swimmers).groupBy("key", "sex", "birth_year").agg(F.count("*").alias("n"), F.min("swimmer_id").alias("first_id"), F.max("swimmer_id").alias("last_id")).filter("n > 1")


def named(swimmers: DataFrame) -> DataFrame:
    """Swimmers with their name's key. Names are numbers here, so their last three digits are left out."""
    name = F.regexp_replace("swimmer", r"\d{3}$", "")
    return swimmers.filter("not is_relay_team").select(sorted_key(name).alias("key"), "sex", "birth_year", "swimmer_id")


def duplicate_pairs(swimmers: DataFrame) -> DataFrame:
    """Pairs of swimmers that may be one, as pairs of classes: same words in the name, and birth years at most one apart or unknown.

    A class is the swimmers of a key and birth year (0 is unknown); its members are ``duplicate_members``. ``pairs``
    is how many pairs of swimmers a row stands for, ``score`` 100 if both years are known and 95 if not.
    """
    classes = named(swimmers).groupBy("key", F.coalesce("birth_year", F.lit(0)).alias("birth_year")).agg(F.count("*").alias("n"))
    known = F.col("birth_year") > 0
    # known years look for their own and the next one, the unknown one for all
    left = classes.withColumn("link", F.explode(F.when(known, F.array("birth_year", F.col("birth_year") + 1)).otherwise(F.array(F.lit(0)))))
    right = classes.select("key", F.col("birth_year").alias("other_year"), F.col("n").alias("others"), F.explode(F.array_distinct(F.array("birth_year", F.lit(0)))).alias("link"))
    pairs = F.when(F.col("birth_year") == F.col("other_year"), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("others"))
    score = F.when(F.least("birth_year", "other_year") > 0, 100).otherwise(95)
    return left.join(right, ["key", "link"]).select("key", "birth_year", "other_year", score.alias("score"), "n", "others", pairs.alias("pairs")).filter("pairs > 0")


def duplicate_members(swimmers: DataFrame) -> DataFrame:
    """The members of the classes in ``duplicate_pairs``, a row for each swimmer."""
    pairs = duplicate_pairs(swimmers)
    linked = pairs.select("key", F.explode(F.array("birth_year", "other_year")).alias("birth_year")).distinct()
    return named(swimmers).select("key", F.coalesce("birth_year", F.lit(0)).alias("birth_year"), "swimmer_id").join(linked, ["key", "birth_year"], "left_semi")


def orphan_clubs(m: Meets, n: int = 50) -> DataFrame:
    """Clubs of results whose name is no team's, the most used first."""
    teams = m.read("supplier").select(F.lower("s_name").alias("name"))
    used = m.swims.groupBy("team").agg(F.count("*").alias("results")).withColumn("name", F.lower("team"))
    return used.join(teams, "name", "left_anti").select("team", "results").orderBy(F.desc("results"), "team").limit(n)


def team_merge_plan(m: Meets) -> DataFrame:
    """For each spelling of a club, the one that is kept: the most used, then the first by name."""
    used = m.swims.groupBy("team").agg(F.count("*").alias("results")).withColumn("key", team_key(F.col("team")))
    keep = used.groupBy("key").agg(F.min_by("team", F.struct(-F.col("results"), F.col("team"))).alias("keep"), F.count("*").alias("spellings"))
    return used.join(keep.filter("spellings > 1"), "key").filter("team != keep").select("team", "keep", "results")


def relay_placeholders(swims: DataFrame) -> DataFrame:
    """Swimmers all of whose results are relays."""
    return swims.groupBy("swimmer_id").agg(F.count("*").alias("results"), F.count_if(F.col("is_relay")).alias("relays")).filter("results = relays")


#: Pairs of swimmers one by one, by the rule itself.
PAIRED = """, named AS (SELECT swimmer_id, coalesce(birth_year, 0) AS y, array_to_string(list_sort(string_split(trim(regexp_replace(upper(regexp_replace(swimmer, '\\d{3}$', '')), '[^A-Z0-9_]+', ' ', 'g')), ' ')), ' ') AS key FROM swimmers WHERE NOT is_relay_team),
paired AS (SELECT a.key, a.swimmer_id AS id_a, b.swimmer_id AS id_b, a.y AS y_a, b.y AS y_b, CASE WHEN a.y > 0 AND b.y > 0 THEN 100 ELSE 95 END AS score
FROM named a JOIN named b ON a.key = b.key AND a.swimmer_id < b.swimmer_id WHERE a.y = 0 OR b.y = 0 OR abs(a.y - b.y) <= 1)
"""

QUERIES = {
    "qy37_duplicate_swimmers": duplicate_swimmers,
    "qy37_duplicate_pairs": lambda m: duplicate_pairs(m.swimmers),
    "qy37_duplicate_members": lambda m: duplicate_members(m.swimmers),
    "qy39_orphan_clubs": orphan_clubs,
    "qy40_points": lambda m: m.swims.select("event_id", "sex", "pool", "time_cs", "points").distinct(),
    "sc03_times": lambda m: m.swims.select("time_cs").distinct().select("time_cs", format_centiseconds(F.col("time_cs")).alias("time")),
    "st05_team_keys": lambda m: m.swims.select("team").distinct().select("team", team_key(F.col("team")).alias("key")),
    "cl12_team_merge_plan": team_merge_plan,
    "cl19_relay_placeholders": lambda m: relay_placeholders(m.swims),
}

SQL = {
    "qy37_duplicate_swimmers": """SELECT key, sex, birth_year, count(*) AS n, min(swimmer_id) AS first_id, max(swimmer_id) AS last_id
FROM (SELECT *, array_to_string(list_sort(string_split(trim(regexp_replace(upper(regexp_replace(swimmer, '\\d{3}$', '')), '[^A-Z0-9_]+', ' ', 'g')), ' ')), ' ') AS key FROM swimmers WHERE NOT is_relay_team) GROUP BY ALL HAVING count(*) > 1""",
    "qy37_duplicate_pairs": PAIRED
    + """SELECT key, birth_year, other_year, score, a.n, b.n AS others, pairs FROM (SELECT key, least(y_a, y_b) AS birth_year, greatest(y_a, y_b) AS other_year, score, count(*) AS pairs FROM paired GROUP BY ALL)
JOIN (SELECT key, y AS birth_year, count(*) AS n FROM named GROUP BY ALL) a USING (key, birth_year) JOIN (SELECT key, y AS other_year, count(*) AS n FROM named GROUP BY ALL) b USING (key, other_year)""",
    "qy37_duplicate_members": PAIRED + "SELECT key, y AS birth_year, swimmer_id FROM named WHERE swimmer_id IN (SELECT id_a FROM paired UNION SELECT id_b FROM paired)",
    "qy39_orphan_clubs": "SELECT team, count(*) AS results FROM swims WHERE lower(team) NOT IN (SELECT lower(s_name) FROM supplier) GROUP BY ALL ORDER BY results DESC, team LIMIT 50",
    "qy40_points": "SELECT DISTINCT event_id, sex, pool, time_cs, points FROM swims",
    "sc03_times": f"SELECT time_cs, {TIME.format('time_cs')} AS time FROM (SELECT DISTINCT time_cs FROM swims)",
    "st05_team_keys": f"SELECT team, {KEY} AS key FROM (SELECT DISTINCT team FROM swims)",
    "cl12_team_merge_plan": f""", used AS (SELECT team, {KEY} AS key, count(*) AS results FROM swims GROUP BY team)
SELECT team, keep, results FROM used JOIN (SELECT key, arg_min(team, (-results, team)) AS keep, count(*) AS spellings FROM used GROUP BY key) USING (key) WHERE spellings > 1 AND team <> keep""",
    "cl19_relay_placeholders": "SELECT swimmer_id, count(*) AS results, count(*) FILTER (is_relay) AS relays FROM swims GROUP BY ALL HAVING count(*) = count(*) FILTER (is_relay)",
}
