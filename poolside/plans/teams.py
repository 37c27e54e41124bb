"""Countries and clubs: profiles, rankings, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolside.functions.names import team_key
from poolside.operators.ranking import best_swims, positional, top_n

from poolside.plans.medals import AWARDED, COUNTS, KEY, medals_of, tally
from poolside.sources.tpch import Meets

THIS_YEAR = 2001


def country_list(m: Meets) -> DataFrame:
    """Countries with their numbers of athletes, those without any as well."""
    people = m.swimmers.filter("not is_relay_team").groupBy("nationality_id").agg(F.count("*").alias("athletes"), F.count_if(F.col("sex") == "F").alias("women"))
    return m.countries.join(people, "nationality_id", "left").select("country", "region", F.coalesce("athletes", F.lit(0)).alias("athletes"), F.coalesce("women", F.lit(0)).alias("women"))


def best_times(swims: DataFrame) -> DataFrame:
    """A country's best time by event, sex and pool; no relays."""
    return best_swims(swims.filter("time_cs > 0 and not is_relay"), ["nationality_id", "event_id", "sex", "pool"], [])


def top_swimmers(swims: DataFrame, n: int = 12) -> DataFrame:
    """The swimmers of a country with the most points in a swim."""
    best = swims.filter("points > 0 and not is_relay_team").groupBy("nationality_id", "swimmer_id").agg(F.max("points").alias("points"))
    return top_n(best, ["nationality_id"], n, F.desc("points"), "swimmer_id")


def team_ranking(m: Meets) -> DataFrame:
    """Clubs of a country by their medals."""
    won = medals_of(m).withColumn("club", team_key(F.col("team")))
    return positional(tally("nationality_id", "club")(won), ["nationality_id"], F.desc("gold"), F.desc("silver"), F.desc("bronze"), "club")


def team_profile(swims: DataFrame) -> DataFrame:
    """Swims, swimmers, events and best points by club."""
    return swims.groupBy(team_key(F.col("team")).alias("club")).agg(
        F.count("*").alias("results"), F.count_distinct("swimmer_id").alias("swimmers"), F.count_distinct("event_id").alias("events"), F.max("points").alias("best_points"), F.lit(0).cast("long").alias("records")
    )


def predictions(swims: DataFrame, this_year: int) -> DataFrame:
    """Next season's best by a line through the bests of the last four seasons (two at least, the last of them within two years).

    The change from the last best is held within 8 %; over 25 hundredths it is a trend.
    """
    keys = ["swimmer_id", "event_id", "pool"]
    seasons = swims.filter("time_cs > 0 and not is_relay and not is_relay_team").groupBy(*keys, "year").agg(F.min("time_cs").alias("best"))
    last = top_n(seasons, keys, 4, F.desc("year"))
    fit = last.groupBy(*keys).agg(F.regr_slope(F.col("best").cast("double"), F.col("year").cast("double")).alias("slope"), F.max("year").alias("last_year"), F.max_by("best", "year").alias("best"), F.count("*").alias("seasons"))
    fit = fit.filter((F.col("seasons") >= 2) & (F.col("last_year") >= this_year - 2) & F.col("slope").isNotNull())
    change = F.greatest(-0.08 * F.col("best"), F.least(0.08 * F.col("best"), F.col("slope")))
    fit = fit.withColumn("delta", F.round(change, 4) + 0.0)  # no negative zero
    trend = F.when(F.col("delta") < -25, "improving").when(F.col("delta") > 25, "declining").otherwise("steady")
    return fit.select(*keys, "seasons", "last_year", "best", "delta", trend.alias("trend"))


QUERIES = {
    "qy28_country_best_times": lambda m: best_times(m.swims),
    "qy28_country_top_swimmers": lambda m: top_swimmers(m.swims),
    "qy30_country_list": country_list,
    "qy34_team_profile": lambda m: team_profile(m.swims),
    "qy35_team_ranking": team_ranking,
    "qy36_prediction": lambda m: predictions(m.swims, THIS_YEAR),
}

SQL = {
    "qy28_country_best_times": """SELECT nationality_id, event_id, sex, pool, time_cs, date, swimmer_id FROM (SELECT *, row_number() OVER (PARTITION BY nationality_id, event_id, sex, pool ORDER BY time_cs, date, swimmer_id) AS k
FROM swims WHERE time_cs > 0 AND NOT is_relay) WHERE k = 1""",
    "qy28_country_top_swimmers": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nationality_id ORDER BY points DESC, swimmer_id) AS rank
FROM (SELECT nationality_id, swimmer_id, max(points) AS points FROM swims WHERE points > 0 AND NOT is_relay_team GROUP BY ALL)) WHERE rank <= 12""",
    "qy30_country_list": """SELECT country, region, coalesce(athletes, 0) AS athletes, coalesce(women, 0) AS women FROM countries
LEFT JOIN (SELECT nationality_id, count(*) AS athletes, count(*) FILTER (sex = 'F') AS women FROM swimmers WHERE NOT is_relay_team GROUP BY ALL) USING (nationality_id)""",
    "qy34_team_profile": f"SELECT {KEY} AS club, count(*) AS results, count(DISTINCT swimmer_id) AS swimmers, count(DISTINCT event_id) AS events, max(points) AS best_points, 0::BIGINT AS records FROM swims GROUP BY club",
    "qy35_team_ranking": AWARDED
    + f"""SELECT *, row_number() OVER (PARTITION BY nationality_id ORDER BY gold DESC, silver DESC, bronze DESC, club) AS rank FROM (SELECT nationality_id, {KEY} AS club, {COUNTS} FROM medal_rows GROUP BY nationality_id, club)""",
    "qy36_prediction": f""", seasons AS (SELECT swimmer_id, event_id, pool, year, min(time_cs) AS best FROM swims WHERE time_cs > 0 AND NOT is_relay AND NOT is_relay_team GROUP BY ALL),
fit AS (SELECT swimmer_id, event_id, pool, regr_slope(best::DOUBLE, year::DOUBLE) AS slope, max(year) AS last_year, arg_max(best, year) AS best, count(*) AS seasons
FROM (SELECT *, row_number() OVER (PARTITION BY swimmer_id, event_id, pool ORDER BY year DESC) AS k FROM seasons) WHERE k <= 4 GROUP BY ALL)
SELECT *, CASE WHEN delta < -25 THEN 'improving' WHEN delta > 25 THEN 'declining' ELSE 'steady' END AS trend
FROM (SELECT swimmer_id, event_id, pool, seasons, last_year, best, round(greatest(-0.08 * best, least(0.08 * best, slope)), 4) + 0.0 AS delta FROM fit WHERE seasons >= 2 AND last_year >= {THIS_YEAR - 2} AND slope IS NOT NULL)""",
}
