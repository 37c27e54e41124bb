"""Profiles, progressions and comparisons of swimmers; every query covers all swimmers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolside.functions.names import team_key
from poolside.functions.times import format_centiseconds
from poolside.operators.ranking import personal_bests, top_n
from poolside.refdata import BASE_TIMES, EVENTS, MOST_POINTS, TIERS, base_seconds
from poolside.sources.tpch import Meets, sql_values


def events_of(m: Meets) -> DataFrame:
    """Best time and number of swims by event and pool; a relay's legs count for the athletes that they name, where they have none of their own."""
    own = m.swims.groupBy("swimmer_id", "event_id", "pool").agg(F.min("time_cs").alias("best"), F.count("*").alias("swims"))
    legs = m.swims.filter("is_relay_team").withColumn("athlete", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.col("swimmer_id") + i))).groupBy(F.col("athlete").alias("swimmer_id"), "event_id", "pool").agg(F.min("time_cs").alias("best"), F.count("*").alias("swims"))
    legs = legs.join(m.swimmers.select("swimmer_id"), "swimmer_id", "left_semi").join(own.select("swimmer_id", "event_id", "pool"), ["swimmer_id", "event_id", "pool"], "left_anti")
    return own.withColumn("as_leg", F.lit(False)).unionByName(legs.withColumn("as_leg", F.lit(True)))


def tier_histogram(swims: DataFrame) -> DataFrame:
    """Swims by tier of points; tiers beyond a swimmer's first and last one that isn't empty are left out."""
    tier = F.lit(None).cast("int")
    for k, (low, _) in reversed(list(enumerate(TIERS, 1))):
        tier = F.when(F.col("points") >= low, k).otherwise(tier)
    counts = swims.filter(f"points between {TIERS[-1][0]} and {MOST_POINTS}").groupBy("swimmer_id", tier.alias("tier")).agg(F.count("*").alias("n"))
    spans = counts.groupBy("swimmer_id").agg(F.sequence(F.min("tier"), F.max("tier")).alias("tiers"), F.map_from_entries(F.collect_list(F.struct("tier", "n"))).alias("n"))
    each = spans.select("swimmer_id", F.explode("tiers").alias("tier"), "n")
    name = F.element_at(F.array(*(F.lit(t) for _, t in TIERS)), F.col("tier"))
    return each.select("swimmer_id", "tier", name.alias("label"), F.coalesce(F.try_element_at("n", F.col("tier")), F.lit(0)).cast("long").alias("n"))


def season_best(swims: DataFrame, this_year: int) -> DataFrame:
    """The best points of this year, or of the latest year that has any."""
    by_year = swims.filter("points > 0").groupBy("swimmer_id", "year").agg(F.max("points").alias("points"))
    return by_year.groupBy("swimmer_id").agg(
        F.coalesce(F.max(F.when(F.col("year") == this_year, F.lit(this_year))), F.max("year")).alias("season"),
        F.coalesce(F.max(F.when(F.col("year") == this_year, F.col("points"))), F.max_by("points", "year")).alias("points"),
    )


def compare(swims: DataFrame) -> DataFrame:
    """What a comparison shows of each swimmer: totals, mean and best points, events."""
    return swims.groupBy("swimmer_id").agg(
        F.count("*").alias("results"), F.count_distinct("meet_id").alias("meets"), F.max("points").alias("best_points"), F.round(F.avg(F.when(F.col("points") > 0, F.col("points"))), 6).alias("mean_points"), F.count_distinct("event_id", "pool").alias("events")
    )


def shared_events(swims: DataFrame) -> DataFrame:
    """Events that two swimmers of a country or more have, with the country's bests."""
    best = personal_bests(swims, "nationality_id", "event_id", "pool", "swimmer_id")
    return best.groupBy("nationality_id", "event_id", "pool").agg(F.count("*").alias("swimmers"), F.min("best").alias("best")).filter("swimmers >= 2")


def progression(swims: DataFrame, keys: list[str], n_events: int | None = 5, n_swims: int = 5) -> DataFrame:
    """The last swims of each event, in the order of dates; of the events with the smallest best times, if limited."""
    keyed = [*keys, "event_id"]
    per_day = swims.filter("time_cs > 0").groupBy(*keyed, "date").agg(F.min("time_cs").alias("time_cs"))
    if n_events:
        best = top_n(personal_bests(per_day, *keyed), keys, n_events, "best", "event_id").select(*keyed)
        per_day = per_day.join(best, keyed, "left_semi")
    last = top_n(per_day, keyed, n_swims, F.desc("date")).drop("rank")
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*keyed).orderBy("date")).cast("long")).withColumn("time", format_centiseconds(F.col("time_cs")))


def transfer_history(swims: DataFrame) -> DataFrame:
    """Clubs of each swimmer with first and last meet; spellings are one club, whose meets are summed up; current: the latest."""
    by_name = swims.groupBy("swimmer_id", "team").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("meet_id").alias("meets"))
    clubs = by_name.withColumn("club", team_key(F.col("team"))).groupBy("swimmer_id", "club").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("meets").alias("meets"))
    return clubs.withColumn("current", F.col("last") == F.max("last").over(Window.partitionBy("swimmer_id")))


def standards(m: Meets) -> DataFrame:
    """Qualifying times: A is 25 % over the base time, B 40 %."""
    rows = [(i, sex, pool, cut, round(base_seconds(name, sex, pool) * share)) for i, (name, _, _) in enumerate(EVENTS[:18], 1) for sex in "MF" for pool in BASE_TIMES for cut, share in (("A", 125), ("B", 140))]
    return m.spark.createDataFrame(rows, "event_id int, sex string, pool string, cut string, standard_cs long")


def qualifying_gaps(m: Meets, season: int) -> DataFrame:
    """The season's best (or that of all time, if there is none) against each cut."""
    best = m.swims.filter("time_cs > 0 and not is_relay").groupBy("swimmer_id", "sex", "event_id", "pool").agg(
        F.min(F.when(F.col("year") == season, F.col("time_cs"))).alias("season_cs"), F.min("time_cs").alias("ever_cs")
    )
    both = best.join(F.broadcast(standards(m)), ["event_id", "sex", "pool"]).withColumn("best", F.coalesce("season_cs", "ever_cs"))
    return both.select("swimmer_id", "event_id", "pool", "cut", "best", "standard_cs", (F.col("best") - F.col("standard_cs")).alias("gap_cs"), (F.col("best") <= F.col("standard_cs")).alias("qualified"))


def age_islands(swims: DataFrame) -> DataFrame:
    """Runs of consecutive ages in which a swimmer raced."""
    ages = swims.filter("age is not null").select("swimmer_id", "age").distinct()
    island = F.col("age") - F.row_number().over(Window.partitionBy("swimmer_id").orderBy("age"))
    return ages.withColumn("island", island).groupBy("swimmer_id", "island").agg(F.min("age").alias("from_age"), F.max("age").alias("to_age")).drop("island")


def laps(swims: DataFrame) -> DataFrame:
    """Steps between a swimmer's consecutive bests of the day, and how they change."""
    day = swims.filter("time_cs > 0").groupBy("swimmer_id", "event_id", "pool", "date").agg(F.min("time_cs").alias("time_cs"))
    w = Window.partitionBy("swimmer_id", "event_id", "pool").orderBy("date")
    step = day.withColumn("step", F.col("time_cs") - F.lag("time_cs").over(w))
    return step.withColumn("change", F.col("step") - F.last("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


THIS_YEAR = 2001
QUERIES = {
    "qy19_swimmer_events": events_of,
    "qy21_tier_histogram": lambda m: tier_histogram(m.swims),
    "qy21_season_best": lambda m: season_best(m.swims, THIS_YEAR),
    "qy22_compare": lambda m: compare(m.swims),
    "qy22_shared_events": lambda m: shared_events(m.swims),
    "qy23_progression": lambda m: progression(m.swims, ["swimmer_id"]),
    "qy24_transfer_history": lambda m: transfer_history(m.swims),
    "qy26_qualifying_gaps": lambda m: qualifying_gaps(m, THIS_YEAR),
    "qy29_country_progression": lambda m: progression(m.swims, ["nationality_id", "pool"], None),
    "qy41_standards": lambda m: standards(m).groupBy("cut", "pool").agg(F.count("*").alias("times"), F.min("standard_cs").alias("fastest")),
    "wn09_steps": lambda m: laps(m.swims),
    "wn10_age_islands": lambda m: age_islands(m.swims),
}

from poolside.plans.medals import KEY  # noqa: E402
from poolside.plans.rankings import TIME  # noqa: E402

STANDARDS = "standards(event_id, sex, pool, cut, standard_cs) AS (VALUES " + sql_values(
    [(i, sex, pool, cut, round(base_seconds(name, sex, pool) * share)) for i, (name, _, _) in enumerate(EVENTS[:18], 1) for sex in "MF" for pool in BASE_TIMES for cut, share in (("A", 125), ("B", 140))]
) + ")"
TIER_ROWS = ", ".join(f"({k}, {low}, '{name}')" for k, (low, name) in enumerate(TIERS, 1))
LAST = """SELECT *, row_number() OVER (PARTITION BY {keys}, event_id ORDER BY date) AS place, {time} AS time
FROM (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, event_id ORDER BY date DESC) AS k FROM days{where}) WHERE k <= 5)"""
SQL = {
    "qy19_swimmer_events": """, own AS (SELECT swimmer_id, event_id, pool, min(time_cs) AS best, count(*) AS swims FROM swims GROUP BY ALL),
legs AS (SELECT swimmer_id + i AS swimmer_id, event_id, pool, min(time_cs) AS best, count(*) AS swims FROM swims, range(1, 5) AS t(i) WHERE is_relay_team GROUP BY ALL)
SELECT *, FALSE AS as_leg FROM own UNION ALL SELECT *, TRUE FROM legs WHERE swimmer_id IN (SELECT swimmer_id FROM swimmers) AND (swimmer_id, event_id, pool) NOT IN (SELECT (swimmer_id, event_id, pool) FROM own)""",
    "qy21_tier_histogram": f""", tiers(tier, low, label) AS (VALUES {TIER_ROWS}),
n AS (SELECT swimmer_id, min(tier) AS tier FROM (SELECT *, row_number() OVER () AS k FROM swims WHERE points BETWEEN 100 AND 1200) JOIN tiers ON points >= low GROUP BY swimmer_id, k),
c AS (SELECT swimmer_id, tier, count(*) AS n FROM n GROUP BY ALL), span AS (SELECT swimmer_id, min(tier) AS a, max(tier) AS b FROM c GROUP BY ALL)
SELECT span.swimmer_id, tiers.tier, label, coalesce(n, 0) AS n FROM span JOIN tiers ON tiers.tier BETWEEN a AND b LEFT JOIN c ON c.swimmer_id = span.swimmer_id AND c.tier = tiers.tier""",
    "qy21_season_best": f"""SELECT swimmer_id, year AS season, points FROM (SELECT *, row_number() OVER (PARTITION BY swimmer_id ORDER BY year = {THIS_YEAR} DESC, year DESC) AS k
FROM (SELECT swimmer_id, year, max(points) AS points FROM swims WHERE points > 0 GROUP BY ALL)) WHERE k = 1""",
    "qy22_compare": """SELECT swimmer_id, count(*) AS results, count(DISTINCT meet_id) AS meets, max(points) AS best_points, round(avg(points) FILTER (points > 0), 6) AS mean_points, count(DISTINCT (event_id, pool)) AS events FROM swims GROUP BY ALL""",
    "qy22_shared_events": "SELECT nationality_id, event_id, pool, count(DISTINCT swimmer_id) AS swimmers, min(time_cs) AS best FROM swims GROUP BY ALL HAVING count(DISTINCT swimmer_id) >= 2",
    "qy23_progression": """, days AS (SELECT swimmer_id, event_id, date, min(time_cs) AS time_cs FROM swims WHERE time_cs > 0 GROUP BY ALL),
first_five AS (SELECT swimmer_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY swimmer_id ORDER BY best, event_id) AS k FROM (SELECT swimmer_id, event_id, min(time_cs) AS best FROM days GROUP BY ALL)) WHERE k <= 5)
"""
    + LAST.format(keys="swimmer_id", time=TIME.format("time_cs"), where=" SEMI JOIN first_five USING (swimmer_id, event_id)"),
    "qy24_transfer_history": f""", names AS (SELECT swimmer_id, team, {KEY} AS club, min(date) AS first, max(date) AS last, count(DISTINCT meet_id) AS meets FROM swims GROUP BY swimmer_id, team)
SELECT *, last = max(last) OVER (PARTITION BY swimmer_id) AS current FROM (SELECT swimmer_id, club, min(first) AS first, max(last) AS last, sum(meets)::BIGINT AS meets FROM names GROUP BY ALL)""",
    "qy26_qualifying_gaps": f""", {STANDARDS}
SELECT swimmer_id, event_id, pool, cut, best, standard_cs, best - standard_cs AS gap_cs, best <= standard_cs AS qualified
FROM (SELECT swimmer_id, sex, event_id, pool, coalesce(min(time_cs) FILTER (year = {THIS_YEAR}), min(time_cs)) AS best FROM swims WHERE time_cs > 0 AND NOT is_relay GROUP BY ALL) JOIN standards USING (event_id, sex, pool)""",
    "qy29_country_progression": """, days AS (SELECT nationality_id, pool, event_id, date, min(time_cs) AS time_cs FROM swims WHERE time_cs > 0 GROUP BY ALL)
"""
    + LAST.format(keys="nationality_id, pool", time=TIME.format("time_cs"), where=""),
    "qy41_standards": f", {STANDARDS} SELECT cut, pool, count(*) AS times, min(standard_cs) AS fastest FROM standards GROUP BY ALL",
    "wn09_steps": """, days AS (SELECT swimmer_id, event_id, pool, date, min(time_cs) AS time_cs FROM swims WHERE time_cs > 0 GROUP BY ALL),
steps AS (SELECT *, time_cs - lag(time_cs) OVER (PARTITION BY swimmer_id, event_id, pool ORDER BY date) AS step FROM days)
SELECT *, step - lag(step) OVER (PARTITION BY swimmer_id, event_id, pool ORDER BY date) AS change FROM steps""",
    "wn10_age_islands": """SELECT swimmer_id, min(age) AS from_age, max(age) AS to_age FROM (SELECT *, age - row_number() OVER (PARTITION BY swimmer_id ORDER BY age) AS island
FROM (SELECT DISTINCT swimmer_id, age FROM swims WHERE age IS NOT NULL)) GROUP BY swimmer_id, island""",
}
