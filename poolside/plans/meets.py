"""Statistics of meets; every query covers all meets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolside.operators.filters import deciding_round
from poolside.operators.ranking import top_n
from poolside.sources.tpch import Meets


def totals(swims: DataFrame) -> DataFrame:
    return swims.groupBy("meet_id").agg(
        F.count("*").alias("results"),
        F.count_distinct("swimmer_id").alias("swimmers"),
        F.count_distinct(F.when(F.col("sex") == "M", F.col("swimmer_id"))).alias("men"),
        F.count_distinct(F.when(F.col("sex") == "F", F.col("swimmer_id"))).alias("women"),
        F.count_distinct("nationality_id").alias("countries"),
        F.count_distinct("event_id").alias("events"),
    )


def by_event(swims: DataFrame) -> DataFrame:
    """Swims and swimmers by event and the gender that it is held for (mixed by name)."""
    gender = F.when(F.contains(F.lower("event"), F.lit("mixed")), "X").otherwise(F.col("sex")).alias("gender")
    return swims.groupBy("meet_id", "event_id", gender).agg(F.count("*").alias("results"), F.count_distinct("swimmer_id").alias("swimmers"))


def top_performers(swims: DataFrame, n: int = 30) -> DataFrame:
    """The best points of each swimmer and event, the first n of each meet."""
    best = swims.filter("points > 0").groupBy("meet_id", "swimmer_id", "event_id").agg(F.max("points").alias("points"), F.min("time_cs").alias("time_cs"))
    return top_n(best, ["meet_id"], n, F.desc("points"), "time_cs", "swimmer_id", "event_id")


def personal_bests_set(swims: DataFrame) -> DataFrame:
    """Swims of a meet that are the swimmer's best of all time in the event."""
    keys = ["swimmer_id", "event_id", "pool"]
    best = swims.filter("time_cs > 0").groupBy("meet_id", *keys).agg(F.min("time_cs").alias("time_cs"))
    return best.withColumn("best", F.min("time_cs").over(Window.partitionBy(*keys))).filter("time_cs = best").drop("best")


def most_improved(swims: DataFrame) -> DataFrame:
    """Best swims of a meet against the best before it (same swimmer, event and pool); null for a first entry.

    A window over days takes the place of a join with all earlier swims.
    """
    keys = ["swimmer_id", "event_id", "pool"]
    best = swims.filter(~F.col("is_hc") & (F.col("time_cs") > 0)).groupBy("meet_id", "date", *keys).agg(F.min("time_cs").alias("time_cs"))
    before = Window.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(Window.unboundedPreceding, -1)
    with_last = best.withColumn("before_cs", F.min("time_cs").over(before)).withColumn("gain_cs", F.col("before_cs") - F.col("time_cs"))
    improved = top_n(with_last.filter("gain_cs > 0"), ["meet_id"], 30, F.desc("gain_cs"), "time_cs", "swimmer_id", "event_id")
    new = top_n(with_last.filter("before_cs is null"), ["meet_id"], 20, "swimmer_id", "event_id", "time_cs")
    kind = lambda df, name: df.select("meet_id", F.lit(name).alias("kind"), *keys, "time_cs", "before_cs", "gain_cs", "rank")
    return kind(improved, "improved").unionByName(kind(new, "new"))


def editions(swims: DataFrame) -> DataFrame:
    """A meet beside the ten latest others of its pool and classification, by date."""
    each = swims.groupBy("classification", "pool", "meet_id", "date").agg(F.count("*").alias("results"), F.count_distinct("swimmer_id").alias("swimmers"), F.count_distinct("nationality_id").alias("countries"))
    other = each.withColumnRenamed("meet_id", "other_id")
    both = each.select("meet_id", "classification", "pool").join(other, ["classification", "pool"])
    own = top_n(both.withColumn("own", F.col("meet_id") == F.col("other_id")), ["meet_id", "own"], 10, F.desc("date"))
    return own.select("meet_id", "other_id", "date", "results", "swimmers", "countries", "own")


def club_swimmers(swims: DataFrame) -> DataFrame:
    """Each club's swimmers at a meet: their events and their best swim by points."""
    best = F.max_by(F.struct("event_id", "time_cs"), F.struct("points", -F.col("time_cs"), -F.col("event_id")))
    rows = swims.filter(~F.col("is_relay")).groupBy("meet_id", F.lower("team").alias("club"), "swimmer_id").agg(F.count_distinct("event_id").alias("events"), F.max("points").alias("points"), best.alias("b"))
    return rows.select("meet_id", "club", "swimmer_id", "events", "points", F.col("b.event_id").alias("best_event_id"), F.col("b.time_cs").alias("best_cs"))


def all_results(swims: DataFrame) -> DataFrame:
    """A meet's results by event, sex and round: how many, and the times in order."""
    times = F.array_join(F.transform(F.array_sort(F.collect_list("time_cs")), lambda t: t.cast("string")), " ")
    return swims.groupBy("meet_id", "event_id", "sex", "round_type").agg(F.count("*").alias("results"), times.alias("times"))


def deciding(swims: DataFrame) -> DataFrame:
    """How many results of each event decide it, and the best."""
    return deciding_round(swims, "meet_id", "event_id").groupBy("meet_id", "event_id", "sex", "round_type").agg(F.count("*").alias("results"), F.min("time_cs").alias("best"))


RESULT_ROWS = ("meet_id", "event_id", "sex", "round_type", "category", "swimmer_id", "team", "time_cs", "points", "is_hc")


def deciding_rows(swims: DataFrame) -> DataFrame:
    """The results that decide an event: those of its finals, else those of no round where there are any, else all.

    Which rounds an event has is a row for each, joined; so no task holds an event's results.
    """
    key = ["meet_id", "event_id"]
    rounds = swims.groupBy(*key).agg(F.bool_or(F.col("round_type") == "Finals").alias("finals"), F.bool_or(F.col("round_type") == "").alias("plain"))
    kept = F.when(F.col("finals"), F.col("round_type") == "Finals").when(F.col("plain"), F.col("round_type") != "Prelims").otherwise(F.lit(True))
    return swims.select(*RESULT_ROWS).join(rounds, key).filter(kept).select(*RESULT_ROWS)


def overview(m: Meets) -> DataFrame:
    """Meets with their host and counts of results and of Arab swimmers."""
    each = m.swims.groupBy("meet_id", "date", "pool", "classification", "host_id").agg(
        F.count("*").alias("results"), F.count_distinct(F.when(F.col("region") != "OTHER", F.col("swimmer_id"))).alias("swimmers")
    )
    return each.join(m.countries.select(F.col("nationality_id").alias("host_id"), F.col("country").alias("host")), "host_id", "left").withColumn("host", F.coalesce("host", F.lit(""))).drop("host_id")


def swims_of(f):
    return lambda m: f(m.swims)


QUERIES = {
    "qy11_meet_totals": swims_of(totals),
    "qy11_meet_events": swims_of(by_event),
    "qy11_meet_top_performers": swims_of(top_performers),
    "qy11_meet_personal_bests": swims_of(personal_bests_set),
    "qy12_most_improved": swims_of(most_improved),
    "qy13_edition_compare": swims_of(editions),
    "qy14_club_swimmers": swims_of(club_swimmers),
    "qy15_results_by_swimmer": lambda m: m.swims.groupBy("meet_id", "swimmer_id", (F.col("region") != "OTHER").alias("is_arab")).agg(F.count("*").alias("results")),
    "qy16_all_results": swims_of(all_results),
    "qy16_result_rows": lambda m: m.swims.select(*RESULT_ROWS),
    "qy17_deciding_rows": swims_of(deciding_rows),
    "qy17_deciding_round": swims_of(deciding),
    "qy18_meet_list": overview,
    "ag17_results_by_month": lambda m: m.swims.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("results"), F.count_distinct("meet_id").alias("meets")),
}

SQL = {
    "qy11_meet_totals": """SELECT meet_id, count(*) AS results, count(DISTINCT swimmer_id) AS swimmers, count(DISTINCT swimmer_id) FILTER (sex = 'M') AS men, count(DISTINCT swimmer_id) FILTER (sex = 'F') AS women,
count(DISTINCT nationality_id) AS countries, count(DISTINCT event_id) AS events FROM swims GROUP BY ALL""",
    "qy11_meet_events": "SELECT meet_id, event_id, CASE WHEN contains(lower(event), 'mixed') THEN 'X' ELSE sex END AS gender, count(*) AS results, count(DISTINCT swimmer_id) AS swimmers FROM swims GROUP BY ALL",
    "qy11_meet_top_performers": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meet_id ORDER BY points DESC, time_cs, swimmer_id, event_id) AS rank
FROM (SELECT meet_id, swimmer_id, event_id, max(points) AS points, min(time_cs) AS time_cs FROM swims WHERE points > 0 GROUP BY ALL)) WHERE rank <= 30""",
    "qy11_meet_personal_bests": """SELECT meet_id, swimmer_id, event_id, pool, time_cs FROM (SELECT *, min(time_cs) OVER (PARTITION BY swimmer_id, event_id, pool) AS best
FROM (SELECT meet_id, swimmer_id, event_id, pool, min(time_cs) AS time_cs FROM swims WHERE time_cs > 0 GROUP BY ALL)) WHERE time_cs = best""",
    "qy12_most_improved": """, best AS (SELECT meet_id, date, swimmer_id, event_id, pool, min(time_cs) AS time_cs FROM swims WHERE NOT is_hc AND time_cs > 0 GROUP BY ALL),
prior AS (SELECT b.meet_id, b.swimmer_id, b.event_id, b.pool, b.time_cs, min(p.time_cs) AS before_cs FROM best b LEFT JOIN best p ON p.swimmer_id = b.swimmer_id AND p.event_id = b.event_id AND p.pool = b.pool AND p.date < b.date GROUP BY ALL),
gains AS (SELECT *, before_cs - time_cs AS gain_cs FROM prior)
SELECT meet_id, 'improved' AS kind, swimmer_id, event_id, pool, time_cs, before_cs, gain_cs, rank FROM (SELECT *, row_number() OVER (PARTITION BY meet_id ORDER BY gain_cs DESC, time_cs, swimmer_id, event_id) AS rank FROM gains WHERE gain_cs > 0) WHERE rank <= 30
UNION ALL SELECT meet_id, 'new', swimmer_id, event_id, pool, time_cs, before_cs, gain_cs, rank FROM (SELECT *, row_number() OVER (PARTITION BY meet_id ORDER BY swimmer_id, event_id, time_cs) AS rank FROM gains WHERE before_cs IS NULL) WHERE rank <= 20""",
    "qy13_edition_compare": """, each AS (SELECT classification, pool, meet_id, date, count(*) AS results, count(DISTINCT swimmer_id) AS swimmers, count(DISTINCT nationality_id) AS countries FROM swims GROUP BY ALL),
pairs AS (SELECT a.meet_id, b.meet_id AS other_id, b.date, b.results, b.swimmers, b.countries, a.meet_id = b.meet_id AS own FROM each a JOIN each b USING (classification, pool))
SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY meet_id, own ORDER BY date DESC) AS k FROM pairs) WHERE k <= 10""",
    "qy14_club_swimmers": """SELECT meet_id, lower(team) AS club, swimmer_id, count(DISTINCT event_id) AS events, max(points) AS points,
arg_max(event_id, (points, -time_cs, -event_id)) AS best_event_id, arg_max(time_cs, (points, -time_cs, -event_id)) AS best_cs FROM swims WHERE NOT is_relay GROUP BY ALL""",
    "qy15_results_by_swimmer": "SELECT meet_id, swimmer_id, region <> 'OTHER' AS is_arab, count(*) AS results FROM swims GROUP BY ALL",
    "qy16_all_results": "SELECT meet_id, event_id, sex, round_type, count(*) AS results, string_agg(time_cs::VARCHAR, ' ' ORDER BY time_cs) AS times FROM swims GROUP BY ALL",
    "qy16_result_rows": f"SELECT {', '.join(RESULT_ROWS)} FROM swims",
    "qy17_deciding_rows": f"""SELECT {', '.join(RESULT_ROWS)} FROM (SELECT *, bool_or(round_type = 'Finals') OVER (PARTITION BY meet_id, event_id) AS finals, bool_or(round_type = '') OVER (PARTITION BY meet_id, event_id) AS plain FROM swims)
WHERE CASE WHEN finals THEN round_type = 'Finals' WHEN plain THEN round_type <> 'Prelims' ELSE TRUE END""",
    "qy17_deciding_round": """SELECT meet_id, event_id, sex, round_type, count(*) AS results, min(time_cs) AS best
FROM (SELECT *, bool_or(round_type = 'Finals') OVER w AS finals, bool_or(round_type = '') OVER w AS plain FROM swims WINDOW w AS (PARTITION BY meet_id, event_id))
WHERE CASE WHEN finals THEN round_type = 'Finals' WHEN plain THEN round_type <> 'Prelims' ELSE TRUE END GROUP BY ALL""",
    "qy18_meet_list": """SELECT meet_id, date, pool, classification, results, swimmers, coalesce(country, '') AS host
FROM (SELECT meet_id, date, pool, classification, host_id, count(*) AS results, count(DISTINCT swimmer_id) FILTER (region <> 'OTHER') AS swimmers FROM swims GROUP BY ALL) LEFT JOIN countries ON host_id = nationality_id""",
    "ag17_results_by_month": "SELECT strftime(date, '%Y-%m') AS month, count(*) AS results, count(DISTINCT meet_id) AS meets FROM swims GROUP BY ALL",
}
