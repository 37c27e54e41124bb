"""Lists, searches and pages, and what has no partner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolside import refdata
from poolside.operators.filters import list_query
from poolside.plans.medals import AWARDED, individual
from poolside.sources.tables import unused
from poolside.sources.tpch import Meets


def swimmer_search(m: Meets, text: str) -> DataFrame:
    """The first 20 swimmers by name that hold every word; no relay squads, none of region OTHER."""
    people = m.swimmers.filter("not is_relay_team and region != 'OTHER'").select("swimmer_id", "swimmer", "country")
    return list_query(people, search=text, search_in=("swimmer", "country"), order=[F.col("swimmer"), F.col("swimmer_id")], size=20)


def meet_page(m: Meets, page: int, size: int = 25) -> DataFrame:
    """A page of meets, the latest first, with the number of all."""
    meets = m.swims.groupBy("meet_id", "date", "pool").agg(F.count("*").alias("results"))
    return list_query(meets, order=[F.desc("date"), F.col("meet_id")], page=page, size=size).withColumn("total", F.lit(meets.count()).cast("long"))


def split_candidates(swims: DataFrame) -> DataFrame:
    """Swimmers in several age categories at one meet, who may be two people."""
    banded = swims.filter("category in ('Cadets', 'Minimes', 'Juniors', 'Seniors') and not is_relay_team")
    return banded.groupBy("swimmer_id", "meet_id").agg(F.count_distinct("category").alias("categories")).filter("categories > 1")


def progression_table(swims: DataFrame) -> DataFrame:
    """By swimmer, event and pool: the best, the first, the latest and what lies between these."""
    day = swims.filter("time_cs > 0").groupBy("swimmer_id", "event_id", "pool", "date").agg(F.min("time_cs").alias("t"))
    table = day.groupBy("swimmer_id", "event_id", "pool").agg(F.min("t").alias("best"), F.min_by("t", "date").alias("first"), F.max_by("t", "date").alias("latest"))
    return table.withColumn("gain", F.col("first") - F.col("latest"))


def category_tabs(swims: DataFrame) -> DataFrame:
    """The categories of each event in their order: the oldest first, those without a name last."""
    order = {"Open": 0, "Seniors": 1, "Juniors": 2, "Cadets": 3, "Minimes": 4}
    place = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("category")), F.lit(99))
    tabs = swims.select("event_id", "category", place.alias("k")).distinct()
    return tabs.withColumn("tab", F.row_number().over(Window.partitionBy("event_id").orderBy("k", "category")).cast("long")).drop("k")


QUERIES = {
    "fl04_swimmer_search": lambda m: swimmer_search(m, "CUSTOMER 7"),
    "sl04_meet_page": lambda m: meet_page(m, 2),
    "fl22_events_with_results": lambda m: refdata.events(m.spark).join(m.swims.select("event_id").distinct(), "event_id", "left_semi").select("event_id", "event", "sort_order"),
    "jn06_orphan_swimmers": lambda m: unused(m.swimmers, "swimmer_id", [(m.swims, "swimmer_id")]).select("swimmer_id", "swimmer"),
    "ag07_split_candidates": lambda m: split_candidates(m.swims),
    "qy10_medal_list": lambda m: individual(m).filter("medal = 'GOLD' and classification = 'Arab'").select("meet_id", "event_id", "swimmer_id", "country", "time_cs"),
    "qy44_category_tabs": lambda m: category_tabs(m.swims),
    "qy47_progression_table": lambda m: progression_table(m.swims),
}

SQL = {
    "fl04_swimmer_search": """SELECT swimmer_id, swimmer, country FROM swimmers WHERE NOT is_relay_team AND region <> 'OTHER'
AND (contains(lower(swimmer), 'customer') OR contains(lower(country), 'customer')) AND (contains(lower(swimmer), '7') OR contains(lower(country), '7')) ORDER BY swimmer, swimmer_id LIMIT 20""",
    "sl04_meet_page": ", m AS (SELECT meet_id, date, pool, count(*) AS results FROM swims GROUP BY ALL) SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY date DESC, meet_id LIMIT 25 OFFSET 25",
    "fl22_events_with_results": "SELECT event_id, event, sort_order FROM events WHERE event_id IN (SELECT event_id FROM swims)",
    "jn06_orphan_swimmers": "SELECT swimmer_id, swimmer FROM swimmers WHERE swimmer_id NOT IN (SELECT swimmer_id FROM swims)",
    "ag07_split_candidates": "SELECT swimmer_id, meet_id, count(DISTINCT category) AS categories FROM swims WHERE category <> '' AND NOT is_relay_team GROUP BY ALL HAVING count(DISTINCT category) > 1",
    "qy10_medal_list": AWARDED + "SELECT meet_id, event_id, swimmer_id, country, time_cs FROM medals WHERE NOT matched AND region <> 'OTHER' AND medal = 'GOLD' AND classification = 'Arab'",
    "qy44_category_tabs": """SELECT event_id, category, row_number() OVER (PARTITION BY event_id ORDER BY k, category) AS tab
FROM (SELECT DISTINCT event_id, category, CASE category WHEN 'Open' THEN 0 WHEN 'Seniors' THEN 1 WHEN 'Juniors' THEN 2 WHEN 'Cadets' THEN 3 WHEN 'Minimes' THEN 4 ELSE 99 END AS k FROM swims)""",
    "qy47_progression_table": """SELECT *, first - latest AS gain FROM (SELECT swimmer_id, event_id, pool, min(t) AS best, arg_min(t, date) AS first, arg_max(t, date) AS latest
FROM (SELECT swimmer_id, event_id, pool, date, min(time_cs) AS t FROM swims WHERE time_cs > 0 GROUP BY ALL) GROUP BY ALL)""",
}
