"""Splits, legs and names as sources write them, read back; their SQL says what was written, not how it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.functions import written
from poolside.functions.times import format_centiseconds
from poolside.sources.tpch import Meets, sql_text

#: Names as sources write them, and as they are stored.
NAMES = [
    ("DORA BUKLU", "Dora BUKLU"), ("maha al shehhi", "Maha AL SHEHHI"), ("Malak MEQDAR", "Malak MEQDAR"), ("saba a a h sultan", "Saba A A H SULTAN"), ("PELÉ", "Pelé"),
    ("  sara   ben ali ", "Sara BEN ALI"), ("henri iv d'alger", "Henri IV D'ALGER"), ("john mcdonald smith", "John McDonald SMITH"), ("al ben", "Al BEN"), ("", ""),
]


def split_laps(m: Meets) -> DataFrame:
    """Laps of swims whose splits are written in one of three forms every 50 m: labelled, time first, or bare."""
    swims = m.swims.filter("not is_relay_team").select("swimmer_id", "meet_id", "event_id", "distance", "time_cs")
    n = (F.col("distance") / 50).cast("int")
    part = lambda i: F.when(i == n, F.col("time_cs")).otherwise((F.col("time_cs") * i / n).cast("long") - 37 * (i % 2))
    text, metres = lambda i: format_centiseconds(part(i)), lambda i: (50 * i).cast("string")
    form = F.col("swimmer_id") % 3
    one = lambda i: F.when(form == 0, F.concat(metres(i), F.lit("m: "), text(i))).when(form == 1, F.concat(text(i), F.lit(" ("), metres(i), F.lit("m)"))).otherwise(text(i))
    texts = F.transform(F.sequence(F.lit(1), n), one)
    read = swims.withColumn("lap", F.explode(written.laps(written.split_times(texts, F.col("distance")))))
    return read.select("swimmer_id", "meet_id", "event_id", "lap.distance", "lap.lap_cs", "lap.diff_cs")


def relay_legs(m: Meets) -> DataFrame:
    """Legs of relay squads out of texts with the swimmer's name and time; every third leg has no time."""
    swims = m.swims.filter("is_relay_team").select("swimmer_id", "meet_id", "event_id", "time_cs")
    one = lambda i: F.concat(F.lit("Leg "), F.col("swimmer_id").cast("string"), F.lit(" TAMER"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" "), format_centiseconds((F.col("time_cs") / 4).cast("long") + i))))
    texts = F.transform(F.sequence(F.lit(1), F.lit(4)), one)
    read = swims.select("*", F.posexplode(written.relay_legs(texts)).alias("place", "read"))
    return read.select("swimmer_id", "meet_id", "event_id", (F.col("place") + 1).alias("leg"), "read.name", F.col("read.time_cs").alias("leg_cs"))


def names(m: Meets) -> DataFrame:
    """Swimmers whose names are written in many ways, in the one way in which they are stored."""
    source = F.element_at(F.array(*(F.lit(w) for w, _ in NAMES)), (F.col("swimmer_id") % len(NAMES) + 1).cast("int"))
    return m.swimmers.select("swimmer_id", written.swimmer_name(source).alias("name"))


QUERIES = {"qy43_split_laps": split_laps, "sc36_relay_legs": relay_legs, "sc22_swimmer_names": names}
CUMULATIVE = "CASE WHEN {0} = n THEN time_cs WHEN {0} < 1 THEN 0 ELSE time_cs * ({0}) // n - 37 * (({0}) % 2) END"
SQL = {
    "qy43_split_laps": f""", parts AS (SELECT swimmer_id, meet_id, event_id, i, {CUMULATIVE.format("i")} AS t0, {CUMULATIVE.format("i - 1")} AS t1, {CUMULATIVE.format("i - 2")} AS t2
FROM (SELECT *, (distance // 50)::INT AS n FROM swims WHERE NOT is_relay_team), range(1, 31) AS r(i) WHERE i <= n)
SELECT swimmer_id, meet_id, event_id, (50 * i)::INT AS distance, (t0 - t1)::BIGINT AS lap_cs, CASE WHEN i > 1 THEN (t0 - 2 * t1 + t2)::BIGINT END AS diff_cs FROM parts""",
    "sc36_relay_legs": "SELECT swimmer_id, meet_id, event_id, i::INT AS leg, 'Leg ' || swimmer_id || ' TAMER' AS name, CASE WHEN i % 3 = 0 THEN 0 ELSE time_cs // 4 + i END::BIGINT AS leg_cs FROM swims, range(1, 5) AS r(i) WHERE is_relay_team",
    "sc22_swimmer_names": "SELECT swimmer_id, CASE swimmer_id % " + str(len(NAMES)) + " " + " ".join(f"WHEN {k} THEN {sql_text(kept)}" for k, (_, kept) in enumerate(NAMES)) + " END AS name FROM swimmers",
}
