"""Rankings, records and the gaps to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.functions.times import format_centiseconds
from poolside.operators.filters import ARAB, in_age_group, in_scope
from poolside.operators.ranking import best_swims, better_count, personal_bests, top_n
from poolside.refdata import BANDS
from poolside.sources.tpch import Meets

PAGE = 50


def ranking(swims: DataFrame, scope: str = "", country: int | None = None, gender: str | None = None, year: int | None = None, pool: str | None = None, age_group: str | None = None, page: int = 1) -> DataFrame:
    """A page of each event's ranking by sex: best time of each swimmer, ties by swimmer. HC swims count here."""
    for column, value in (("sex", gender), ("year", year), ("pool", pool)):
        if value is not None:
            swims = swims.filter(F.col(column) == value)
    swims = in_age_group(in_scope(swims, scope, country), age_group)
    best = personal_bests(swims, "event_id", "sex", "swimmer_id", "swimmer", "country")
    return top_n(best, ["event_id", "sex"], page * PAGE, "best", "swimmer_id").filter(F.col("rank") > (page - 1) * PAGE).withColumn("time", format_centiseconds(F.col("best")))


def computed_records(swims: DataFrame) -> DataFrame:
    """The fastest swim of each event, sex and pool: not HC; ties go to the earlier date."""
    return best_swims(swims.filter(~F.col("is_hc") & (F.col("time_cs") > 0)), ["event_id", "sex", "pool"], ["nationality_id"])


def with_scopes(swims: DataFrame) -> DataFrame:
    """Each swim once for each scope that it is in (national, arab, gcc), with the scope's country."""
    none = F.lit(None).cast("int")
    scopes = F.array(
        F.struct(F.lit("national").alias("scope"), F.col("nationality_id").cast("int").alias("scope_id")),
        F.when(F.col("region").isin(*ARAB), F.struct(F.lit("arab").alias("scope"), none.alias("scope_id"))),
        F.when(F.col("region") == "GCC", F.struct(F.lit("gcc").alias("scope"), none.alias("scope_id"))),
    )
    return swims.withColumn("_s", F.explode(F.filter(scopes, lambda s: s.isNotNull()))).select("*", "_s.*").drop("_s")


def records_held(swims: DataFrame) -> DataFrame:
    """Who holds which record, over scopes and age bands; one row for each swim, with the bands it holds.

    Best swims by age come first, so bands multiply few rows.
    """
    swims = swims.filter(~F.col("is_hc") & (F.col("time_cs") > 0) & F.col("region").isin(*ARAB))
    by_age = best_swims(swims, ["event_id", "sex", "pool", "nationality_id", "region", "age"], [])
    by_scope = best_swims(with_scopes(by_age), ["scope", "scope_id", "pool", "event_id", "sex", "age"], [])
    bands = F.array(*(F.lit(b).cast("int") for b in BANDS))
    by_band = by_scope.withColumn("band", F.explode(F.filter(bands, lambda b: b.isNull() | (F.col("age") <= b))))
    leaders = best_swims(by_band, ["scope", "scope_id", "pool", "event_id", "sex", "band"], [])
    name = F.struct(F.coalesce("band", F.lit(99)).alias("n"), F.coalesce(F.concat(F.lit("U"), F.col("band")), F.lit("OPEN")).alias("band"))
    held = leaders.groupBy("swimmer_id", "scope", "pool", "event_id", "sex", "time_cs", "date").agg(F.array_sort(F.collect_list(name)).alias("b"))
    return held.select("swimmer_id", "scope", "pool", "event_id", "sex", "time_cs", "date", F.array_join("b.band", ",").alias("categories"))


def record_gaps(swims: DataFrame) -> DataFrame:
    """Each swimmer's best times against the records of the scopes that they are in."""
    swims = swims.filter((F.col("time_cs") > 0) & F.col("region").isin(*ARAB) & ~F.col("is_relay"))
    best = personal_bests(with_scopes(swims), "swimmer_id", "scope", "scope_id", "event_id", "sex", "pool")
    record = with_scopes(swims.filter(~F.col("is_hc"))).groupBy("scope", "scope_id", "event_id", "sex", "pool").agg(F.min("time_cs").alias("record_cs"))
    same = [best[c].eqNullSafe(record[c]) for c in ("scope", "scope_id", "event_id", "sex", "pool")]
    both = best.join(record, same).select(best["swimmer_id"], best["scope"], best["event_id"], best["pool"], "best", "record_cs")
    return both.withColumn("gap_cs", F.col("best") - F.col("record_cs")).withColumn("gap_pct", F.round((F.col("best") / F.col("record_cs") - 1) * 100, 4))


def swimmer_rankings(swims: DataFrame) -> DataFrame:
    """Each swimmer's place by event and pool in national, arab and gcc rankings: 1 + how many are faster."""
    best = personal_bests(with_scopes(swims.filter(~F.col("is_hc") & (F.col("time_cs") > 0) & ~F.col("is_relay"))), "swimmer_id", "scope", "scope_id", "event_id", "sex", "pool")
    return better_count(best, ["scope", "scope_id", "event_id", "sex", "pool"], "best").drop("sex")


def meets_swims(f):
    return lambda m: f(m.swims)


QUERIES = {
    "qy01_ranking": meets_swims(ranking),
    "qy01_ranking_arab_u18_lcm": lambda m: ranking(m.swims, "arab", pool="LCM", age_group="U18"),
    "qy02_computed_records": lambda m: computed_records(in_scope(m.swims, "arab")),
    "qy03_records_held": meets_swims(records_held),
    "qy04_record_gaps": meets_swims(record_gaps),
    "qy25_swimmer_rankings": meets_swims(swimmer_rankings),
}

TIME = "CASE WHEN {0} <= 0 THEN '' WHEN {0} >= 6000 THEN ({0} // 6000)::VARCHAR || ':' || lpad(({0} % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad(({0} % 100)::VARCHAR, 2, '0') ELSE ({0} // 100)::VARCHAR || '.' || lpad(({0} % 100)::VARCHAR, 2, '0') END"
RANKING = f"""SELECT *, {TIME.format("best")} AS time FROM (SELECT *, row_number() OVER (PARTITION BY event_id, sex ORDER BY best, swimmer_id) AS rank
FROM (SELECT event_id, sex, swimmer_id, swimmer, country, min(time_cs) AS best FROM swims WHERE {{}} GROUP BY ALL)) WHERE rank <= {PAGE}"""
SCOPED = """scopes AS (SELECT 'national' AS scope, nationality_id AS scope_id, * FROM swims UNION ALL SELECT 'arab', NULL, * FROM swims WHERE region IN ('ARAB', 'GCC') UNION ALL SELECT 'gcc', NULL, * FROM swims WHERE region = 'GCC')"""
SQL = {
    "qy01_ranking": RANKING.format("region <> 'OTHER'"),
    "qy01_ranking_arab_u18_lcm": RANKING.format("region IN ('ARAB', 'GCC') AND pool = 'LCM' AND age <= 18"),
    "qy02_computed_records": """SELECT event_id, sex, pool, time_cs, date, swimmer_id, nationality_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id, sex, pool ORDER BY time_cs, date, swimmer_id) AS k
FROM swims WHERE NOT is_hc AND time_cs > 0 AND region IN ('ARAB', 'GCC')) WHERE k = 1""",
    "qy03_records_held": f""", {SCOPED},
bands(band, n) AS (VALUES {", ".join(f"({'NULL' if b is None else b}, {b or 99})" for b in BANDS)}),
led AS (SELECT *, row_number() OVER (PARTITION BY scope, scope_id, pool, event_id, sex, n ORDER BY time_cs, date, swimmer_id) AS k
FROM scopes, bands WHERE NOT is_hc AND time_cs > 0 AND region IN ('ARAB', 'GCC') AND (band IS NULL OR age <= band))
SELECT swimmer_id, scope, pool, event_id, sex, time_cs, date, string_agg(coalesce('U' || band, 'OPEN'), ',' ORDER BY n) AS categories FROM led WHERE k = 1 GROUP BY ALL""",
    "qy04_record_gaps": f""", {SCOPED},
mine AS (SELECT swimmer_id, scope, scope_id, event_id, sex, pool, min(time_cs) AS best FROM scopes WHERE time_cs > 0 AND region IN ('ARAB', 'GCC') AND NOT is_relay GROUP BY ALL),
rec AS (SELECT scope, scope_id, event_id, sex, pool, min(time_cs) AS record_cs FROM scopes WHERE time_cs > 0 AND region IN ('ARAB', 'GCC') AND NOT is_relay AND NOT is_hc GROUP BY ALL)
SELECT swimmer_id, mine.scope, mine.event_id, mine.pool, best, record_cs, best - record_cs AS gap_cs, round((best / record_cs - 1) * 100, 4) AS gap_pct
FROM mine JOIN rec ON mine.scope = rec.scope AND mine.scope_id IS NOT DISTINCT FROM rec.scope_id AND mine.event_id = rec.event_id AND mine.sex = rec.sex AND mine.pool = rec.pool""",
    "qy25_swimmer_rankings": f""", {SCOPED}
SELECT swimmer_id, scope, scope_id, event_id, pool, best, rank() OVER w AS rank, count(*) OVER (PARTITION BY scope, scope_id, event_id, sex, pool) AS total
FROM (SELECT swimmer_id, scope, scope_id, event_id, sex, pool, min(time_cs) AS best FROM scopes WHERE NOT is_hc AND time_cs > 0 AND NOT is_relay GROUP BY ALL) WINDOW w AS (PARTITION BY scope, scope_id, event_id, sex, pool ORDER BY best)""",
}
