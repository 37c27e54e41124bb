"""Histories and reports of swimmers and clubs, calendars, and checks of imported meets."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolside.functions.events import bands_conflict
from poolside.functions.names import team_key
from poolside.functions.times import format_centiseconds
from poolside.operators.filters import ARAB
from poolside.operators.ranking import best_swims, better_count, top_n
from poolside.plans.medals import AWARDED, COUNTS, INDIVIDUAL, KEY, individual, medals_of, tally
from poolside.plans.rankings import TIME
from poolside.plans.swimmers import LAST, progression
from poolside.sources.tpch import Meets, sql_values

AS_OF, BANDS = datetime.date(1998, 3, 1), (10, 12, 14, 16, 18)
HISTORY = ("event_id", "pool", "meet_id", "date", "round_type", "time_cs", "points", "team", "is_hc")


def event_history(m: Meets) -> DataFrame:
    """Every swim of a swimmer in an event, and those of relay squads that name the swimmer as one of their legs."""
    own = m.swims.select("swimmer_id", *HISTORY, F.lit(False).alias("as_leg"))
    legs = m.swims.filter("is_relay_team").withColumn("swimmer_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.col("swimmer_id") + i)))
    legs = legs.select("swimmer_id", *HISTORY, F.lit(True).alias("as_leg")).join(m.swimmers.select("swimmer_id"), "swimmer_id", "left_semi")
    return own.union(legs).withColumn("time", format_centiseconds(F.col("time_cs")))


def club_medals(m: Meets) -> DataFrame:
    """Medals of a club by where they were won, at home or abroad; meets of no class don't count."""
    won = medals_of(m).filter("classification != 'Other'")
    return tally("club", "national")(won.select(team_key(F.col("team")).alias("club"), (F.col("classification") == "National").alias("national"), "medal"))


def with_home(swims: DataFrame) -> DataFrame:
    """Swims with their club's key and the swimmer's home club: that of the latest meet, of several the first by name."""
    keyed = swims.withColumn("club", team_key(F.col("team")))
    home = F.min_by("club", F.struct(-F.unix_date("date"), F.col("club"))).over(Window.partitionBy("swimmer_id"))
    return keyed.filter("swimmer_id is not null").withColumn("home", home)


def club_times(swims: DataFrame) -> DataFrame:
    """The best swims of a club's roster by event, pool and sex, without those for other clubs."""
    return best_swims(with_home(swims).filter("club = home and time_cs > 0"), ["club", "event_id", "pool", "sex"], [])


def shares(m: Meets) -> DataFrame:
    """Medals per start in per cent, at most 100, and the share of gold with one decimal; halves go up."""
    won = tally("swimmer_id")(individual(m))
    starts = m.swims.groupBy("swimmer_id").agg(F.count("*").alias("starts"))
    per_start = F.least(F.lit(100), F.floor(100 * F.col("total") / F.col("starts") + 0.5)).cast("int")
    return won.join(starts, "swimmer_id").select("swimmer_id", "starts", "total", per_start.alias("medal_pct"), (F.floor(1000 * F.col("gold") / F.col("total") + 0.5) / 10).alias("gold_share"))


def band_rankings(swims: DataFrame) -> DataFrame:
    """Places of Arab swimmers by age band: 1 + how many are faster among swims at most that old; every band that a swim is in counts it."""
    rows = swims.filter(F.col("region").isin(*ARAB) & ~F.col("is_hc") & ~F.col("is_relay") & (F.col("time_cs") > 0) & F.col("age").isNotNull())
    by_age = rows.groupBy("swimmer_id", "event_id", "sex", "pool", "age").agg(F.min("time_cs").alias("time_cs"))
    each = by_age.withColumn("band", F.explode(F.filter(F.array(*map(F.lit, BANDS)), lambda b: b >= F.col("age"))))
    best = each.groupBy("swimmer_id", "event_id", "sex", "pool", "band").agg(F.min("time_cs").alias("best"))
    return better_count(best, ["event_id", "sex", "pool", "band"], "best")


def event_places(swims: DataFrame) -> DataFrame:
    """Shared places of an event's round; swims out of competition have none."""
    place = F.rank().over(Window.partitionBy("meet_id", "event_id", "sex", "category", "round_type", "is_hc").orderBy("time_cs"))
    return swims.select("meet_id", "event_id", "sex", "category", "round_type", "swimmer_id", "time_cs", "is_hc", F.when(~F.col("is_hc"), place).alias("place"))


def country_stars(swims: DataFrame, first: int = 400, n: int = 12) -> DataFrame:
    """Of a country's ``first`` swims by points, each swimmer's best, ``n`` of them; the limit is part of the question."""
    best = top_n(swims.filter("points > 0").select("nationality_id", "swimmer_id", "points"), ["nationality_id"], first, F.desc("points"), "swimmer_id")
    each = best.groupBy("nationality_id", "swimmer_id").agg(F.max("points").alias("points"))
    return top_n(each, ["nationality_id"], n, F.desc("points"), "swimmer_id")


def record_swims(swims: DataFrame) -> DataFrame:
    """All swims that equal the record of their event, sex and pool."""
    keys = ["event_id", "sex", "pool"]
    rows = swims.filter("time_cs > 0 and not is_hc").select(*keys, "swimmer_id", "date", "time_cs")
    return rows.join(rows.groupBy(*keys).agg(F.min("time_cs").alias("time_cs")), [*keys, "time_cs"])


def band_conflicts(swims: DataFrame, days: int = 400) -> DataFrame:
    """Swimmers that raced in two categories that exclude each other within ``days``: how often, and when first. Meets of a category count once.

    Days are joined by buckets of ``days``, own and neighbouring ones, so a long career isn't paired with itself.
    """
    bucket = F.floor(F.unix_date("date") / days)
    at = swims.filter("category != ''").select("swimmer_id", "category", "date").distinct().withColumn("bucket", bucket)
    other = at.select("swimmer_id", F.col("category").alias("other"), F.col("date").alias("then"), F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)])).alias("bucket"))
    near = at.join(other, ["swimmer_id", "bucket"]).filter((F.col("category") < F.col("other")) & (F.abs(F.date_diff("date", "then")) <= days))
    near = near.filter(bands_conflict(F.col("category"), F.col("other")))
    return near.groupBy("swimmer_id").agg(F.count("*").alias("conflicts"), F.min(F.least("date", "then")).alias("first"))


def round_overlap(swims: DataFrame, least: float = 0.8) -> DataFrame:
    """How much of the smaller of two rounds, heats and finals, is in the other one; repeated: so much that they may be one list read twice."""
    keys = ["meet_id", "event_id", "sex"]
    flags = swims.filter("round_type != ''").groupBy(*keys, "swimmer_id").agg(F.max(F.col("round_type") == "Finals").alias("f"), F.max(F.col("round_type") == "Prelims").alias("p"))
    n = flags.groupBy(*keys).agg(F.count_if("f").alias("finals"), F.count_if("p").alias("prelims"), F.count_if(F.col("f") & F.col("p")).alias("shared")).filter("finals > 0 and prelims > 0")
    return n.withColumn("repeated", F.col("shared") >= least * F.least("finals", "prelims"))


def meet_pairs(swims: DataFrame) -> DataFrame:
    """Pairs of meets with results in common (swimmer, event, time), and what that says of them; a result that a meet repeats counts once."""
    rows = swims.filter("time_cs > 0").select("meet_id", "pool", "swimmer_id", "event_id", "time_cs").distinct()
    n = rows.groupBy("meet_id").agg(F.count("*").alias("n"))
    other = rows.select(F.col("meet_id").alias("other_id"), F.col("pool").alias("other_pool"), "swimmer_id", "event_id", "time_cs")
    pairs = rows.join(other, ["swimmer_id", "event_id", "time_cs"]).filter("meet_id < other_id").groupBy("meet_id", "other_id", "pool", "other_pool").agg(F.count("*").alias("shared"))
    both = pairs.join(n, "meet_id").join(n.select(F.col("meet_id").alias("other_id"), F.col("n").alias("other_n")), "other_id")
    kind = F.when(F.col("pool") != F.col("other_pool"), "different_pool").when(F.col("shared") == F.greatest("n", "other_n"), "exact_duplicate").otherwise("partial_new")
    return both.select("meet_id", "other_id", "shared", "n", "other_n", kind.alias("kind"))


def month_summary(swims: DataFrame) -> DataFrame:
    """Meets, swims and athletes by month of the year; squads count as athletes here."""
    return swims.groupBy(F.month("date").alias("month")).agg(F.count_distinct("meet_id").alias("meets"), F.count("*").alias("swims"), F.count_distinct("swimmer_id").alias("athletes"))


def upcoming(swims: DataFrame, as_of: datetime.date, n: int = 5) -> DataFrame:
    """The next meets from a day on, with the days until them."""
    meets = swims.filter(F.col("date") >= F.lit(as_of)).select("meet_id", "date", "pool", "classification").distinct()
    return meets.withColumn("days", F.date_diff("date", F.lit(as_of)).cast("long")).orderBy("date", "meet_id").limit(n)


def teams_from_clubs(swims: DataFrame) -> DataFrame:
    """A team for each club key: its most frequent spelling, of several the first, how many swims and spellings."""
    spelled = swims.groupBy("team").agg(F.count("*").alias("n")).withColumn("key", team_key(F.col("team")))
    return spelled.groupBy("key").agg(F.min_by("team", F.struct(-F.col("n"), F.col("team"))).alias("name"), F.sum("n").alias("swims"), F.count("*").alias("spellings"))


def with_club(swims: DataFrame) -> DataFrame:
    return swims.withColumn("club", team_key(F.col("team")))


def year_ranking(swims: DataFrame, year: Column, n: int = 50) -> DataFrame:
    """A year's ranking by event and sex; the year is a range of days, which filters can carry to the scan."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    rows = swims.filter((F.col("date") >= first) & (F.col("date") < F.make_date(year + 1, F.lit(1), F.lit(1))) & (F.col("time_cs") > 0) & ~F.col("is_relay_team"))
    return top_n(rows.groupBy("event_id", "sex", "swimmer_id").agg(F.min("time_cs").alias("best")), ["event_id", "sex"], n, "best", "swimmer_id")


QUERIES = {
    "qy20_event_history": event_history,
    "qy31_club_medals": club_medals,
    "qy32_club_times": lambda m: club_times(m.swims),
    "qy33_club_progression": lambda m: progression(with_club(m.swims), ["club", "stroke"], None),
    "ag16_shares": shares,
    "wn02_band_rankings": lambda m: band_rankings(m.swims),
    "wn04_event_places": lambda m: event_places(m.swims),
    "wn07_country_stars": lambda m: country_stars(m.swims),
    "fl02_year_ranking": lambda m: year_ranking(m.swims, F.lit(1997)),
    "fl21_record_swims": lambda m: record_swims(m.swims),
    "jn15_band_conflicts": lambda m: band_conflicts(m.swims),
    "ag20_round_overlap": lambda m: round_overlap(m.swims),
    "qy38_meet_pairs": lambda m: meet_pairs(m.swims),
    "qy27_month_summary": lambda m: month_summary(m.swims),
    "qy46_upcoming": lambda m: upcoming(m.swims, AS_OF),
    "cl14_teams_from_clubs": lambda m: teams_from_clubs(m.swims),
}

CLUBS = f", clubbed AS (SELECT *, {KEY} AS club FROM swims)"
SQL = {
    "qy20_event_history": f"""SELECT swimmer_id, {", ".join(HISTORY)}, FALSE AS as_leg, {TIME.format("time_cs")} AS time FROM swims
UNION ALL SELECT swimmer_id + i, {", ".join(HISTORY)}, TRUE, {TIME.format("time_cs")} FROM swims, range(1, 5) AS t(i) WHERE is_relay_team AND swimmer_id + i IN (SELECT swimmer_id FROM swimmers)""",
    "qy31_club_medals": AWARDED + f"SELECT {KEY} AS club, classification = 'National' AS national, {COUNTS} FROM medal_rows WHERE classification <> 'Other' GROUP BY 1, 2",
    "qy32_club_times": CLUBS
    + """, homes AS (SELECT swimmer_id, club AS home FROM (SELECT swimmer_id, club, row_number() OVER (PARTITION BY swimmer_id ORDER BY date DESC, club) AS k FROM clubbed) WHERE k = 1)
SELECT club, event_id, pool, sex, time_cs, date, swimmer_id FROM (SELECT *, row_number() OVER (PARTITION BY club, event_id, pool, sex ORDER BY time_cs, date, swimmer_id) AS k
FROM clubbed JOIN homes USING (swimmer_id) WHERE club = home AND time_cs > 0) WHERE k = 1""",
    "qy33_club_progression": CLUBS + ", days AS (SELECT club, stroke, event_id, date, min(time_cs) AS time_cs FROM clubbed WHERE time_cs > 0 GROUP BY ALL)\n" + LAST.format(keys="club, stroke", time=TIME.format("time_cs"), where=""),
    "ag16_shares": AWARDED
    + f"""SELECT swimmer_id, starts, total, least(100, floor(100.0 * total / starts + 0.5))::INT AS medal_pct, floor(1000.0 * gold / total + 0.5) / 10 AS gold_share
FROM (SELECT swimmer_id, {COUNTS} {INDIVIDUAL} GROUP BY ALL) JOIN (SELECT swimmer_id, count(*) AS starts FROM swims GROUP BY ALL) USING (swimmer_id)""",
    "wn02_band_rankings": f""", best AS (SELECT swimmer_id, event_id, sex, pool, band, min(time_cs) AS best FROM swims JOIN (VALUES {sql_values([(b,) for b in BANDS])}) AS b(band) ON age <= band
WHERE region IN ('ARAB', 'GCC') AND NOT is_hc AND NOT is_relay AND time_cs > 0 GROUP BY ALL)
SELECT *, rank() OVER (PARTITION BY event_id, sex, pool, band ORDER BY best) AS rank, count(*) OVER (PARTITION BY event_id, sex, pool, band) AS total FROM best""",
    "wn04_event_places": """SELECT meet_id, event_id, sex, category, round_type, swimmer_id, time_cs, is_hc, CASE WHEN NOT is_hc THEN 1 + count(*) FILTER (NOT is_hc) OVER (PARTITION BY meet_id, event_id, sex, category, round_type ORDER BY time_cs RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS place FROM swims""",
    "wn07_country_stars": """SELECT nationality_id, swimmer_id, points, rank FROM (SELECT *, row_number() OVER (PARTITION BY nationality_id ORDER BY points DESC, swimmer_id) AS rank
FROM (SELECT nationality_id, swimmer_id, max(points) AS points FROM (SELECT *, row_number() OVER (PARTITION BY nationality_id ORDER BY points DESC, swimmer_id) AS k FROM swims WHERE points > 0) WHERE k <= 400 GROUP BY ALL)) WHERE rank <= 12""",
    "fl02_year_ranking": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, sex ORDER BY best, swimmer_id) AS rank
FROM (SELECT event_id, sex, swimmer_id, min(time_cs) AS best FROM swims WHERE year = 1997 AND time_cs > 0 AND NOT is_relay_team GROUP BY ALL)) WHERE rank <= 50""",
    "fl21_record_swims": """, legal AS (SELECT * FROM swims WHERE time_cs > 0 AND NOT is_hc)
SELECT event_id, sex, pool, swimmer_id, date, time_cs FROM legal WHERE (event_id, sex, pool, time_cs) IN (SELECT (event_id, sex, pool, min(time_cs)) FROM legal GROUP BY event_id, sex, pool)""",
    "jn15_band_conflicts": """, spells AS (SELECT DISTINCT swimmer_id, category, date FROM swims WHERE category <> '')
SELECT a.swimmer_id, count(*) AS conflicts, min(least(a.date, b.date)) AS first FROM spells a JOIN spells b ON a.swimmer_id = b.swimmer_id AND a.category < b.category AND abs(a.date - b.date) <= 400 GROUP BY ALL""",
    "ag20_round_overlap": """, f AS (SELECT DISTINCT meet_id, event_id, sex, swimmer_id FROM swims WHERE round_type = 'Finals'), p AS (SELECT DISTINCT meet_id, event_id, sex, swimmer_id FROM swims WHERE round_type = 'Prelims'),
b AS (SELECT meet_id, event_id, sex, count(*) AS n FROM f JOIN p USING (meet_id, event_id, sex, swimmer_id) GROUP BY ALL)
SELECT fs.meet_id, fs.event_id, fs.sex, fs.n AS finals, ps.n AS prelims, coalesce(b.n, 0) AS shared, coalesce(b.n, 0) >= 0.8 * least(fs.n, ps.n) AS repeated
FROM (SELECT meet_id, event_id, sex, count(*) AS n FROM f GROUP BY ALL) fs JOIN (SELECT meet_id, event_id, sex, count(*) AS n FROM p GROUP BY ALL) ps USING (meet_id, event_id, sex) LEFT JOIN b USING (meet_id, event_id, sex)""",
    "qy38_meet_pairs": """, r AS (SELECT DISTINCT meet_id, pool, swimmer_id, event_id, time_cs FROM swims WHERE time_cs > 0), n AS (SELECT meet_id, count(*) AS n FROM r GROUP BY ALL),
pairs AS (SELECT a.meet_id, b.meet_id AS other_id, a.pool <> b.pool AS apart, count(*) AS shared FROM r a JOIN r b USING (swimmer_id, event_id, time_cs) WHERE a.meet_id < b.meet_id GROUP BY ALL)
SELECT p.meet_id, other_id, shared, x.n, y.n AS other_n, CASE WHEN apart THEN 'different_pool' WHEN shared = greatest(x.n, y.n) THEN 'exact_duplicate' ELSE 'partial_new' END AS kind FROM pairs p JOIN n x ON x.meet_id = p.meet_id JOIN n y ON y.meet_id = other_id""",
    "qy27_month_summary": "SELECT month(date)::INT AS month, count(DISTINCT meet_id) AS meets, count(*) AS swims, count(DISTINCT swimmer_id) AS athletes FROM swims GROUP BY 1",
    "qy46_upcoming": f"SELECT DISTINCT meet_id, date, pool, classification, date - DATE '{AS_OF}' AS days FROM swims WHERE date >= DATE '{AS_OF}' ORDER BY date, meet_id LIMIT 5",
    "cl14_teams_from_clubs": f""", s AS (SELECT team, {KEY} AS key, count(*) AS n FROM swims GROUP BY team)
SELECT key, arg_min(team, (-n, team)) AS name, sum(n)::BIGINT AS swims, count(*) AS spellings FROM s GROUP BY key""",
}
