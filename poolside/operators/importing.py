"""From parsed results to the tables: who a row is within a meet, whose profile that is, and which results are written.

A batch is matched against one snapshot of the tables. Parsed rows have: meet_id, date, row (order within the meet),
event_id, round_type, category, name, birth_year (0 or null: unknown), club, sex, is_relay, time_cs, rank, points.
Tables: swimmers (swimmer_id, name, birth_year, club, sex, is_relay_team) and results (swimmer_id, meet_id, event_id,
round_type, category, team, time_cs, rank, points, date).

``identities`` and ``resolved`` keep order where the rule depends on it: what is folded are a name's identities (a row
for each meet and band, or year and club), a task at a time in sorted streams, and never a name's results.
New swimmers get ids above all others, in the order in which the batch has them: where several profiles fit, the
older one is taken, so a second import of the same rows finds what the first one made.
"""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolside.functions import events
from poolside.functions.names import match_key, sorted_key, strip_squad_number
from poolside.functions.resolve import is_team_name, relay_team
from poolside.operators.similar import clubs_equivalent
from poolside.sources.tables import held

#: Meets further apart say nothing about a category.
NEAR_DAYS = 400
WHO = ["meet_id", "upper_name"]


def known_year(year: Column) -> Column:
    return F.nullif(year.cast("int"), F.lit(0))


def near_bands(asked: DataFrame, results: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """asked (ask, swimmer_id, band, date) with conflicts and fits: whether a result within ``days`` has a band that conflicts, or one that doesn't.

    Days are joined by buckets of ``days``, own and neighbouring ones, so a long career isn't paired with itself.
    """
    has = results.select("swimmer_id", events.band(F.col("category")).alias("other"), F.col("date").alias("then")).filter("other != ''").distinct()
    bucket = lambda d: F.floor(F.unix_date(F.col(d)) / days)
    around = asked.withColumn("bucket", F.explode(F.when(F.col("date").isNotNull(), F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: bucket("date") + k)).otherwise(F.array(F.lit(None).cast("long")))))
    dated = around.join(has.withColumn("bucket", bucket("then")), ["swimmer_id", "bucket"]).filter(F.abs(F.date_diff("date", "then")) <= days)
    undated = asked.join(has.withColumnRenamed("date", "then").filter("then is null"), "swimmer_id").withColumn("bucket", F.lit(None).cast("long"))
    unknown = asked.filter("date is null").join(has.filter("then is not null"), "swimmer_id").withColumn("bucket", F.lit(None).cast("long"))
    names = [*asked.columns, "other"]
    conflict = events.bands_conflict(F.col("other"), F.col("band"))
    told = dated.select(*names).union(undated.select(*names)).union(unknown.select(*names)).groupBy("ask", "swimmer_id").agg(F.bool_or(conflict).alias("conflicts"), F.bool_or(~conflict).alias("fits"))
    return asked.join(told, ["ask", "swimmer_id"], "left").fillna(False, ["conflicts", "fits"])


def identities(parsed: DataFrame) -> DataFrame:
    """Individual rows with ``identity``: who of a name's bearers in the meet a row is.

    With a year: the year, and the club where it is another one than that of the year's first row. Without: the
    category's band; a broad category is the first bearer, and the first band after a broad one is that bearer, too.
    """
    rows = parsed.withColumn("name", F.coalesce("name", F.lit(""))).withColumns({"upper_name": F.upper("name"), "year": known_year(F.col("birth_year")), "band": events.band(F.col("category")), "club_key": F.upper(F.trim(F.coalesce("club", F.lit(""))))})
    dated, undated = rows.filter("year is not null"), rows.filter("year is null")
    clubs = dated.groupBy(*WHO, "year", "club_key").agg(F.min("row").alias("at"))
    first = clubs.groupBy(*WHO, "year").agg(F.min_by("club_key", "at").alias("first_club"))
    told = clubs_equivalent(clubs.join(first, [*WHO, "year"]), "club_key", "first_club", "same")
    other = (F.col("club_key") != "") & (F.col("first_club") != "") & ~F.col("same")
    of_year = told.select(*WHO, "year", "club_key", F.concat_ws("|", F.lit("Y"), "year", F.when(other, F.col("club_key"))).alias("identity"))
    bands = undated.groupBy(*WHO, "band").agg(F.min("row").alias("at"))
    order = Window.partitionBy(*WHO).orderBy("at")
    placed = bands.withColumns({"k": F.row_number().over(order), "first_band": F.first("band").over(order)})
    mine = F.when(F.col("band") == "", F.col("first_band")).when((F.col("first_band") == "") & (F.col("k") == 2), F.lit("")).otherwise(F.col("band"))
    of_band = placed.select(*WHO, "band", F.concat(F.lit("B|"), mine).alias("identity"))
    return dated.join(of_year, [*WHO, "year", "club_key"]).unionByName(undated.join(of_band, [*WHO, "band"]))


def candidates(asked: DataFrame, swimmers: DataFrame, results: DataFrame) -> DataFrame:
    """Per identity (ask), the profiles that its name allows, summed up: tier, n_exact, exact_id, club_id, near_id, near_score, free_id.

    tier: 0 the same name without regard to case, 1 the same key, 2 the same words; the lowest that has any. Frequent
    names are summed up to their years and clubs before the join, but for identities that ask by band.
    """
    keys = F.array(F.lower("name"), match_key(F.col("name")), sorted_key(F.col("name")))
    # held, as the years, clubs and first ones of a name read them, and words of names take long
    profiles = held(swimmers.filter("not is_relay_team").select("swimmer_id", known_year(F.col("birth_year")).alias("has_year"), F.coalesce("club", F.lit("")).alias("has_club"), F.posexplode(keys).alias("tier", "key")))
    asks = asked.select("ask", "year", "band", "club", "date", F.posexplode(keys).alias("tier", "key"))
    years = profiles.groupBy("tier", "key", "has_year").agg(F.min("swimmer_id").alias("first_id"), F.count("*").alias("n"))
    found = asks.filter("year is not null").join(years, ["tier", "key"])
    lowest = F.min("tier").over(Window.partitionBy("ask"))
    found = found.withColumn("low", lowest).filter("tier = low")
    exact, near = F.col("has_year") == F.col("year"), F.col("has_year").isNull() | (F.abs(F.col("has_year") - F.col("year")) <= 1)
    dated = found.groupBy("ask", "tier", "key", "year", "club").agg(
        F.sum(F.when(exact, F.col("n"))).alias("n_exact"), F.min(F.when(exact, F.col("first_id"))).alias("exact_id"),
        F.min(F.when(near, F.struct(F.col("first_id").alias("id"), F.when(F.col("has_year").isNull(), 95).otherwise(100).alias("score")))).alias("near"),
    )
    # several of one name and year: the club decides
    several = dated.filter("n_exact > 1 and trim(club) != ''").select("ask", "tier", "key", "year", "club")
    clubs = profiles.filter("has_year is not null").groupBy("tier", "key", F.col("has_year").alias("year"), "has_club").agg(F.min("swimmer_id").alias("club_id"))
    same = clubs_equivalent(several.join(clubs, ["tier", "key", "year"]), "club", "has_club", "same").filter("same").groupBy("ask").agg(F.min("club_id").alias("club_id"))
    none = F.lit(None).cast("long")
    of_years = dated.join(same, "ask", "left").select("ask", "tier", "n_exact", "exact_id", "club_id", F.col("near.id").alias("near_id"), F.col("near.score").alias("near_score"), none.alias("free_id"))
    # without a year the first one serves, but for those whose bands near the meet rule the row's band out
    firsts = profiles.groupBy("tier", "key").agg(F.min("swimmer_id").alias("free_id"))
    any_ = asks.filter("year is null and band = ''").join(firsts, ["tier", "key"]).groupBy("ask").agg(F.min(F.struct("tier", "free_id")).alias("x")).select("ask", "x.*")
    loose = asks.filter("year is null and band != ''").join(profiles.select("swimmer_id", "tier", "key"), ["tier", "key"]).withColumn("low", lowest).filter("tier = low")
    told = near_bands(loose.select("ask", "swimmer_id", "band", "date"), results).filter("conflicts and not fits").select("ask", "swimmer_id", F.lit(True).alias("no"))
    free = loose.join(told, ["ask", "swimmer_id"], "left").groupBy("ask", "tier").agg(F.min(F.when(F.col("no").isNull(), F.col("swimmer_id"))).alias("free_id"))
    of_bands = any_.unionByName(free).select("ask", "tier", *[none.alias(c) for c in ("n_exact", "exact_id", "club_id", "near_id")], F.lit(None).cast("int").alias("near_score"), "free_id")
    return of_years.unionByName(of_bands)


def match_profiles(rows: DataFrame, swimmers: DataFrame, results: DataFrame) -> DataFrame:
    """Per row (row, name, birth_year, club, category, date), by what the tables have: row, swimmer_id (null if new), confidence, match.

    With a year: the profile of that year (of several, that of an equivalent club, else the first), else the first of
    a year at most one apart (100) or of no known year (95), else a new swimmer. Without a year: the first whose
    bands near the date don't rule the row's category out (95), else a new one. Rows without a name are skipped.
    """
    asked = rows.select(F.col("row").alias("ask"), "name", known_year(F.col("birth_year")).alias("year"), events.band(F.col("category")).alias("band"), F.coalesce("club", F.lit("")).alias("club"), "date")
    hits = candidates(asked.filter("trim(name) != ''"), swimmers, results)
    picked = hits.select(F.col("ask").alias("row"), F.coalesce(F.when(F.col("n_exact") > 1, F.col("club_id")), "exact_id", "near_id", "free_id").alias("swimmer_id"), F.when(F.col("exact_id").isNotNull(), 100).when(F.col("near_id").isNotNull(), F.col("near_score")).otherwise(95).alias("score"))
    out = rows.select("row", (F.trim(F.coalesce("name", F.lit(""))) != "").alias("named")).join(picked, "row", "left")
    found = F.col("swimmer_id").isNotNull()
    return out.select("row", "swimmer_id", F.when(found, F.col("score")).otherwise(0).alias("confidence"), F.when(found, "exact").when(F.col("named"), "new").otherwise("skip").alias("match"))


ASKED = ("ask", "words", "name", "key", "upper_name", "meet_id", "date", "identity", "year", "bands", "club", "tier", "exact_id", "club_id", "near_id", "near_score", "free_id")


def folded(batches, clubs_alike):
    """Sorted identities to (ask, swimmer_id, confidence, match): a name's bearers in order, with the profiles made for earlier ones."""
    words, made, meet, claims, seen = None, [], None, [], {}
    for batch in batches:
        for ask, of, name, key, upper, at, date, identity, year, bands, club, tier, exact, by_club, near, score, free in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ASKED)):
            if of != words:
                words, made, meet, seen = of, [], None, {}
            if at != meet:
                meet, claims = at, []
            own = identity.removeprefix("B|") if identity.startswith("B|") else ""
            fresh = [(0 if p["name"] == name.lower() else 1 if p["key"] == key else 2, p) for p in made]
            low = min([t for t, _ in fresh] + ([tier] if tier is not None else []), default=None)
            fresh = [p for t, p in fresh if t == low]
            if tier != low:
                exact = by_club = near = free = None
            got, confidence = None, 0
            if year is not None:
                same = [p for p in fresh if p["year"] == year]
                near_fresh = next(((p["id"], 100 if p["year"] else 95) for p in fresh if p["year"] is None or abs(p["year"] - year) <= 1), None)
                if exact is not None or same:
                    alike = by_club if by_club is not None else next((p["id"] for p in same if club and (exact is not None or len(same) > 1) and clubs_alike(p["club"], club)), None)
                    got, confidence = alike if alike is not None else exact if exact is not None else same[0]["id"], 100
                elif near is not None:
                    got, confidence = near, score
                elif near_fresh:
                    got, confidence = near_fresh
            else:
                for one in ([free] if free is not None else []) + [p["id"] for p in fresh]:
                    if not held_apart(seen.get(one, ()), own, date):
                        got, confidence = one, 95
                        break
            for other, claimed in claims:
                if claimed == got and other[0] == upper and other[1] != identity:
                    if (other[1].startswith("B|") and conflict(other[1][2:], own)) or (other[1].startswith("Y|") and identity.startswith("Y|")):
                        got, confidence = None, 0
                        break
            kind = "exact"
            if got is None:
                got, kind = ask, "new"
                made.append({"id": ask, "name": name.lower(), "key": key, "year": year, "club": club})
            claims.append(((upper, identity), got))
            seen.setdefault(got, []).extend((b, date) for b in bands if b)
            yield ask, got, confidence, kind


def held_apart(seen, band: str, date: datetime.date | None) -> bool:
    """Whether all that a profile has near a date conflicts with a band."""
    near = [b for b, d in seen if not (d and date) or abs((d - date).days) <= NEAR_DAYS]
    return bool(band) and bool(near) and all(conflict(b, band) for b in near)


def conflict(a: str, b: str) -> bool:
    """``events.bands_conflict`` for the fold."""
    if not a or not b:
        return False
    one, two = ({t.strip() for t in x.upper().split("/")} for x in (a, b))
    if one & two:
        return False
    if one | two <= set(events.FRENCH_BANDS):
        return True
    ra, rb = age_range(a), age_range(b)
    return bool(ra and rb) and (ra[1] < rb[0] or rb[1] < ra[0])


def age_range(label: str) -> tuple[int, int] | None:
    """The ages of a label: the first two numbers with a hyphen between them, else a number with a plus."""
    numbers, at = [], 0
    while at < len(label):
        end = at
        while end < len(label) and label[end].isdecimal():
            end += 1
        if end > at:
            numbers.append((int(label[max(at, end - 2) : end]), label[end:].lstrip()[:1]))
        at = max(end, at + 1)
    for (low, sign), (high, _) in zip(numbers, numbers[1:]):
        if sign == "-":
            return low, high
    return next(((n, 99) for n, sign in numbers if sign == "+"), None)


def resolved(rows: DataFrame, swimmers: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of ``identities`` with swimmer_id (of a profile, or a new one), confidence and match (exact, new or skip: no name)."""
    named = rows.filter(F.trim("name") != "")
    one = named.groupBy(*WHO, "identity").agg(F.min("date").alias("date"), F.min("row").alias("at"), *[F.min_by(c, "row").alias(c) for c in ("name", "year", "club", "band")], F.collect_set("band").alias("bands"))
    one = one.withColumn("ask", F.xxhash64("upper_name", "meet_id", "identity").bitwiseAND((1 << 61) - 1).bitwiseOR(1 << 61))
    one = held(one.withColumns({"words": sorted_key(F.col("name")), "key": match_key(F.col("name")), "club": F.upper(F.trim(F.coalesce("club", F.lit(""))))}))
    asked = one.join(candidates(one, swimmers, results).drop("n_exact"), "ask", "left").select(*ASKED, "at")

    def run(batches):
        from poolside.operators.similar import ratio

        def alike(a, b):
            a, b = ("".join(c for c in x.upper() if c.isascii() and c.isalnum()) for x in (a, b))
            return bool(a and b) and (a == b or ratio(a, b, "block") >= 0.85)

        held = []
        for row in folded(batches, alike):
            held.append(row)
            if len(held) == 4096:
                yield pack(held)
                held = []
        if held:
            yield pack(held)

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["ask", "swimmer_id", "confidence", "match"])

    who = asked.repartition("words").sortWithinPartitions("words", "date", "meet_id", "at").mapInArrow(run, "ask long, swimmer_id long, confidence int, match string")
    of = one.select(*WHO, "identity", "ask").join(who, "ask").drop("ask")
    full = named.join(of, [*WHO, "identity"])
    blank = rows.filter(F.trim("name") == "").select("*", F.lit(None).cast("long").alias("swimmer_id"), F.lit(0).alias("confidence"), F.lit("skip").alias("match"))
    return full.unionByName(blank)


RESULT = ["swimmer_id", "meet_id", "event_id", "round_type", "category"]


def squads(parsed: DataFrame, swimmers: DataFrame) -> DataFrame:
    """Relay rows with the placeholder of their team: one for a team's name and sex, old or new; names that can't be a team's have none."""
    rows = parsed.withColumns({"team_name": relay_team(F.col("name")), "sex": F.coalesce(F.nullif("sex", F.lit("")), F.lit("M"))}).withColumn("upper_name", F.upper("team_name"))
    known = swimmers.groupBy(F.upper("name").alias("upper_name"), "sex").agg(F.min("swimmer_id").alias("known_id"))
    new = F.xxhash64("upper_name", "sex").bitwiseAND((1 << 61) - 1).bitwiseOR(1 << 61)
    found = rows.join(known, ["upper_name", "sex"], "left")
    return found.withColumns({"swimmer_id": F.when(is_team_name(F.col("team_name")), F.coalesce("known_id", new)), "match": F.when(~is_team_name(F.col("team_name")), "skip").when(F.col("known_id").isNull(), "new").otherwise("exact")})


SQUAD = "swimmer_id long, meet_id long, event_id int, round_type string, category string, team string, time_cs long, rank int, points int, date date, row long, action string"


def squad_results(batches):
    """Sorted stored and parsed squads, a team in an event at a time: stored rows as they become, and parsed ones with what was done."""
    names = [x.split()[0] for x in SQUAD.split(", ")]

    def done(rows):
        stored = [[*r, False] for r in rows if r[10] is None]
        for r in (r for r in rows if r[10] is not None):
            team, time = r[5], r[6]
            same = next((s for s in stored if s[6] == time), None)
            if same is not None:
                same[-1] = True
                action = "same time"
                if team and same[5] != team and not any(s[5].upper() == team.upper() and s[6] == time for s in stored):
                    same[5], action = team, "renamed"
            else:
                named = next((s for s in stored if s[5].upper() == team.upper() and not s[-1]), None)
                if named is not None:
                    named[5:9], named[-1], action = [team, *r[6:9]], True, "updated"
                else:
                    stored.append([*r[:10], None, None, True])
                    action = "inserted"
            yield (*r[:11], action)
        for s in stored:
            yield (*s[:10], None, None)

    held, key, out = [], None, []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            if row[:5] != key:
                out += done(held)
                held, key = [], row[:5]
            held.append(row)
            if len(out) > 4096:
                yield squad_batch(out, names)
                out = []
    out += done(held)
    if out:
        yield squad_batch(out, names)


def squad_batch(rows, names):
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.date32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def merged_squads(rows: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of relays after the rows, and what was done with each row.

    Squads of a club share a placeholder, so a time is what tells them apart: a stored row of the same time is the
    same squad's, and takes its name; else a stored row of the same name, which no other row has claimed, is an older
    import's and takes the time; else the squad is new. ``results`` are those of the placeholders' meets.
    """
    types = {n: t for n, t in (x.split() for x in SQUAD.split(", "))}
    both = results.select(*[F.col(c).cast(types[c]) for c in [*RESULT, "team", "time_cs", "rank", "points", "date"]], F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("action"))
    new = rows.select(*[F.col(c).cast(types[c]) for c in RESULT], F.trim(F.col("name")).alias("team"), *[F.col(c).cast(types[c]) for c in ("time_cs", "rank", "points", "date", "row")], F.lit(None).cast("string").alias("action"))
    full = both.union(new).repartition(*RESULT).sortWithinPartitions(*RESULT, F.col("row").asc_nulls_first(), "time_cs", "team").mapInArrow(squad_results, SQUAD)
    return full.filter("row is null").drop("row", "action"), full.filter("row is not null").select("meet_id", "row", "action")


def merged_swims(rows: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Individual results after the rows, and what was done with each: a swimmer's round keeps its best time, the first of equal ones.

    A row improves if it is faster than what is stored and than all rows before it. A better row without a team keeps
    the stored one, and one without points keeps theirs.
    """
    team = F.when(F.upper(strip_squad_number(F.col("club"))) == "LP", "LP").otherwise(strip_squad_number(F.col("club")))
    columns = [*RESULT, "team", "time_cs", "rank", "points", "date"]
    new = rows.select(*RESULT, team.alias("team"), "time_cs", "rank", "points", "date", "row")
    both = results.select(*columns, F.lit(-1).cast("long").alias("row")).unionByName(new)
    order = Window.partitionBy(*RESULT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("before", F.min("time_cs").over(order))
    told = F.when(F.col("before").isNull(), "inserted").when(F.col("time_cs") < F.col("before"), "improved").when(F.col("time_cs") == F.col("before"), "same time").otherwise("slower")
    first = F.struct("time_cs", "row")
    best = both.groupBy(*RESULT).agg(
        F.coalesce(F.nullif(F.min_by("team", first), F.lit("")), F.max(F.when(F.col("row") == -1, F.col("team"))), F.lit("")).alias("team"),
        F.min("time_cs").alias("time_cs"), F.min_by("rank", first).alias("rank"),
        F.coalesce(F.nullif(F.min_by("points", first), F.lit(0)), F.max(F.when(F.col("row") == -1, F.col("points")))).alias("points"), F.min("date").alias("date"),
    )
    return best.select(*columns), seen.filter("row >= 0").select("meet_id", "row", told.alias("action"))


def import_results(parsed: DataFrame, swimmers: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The tables after a batch: ``swimmers`` with new profiles, ``results`` merged, ``log`` (meet_id, row, swimmer_id, match, action).

    Results of meets that the batch doesn't touch are passed on as they are.
    """
    parsed = held(parsed)
    # each step that several later ones read is held, so that none is computed for each of its readers
    individual = held(resolved(held(identities(parsed.filter("not is_relay"))), swimmers, results))
    relay = held(squads(parsed.filter("is_relay"), swimmers))
    first = lambda df, key: df.filter("match = 'new'").groupBy("swimmer_id").agg(*[F.min(c).alias(c) for c in ("date", "meet_id", "row")], *[F.min_by(c, F.struct("date", "meet_id", "row")).alias(c) for c in key])
    people = first(individual, ("name", "year", "club", "sex")).select("swimmer_id", "date", "meet_id", "row", "name", F.col("year").alias("birth_year"), "club", "sex", F.lit(False).alias("is_relay_team"))
    placeholders = first(relay, ("team_name", "sex")).select("swimmer_id", "date", "meet_id", "row", F.col("team_name").alias("name"), F.lit(None).cast("int").alias("birth_year"), F.col("team_name").alias("club"), "sex", F.lit(True).alias("is_relay_team"))
    order = ["date", "meet_id", "row"]
    last = swimmers.agg(F.max("swimmer_id")).first()[0] or 0
    made = people.union(placeholders).repartitionByRange(*order).sortWithinPartitions(*order)
    made = held(made.withColumn("new_id", F.lit(last + 1) + F.monotonically_increasing_id()))
    new_ids = made.select("swimmer_id", "new_id")
    individual, relay = (df.join(new_ids, "swimmer_id", "left").withColumn("swimmer_id", F.coalesce("new_id", "swimmer_id")).drop("new_id") for df in (individual, relay))
    timed = (F.coalesce("time_cs", F.lit(0)) > 0) & F.col("swimmer_id").isNotNull()
    touched = parsed.select("meet_id").distinct()
    here, elsewhere = results.join(touched, "meet_id", "left_semi"), results.join(touched, "meet_id", "left_anti")
    teams = swimmers.filter("is_relay_team").select("swimmer_id")
    swims, swim_log = merged_swims(individual.filter(timed), here.join(teams, "swimmer_id", "left_anti"))
    legs, leg_log = merged_squads(relay.filter(timed), here.join(teams, "swimmer_id", "left_semi"))
    done = individual.select("meet_id", "row", "swimmer_id", "match", timed.alias("timed")).unionByName(relay.select("meet_id", "row", "swimmer_id", "match", timed.alias("timed")))
    why = F.when(F.col("match") == "skip", "no name").otherwise("no time")
    log = done.join(swim_log.unionByName(leg_log), ["meet_id", "row"], "left").select("meet_id", "row", "swimmer_id", "match", F.coalesce("action", why).alias("action"))
    profiles = made.withColumn("swimmer_id", F.col("new_id")).select("swimmer_id", "name", "birth_year", "club", "sex", "is_relay_team")
    return {"swimmers": swimmers.unionByName(profiles), "results": elsewhere.unionByName(swims).unionByName(legs).select(*results.columns), "log": log}
