"""What is put right within a read meet before it is imported, and profiles that hold two swimmers.

Rows of a read meet: meet_id, row, event_id (any event key), sex, round_type, category (the event's), name, time_cs, rank, status.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolside.functions import events
from poolside.operators.importing import NEAR_DAYS, conflict

EVENT = ["meet_id", "event_id", "sex"]
HEATS = ("Heats", "Prelims", "Semis")


def known(*columns: str) -> Column:
    """Whether none of the columns is null; null keys are equal to nothing."""
    return reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in columns))


def without_repeats(rows: DataFrame) -> DataFrame:
    """One event for each key, and of rows with the same name, time, rank and status of an event the first: pages read twice."""
    key = [*EVENT, "round_type", "_name", "time_cs", "category", "rank", "status"]
    named = rows.withColumn("_name", F.upper("name"))
    return named.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("row"))).filter("_k = 1").drop("_k").select(*rows.columns)


def without_general_lists(rows: DataFrame) -> DataFrame:
    """Without rows of no category whose swim (name and time) stands under a category of the same event and round, too."""
    swim = [*EVENT, "round_type", "_name", "time_cs"]
    named = rows.filter("category is not null").withColumn("_name", F.upper("name"))
    aged = named.withColumn("_aged", F.bool_or(F.col("category") != "").over(Window.partitionBy(*swim)))
    return aged.filter((F.col("category") != "") | ~(F.col("_aged") & known(*swim))).select(*rows.columns)


def with_finals(rows: DataFrame) -> DataFrame:
    """Rows of an event without a final have been the final: heats, prelims and rows of no round become Finals."""
    finals = F.bool_or(F.col("round_type") == "Finals").over(Window.partitionBy(*EVENT))
    alone = ~F.coalesce(finals, F.lit(False)) & F.coalesce("round_type", F.lit("")).isin("", "Heats", "Prelims")
    return rows.withColumn("round_type", F.when(alone, "Finals").otherwise(F.col("round_type")))


def with_overlap(rows: DataFrame) -> DataFrame:
    """Rows with ``_heat``, whether they are of heats of an event with finals, and ``_shared``, whether name and time stand in the finals."""
    final = lambda *keys: F.coalesce(F.bool_or(F.col("round_type") == "Finals").over(Window.partitionBy(*keys)), F.lit(False)) & known(*keys)
    heat = F.coalesce(F.col("round_type").isin(*HEATS), F.lit(False))
    return rows.withColumn("_heat", heat & final(*EVENT)).withColumn("_shared", final(*EVENT, "name", "time_cs"))


def heat_overlap(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """Per heats of an event with finals: results, how many of them (name and time) stand in the finals, and whether so many that they are the same list."""
    held = with_overlap(rows).filter("_heat")
    n = held.groupBy(*EVENT, "round_type", "category").agg(F.count("*").alias("heats"), F.count_if("_shared").alias("shared"))
    return n.withColumn("repeated", F.col("shared") >= least * F.col("heats"))


def without_repeated_heats(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """Without heats that ``heat_overlap`` calls repeated; heats with other swims stay."""
    heats = Window.partitionBy(*EVENT, "round_type", "category")
    repeated = F.count_if("_shared").over(heats) >= least * F.count("*").over(heats)
    told = with_overlap(rows).withColumn("_gone", F.col("_heat") & F.col("category").isNotNull() & repeated)
    return told.filter("not _gone").select(*rows.columns)


def cleaned_meet(rows: DataFrame) -> DataFrame:
    """All of it in order: repeats, general lists, lone heats, repeated heats. Each is told by windows within an event, so rows are read and dealt once."""
    return without_repeated_heats(with_finals(without_general_lists(without_repeats(rows.repartition(*EVENT)))))


def conflict_days(results: DataFrame) -> DataFrame:
    """swimmer_id, date: days of meets at which a swimmer has results of conflicting bands. Bands of a meet are few; each pair is looked at once."""
    at = results.select("swimmer_id", "meet_id", "date", events.band(F.col("category")).alias("band")).filter("band != ''").distinct()
    other = at.select("swimmer_id", "meet_id", F.col("band").alias("other"))
    pairs = at.join(other, ["swimmer_id", "meet_id"]).filter("band < other")
    return pairs.filter(events.bands_conflict(F.col("band"), F.col("other"))).select("swimmer_id", "date").distinct()


def near_conflicts(results: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """Banded results of swimmers within ``days`` of a conflict of theirs; by buckets of days, so careers aren't paired with themselves.

    A result or a conflict without a date is near all of a swimmer's.
    """
    conflicts = conflict_days(results)
    bucket = lambda d: F.floor(F.unix_date(F.col(d)) / days)
    banded = results.withColumn("band", events.band(F.col("category"))).filter("band != ''")
    when = conflicts.filter("date is not null").select("swimmer_id", F.col("date").alias("then"))
    around = when.withColumn("_bucket", F.explode(F.array(*[bucket("then") + k for k in (-1, 0, 1)])))
    spells = banded.select("swimmer_id", "date").filter("date is not null").distinct().withColumn("_bucket", bucket("date"))
    near = spells.join(around, ["swimmer_id", "_bucket"]).filter(F.abs(F.date_diff("date", "then")) <= days).select("swimmer_id", "date").distinct()
    always = conflicts.filter("date is null").select("swimmer_id").distinct()
    dated = banded.join(always, "swimmer_id", "left_anti").join(near, ["swimmer_id", "date"], "left_semi")
    loose = banded.join(always, "swimmer_id", "left_semi").unionByName(banded.join(always, "swimmer_id", "left_anti").filter("date is null").join(conflicts.select("swimmer_id").distinct(), "swimmer_id", "left_semi"))
    return dated.select(*results.columns, "band").unionByName(loose.select(*results.columns, "band"))


def split_swimmers(results: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """swimmer_id, band, part, moves: which part of a profile that holds several swimmers a band's results near a conflict are.

    Bands in alphabetical order join the first part none of whose bands they conflict with. The part of the most
    results (of equal ones the first) keeps the profile, the others move to new ones. Only profiles of two parts or
    more have rows. What is folded is a swimmer's distinct bands, which are few.
    """
    counts = near_conflicts(results, days).groupBy("swimmer_id", "band").agg(F.count("*").alias("n"))

    def parts(batches):
        swimmer, held, out = None, [], []

        def told():
            clusters = []
            for band, n in held:
                at = next((c for c in clusters if not any(conflict(band, other) for other, _ in c)), None)
                if at is None:
                    clusters.append(at := [])
                at.append((band, n))
            if len(clusters) > 1:
                keep = max(range(len(clusters)), key=lambda i: (sum(n for _, n in clusters[i]), -i))
                return [(swimmer, band, i, i != keep) for i, c in enumerate(clusters) for band, _ in c]
            return []

        for batch in batches:
            for s, band, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("swimmer_id", "band", "n"))):
                if s != swimmer:
                    out += told()
                    swimmer, held = s, []
                held.append((band, n))
            if len(out) > 4096:
                yield packed(out)
                out = []
        out += told()
        if out:
            yield packed(out)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.bool_()))], names=["swimmer_id", "band", "part", "moves"])

    return counts.repartition("swimmer_id").sortWithinPartitions("swimmer_id", "band").mapInArrow(parts, "swimmer_id long, band string, part int, moves boolean")


def moved_results(results: DataFrame, days: int = NEAR_DAYS) -> DataFrame:
    """Results with ``profile``: the swimmer's own (part null), or the number of the part that becomes a profile of its own."""
    parts = split_swimmers(results, days).filter("moves").select("swimmer_id", "band", F.col("part").alias("profile"))
    near = near_conflicts(results, days).join(parts, ["swimmer_id", "band"])
    moved = near.select(*[F.col(c).alias(f"_{c}") for c in results.columns], "profile").distinct()
    return results.join(moved, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in results.columns], "left").select(*results.columns, "profile")
