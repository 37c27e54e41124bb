"""Is a read meet there already? Meets of similar names, told apart by date, pool and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.operators.similar import similar_pairs, sorted_words

#: Words in order, alike by 80 per cent when rounded to whole ones.
SIMILAR = 0.795


def similar_names(read: DataFrame, stored: DataFrame, least: float = SIMILAR) -> DataFrame:
    """file_id, meet_id: files and stored meets of names whose sorted words are alike; equal words need no comparison."""
    ours = read.select("file_id", sorted_words(F.col("name")).alias("words")).filter("words != ''")
    theirs = stored.select("meet_id", sorted_words(F.col("name")).alias("words")).filter("words != ''")
    near = similar_pairs(ours.select("words").union(theirs.select("words")), "words", least, "order")
    both = near.select("left", "right").union(near.select(F.col("right").alias("left"), F.col("left").alias("right")))
    alike = ours.join(both, F.col("words") == F.col("left")).select("file_id", "right").join(theirs, F.col("right") == F.col("words")).select("file_id", "meet_id")
    return ours.join(theirs, "words").select("file_id", "meet_id").union(alike)


def meet_warnings(read: DataFrame, stored: DataFrame) -> DataFrame:
    """Per file and similar meet (file_id, name, date, pool and events; meet_id the same): kind, new_events.

    exact_duplicate: the same day and pool, and no event that isn't there; partial_new: with new events;
    different_pool: the same day in another pool; similar_name: everything else. A file without a pool is of any.
    """
    pairs = similar_names(read, stored)
    ours = read.select("file_id", "date", "pool", F.array_distinct(F.coalesce("events", F.array().cast("array<string>"))).alias("events"))
    theirs = stored.select("meet_id", F.col("date").alias("their_date"), F.col("pool").alias("their_pool"), F.coalesce("events", F.array().cast("array<string>")).alias("their_events"))
    rows = pairs.join(ours, "file_id").join(theirs, "meet_id")
    same_day = F.coalesce(F.col("date") == F.col("their_date"), F.lit(False))
    same_pool = F.coalesce(F.nullif("pool", F.lit("")) == F.col("their_pool"), F.coalesce("pool", F.lit("")) == "")
    new = F.size(F.array_except("events", "their_events"))
    shared = F.size(F.array_intersect("events", "their_events"))
    kind = F.when(same_day & same_pool & (shared > 0) & (new == 0), "exact_duplicate").when(same_day & same_pool & (new > 0), "partial_new").when(same_day & ~same_pool, "different_pool").otherwise("similar_name")
    return rows.select("file_id", "meet_id", kind.alias("kind"), new.cast("long").alias("new_events"))
