"""Spellings of clubs within a meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def letters_key(name):
    return F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]", "")


def canonical_clubs(clubs: DataFrame, meet: str = "meet_id", club: str = "club", count: str = "n") -> DataFrame:
    """The canonical spelling of each club of each meet (meet, club, canonical); clubs: (meet, club, n).

    Spellings of the same letters take the most frequent one. A rare club (up to 2 rows) one edit away from one
    of at least 3 and three times its rows becomes that one. Names one edit apart share a name with one
    character left out, so they are found by an equi-join and then compared.
    """
    keyed = clubs.groupBy(meet, club).agg(F.sum(count).alias("n")).withColumn("key", letters_key(F.col(club)))
    spelled = keyed.withColumn("best", F.first(club).over(Window.partitionBy(meet, "key").orderBy(F.desc("n"), club)))
    groups = spelled.groupBy(meet, "key", "best").agg(F.sum("n").alias("n"))
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))), lambda i: F.concat(F.substring("key", F.lit(1), i - 1), F.substring("key", i + 1, F.length("key"))))
    probes = groups.withColumn("probe", F.explode(F.array_distinct(F.array_append(shorter, F.col("key")))))
    rare = probes.filter("n <= 2").select(meet, "probe", "key", "n")
    often = probes.filter("n >= 3").select(meet, "probe", F.col("key").alias("to_key"), F.col("best").alias("to"), F.col("n").alias("to_n"))
    near = rare.join(often, [meet, "probe"]).filter("to_n >= greatest(3, 3 * n) and key != to_key").filter(F.levenshtein("key", "to_key") <= 1)
    taken = near.groupBy(meet, "key").agg(F.min_by("to", F.struct(-F.col("to_n"), "to")).alias("to"))
    return spelled.join(taken, [meet, "key"], "left").select(meet, club, F.coalesce("to", "best").alias("canonical"))
