"""Three rankings, and the best rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_swims(df: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """The first swim of each group by time, date and swimmer: a minimum of a struct, so partly summed before the shuffle."""
    first = F.min(F.struct("time_cs", "date", "swimmer_id", *[c for c in keep if c not in ("time_cs", "date", "swimmer_id")])).alias("_best")
    return df.groupBy(*keys).agg(first).select(*keys, "_best.*")


def personal_bests(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("time_cs").alias("best"))


def positional(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """1, 2, 3, .. in order; ties get places of their own."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def better_count(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1 + how many are strictly better, and out of how many.

    Equal values are counted first, so the windows see different values only and no task sorts a whole key's rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select(*(F.col(c).alias(f"_{c}") for c in (*keys, value)), (F.coalesce(before, F.lit(0)) + 1).alias("rank"), F.sum("_n").over(w).alias("total"))
    return df.join(places, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, value)]).select(*df.columns, "rank", "total")


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    return positional(df, keys, *order).filter(F.col("rank") <= n)
