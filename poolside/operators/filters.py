"""Filters that queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARAB = ("ARAB", "GCC")


def in_scope(df: DataFrame, scope: str, country: int | None = None) -> DataFrame:
    """Swims of a scope: national (needs a country, else nothing), arab (with GCC), gcc; anything else: all but OTHER."""
    if scope == "national":
        return df.filter(F.lit(False) if country is None else F.col("nationality_id") == country)
    if scope == "gcc":
        return df.filter(F.col("region") == "GCC")
    return df.filter(F.col("region").isin(*ARAB) if scope == "arab" else F.col("region") != "OTHER")


def in_age_group(df: DataFrame, group: str | None) -> DataFrame:
    """``U<n>``: at most n years old (an unknown age drops out); open and anything else: all."""
    text = (group or "").upper().removeprefix("U")
    return df.filter(F.col("age") <= int(text)) if (group or "").upper().startswith("U") and text.isdigit() else df


def deciding_round(df: DataFrame, *keys: str) -> DataFrame:
    """The swims that decide: Finals where there are any, else unlabelled ones beside Prelims, else all."""
    w = Window.partitionBy(*keys)
    finals = F.max(F.col("round_type") == "Finals").over(w)
    plain = F.max(F.col("round_type") == "").over(w)
    kept = F.when(finals, F.col("round_type") == "Finals").when(plain, F.col("round_type") != "Prelims").otherwise(F.lit(True))
    return df.withColumn("_kept", kept).filter("_kept").drop("_kept")


def list_query(df: DataFrame, filters: dict | None = None, search: str | None = None, search_in: tuple[str, ...] = (), order: list[Column] | None = None, page: int = 1, size: int = 25) -> DataFrame:
    """A page of rows: equality filters (None: not set), words that each must be in one of some columns, an order."""
    for column, value in (filters or {}).items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    for word in (search or "").lower().split():
        df = df.filter(reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), F.lit(word)) for c in search_in)))
    return df.orderBy(*(order or [])).offset((page - 1) * size).limit(size)
