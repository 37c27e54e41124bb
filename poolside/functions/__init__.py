"""Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the plan once and is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def bound(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(*columns)``, each computed once: later filters and projections take its values and don't take its expressions in."""
    return df.select(F.inline(F.array(F.struct(*columns))))
