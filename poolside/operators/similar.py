"""Texts that are alike by their matching characters: a similarity join by rare pairs of letters, and exact ratios.

Two ratios, both of twice the matching characters to all characters: ``block`` matches the longest common run, then
what is left of it and right of it; ``order`` matches the longest common subsequence. If the ratio is r and T the
number of characters of both texts, at least rT/2 characters match, in at most (1 - r)T + 1 runs, so at least
(3r/2 - 1)T - 1 pairs of neighbouring letters are common to both. ``similar_pairs`` joins texts by their rarest pairs
only, as many as no alike text can do without; texts too short for that are joined by rare letters. So no pair is lost
and no cross join is made; the exact ratio then decides.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def common_in_order(a: str, b: str) -> int:
    """Length of the longest common subsequence; one row of bits for each letter of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    open_, every = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(a) - open_.bit_count()


def ratio(a: str, b: str, kind: str) -> float:
    if not a and not b:
        return 1.0
    return SequenceMatcher(None, a, b).ratio() if kind == "block" else 2 * common_in_order(a, b) / (len(a) + len(b))


def ratio_of(a: Column, b: Column, kind: str = "block") -> Column:
    """The ratio of two texts, in batches; equal pairs of a batch are compared once."""

    @pandas_udf("double")
    def compared(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        for pair in zip(left, right):
            if pair not in known:
                known[pair] = ratio(*pair, kind)
        return pd.Series([known[pair] for pair in zip(left, right)], dtype="float64")

    return compared(a, b)


def club_letters(club: Column) -> Column:
    """The letters A to Z and digits of a club's name."""
    return F.regexp_replace(F.upper(F.coalesce(club, F.lit(""))), "[^A-Z0-9]", "")


def clubs_equivalent(pairs: DataFrame, a: str, b: str, name: str, least: float = 0.85) -> DataFrame:
    """``pairs`` with a boolean: whether two spellings are one club's. Names without letters are none's.

    Distinct pairs whose lengths allow the ratio are compared; the others are told apart by Spark.
    """
    rows = pairs.withColumns({"_a": club_letters(F.col(a)), "_b": club_letters(F.col(b))})
    total = F.length("_a") + F.length("_b")
    open_ = (F.col("_a") != "") & (F.col("_b") != "") & (F.col("_a") != F.col("_b")) & (2 * F.least(F.length("_a"), F.length("_b")) >= least * total)
    told = rows.filter(open_).select("_a", "_b").distinct().withColumn("_alike", ratio_of(F.col("_a"), F.col("_b")) >= least)
    found = rows.join(told, ["_a", "_b"], "left")
    return found.withColumn(name, (F.col("_a") != "") & (F.col("_b") != "") & ((F.col("_a") == F.col("_b")) | F.coalesce("_alike", F.lit(False)))).drop("_a", "_b", "_alike")


def counted_grams(text: Column, n: int) -> Column:
    """A text's runs of n letters, each with how often it has come before, so that repeated ones count."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.get(F.transform(F.array(grams), lambda g: F.transform(g, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(g, F.lit(1), i), lambda y: y == x)).cast("string")))), 0)


def similar_pairs(texts: DataFrame, column: str, least: float, kind: str = "block") -> DataFrame:
    """left, right, ratio: distinct texts (left < right) whose ratio is ``least`` or more. Empty texts are like none."""
    rows = texts.select(F.col(column).alias("text")).filter("text != ''").distinct().withColumn("size", F.length("text"))
    # the shortest text that can be alike has least / (2 - least) times the letters
    total = F.col("size") * (1 + least / (2 - least))
    pairs_least = F.ceil((1.5 * least - 1) * total - 1 - 1e-9)
    by_pairs = pairs_least >= 1
    letters_least = F.greatest(F.ceil(least / 2 * total - 1e-9), F.lit(1))
    longest = rows.agg(F.max("size")).first()[0] or 0
    short = [n for n in range(1, longest + 1) if (1.5 * least - 1) * n * (1 + least / (2 - least)) - 1 - 1e-9 <= 0]
    bound = max(short, default=0) * (2 - least) / least  # texts that a short one can be alike
    letters = rows.filter(F.col("size") <= bound).select("text", "size", F.lit(1).alias("n"), (F.col("size") - letters_least + 1).alias("take"), F.explode(counted_grams(F.col("text"), 1)).alias("gram"))
    runs = rows.filter(by_pairs).select("text", "size", F.lit(2).alias("n"), (F.col("size") - 1 - pairs_least + 1).alias("take"), F.explode(counted_grams(F.col("text"), 2)).alias("gram"))
    grams = letters.union(runs)
    often = grams.groupBy("n", "gram").agg(F.count("*").alias("often"))
    ranked = grams.join(often, ["n", "gram"]).withColumn("place", F.row_number().over(Window.partitionBy("n", "text").orderBy("often", "gram")))
    probes = ranked.filter("place <= take and often > 1").select("n", "gram", "text", "size")
    other = probes.select("n", "gram", F.col("text").alias("right"), F.col("size").alias("right_size"))
    fits = 2 * F.least("size", "right_size") >= least * (F.col("size") + F.col("right_size"))
    near = probes.join(other, ["n", "gram"]).filter((F.col("text") < F.col("right")) & fits).select(F.col("text").alias("left"), "right").distinct()
    return near.withColumn("ratio", ratio_of(F.col("left"), F.col("right"), kind)).filter(F.col("ratio") >= least - 1e-12)


def sorted_words(name: Column) -> Column:
    """Lower-case words of letters and digits in alphabetical order; anything else parts words."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w]|_", " "))
    return F.array_join(F.array_sort(F.filter(F.split(plain, r"\s+"), lambda w: w != "")), " ")
