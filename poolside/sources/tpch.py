"""Competition tables as views over order tables.

Customers are swimmers (every 37th a relay squad), months are meets, lines of orders are swims. ``swims`` is
the fact with its dimensions joined on; ``SWIMS_SQL`` is the same as common table expressions. The sources
have no key for a swim, so queries depend on values only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolside import refdata
from poolside.functions.times import points


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(value: Column, options: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in reversed(options.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


REGIONS = {"MIDDLE EAST": "GCC", "AFRICA": "ARAB", "ASIA": "ARAB"}
CATEGORIES = {"1-URGENT": "Cadets", "2-HIGH": "Minimes", "3-MEDIUM": "Juniors", "4-NOT SPECIFIED": "Seniors"}
ROUNDS = {"A": "Finals", "N": "Prelims"}
CLASSES = {0: "Arab", 1: "National", 2: "Other"}


#: Lines of a task that joins them to orders and to swimmers. What follows by swimmer runs in the same tasks.
TASK_LINES = 1 << 18


@dataclass
class Meets:
    """The tables of one folder."""

    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    @cached_property
    def countries(self) -> DataFrame:
        joined = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            F.col("n_nationkey").alias("nationality_id"), F.col("n_name").alias("country"), F.substring("n_name", 1, 3).alias("code"), choice(F.col("r_name"), REGIONS, "OTHER").alias("region")
        )

    @cached_property
    def swimmers(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.read("customer")
            .select(
                key.alias("swimmer_id"),
                F.col("c_name").alias("swimmer"),
                F.col("c_nationkey").alias("nationality_id"),
                F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
                F.when(key % 13 != 0, 1978 + key % 12).alias("birth_year"),
                (key % 37 == 0).alias("is_relay_team"),
            )
            .join(self.countries, "nationality_id")
        )

    @cached_property
    def tasks(self) -> int:
        """How many tasks swims are dealt to: as many as the machines run at once, or more, so that none has more than ``TASK_LINES`` or so."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.read("lineitem").count() // TASK_LINES))

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows by a key in ``tasks``; where the machines run them all at once they stay as they are."""
        return rows.repartition(self.tasks, key) if self.tasks > self.spark.sparkContext.defaultParallelism else rows

    @cached_property
    def swims(self) -> DataFrame:
        """A row for each swim: swimmer, country, meet, event, time_cs, points, age and the rest."""
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("swimmer_id"), F.trunc("o_orderdate", "month").alias("date"), choice(F.col("o_orderpriority"), CATEGORIES, "").alias("category"))
        lines = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
        meet = ((F.year("date") - 1992) * 12 + F.month("date")).alias("meet_id")
        # numbers of tasks of their own, as adaptive execution puts together what compresses well until a task has too much
        rows = self.dealt(lines, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("*", meet)
        rows = self.dealt(rows, "swimmer_id").join(self.swimmers, "swimmer_id")
        event = F.when(F.col("is_relay_team"), 19 + F.col("l_partkey") % 5).otherwise((F.col("swimmer_id") + F.col("l_partkey") % 4) % 18 + 1).cast("int").alias("event_id")
        rows = rows.select("*", event).join(F.broadcast(refdata.events(self.spark)), "event_id").withColumn("pool", F.when(F.col("meet_id") % 2 == 0, "LCM").otherwise("SCM"))
        rows = rows.join(F.broadcast(refdata.base_times(self.spark)), ["event_id", "sex", "pool"], "left")
        cs = ((2000 + 40 * F.col("l_quantity").cast("long") + 5 * F.round(100 * F.col("l_discount")).cast("long")) * (F.col("distance") / 50).cast("long")).alias("time_cs")
        name = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
        # spellings of one club
        team = F.when(F.col("l_linenumber") % 4 == 0, name).when(F.col("l_linenumber") % 4 == 1, F.upper(name)).when(F.col("l_linenumber") % 4 == 2, F.concat(name, F.lit(" B"))).otherwise(F.concat(name, F.lit(" 2")))
        rows = rows.select("*", cs).select(
            "swimmer_id", "swimmer", "nationality_id", "country", "code", "region", "sex", "birth_year", "is_relay_team",
            "meet_id", "date", "pool", choice(F.col("meet_id") % 3, CLASSES, "Other").alias("classification"), (F.col("meet_id") % 25).alias("host_id"),
            "event_id", "event", "distance", "stroke", "is_relay", "sort_order",
            choice(F.col("l_returnflag"), ROUNDS, "").alias("round_type"), "category", team.alias("team"),
            "time_cs", points(F.col("base"), F.col("time_cs")).alias("points"), (F.col("l_discount") >= 0.1).alias("is_hc"),
            (F.year("date") - F.col("birth_year")).alias("age"), F.year("date").alias("year"),
        )
        return rows


def sql_text(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in rows)


def sql_case(column: str, options: dict, otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in options.items()) + f" ELSE {sql_text(otherwise)} END"


SWIMS_SQL = f"""WITH events(event_id, event, distance, stroke, is_relay, sort_order) AS (VALUES {sql_values(refdata.event_rows())}),
bases(event_id, sex, pool, base) AS (VALUES {sql_values(refdata.base_rows())}),
countries AS (SELECT n_nationkey AS nationality_id, n_name AS country, substr(n_name, 1, 3) AS code, {sql_case("r_name", REGIONS, "OTHER")} AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
swimmers AS (SELECT c_custkey AS swimmer_id, c_name AS swimmer, c_nationkey AS nationality_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  CASE WHEN c_custkey % 13 <> 0 THEN 1978 + c_custkey % 12 END AS birth_year, c_custkey % 37 = 0 AS is_relay_team, country, code, region FROM customer JOIN countries ON c_nationkey = nationality_id),
lines AS (SELECT *, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS meet_id, date_trunc('month', o_orderdate)::DATE AS date,
  'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS club FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
placed AS (SELECT *, CASE WHEN meet_id % 2 = 0 THEN 'LCM' ELSE 'SCM' END AS pool, (CASE WHEN is_relay_team THEN 19 + l_partkey % 5 ELSE (swimmer_id + l_partkey % 4) % 18 + 1 END)::INT AS event_id
  FROM lines JOIN swimmers ON o_custkey = swimmer_id),
timed AS (SELECT *, (2000 + 40 * l_quantity::BIGINT + 5 * round(100 * l_discount)::BIGINT) * (distance // 50) AS time_cs FROM placed JOIN events USING (event_id) LEFT JOIN bases USING (event_id, sex, pool)),
swims AS (SELECT swimmer_id, swimmer, nationality_id, country, code, region, sex, birth_year, is_relay_team, meet_id, date, pool, {sql_case("meet_id % 3", CLASSES, "Other")} AS classification, meet_id % 25 AS host_id,
  event_id, event, distance, stroke, is_relay, sort_order, {sql_case("l_returnflag", ROUNDS, "")} AS round_type, {sql_case("o_orderpriority", CATEGORIES, "")} AS category,
  CASE l_linenumber % 4 WHEN 0 THEN club WHEN 1 THEN upper(club) WHEN 2 THEN club || ' B' ELSE club || ' 2' END AS team,
  time_cs, CASE WHEN base IS NOT NULL AND time_cs > 0 THEN trunc(1000.0 * pow(base / (time_cs / 100.0), 3))::INT ELSE 0 END AS points, l_discount >= 0.1 AS is_hc,
  year(date) - birth_year AS age, year(date) AS year FROM timed)
"""
