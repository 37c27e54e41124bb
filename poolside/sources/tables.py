"""Writes that give new tables: appends, upserts, deletes with what hangs on them, merges of ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(df: DataFrame) -> DataFrame:
    """``df`` written as columns to the folder of checkpoints that all machines share, so that what follows reads it and doesn't compute it again. The files go when the JVM ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    elif not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    path = f"{context.getCheckpointDir()}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def upserted(current: DataFrame, new: DataFrame, keys: list[str], better: Column | None = None) -> DataFrame:
    """``current`` with ``new`` put in by key: the new row wins, or the one that comes first by ``better`` (a result's better time)."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc("_new")] if better is None else [better.asc_nulls_last(), F.asc("_new")]
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k", "_new")


def deleted(table: DataFrame, gone: DataFrame, key: str, hanging: dict[str, tuple[DataFrame, str]] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The table without the keys of ``gone``, and each table that hangs on it (name: table and column) without theirs."""
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    without = lambda df, column: df.join(keys, F.col(column) == F.col("_gone"), "left_anti")
    return without(table, key), {name: without(df, column) for name, (df, column) in (hanging or {}).items()}


def unused(table: DataFrame, key: str, users: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows that none of the users (table and column) names."""
    for df, column in users:
        table = table.join(df.select(F.col(column).alias("_used")).distinct(), F.col(key) == F.col("_used"), "left_anti")
    return table


def repointed(table: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """The table with ids replaced by those that they are merged into; merges: (old, kept), one row for each old."""
    return table.join(merges, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("kept", F.col(column))).drop("old", "kept")


def merged_rows(table: DataFrame, key: str, merges: DataFrame, fill: list[str]) -> DataFrame:
    """Rows merged by id: the kept row's values, and where they are empty the others'."""
    moved = repointed(table.withColumn("_id", F.col(key)), key, merges)
    own = F.col("_id") != F.col(key)
    value = lambda c: F.coalesce(F.min_by(c, own), F.min(c)) if c not in fill else F.min_by(c, F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", own, "_id"))
    return moved.groupBy(key).agg(*(value(c).alias(c) for c in table.columns if c != key))
