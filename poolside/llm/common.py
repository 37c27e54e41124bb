"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. Workers on this machine look for this package where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark removes the files that a query has shuffled at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ``folders``: what this thread's pipeline steps have staged for themselves; ``within``: whether one is at work.
_steps = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, on this machine alone, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs the tasks that it ran, not the steps before; the files go when the JVM ends, as
    ``pipeline_step`` says, or by ``dropped``. What the write has shuffled goes as soon as it is written: the
    driver's garbage collection may come to that late or never, and nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    if getattr(_steps, "within", False):
        _steps.folders.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    system, hadoop = folder(spark, path)
    system.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` has returned, once nothing reads them any more."""
    for df in tables:
        for name in {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}:
            system, hadoop = folder(df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}")
            system.delete(hadoop, True)


def folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


@contextmanager
def pipeline_step(docs: DataFrame) -> Iterator[None]:
    """A step of a pipeline that begins with ``docs``: what earlier steps of this thread staged for themselves goes.

    So the shared folder holds the tables of one step at a time, and not of all steps. Tables that ``docs`` reads
    stay; anything else that a step has returned is to be written before the next step begins.
    """
    spark, before = docs.sparkSession, getattr(_steps, "folders", [])
    files = docs.inputFiles() if before else []
    read = {os.path.basename(os.path.dirname(f)) for f in files}
    _steps.folders = [path for path in before if os.path.basename(path) in read]
    for path in set(before) - set(_steps.folders):
        system, hadoop = folder(spark, path)
        system.delete(hadoop, True)
    _steps.within = True
    try:
        yield
    finally:
        _steps.within = False


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, named ``id`` and ``text``; a null text is an empty one."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def rows_of(batches, *names):
    """The rows of Arrow batches as tuples, a batch's columns turned into Python values a few rows at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.slice(at, 256).to_pylist() for c in columns))


def record_batches(rows, names, types, rows_most: int = 4096, bytes_most: int = 8 << 20):
    """Arrow batches of an iterator of tuples; a batch ends at ``rows_most`` rows or about ``bytes_most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) == rows_most or size >= bytes_most:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


def in_groups(rows, size_of, most: int):
    """Lists of rows of ``most`` in size, or a row more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
