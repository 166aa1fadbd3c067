"""Appending tables to which each batch is added once, however often it is delivered or interrupted.

A batch is written to a hidden folder of the table first and then renamed, in one step, to the folder that its name stands for. Readers see all of
a batch or nothing of it; a batch whose folder is there isn't written again. What an interrupted attempt left behind is hidden from readers and removed
by the next attempt. The file system has to rename folders atomically (HDFS and local ones do; an object store needs a table format
in front of it).

With ``key``, rows whose key the table already has, from whatever batch, are left out too, and of rows of one key in a batch the first by all
columns is kept. Rows of null key are told apart by null like by any other value.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the target is there; true if it was renamed."""
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    qualified = lambda p: _system(spark, p).makeQualified(_path(spark, p))
    try:
        context.rename(qualified(source), qualified(target), spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if exists(spark, target):
            return False
        raise e
    return True


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows so far, with ``batch``; none if nothing was appended yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch string")
    return spark.read.schema(f"{schema}, batch string").parquet(path)


def append_once(df: DataFrame, path: str, batch: str, key: Sequence[str] = ()) -> bool:
    """Add a batch to the table below ``path`` unless it is there; true if this call added it. ``batch`` is a name of letters, digits, ``-`` and ``_``."""
    spark = df.sparkSession
    target = f"{path}/batch={batch}"
    if exists(spark, target):
        return False
    fs = _system(spark, path)
    for left in fs.globStatus(_path(spark, f"{path}/_staged-{batch}-*")) or []:
        fs.delete(left.getPath(), True)
    if key:
        first = Window.partitionBy(*key).orderBy(*df.columns)
        df = df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        if exists(spark, path):
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            held = appended(spark, path, kinds).select(*(F.col(k).alias(f"_held_{k}") for k in key))
            same = [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in key]
            df = df.join(held, same, "left_anti")
    staged = f"{path}/_staged-{batch}-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if rename_once(spark, staged, target):
        return True
    remove(spark, staged)  # another writer added the batch meanwhile
    return False


def append_stream(events: DataFrame, path: str, name: str, key: Sequence[str] = ()) -> DataStreamWriter:
    """A writer that adds each micro-batch once. ``name`` stands for the stream's checkpoint: a stream that begins anew needs another one, and ``key`` then keeps
    what it reads again from being added again. Set the checkpoint's location and the trigger, and start it."""

    def add(batch: DataFrame, number: int) -> None:
        append_once(batch, path, f"{name}-{number}", key)

    return events.writeStream.foreachBatch(add)


def review_rows(compared: DataFrame, key: str, run: str) -> DataFrame:
    """Rows for the review queue of a blind run: the mismatches of ``quality.compare_answers``, keyed by question and run. Append them with ``key=[key, "run"]``."""
    return compared.filter("status = 'mismatch'").withColumns({"run": F.lit(run), "resolution": F.lit(None).cast("string")}).dropDuplicates([key])
