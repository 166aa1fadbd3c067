"""What the operators of this subpackage share: table access, shared scratch tables and settings."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "4m"
BLOCK_BITS = 32_768  # Spark's bitmap functions build blocks of 4 KB
MAX_BLOCKS = 8_192  # 32 MB: what is broadcast at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local one is set if the master is local; on a cluster,
    whose executors would not share it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext.getCheckpointDir()
    if not (root or found or spark.sparkContext.master.split("[")[0] == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return root or spark.sparkContext.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes: 10,000 rows of long texts would take hundreds of MB in the executor and again in its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_held_by: list[str] = []
_forget: list[Callable[[], None]] = []


def kept_by_worker(cached):
    """An ``lru_cache`` of a reused Python worker that is emptied when a task of another operator begins there."""
    _forget.append(cached.cache_clear)
    return cached


def take_over(operator: str) -> None:
    """Called when a task begins: what tasks of other operators left in this worker is freed."""
    if _held_by != [operator]:
        for forget in _forget:
            forget()
        give_back()
        _held_by[:] = [operator]


def give_back() -> None:
    """Return what a finished task of a reused Python worker no longer needs to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: lineage ends there, and an
    executor that is lost later costs nothing but a read. ``drop_scratch`` removes these tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of the shared folder. Call it once all results that read them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for the small tables of iterations; Spark's cleaner removes its files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row: the optimiser doesn't copy it into the lambdas and filters
    that use it, as it would with a plain projection."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def bit_set(bitmap: str, bit: Column) -> Column:
    """Whether a bit of a bitmap of Spark's bitmap functions is set; false for null."""
    byte = F.conv(F.hex(F.col(bitmap).substr((bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.col(bitmap).isNotNull() & (F.coalesce(byte, F.lit(0)).bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (bit % 8).cast("int") + 1)) > 0)


def bitmaps(bits: DataFrame) -> DataFrame:
    """``_block`` and ``_bitmap`` of rows ``block``, ``bit``."""
    found = bits.groupBy("block").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))
    return found.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))


def maybe_among(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with whether their key may be among ``ids`` (one column of the key's type): false only if it certainly isn't, so that what has to meet
    ``ids`` in a join is little more than those. The filter is broadcast; it takes 16 bits an id, 32 MB at most: beyond 16 million ids it lets
    more and more others through, which costs their way to the join and changes no result."""
    blocks = max(1, min(MAX_BLOCKS, ids.count() * 16 // BLOCK_BITS))
    place = lambda c: (F.pmod(F.xxhash64(c), F.lit(blocks)), F.pmod(F.shiftrightunsigned(F.xxhash64(c), 32), F.lit(BLOCK_BITS)))
    block, bit = place(ids.columns[0])
    filled = bitmaps(ids.select(block.alias("block"), bit.alias("bit")).distinct())
    block, bit = place(key)
    found = rows.join(F.broadcast(filled), block == F.col("_block"), "left")
    return found.select(*(rows[c] for c in rows.columns), bit_set("_bitmap", bit).alias(name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: the split of labelled rows into learnt and held out."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % parts


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
