"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: digits, lower-case a-z and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id in join keys; the largest id, so that any other is less.
NULL_ID = 2**63 - 1
#: Groups or overfull buckets of ``indexed`` that are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: A bucket of so many times its rows is dealt once more.
OVERFULL = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a folder of this
    process's own is set only where none is and Spark runs in this process, as
    in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that all its machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the session's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files and checkpoints that nothing refers to any more removed.

    Spark's cleaner learns of them when the driver collects its garbage, which
    a driver with much memory does seldom.
    """
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return what this process has freed to the system, which the allocators otherwise keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers, which wait for other tasks beside the JVM, give back the memory of the last one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from stage(parts)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def sized(df: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, else as it is.

    The rows are counted unless the caller knows a bound on them.
    """
    rows = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= most else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))


def text_keys(text: Column) -> dict[str, Column]:
    """128 bits that stand for a text; null and empty texts differ."""
    return {"k1": F.xxhash64(F.lit(1), text), "k2": F.xxhash64(F.lit(2), text, F.length(text))}


def safe_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def indexed(df: DataFrame, group: str, order: list[str], out: str, rows_per_bucket: int = 8_192) -> DataFrame:
    """Number the rows of each group from 0, gapless, in the order of ``order``.

    ``order[0]`` is a long spread evenly over its range (a hash).  Its top bits
    deal each group over as many buckets as its size needs; a task sorts a
    bucket, and offsets of the buckets come from a table of counts.  A bucket
    that repeated rows overfill is dealt once more by the place of its rows in
    ``df``, so no task holds more than a few buckets, however large a group or
    however often repeated a row is.  Groups aren't null.  ``df`` is read more
    than once and has to give its rows in the same order: a table or a checkpoint.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.log2(F.greatest(F.count(F.lit(1)) / rows_per_bucket, F.lit(1.0)))).cast("int").alias("__bits"))
    sign_free = F.col(order[0]).bitwiseXOR(F.lit(-(2**63)))
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    dealt = placed.join(sized(sizes, BROADCAST_GROUPS), group).withColumn("__top", sign_free)
    dealt = dealt.withColumn("__bucket", F.when(F.col("__bits") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(__top, 64 - __bits)"))).drop("__top", "__bits")
    keys = [group, "__bucket", "__part"]
    over = dealt.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OVERFULL * rows_per_bucket)
    found = over.limit(BROADCAST_GROUPS + 1).count()
    if found:
        parts = sized(over.select(group, "__bucket", F.ceil(F.col("n") / rows_per_bucket).alias("__parts")), BROADCAST_GROUPS, found)
        dealt = dealt.join(parts, [group, "__bucket"], "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__place"), F.col("__parts")), F.lit(0))).drop("__parts")
    else:
        dealt = dealt.withColumn("__part", F.lit(0).cast("long"))
    dealt = dealt.drop("__place")
    before = Window.partitionBy(group).orderBy("__bucket", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        dealt.withColumn("__row", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(out, (F.col("__offset") + F.col("__row") - 1).cast("long"))
        .drop("__bucket", "__part", "__row", "__offset")
    )
