"""What the training-data operators share: word pattern, checkpoint folder, table reading, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A temporary one is made only where none is set and Spark runs in
    one process, as in tests; on a cluster a missing setting is an error, as executors couldn't read each other's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vesper-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder: later steps read it back even if its executors are gone."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def pow2(n: float, least: int, most: int) -> int:
    """The smallest power of two that is at least n, between least and most."""
    p = least
    while p < n and p < most:
        p *= 2
    return p


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: Column) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys up to this one, in `order`.

    `bucket` (an int that never falls along `order`) splits a key's rows among tasks: rows are summed within
    (keys, bucket), and the sums of earlier buckets are added from a table with a row for each of those, so that
    a key that holds a third of all rows doesn't meet in one task.
    """
    df = df.withColumn("_b", bucket)
    sums = df.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum(value).over(within)).join(sums, [*keys, "_b"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_b", "_before", "_in")


_stashed: list[str] = []


def stash(df: DataFrame) -> DataFrame:
    """As cut(), for larger tables: compressed Parquet in the shared checkpoint folder, read back. It stays until release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    _stashed.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what stash() has written so far; for callers that have read or written the results. Returns how many tables."""
    gone = 0
    while _stashed:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stashed.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
