"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A temporary folder is made only where none is set and Spark runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vesper-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder; what is written there stays until release()."""
    _made.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder, read back: later steps don't depend on executors that made it."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> int:
    """Deletes what new_folder() has named so far; for callers that have read or written the results. Returns how many folders."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
