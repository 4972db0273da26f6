"""Directory listings by Spark's file source; contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from ..functions import paths
from ..plans.ranges import running_sum
from ..schemas import LISTING
from .walk import scan


def listing(spark: SparkSession, root: str, images: bool = True, videos: bool = False, depth: int | None = None) -> DataFrame:
    """path, dir, file_size, mtime, ordinal of the media below root, at most `depth` directories down (0: root's own).

    A missing root gives no rows. Only metadata is read: `content` is pruned from the scan. With a depth, a local tree is walked by
    levels (sources.walk), so that what lies deeper is never listed; on other file systems it is listed and left out.
    """
    wanted = (IMAGE_EXTENSIONS if images else ()) + (VIDEO_EXTENSIONS if videos else ())
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path) or not wanted:
        return spark.createDataFrame([], LISTING)
    base = fs.makeQualified(jvm_path).toUri().getPath()
    if depth is not None and fs.getScheme() == "file":
        return scan(spark, base, images, videos, depth).rows
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(wanted) + "}").load(root)
    path = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    rows = files.select(path.alias("path"), F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("mtime"))
    rows = rows.withColumn("dir", paths.dir_of("path"))
    if depth is not None:
        rows = rows.where(paths.depth_below("path", base) <= depth)
    return with_ordinal(rows).select(*LISTING.fieldNames())


def with_ordinal(rows: DataFrame) -> DataFrame:
    """Numbers rows by directory and path from 0, in ranges, so that neither many directories nor a large one meet in one task."""
    return running_sum(rows, ["dir", "path"], into="ordinal")


def scan_report(rows: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A listing and a one-row summary of what couldn't be read; the listing stands in spite of errors."""
    from ..operators.summary import walk_errors

    return rows, walk_errors(errors)
