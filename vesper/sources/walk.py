"""Walks of directory trees by levels: each level's directories are listed on executors, and what can't be read becomes a row."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from ..functions import paths
from ..plans.ranges import running_sum
from ..plans.tables import new_folder
from ..schemas import LISTING

FRONTIER = "dir string, depth int"
#: What a lister gives: entries of the directories it was given, or a message where one can't be read.
ENTRIES = "dir string, depth int, name string, is_dir boolean, file_size long, mtime long, message string"
BATCH = 8192
Lister = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Scan:
    """rows: LISTING columns. errors: ordinal (by path), path, message. levels: how many rounds it took."""

    rows: DataFrame
    errors: DataFrame
    levels: int


def scandir(directory: str) -> Iterator[tuple[str, bool, int, int]]:
    """name, whether it is a directory, size and time of a local directory's entries. Links to directories aren't followed."""
    with os.scandir(directory) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                yield e.name, True, 0, 0
            elif e.is_file():
                s = e.stat()
                yield e.name, False, s.st_size, int(s.st_mtime)


def arrow_list(directory: str) -> Iterator[tuple[str, bool, int, int]]:
    """As scandir(), of any file system that pyarrow can reach by a URI."""
    system, path = fs.FileSystem.from_uri(directory)
    for e in system.get_file_info(fs.FileSelector(path)):
        yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, int(e.mtime.timestamp()) if e.mtime else 0


def by_call(read: Callable[[str], Iterable[tuple[str, bool, int, int]]] = scandir, tasks: int | None = None) -> Lister:
    """A lister that calls `read` on executors, a directory at a time; entries are sent on as they come, so that a directory of any size passes.

    An OSError is the directory's message; entries that came before it stay. `tasks`: into how many a level is dealt (the session's default parallelism).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ENTRIES.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        held: list[tuple] = []

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)
            held.clear()
            return batch

        for batch in batches:
            for directory, depth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for entry in read(directory):
                        held.append((directory, depth, *entry, None))
                        if len(held) == BATCH:
                            yield sent()
                except OSError as e:
                    held.append((directory, depth, None, None, None, None, e.strerror or str(e) or type(e).__name__))
        if held:
            yield sent()

    def lister(frontier: DataFrame) -> DataFrame:
        n = tasks or frontier.sparkSession.sparkContext.defaultParallelism
        return frontier.select("dir", "depth").repartition(n).mapInArrow(run, ENTRIES)

    return lister


def by_table(entries: DataFrame) -> Lister:
    """A lister over a table of entries: dir, name, is_dir, file_size, mtime, and message where a directory (name null) can't be read."""

    def lister(frontier: DataFrame) -> DataFrame:
        return frontier.join(entries, "dir").select("dir", "depth", "name", "is_dir", F.col("file_size").cast("long"), F.col("mtime").cast("long"), "message")

    return lister


def walk(spark: SparkSession, roots: list[str], lister: Lister, depth: int | None = None, wanted: tuple[str, ...] = IMAGE_EXTENSIONS + VIDEO_EXTENSIONS) -> Scan:
    """Lists the trees below `roots`, at most `depth` directories down (0: the roots' own files; None: all).

    A round lists the directories that the last one found. Its entries are written to the shared folder, so that a round is done once; directories
    beyond the depth are never listed. Extensions are matched as written. A directory that can't be read, a missing root included, is an error; the rest
    of the walk stands. Of roots that lie in one another, each tree is listed once for each. No roots: no rows.
    """
    folder = new_folder(spark, "walk")
    frontier = spark.createDataFrame([(r.rstrip("/") or "/", 0) for r in roots], FRONTIER)
    level = 0
    file = (~F.col("is_dir")) & paths.extension(F.concat(F.lit("/"), "name")).isin(*wanted)
    while True:
        found = lister(frontier)
        kept = found.where(F.col("message").isNotNull() | F.col("is_dir") | file)
        kept.write.parquet(f"{folder}/level={level}")
        if depth is not None and level >= depth:
            break
        entries = spark.read.schema(found.schema).parquet(f"{folder}/level={level}")
        frontier = entries.where("is_dir AND message IS NULL").select(_below("dir", "name").alias("dir"), F.lit(level + 1).alias("depth"))
        if not frontier.limit(1).count():
            break
        level += 1
    entries = spark.read.schema(found.schema).parquet(*[f"{folder}/level={k}" for k in range(level + 1)])
    rows = entries.where("NOT is_dir AND message IS NULL").select(_below("dir", "name").alias("path"), "dir", "file_size", "mtime")
    errors = entries.where("message IS NOT NULL").select(F.col("dir").alias("path"), "message")
    numbered = running_sum(rows, ["dir", "path"], into="ordinal").select(*LISTING.fieldNames())
    return Scan(numbered, running_sum(errors, ["path", "message"], into="ordinal").select("ordinal", "path", "message"), level + 1)


def _below(directory: str, name: str) -> Column:
    return F.concat(F.when(F.col(directory) == "/", "").otherwise(F.col(directory)), F.lit("/"), F.col(name))


def scan(spark: SparkSession, root: str, images: bool = True, videos: bool = False, depth: int | None = None, lister: Lister | None = None) -> Scan:
    """walk() of one root for the chosen media; without any chosen, only directories are read. A root with a scheme is listed by pyarrow."""
    wanted = (IMAGE_EXTENSIONS if images else ()) + (VIDEO_EXTENSIONS if videos else ())
    lister = lister or by_call(arrow_list if "://" in root else scandir)
    return walk(spark, [root], lister, depth, wanted)
