"""Content hashes of files: BLAKE3 as a tree over segments that are read where there is room, joined level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blake3
from ..plans.tables import new_folder, written

#: Bytes of a segment and of a read: powers of two times a chunk, so that both are whole subtrees. Nodes that a task joins at once, a power of two.
SEGMENT, READ, FAN = 1 << 26, 1 << 20, 1024
_NODES = "path string, idx long, n long, value binary, message string"


def open_file(path: str) -> BinaryIO:
    """A file, named by a path or a URI that pyarrow can reach."""
    if "://" not in path:
        return open(path, "rb")
    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _segment(source: BinaryIO, size: int, first: int, root: bool) -> bytes:
    """The chaining value of a segment's subtree, of `size` bytes from where `source` stands."""
    nodes, left, counter = [], size, first
    while left or not nodes:
        data = source.read(min(READ, left))
        if len(data) < min(READ, left):
            raise OSError("shorter than listed")
        nodes.append(blake3.parent(blake3.chunks(data, counter, root and size <= blake3.CHUNK), root and size <= READ))
        left, counter = left - len(data), counter + READ // blake3.CHUNK
    return blake3.packed(blake3.parent(np.concatenate(nodes, axis=1), root))


def content_hashes(files: DataFrame, read: Callable[[str], BinaryIO] = open_file, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """path, content_hash (lowercase hex), message of files (path, file_size).

    A file is read in segments of `segment` bytes (a power of two times 1024), each by a task of its own choosing; a task holds READ bytes and 32 for each of
    those that it has read. Segments' nodes are joined `fan` (a power of two) at a time, in as many rounds as the largest file needs. A file that can't be read, or is shorter than
    listed, has a message and no hash; others aren't concerned. Null size: a message. Repeated paths: one row.
    """
    spark, folder = files.sparkSession, new_folder(files.sparkSession, "hashes")
    size = F.greatest(F.lit(0), F.col("file_size"))
    known = files.where("file_size IS NOT NULL AND path IS NOT NULL").groupBy("path").agg(F.max("file_size").alias("file_size"))
    parts = known.select("path", size.alias("size"), F.greatest(F.lit(1), F.ceil(size / segment)).cast("long").alias("n"))
    parts = parts.select("path", "size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size, n, idx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with read(path) as source:
                        source.seek(idx * segment)
                        value, message = _segment(source, min(segment, size - idx * segment), idx * segment // blake3.CHUNK, n == 1), None
                except OSError as e:
                    value, message = None, e.strerror or str(e) or type(e).__name__
                out.append((path, idx, n, value, message))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["path", "idx", "n", "value", "message"])

    def joined(t: pa.Table) -> pa.Table:
        order = np.argsort(t["idx"].to_numpy(), kind="stable").tolist()
        values, messages = t["value"].to_pylist(), [m for m in t["message"].to_pylist() if m is not None]
        n = t["n"][0].as_py()
        value = None if messages else blake3.packed(blake3.parent(blake3.unpacked([values[i] for i in order]), n <= fan))
        return pa.table({"path": t["path"][:1], "idx": pa.array([t["idx"][order[0]].as_py() // fan]), "n": pa.array([-(-n // fan)]), "value": pa.array([value], pa.binary()), "message": pa.array([min(messages) if messages else None], pa.string())})

    tasks = spark.sparkContext.defaultParallelism
    level = written(parts.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(hashed, _NODES), f"{folder}/0")
    done, k = level.where("n = 1"), 0
    while True:
        open_ = level.where("n > 1")
        if not open_.limit(1).count():
            break
        k += 1
        level = written(open_.withColumn("_group", F.floor(F.col("idx") / fan)).groupBy("path", "_group").applyInArrow(joined, _NODES), f"{folder}/{k}")
        done = done.unionByName(level.where("n = 1"))
    found = done.select("path", F.lower(F.hex("value")).alias("content_hash"), "message")
    unknown = files.where("file_size IS NULL AND path IS NOT NULL").select("path").distinct().join(known, "path", "left_anti")
    return found.unionByName(unknown.select("path", F.lit(None).cast("string").alias("content_hash"), F.lit("no size").alias("message")))


def with_hashes(listing: DataFrame, store: DataFrame, namespace: str, read: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """The listing with content_hash where size or time differ from what is stored: only these files are read. Those that can't be have none."""
    from ..operators.freshness import to_hash

    wanted = to_hash(listing, store, namespace)
    hashes = content_hashes(wanted.select("path", "file_size"), read).select("path", "content_hash")
    return listing.drop("content_hash").join(hashes, "path", "left")
