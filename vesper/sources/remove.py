"""Deletion of files on executors, with a row for each that says what came of it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

OUTCOME = "path string, bytes long, message string"
Remover = Callable[[DataFrame], DataFrame]


def unlink(path: str) -> int:
    """Deletes a file, named by a path or a URI that pyarrow can reach: the bytes it had; 0 if there is none."""
    parts = urlsplit(path)
    try:
        if parts.scheme not in ("", "file"):
            system, where = fs.FileSystem.from_uri(path)
            size = system.get_file_info(where).size or 0
            system.delete_file(where)
            return size
        where = unquote(parts.path) if parts.scheme else path
        size = os.stat(where).st_size
        os.remove(where)
        return size
    except FileNotFoundError:
        return 0


def remove(files: DataFrame, delete: Callable[[str], int] = unlink) -> DataFrame:
    """path, bytes, message of each of `files` (path): bytes that were freed, 0 and a message if it couldn't be deleted, 0 if it was gone.

    An OSError concerns its file alone. Deleting happens whenever the rows are made, so write them once. A task that is run
    again finds files of its first run gone; what is left is right all the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, freed, messages = batch.column(0).to_pylist(), [], []
            for path in paths:
                try:
                    freed.append(delete(path))
                    messages.append(None)
                except OSError as e:
                    freed.append(0)
                    messages.append(e.strerror or str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(freed, pa.int64()), pa.array(messages, pa.string())], ["path", "bytes", "message"])

    return files.select("path").mapInArrow(run, OUTCOME)
