"""Thumbnails written as PNG files on executors, with a row for each that says what came of it."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.paths import blake3_hex

OUTCOME = "path string, thumbnail_path string, bytes long, message string"


def png(width: int, height: int, data: bytes) -> bytes:
    """RGB bytes, row by row, as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + data[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def put(path: str, content: bytes) -> None:
    """Writes a file under another name and then renames it, so that no reader and no second run of a task sees half of it."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    if "://" in path:
        system, where = fs.FileSystem.from_uri(path)
        fresh = f"{where}.{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as out:
            out.write(content)
        system.move(fresh, where)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    try:
        with open(fresh, "wb") as out:
            out.write(content)
        os.replace(fresh, path)
    finally:
        if os.path.exists(fresh):
            os.remove(fresh)


def write_thumbnails(images: DataFrame, folder: str, size: int = pixels.THUMBNAIL) -> DataFrame:
    """path, thumbnail_path, bytes, message of each image (path, width, height, pixels: RGB bytes).

    A thumbnail has the image's shape, within `size` by `size` (Lanczos), and 16 digits of the BLAKE3 hash of the path as its name, so that the same file is
    written whenever a path comes again. An image without pixels or whose file can't be written has a message and no thumbnail; others aren't
    concerned. Files are written whenever the rows are made: write the rows once. folder: one that all executors reach.
    """
    folder = folder.rstrip("/")
    small = pixels.resize(images.select("path", "width", "height", "pixels"), size, size)
    named = small.select("path", "width", "height", "pixels", "message", F.concat(F.lit(folder + "/"), F.substring(blake3_hex("path"), 1, 16), F.lit(".png")).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, width, height, data, message, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if message is None and name is None:
                    message = "no path"
                if message is not None:
                    out.append((path, None, 0, message))
                    continue
                try:
                    content = png(width, height, data)
                    put(name, content)
                    out.append((path, name, len(content), None))
                except OSError as e:
                    out.append((path, None, 0, e.strerror or str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], [f.split()[0] for f in OUTCOME.split(", ")])

    return named.mapInArrow(run, OUTCOME)
