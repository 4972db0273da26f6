"""Path predicates and projections. Extensions are matched as written, names and directories without regard to case."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from . import blake3
from .vectors import col


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dir_of(path: str | Column) -> Column:
    """The parent directory."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def extension(path: str | Column) -> Column:
    """What follows the name's last dot; empty if there is none."""
    return F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1)


def is_image(path: str | Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_video(path: str | Column) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)


def indexed_as(path: str | Column) -> Column:
    """Videos by extension; everything else is indexed as an image."""
    return F.when(is_video(path), "video").otherwise("image")


def media_type(path: str | Column) -> Column:
    return F.when(is_image(path), "image").when(is_video(path), "video").otherwise("other")


def in_dir(directory: str | Column, where: str, recursive: bool = False) -> Column:
    """Whether a directory column is `where`, or with `recursive` below it. `/a/bc` isn't below `/a/b`."""
    d = col(directory)
    return (d == where) | d.startswith(where.rstrip("/") + "/") if recursive else d == where


def depth_below(path: str | Column, root: str) -> Column:
    """Directories between root and the file: 0 for root's own files."""
    return F.size(F.split(F.substring(col(path), len(root.rstrip("/")) + 2, 1 << 30), "/")) - 1


def contains_ignoring_case(text: str | Column, query: str) -> Column:
    """An empty query matches everything."""
    return F.lower(col(text)).contains(query.lower()) if query else F.lit(True)


def name_matches(path: str | Column, query: str) -> Column:
    return contains_ignoring_case(basename(path), query)


def thumbnail_name(path: str | Column) -> Column:
    """A name for a path's thumbnail: 16 hex digits of its SHA-256."""
    return F.concat(F.substring(F.sha2(col(path).cast("binary"), 256), 1, 16), F.lit(".jpg"))


def blake3_hex(text: str | Column) -> Column:
    """Lowercase hex of the BLAKE3 hash of a text in UTF-8; null for null. Many short texts are hashed side by side."""

    @F.pandas_udf("string")
    def hashed(text: pd.Series) -> pd.Series:
        known = text.notna()
        out = pd.Series([None] * len(text), dtype=object)
        out[known.to_numpy()] = blake3.digests([t.encode() for t in text[known]])
        return out

    return hashed(col(text))


def blake3_thumbnail_name(path: str | Column) -> Column:
    """As thumbnail_name(), of the BLAKE3 hash: the names that caches made by other programs of this kind have."""
    return F.concat(F.substring(blake3_hex(path), 1, 16), F.lit(".jpg"))
