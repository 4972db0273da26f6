"""Mutations of the keyed store, each as a new table: upsert, delete, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import STORE

KEY = ["namespace", "path"]
_META = ("dir", "file_size", "mtime", "content_hash", "payload_version")
_PAYLOAD = ("thumbnail_path", "clip_vector", "audio_vector")


def upsert(store: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """The store after the changes (rows of its schema, updated_at ignored), one change a key.

    A null vector or thumbnail in a change keeps the stored value if the stored row is fresh, that is, if size and time are the change's; a
    stale row's values are discarded. A change that is fresh, brings no vector and doesn't change the thumbnail is no write: the row and
    its updated_at stay. One full outer join on the key.
    """
    old, new = store.alias("old"), changes.alias("new")
    both = old.join(new, KEY, "full_outer")
    o, n = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    changed, stored = n("dir").isNotNull(), o("dir").isNotNull()
    fresh = F.coalesce(stored & (o("file_size") == n("file_size")) & (o("mtime") == n("mtime")), F.lit(False))
    nothing = fresh & n("clip_vector").isNull() & n("audio_vector").isNull() & (n("thumbnail_path").isNull() | n("thumbnail_path").eqNullSafe(o("thumbnail_path")))
    write = changed & ~nothing
    columns = {c: F.when(write, n(c)).otherwise(o(c)) for c in _META}
    columns |= {c: F.when(write & fresh, F.coalesce(n(c), o(c))).when(write, n(c)).otherwise(o(c)) for c in _PAYLOAD}
    columns["updated_at"] = F.when(write, F.lit(now).cast("long")).otherwise(o("updated_at"))
    return both.select(*KEY, *[columns[c].alias(c) for c in STORE.fieldNames() if c not in KEY]).select(*STORE.fieldNames())


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes that can be written, and (path, message) of those that can't; a bad element doesn't stop the others."""
    bad = F.when(F.col("path").isNull() | (F.col("path") == ""), "no path").when(F.col("file_size").isNull(), "file can't be read")
    marked = changes.withColumn("message", bad)
    return marked.where("message IS NULL").drop("message"), marked.where("message IS NOT NULL").select("path", "message")


def purge(store: DataFrame, version: int) -> DataFrame:
    """Rows of the current payload version."""
    return store.where(F.col("payload_version") == version)


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def held_in_dir(directory: str, recursive: bool = False, namespaces: tuple[str, ...] = ("image", "video")) -> Column:
    return F.col("namespace").isin(*namespaces) & paths.in_dir("dir", directory, recursive)


def delete_in_dir(store: DataFrame, directory: str, recursive: bool = False, namespaces: tuple[str, ...] = ("image", "video")) -> DataFrame:
    """Without the rows of a directory, by default its own only."""
    return store.where(~held_in_dir(directory, recursive, namespaces))


def removed_in_dir(store: DataFrame, directory: str, recursive: bool = False, namespaces: tuple[str, ...] = ("image", "video")) -> DataFrame:
    """How many rows delete_in_dir() would remove: removed_images, removed_videos, removed."""
    gone = held_in_dir(directory, recursive, namespaces)
    counts = [F.count_if(gone & (F.col("namespace") == ns)).alias(f"removed_{ns}s") for ns in ("image", "video")]
    return store.agg(*counts).withColumn("removed", F.col("removed_images") + F.col("removed_videos"))


def register(listing: DataFrame, version: int) -> DataFrame:
    """Changes that enter every listed file into the image namespace, without vectors."""
    null = lambda kind: F.lit(None).cast(kind)
    return listing.select(F.lit("image").alias("namespace"), "path", "dir", "file_size", "mtime", null("string").alias("content_hash"), null("long").alias("updated_at"), F.lit(version).alias("payload_version"), null("string").alias("thumbnail_path"), null("array<float>").alias("clip_vector"), null("array<float>").alias("audio_vector"))
