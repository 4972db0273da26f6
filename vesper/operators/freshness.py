"""Lookups of listed files in the store, and whether what is stored is still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(hashed: bool) -> Column:
    """hit, invalidated or miss of a listed file joined with what is stored (columns with an underscore, _stored null for none).

    Size and modification time decide. Where they differ and both sides have a content_hash, equal hashes count as fresh.
    """
    same = (F.col("file_size") == F.col("_file_size")) & (F.col("mtime") == F.col("_mtime"))
    if hashed:
        same = same | F.coalesce(F.col("content_hash") == F.col("_content_hash"), F.lit(False))
    return F.when(F.col("_stored").isNull(), "miss").when(F.coalesce(same, F.lit(False)), "hit").otherwise("invalidated")


def lookup(listing: DataFrame, store: DataFrame, namespace: str) -> DataFrame:
    """The listing with status() and, for hits, thumbnail_path and the vectors.

    A file that isn't listed can't hit. The order of the listing is in its ordinal.
    """
    kept = store.where(F.col("namespace") == namespace).select("path", *[F.col(c).alias(f"_{c}") for c in ("file_size", "mtime", "content_hash", "thumbnail_path", "clip_vector", "audio_vector")], F.lit(True).alias("_stored"))
    met = listing.join(kept, "path", "left").withColumn("status", status("content_hash" in listing.columns))
    hit: Column = F.col("status") == "hit"
    return met.select(*listing.columns, "status", *[F.when(hit, F.col(f"_{c}")).alias(c) for c in ("thumbnail_path", "clip_vector", "audio_vector")])


def to_hash(listing: DataFrame, store: DataFrame, namespace: str) -> DataFrame:
    """Listed files whose size or time differ from the stored: only their content needs a hash."""
    return lookup(listing.drop("content_hash"), store, namespace).where("status = 'invalidated'").select(*[c for c in listing.columns if c != "content_hash"])


def check(listing: DataFrame, store: DataFrame, namespace: str) -> DataFrame:
    """path, fresh."""
    return lookup(listing, store, namespace).select("path", (F.col("status") == "hit").alias("fresh"))


def flags(looked_up: DataFrame) -> DataFrame:
    """One row: any_hit, any_invalidated, any_miss (false for an empty input)."""
    return looked_up.agg(*[F.coalesce(F.bool_or(F.col("status") == s), F.lit(False)).alias(f"any_{s}") for s in ("hit", "invalidated", "miss")])
