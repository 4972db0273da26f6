"""Re-indexing as a stream: new listing files are merged into the store, unchanged files cost nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..operators import freshness
from ..schemas import LISTING
from ..sources.store import Store


def pending(listing: DataFrame, store: DataFrame) -> DataFrame:
    """Listed files that the store doesn't hold fresh and with a vector: those that need the encoder.

    store: its rows, or Store.fingerprints(), which have no vectors to read. One join for both namespaces.
    """
    if "has_clip" not in store.columns:
        store = store.withColumns({"has_clip": F.col("clip_vector").isNotNull(), "has_audio": F.col("audio_vector").isNotNull()})
    kept = store.select("namespace", "path", *[F.col(c).alias(f"_{c}") for c in ("file_size", "mtime", "content_hash", "has_clip", "has_audio")], F.lit(True).alias("_stored"))
    met = listing.withColumn("namespace", paths.indexed_as("path")).join(kept, ["namespace", "path"], "left").withColumn("status", freshness.status("content_hash" in listing.columns))
    usable = F.coalesce(F.col("_has_clip"), F.lit(False)) | ((F.col("namespace") == "video") & F.coalesce(F.col("_has_audio"), F.lit(False)))
    return met.where((F.col("status") != "hit") | ~usable).select(*listing.columns, "namespace", "status")


def reindex(spark: SparkSession, listings: str, store: Store, changes: Callable[[DataFrame], DataFrame], now: Callable[[], int], checkpoint: str) -> StreamingQuery:
    """Starts a query over listing files (Parquet, LISTING columns) that arrive in a folder.

    Each batch is one merge: latest listing row of each path, reduced to what is pending, turned into changes by the caller (which encodes)
    and upserted. Only the fingerprints in buckets of the batch's paths are read, and only buckets of what is pending are written. Merging the same batch
    twice gives the same store. Stop it with its stop(), at a batch boundary.
    """
    stream = spark.readStream.schema(LISTING).parquet(listings)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in LISTING.fieldNames() if c != "path"]), "mtime").alias("r")).select("path", "r.*").select(*LISTING.fieldNames())
        todo = pending(latest, store.fingerprints(latest))
        if todo.limit(1).count():
            store.upsert(changes(todo), now())

    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
