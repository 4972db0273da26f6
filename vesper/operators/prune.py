"""Eviction to a byte budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import running_sum
from ..plans.tables import new_folder, written

BINS = 4096


def orphans(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Thumbnail files that no entry of either namespace names."""
    return files.join(entries.where(F.col("thumbnail_path").isNotNull()).select(F.col("thumbnail_path").alias("path")).distinct(), "path", "left_anti")


def victims(entries: DataFrame, excess: int, size: str = "thumb_bytes", bins: int = BINS) -> DataFrame:
    """Entries to evict, oldest first (updated_at, path, namespace), until `excess` bytes are freed; none if it isn't positive.

    Entries without bytes stay. Time is cut into bins whose sums tell in which of them the excess is reached: all
    entries of earlier bins go, and only that bin is ordered, in ranges, as a bulk import may give most of the store one time.
    """
    rows = entries.where(F.col(size) > 0)
    if excess <= 0:
        return rows.limit(0)
    low, high = rows.agg(F.min("updated_at"), F.max("updated_at")).first()
    if low is None:
        return rows
    width = max(1, -(-(high - low + 1) // bins))
    binned = rows.withColumn("_bin", F.floor((F.col("updated_at") - low) / width))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy("_bin").agg(F.sum(size).alias("_s")).withColumn("_prior", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    last = sums.where(F.col("_prior") < excess).agg(F.max(F.struct("_bin", "_prior")).alias("x")).first()["x"]
    edge = running_sum(binned.where(F.col("_bin") == last["_bin"]), ["updated_at", "path", "namespace"], size).where(F.col("_prior") + last["_prior"] < excess).drop("_prior")
    return binned.where(F.col("_bin") < last["_bin"]).unionByName(edge).drop("_bin")


def footprint(files: DataFrame) -> DataFrame:
    """One row of bytes from (kind, length) rows: database, sidecars (its -wal and -shm files), thumbnails, total. What is missing counts 0."""
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.greatest(F.lit(0), "length"))), F.lit(0)).alias(f"{k}_bytes") for k in ("database", "sidecar", "thumbnail")]
    return files.agg(*sums).withColumn("total_bytes", F.col("database_bytes") + F.col("sidecar_bytes") + F.col("thumbnail_bytes"))


def prune(entries: DataFrame, files: DataFrame, other_bytes: int, max_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orphan files to remove, entries to evict, and a one-row report.

    entries: namespace, path, updated_at, thumbnail_path, thumb_bytes; files: the thumbnail files (path, length).
    Nothing happens within the budget. Orphans go first, then victims() until the rest fits.
    """
    held = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    before = other_bytes + held
    loose = orphans(files, entries) if before > max_bytes else files.limit(0)
    loose_bytes = loose.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    gone = victims(entries, before - loose_bytes - max_bytes if before > max_bytes else 0)
    report = gone.agg(F.count("*").alias("removed_entries"), F.coalesce(F.sum("thumb_bytes"), F.lit(0)).alias("removed_thumbnail_bytes"))
    after = F.greatest(F.lit(0), F.lit(before) - F.lit(loose_bytes) - F.col("removed_thumbnail_bytes"))
    report = report.select(F.lit(before).cast("long").alias("bytes_before"), after.cast("long").alias("bytes_after"), (after <= max_bytes).alias("target_reached"), F.greatest(F.lit(0), after - max_bytes).cast("long").alias("unreclaimable_bytes"), "removed_entries", "removed_thumbnail_bytes", F.lit(loose_bytes).cast("long").alias("removed_orphan_bytes"))
    return loose, gone, report


@dataclass(frozen=True)
class Pruned:
    """outcomes: kind (orphan, thumbnail), path, bytes, message of each file that was to go. entries: namespace, path of the entries that left. report: one row."""

    outcomes: DataFrame
    entries: DataFrame
    report: DataFrame


def enforce(entries: DataFrame, thumbs: DataFrame, remover: Callable[[DataFrame], DataFrame], max_bytes: int, measure: Callable[[], int], forget: Callable[[DataFrame], None] = lambda gone: None, rounds: int = 100) -> Pruned:
    """Deletes thumbnails until what measure() gives fits max_bytes, as far as thumbnails go.

    entries: namespace, path, updated_at, thumbnail_path; thumbs: the files there are (path, length). remover takes files (path) and gives path, bytes,
    message, as sources.remove does. Nothing happens within the budget. Orphans go first; then, oldest first (updated_at, path, namespace), the
    files of entries that have one with bytes. Only bytes that were freed count, so that a file that can't be deleted makes a later entry go as well; its own
    entry leaves all the same. Each round takes as many entries as the lengths of their files say, and the next one what failures left over: the same
    entries as one by one. Two entries with one file: the first frees it. `forget` takes the entries (namespace, path) out of the store, once;
    the sizes after it are measured. `rounds` bounds how often failures are followed up; what is over the budget then is reported.
    """
    spark = entries.sparkSession
    before, folder = measure(), new_folder(spark, "prune")
    nothing = spark.createDataFrame([], "kind string, path string, bytes long, message string, namespace string, entry string")
    out, freed, taken = [], 0, entries.select("namespace", "path").limit(0)

    def gone(files: DataFrame, kind: str) -> int:
        """Deletes files (path and, for thumbnails, namespace and entry) and notes what came of it."""
        wanted = written(files.withColumn("kind", F.lit(kind)), f"{folder}/{len(out)}-wanted")
        done = written(remover(wanted.select("path").distinct()), f"{folder}/{len(out)}-done")
        first = wanted.groupBy("path").agg(F.min(F.struct("updated_at", "entry", "namespace")).alias("_first"))
        marked = wanted.join(first, "path").withColumn("_counts", F.struct("updated_at", "entry", "namespace").eqNullSafe(F.col("_first")))
        out.append(written(marked.join(done, "path").select("kind", "path", F.when(F.col("_counts"), F.col("bytes")).otherwise(0).alias("bytes"), "message", "namespace", "entry"), f"{folder}/{len(out)}"))
        return out[-1].agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    if before > max_bytes:
        null = {"namespace": F.lit(None).cast("string"), "entry": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("long")}
        # what there is at the start, as files are about to go
        entries = written(entries.select("namespace", "path", "updated_at", "thumbnail_path"), f"{folder}/entries")
        thumbs = written(thumbs.select("path", "length"), f"{folder}/thumbs")
        freed = gone(orphans(thumbs, entries).select("path").withColumns(null), "orphan")
        held = written(entries.where("thumbnail_path IS NOT NULL").select("namespace", "path", "updated_at", F.col("thumbnail_path").alias("_file")).join(thumbs.select(F.col("path").alias("_file"), "length"), "_file").where("length > 0"), f"{folder}/held")
        for _ in range(rounds):
            excess = before - freed - max_bytes
            if excess <= 0:
                break
            left = held.join(taken, ["namespace", "path"], "left_anti")
            batch = written(victims(left, excess, size="length"), f"{folder}/{len(out)}-victims")
            if not batch.limit(1).count():
                break
            freed += gone(batch.select(F.col("_file").alias("path"), "namespace", F.col("path").alias("entry"), "updated_at"), "thumbnail")
            taken = taken.unionByName(batch.select("namespace", "path"))
        if taken.limit(1).count():
            forget(taken)
    after = measure()
    outcomes = nothing
    for part in out:
        outcomes = outcomes.unionByName(part)
    sums = outcomes.agg(F.count_if(F.col("kind") == "thumbnail").alias("removed_entries"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("bytes"))), F.lit(0)).alias(f"removed_{k}_bytes") for k in ("thumbnail", "orphan")], F.count("message").alias("failed"))
    sizes = {"bytes_before": before, "bytes_after": after, "unreclaimable_bytes": max(0, after - max_bytes)}
    report = sums.select(*[F.lit(v).cast("long").alias(k) for k, v in sizes.items()], F.lit(after <= max_bytes).alias("target_reached"), *sums.columns)
    return Pruned(outcomes.select("kind", "path", "bytes", "message"), taken, report)
