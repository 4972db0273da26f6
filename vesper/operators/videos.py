"""Indexing of videos as one flow: look up, sample, encode both modalities, pool, write, and say what came of each file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Sampling
from ..functions import formats, vectors
from ..plans.tables import new_folder, written
from ..sources.store import Store
from .encode import Encoder, encode, pooled, sample_points


@dataclass(frozen=True)
class Modality:
    """extract: from samples (path, pos, at_secs and others) to the same with content (binary; null where there is nothing). make: the encoder,
    one for each worker. error: why there is none, in which case the others are left out."""

    extract: Callable[[DataFrame], DataFrame] | None = None
    make: Callable[[], Encoder] | None = None
    error: str | None = None


def index_videos(listing: DataFrame, store: Store, durations: Callable[[DataFrame], DataFrame], frames: Modality, sound: Modality, now: int, cfg: Sampling = Sampling()) -> DataFrame:
    """path, outcome (processed, skipped, write_failed), message of each listed video; their features are in the store then.

    listing: LISTING columns. durations: from listed files to the same with duration (null where it can't be read). A file that the store holds fresh and with a vector
    that isn't zero is processed without being read. Others are sampled at the same points for frames and sound, each modality's
    vectors are pooled to one, and all are written in one merge; one modality is enough. Where neither gives a vector, the file is skipped with the
    reasons. Each step's rows are written to the shared folder, so that extractors and encoders run once.
    """
    spark, folder = listing.sparkSession, new_folder(listing.sparkSession, "videos")
    found = written(store.lookup(listing, "video"), f"{folder}/found")
    usable = (F.col("status") == "hit") & (vectors.has_signal("clip_vector") | vectors.has_signal("audio_vector"))
    known = found.where(usable).select("path", F.lit("processed").alias("outcome"), F.lit(None).cast("string").alias("message"))
    todo = written(durations(found.where(~usable).select(*listing.columns)), f"{folder}/todo")
    mute = todo.where("duration IS NULL").select("path", F.lit("skipped").alias("outcome"), F.lit("can't read the duration").alias("message"))
    todo = todo.where("duration IS NOT NULL")
    samples = written(sample_points(todo, cfg=cfg), f"{folder}/samples")
    features = todo.select("path", "dir", "file_size", "mtime")
    for name, modality in (("clip", frames), ("audio", sound)):
        if modality.error is not None or modality.extract is None or modality.make is None:
            features = features.withColumns({f"{name}_vector": F.lit(None).cast("array<float>"), f"_{name}_failures": F.lit(0)})
            continue
        taken = modality.extract(samples)
        encoded = written(encode(taken.select("path", "pos", "content"), modality.make), f"{folder}/{name}")
        failures = encoded.groupBy("path").agg(F.count_if(F.col("vector").isNull()).alias(f"_{name}_failures"))
        features = features.join(failures, "path", "left").join(pooled(encoded).withColumnRenamed("vector", f"{name}_vector"), "path", "left")
    valid = lambda c: F.when(vectors.has_signal(c), F.col(c))
    features = written(features.withColumns({c: valid(c) for c in ("clip_vector", "audio_vector")}), f"{folder}/features")
    empty = F.col("clip_vector").isNull() & F.col("audio_vector").isNull()
    reasons = formats.failure_reasons(F.lit(frames.error).cast("string"), F.coalesce("_clip_failures", F.lit(0)), F.lit(sound.error).cast("string"), F.coalesce("_audio_failures", F.lit(0)))
    skipped = features.where(empty).select("path", F.lit("skipped").alias("outcome"), reasons.alias("message"))
    null = lambda kind: F.lit(None).cast(kind)
    changes = features.where(~empty).select(F.lit("video").alias("namespace"), "path", "dir", "file_size", "mtime", null("string").alias("content_hash"), null("long").alias("updated_at"), F.lit(store.version).alias("payload_version"), null("string").alias("thumbnail_path"), "clip_vector", "audio_vector")
    bad = written(store.upsert(changes, now), f"{folder}/bad") if changes.limit(1).count() else spark.createDataFrame([], "path string, message string")
    done = changes.select("path").join(bad, "path", "left").select("path", F.when(F.col("message").isNull(), "processed").otherwise("write_failed").alias("outcome"), "message")
    return known.unionByName(mute).unionByName(skipped).unionByName(done)
