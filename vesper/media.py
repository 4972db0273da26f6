"""A media collection made of the embeddings table, for queries and benchmarks; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, ordinal, label, namespace, dir, path, file_size, updated_at, payload_version, thumb_bytes, clip, audio."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    i = F.col("vec_id")
    video = i % 4 == 3
    e = e.withColumn("namespace", F.when(video, "video").otherwise("image")).withColumn("dir", F.concat(F.lit("/lib/d"), F.col("label").cast("string"), F.when(i % 3 == 0, "/sub").otherwise("")))
    suffix = F.when(video, ".mp4").when(i % 8 == 0, ".JPG").when(i % 4 == 0, ".jpg").when(i % 4 == 1, ".png").otherwise(".webp")
    return e.select(
        "vec_id", i.alias("ordinal"), "label", "namespace", "dir", F.concat("dir", F.when(i % 2 == 0, "/IMG_").otherwise("/shot-"), i.cast("string"), suffix).alias("path"),
        (1000 + (i * 37) % 5000).alias("file_size"), (1700000000 + (i * 7919) % 86400).alias("updated_at"), F.when(i % 13 == 0, 1).otherwise(2).alias("payload_version"),
        F.when(i % 6 == 5, F.lit(0).cast("long")).otherwise(500 + (i * 53) % 1500).alias("thumb_bytes"),
        F.when(i % 10 != 9, F.slice("embedding", 1, 32)).alias("clip"),
        F.when(video & (i % 5 != 2) & (i % 40 != 39), F.slice("embedding", 33, 32)).alias("audio"),
    )


SQL = """media AS (SELECT vec_id, vec_id AS ordinal, label, namespace, dir,
  dir || CASE WHEN vec_id % 2 = 0 THEN '/IMG_' ELSE '/shot-' END || vec_id ||
    CASE WHEN vec_id % 4 = 3 THEN '.mp4' WHEN vec_id % 8 = 0 THEN '.JPG' WHEN vec_id % 4 = 0 THEN '.jpg' WHEN vec_id % 4 = 1 THEN '.png' ELSE '.webp' END AS path,
  1000 + (vec_id * 37) % 5000 AS file_size, 1700000000 + (vec_id * 7919) % 86400 AS updated_at, CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 2 END AS payload_version,
  CASE WHEN vec_id % 6 = 5 THEN 0 ELSE 500 + (vec_id * 53) % 1500 END AS thumb_bytes,
  CASE WHEN vec_id % 10 <> 9 THEN embedding[1:32] END AS clip,
  CASE WHEN vec_id % 4 = 3 AND vec_id % 5 <> 2 AND vec_id % 40 <> 39 THEN embedding[33:64] END AS audio
  FROM (SELECT *, CASE WHEN vec_id % 4 = 3 THEN 'video' ELSE 'image' END AS namespace, '/lib/d' || label || CASE WHEN vec_id % 3 = 0 THEN '/sub' ELSE '' END AS dir FROM embeddings))"""
