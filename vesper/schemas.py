"""Columns of listings and of the keyed feature store."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())
NAMESPACES = ("image", "video")

LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("file_size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("ordinal", T.LongType())])

STORE = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("dir", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("updated_at", T.LongType()),
        T.StructField("payload_version", T.IntegerType()),
        T.StructField("thumbnail_path", T.StringType()),
        T.StructField("clip_vector", VECTOR),
        T.StructField("audio_vector", VECTOR),
    ]
)
