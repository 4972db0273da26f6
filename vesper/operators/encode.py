"""Feature extraction by encoders that the caller supplies, one instance for each Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Sampling
from ..functions.sampling import sample_timestamps


class Encoder(Protocol):
    dim: int

    def encode(self, contents: list[bytes]) -> list[list[float] | None]:
        """A vector for each content; None where it can't be read."""
        ...


class HashEncoder:
    """A stand-in without weights: equal contents have equal unit vectors."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def encode(self, contents: list[bytes]) -> list[list[float] | None]:
        out = []
        for c in contents:
            if not c:
                out.append(None)
                continue
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(c).digest()[:8], "little")).standard_normal(self.dim)
            out.append((v / np.sqrt((v * v).sum() + 1e-8)).tolist())
        return out


class ByteEncoder:
    """A stand-in that SQL can state: how often each remainder of the bytes by `dim` occurs, divided by the length of that vector."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def encode(self, contents: list[bytes]) -> list[list[float] | None]:
        counts = [np.bincount(np.frombuffer(c, np.uint8) % self.dim, minlength=self.dim) if c else None for c in contents]
        return [None if n is None else (n / np.sqrt((n * n).sum())).tolist() for n in counts]


def encode(rows: DataFrame, make: Callable[[], Encoder], content: str = "content", batch: int = 64) -> DataFrame:
    """rows without `content`, with vector, outcome (processed or skipped) and message. An encoder error skips its batch's rows one by one."""
    names = [c for c in rows.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                contents = [c or b"" for c in part.column(content).to_pylist()]
                vectors, messages = [], []
                try:
                    vectors = encoder.encode(contents)
                    messages = [None if v is not None else "can't be read" for v in vectors]
                except Exception:
                    for c in contents:
                        try:
                            vectors.append(encoder.encode([c])[0])
                            messages.append(None if vectors[-1] is not None else "can't be read")
                        except Exception as e:
                            vectors.append(None)
                            messages.append(str(e))
                outcome = ["processed" if m is None else "skipped" for m in messages]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(vectors, pa.list_(pa.float32())), pa.array(outcome), pa.array(messages, pa.string())], [*names, "vector", "outcome", "message"])

    new = [T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("outcome", T.StringType()), T.StructField("message", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema.fields if f.name != content), *new]))


def sample_points(videos: DataFrame, duration: str = "duration", cfg: Sampling = Sampling()) -> DataFrame:
    """A row for each timestamp at which a video is to be sampled: the videos' columns, pos and at_secs."""
    return videos.select("*", F.posexplode(sample_timestamps(duration, cfg)).alias("pos", "at_secs"))


def pooled(samples: DataFrame, key: str = "path", vector: str = "vector") -> DataFrame:
    """key, vector: the mean of a video's sample vectors, divided by its length; samples without vector are left out."""
    from .similarity import mean_vectors

    usable = samples.where(F.col(vector).isNotNull())
    return mean_vectors(usable, key, vector).select(key, F.col(vector).cast("array<float>").alias(vector))


def runnable(requested: tuple[str, ...], available: tuple[str, ...], n_files: int) -> tuple[tuple[str, ...], bool]:
    """The modalities that can run, and whether the run fails: only if files ask for some and none can."""
    can = tuple(m for m in requested if m in available)
    return can, bool(n_files and requested and not can)
