"""Resampling of raw RGB images by separable filters, and pixel tensors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Means and deviations of the colours that the image encoder was trained with, and the size of thumbnails.
CLIP_MEAN = (0.48145466, 0.4578275, 0.40821073)
CLIP_STD = (0.26862954, 0.26130258, 0.27577711)
THUMBNAIL = 224


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def _lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


#: Kernel and how far it reaches.
FILTERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {"triangle": (_triangle, 1.0), "lanczos3": (_lanczos3, 3.0)}


def band(size: int, to: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The band of the matrix that takes `size` samples to `to`: for each new one, which old ones (to, width) and their weights, which sum to 1.

    When there are fewer, the kernel is as much wider, so that each old sample counts. Beyond the edge there is nothing.
    """
    kernel, reach = FILTERS[kind]
    ratio = size / to
    scale = max(ratio, 1.0)
    centre = (np.arange(to) + 0.5) * ratio
    first = np.clip(np.floor(centre - reach * scale), 0, size - 1).astype(np.int64)
    last = np.maximum(first + 1, np.minimum(size, np.ceil(centre + reach * scale).astype(np.int64)))
    at = first[:, None] + np.arange(int((last - first).max()))
    weight = np.where(at < last[:, None], kernel((at - (centre - 0.5)[:, None]) / scale), 0)
    return np.minimum(at, size - 1), weight / weight.sum(axis=1, keepdims=True)


def _along_first(x: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), *x.shape[1:]))
    for k in range(at.shape[1]):
        out += weight[:, k].reshape(-1, *[1] * (x.ndim - 1)) * x[at[:, k]]
    return out


def resampled(image: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """(height, width, colours) as doubles, rows first, then columns."""
    x = image.astype(np.float64)
    x = _along_first(x, *band(x.shape[0], height, kind))
    return _along_first(x.transpose(1, 0, 2), *band(x.shape[1], width, kind)).transpose(1, 0, 2)


def whole(x: np.ndarray) -> np.ndarray:
    """As bytes: cut to 0 and 255, halves go up."""
    return np.floor(np.clip(x, 0, 255) + 0.5).astype(np.uint8)


def fitted(width: int, height: int, most_width: int = THUMBNAIL, most_height: int = THUMBNAIL) -> tuple[int, int]:
    """The largest size of the same shape that fits, one pixel at least; small images grow."""
    by = min(most_width / width, most_height / height)
    return max(1, math.floor(width * by + 0.5)), max(1, math.floor(height * by + 0.5))


def tensor(image: np.ndarray) -> np.ndarray:
    """(colours, height, width) of (height, width, colours): (p / 255 - mean) / deviation."""
    return ((image / 255.0 - np.array(CLIP_MEAN)) / np.array(CLIP_STD)).transpose(2, 0, 1)


def _per_image(rows: DataFrame, new: list[T.StructField], kinds: list[pa.DataType], one: Callable[[np.ndarray], tuple]) -> DataFrame:
    """rows (width, height, pixels and others) with one(image) in place of those columns, and message: null, or why there is nothing."""
    used = ("width", "height", "pixels")
    kept = [f for f in rows.schema.fields if f.name not in (*used, *(f.name for f in new), "message")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out, messages = batch.slice(at, 64), [], []
                for w, h, data in zip(*(part.column(c).to_pylist() for c in used), strict=True):
                    if w is None or h is None or data is None or w < 1 or h < 1 or len(data) != 3 * w * h:
                        out.append((None,) * len(new))
                        messages.append("no image" if data is None else "size and pixels differ")
                        continue
                    out.append(one(np.frombuffer(data, np.uint8).reshape(h, w, 3)))
                    messages.append(None)
                columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns, pa.array(messages, pa.string())], [*(f.name for f in kept), *(f.name for f in new), "message"])

    wanted = [*(F.col(f"`{f.name}`") for f in kept), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels"]
    return rows.select(*wanted).mapInArrow(run, T.StructType([*kept, *new, T.StructField("message", T.StringType())]))


def resize(rows: DataFrame, width: int = THUMBNAIL, height: int = THUMBNAIL, kind: str = "lanczos3", exact: bool = False) -> DataFrame:
    """rows with their images (width, height, pixels: RGB bytes, row by row) at another size, and message.

    exact: just that size; else the largest of the image's own shape within it, as thumbnails are. Rows whose pixels are null or don't fit their
    size have a message, and null in all three. An image is held by itself, with a band of weights.
    """

    def one(image: np.ndarray) -> tuple:
        w, h = (width, height) if exact else fitted(image.shape[1], image.shape[0], width, height)
        return w, h, whole(resampled(image, w, h, kind)).tobytes()

    new = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())]
    return _per_image(rows, new, [pa.int32(), pa.int32(), pa.binary()], one)


def tensors(rows: DataFrame, width: int = THUMBNAIL, height: int = THUMBNAIL, kind: str = "triangle", rounded: bool = True, into: str = "tensor") -> DataFrame:
    """rows with an encoder's input in place of the image: `into` (array<float>, colour by colour and row by row, normalised), and message.

    Images are resampled to just this size; `rounded`: to whole bytes before they are normalised, as an image file would hold them.
    """

    def one(image: np.ndarray) -> tuple:
        x = resampled(image, width, height, kind)
        return (tensor(whole(x) if rounded else x).ravel().astype(np.float32),)

    return _per_image(rows, [T.StructField(into, T.ArrayType(T.FloatType()))], [pa.list_(pa.float32())], one)
