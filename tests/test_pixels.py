import math
import random

import numpy as np
import pytest

from vesper.functions import pixels
from vesper.functions.blake3 import digest, digests

ROWS = "id long, width int, height int, pixels binary"


def plain(image, width, height, kind):
    """Every new pixel by itself, rows first."""
    kernel = {"triangle": lambda x: max(0.0, 1 - abs(x)), "lanczos3": lambda x: 0.0 if abs(x) >= 3 else 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)}[kind]
    reach = {"triangle": 1, "lanczos3": 3}[kind]

    def line(values, to):
        n = len(values)
        ratio = n / to
        scale, out = max(1.0, ratio), []
        for o in range(to):
            c = (o + 0.5) * ratio
            low = min(max(math.floor(c - reach * scale), 0), n - 1)
            high = min(max(math.ceil(c + reach * scale), low + 1), n)
            w = [kernel((i - (c - 0.5)) / scale) for i in range(low, high)]
            out.append(sum(a * b for a, b in zip(w, values[low:high], strict=True)) / sum(w))
        return out

    h, w, _ = image.shape
    tall = np.array([[line([float(image[y, x, c]) for y in range(h)], height) for x in range(w)] for c in range(3)])  # c, x, y
    return np.array([[line([tall[c, x, y] for x in range(w)], width) for y in range(height)] for c in range(3)]).transpose(1, 2, 0)


@pytest.mark.parametrize("kind", ["triangle", "lanczos3"])
@pytest.mark.parametrize(("w", "h", "to_w", "to_h"), [(5, 4, 3, 9), (1, 1, 4, 2), (16, 3, 2, 3), (7, 7, 7, 7), (2, 9, 1, 1)])
def test_resampling_equals_plain(kind, w, h, to_w, to_h):
    image = np.random.default_rng(w * h).integers(0, 256, (h, w, 3), dtype=np.uint8)
    assert np.allclose(pixels.resampled(image, to_w, to_h, kind), plain(image, to_w, to_h, kind), atol=1e-9)


def test_images_of_one_colour_stay_so():
    image = np.full((37, 11, 3), 200, np.uint8)
    for kind in pixels.FILTERS:
        assert (pixels.whole(pixels.resampled(image, 224, 224, kind)) == 200).all()


def test_overshoot_is_cut():
    image = np.zeros((1, 8, 3), np.uint8)
    image[:, 4:] = 255
    sharp = pixels.resampled(image, 32, 1, "lanczos3")
    assert sharp.max() > 255 and sharp.min() < 0 and pixels.whole(sharp).max() == 255 and pixels.whole(sharp).min() == 0


@pytest.mark.parametrize(("size", "expected"), [((448, 224), (224, 112)), ((10, 20), (112, 224)), ((1, 5000), (1, 224)), ((224, 224), (224, 224)), ((300, 301), (223, 224))])
def test_thumbnails_keep_their_shape(size, expected):
    assert pixels.fitted(*size) == expected


def test_thumbnails_and_tensors(spark):
    rng = random.Random(6)
    images = [(i, w, h, bytes(rng.randrange(256) for _ in range(3 * w * h))) for i, (w, h) in enumerate([(4, 4), (9, 3), (1, 1), (30, 40)])]
    bad = [(10, 4, 4, None), (11, 4, 4, b"short"), (12, None, 4, b""), (13, 0, 0, b""), (14, -1, -1, b"abc")]
    df = spark.createDataFrame(images + bad, ROWS)
    found = {r["id"]: r for r in pixels.resize(df, 16, 16).collect()}
    for i, w, h, data in images:
        size = pixels.fitted(w, h, 16, 16)
        assert (found[i]["width"], found[i]["height"]) == size
        assert bytes(found[i]["pixels"]) == pixels.whole(pixels.resampled(np.frombuffer(data, np.uint8).reshape(h, w, 3), *size, "lanczos3")).tobytes()
    assert all(found[i]["pixels"] is None and found[i]["message"] for i, *_ in bad) and found[10]["message"] == "no image"
    assert all(r["width"] == r["height"] == 5 for r in pixels.resize(df.where("id < 4"), 5, 5, exact=True).collect())
    for rounded in (True, False):
        for r in pixels.tensors(df.where("id < 4"), 6, 5, rounded=rounded).collect():
            _, w, h, data = images[r["id"]]
            x = plain(np.frombuffer(data, np.uint8).reshape(h, w, 3), 6, 5, "triangle")
            x = np.floor(np.clip(x, 0, 255) + 0.5) if rounded else x
            expected = [(x[y, k, c] / 255 - pixels.CLIP_MEAN[c]) / pixels.CLIP_STD[c] for c in range(3) for y in range(5) for k in range(6)]
            assert np.allclose(r["tensor"], expected, atol=0.02 if rounded else 1e-5)
    assert pixels.resize(df.limit(0)).count() == 0


def test_hashes_side_by_side():
    rng = random.Random(8)
    contents = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 63, 64, 65, 128, 500, 1023, 1024, 1025, 5000, 0, 64]]
    assert digests(contents) == [digest(c) for c in contents] and digests([]) == []


def test_names_by_hash(spark):
    from vesper.functions import paths

    rows = spark.createDataFrame([("abc",), (None,), ("é" * 700,)], "path string").select("path", paths.blake3_hex("path").alias("h"), paths.blake3_thumbnail_name("path").alias("n")).collect()
    assert rows[0]["h"] == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85" and rows[0]["n"] == "6437b3ac38465133.jpg"
    assert rows[1]["h"] is None and rows[2]["h"] == digest(("é" * 700).encode())
