import os
import struct
import zlib

import numpy as np

from vesper.functions import pixels
from vesper.functions.blake3 import digest
from vesper.sources.thumbs import png, write_thumbnails


def decoded(content):
    """The pixels of a PNG file as png() makes them; checks each chunk's sum."""
    assert content[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(content):
        n = struct.unpack(">I", content[at : at + 4])[0]
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        assert struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        chunks[kind] = body
        at += 12 + n
    width, height = struct.unpack(">II", chunks[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, 1 + 3 * width)
    assert (rows[:, 0] == 0).all() and chunks[b"IEND"] == b""
    return rows[:, 1:].reshape(height, width, 3)


def test_png_holds_the_pixels():
    image = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (decoded(png(7, 5, image.tobytes())) == image).all()


def test_thumbnails_are_written(spark, tmp_path):
    rng = np.random.default_rng(2)
    images = {f"/d/{i}.jpg": rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for i, (w, h) in enumerate([(40, 20), (3, 9), (16, 16)])}
    rows = [(p, x.shape[1], x.shape[0], x.tobytes()) for p, x in images.items()] + [("/d/none.jpg", 4, 4, None), ("/d/bad.jpg", 9, 9, b"x"), (None, 1, 1, b"abc")]
    df = spark.createDataFrame(rows, "path string, width int, height int, pixels binary")
    folder = tmp_path / "thumbs"
    for _ in range(2):  # a second run writes the same files
        out = {r["path"]: r for r in write_thumbnails(df, str(folder), 16).collect()}
        assert len(os.listdir(folder)) == 3
    for path, image in images.items():
        w, h = pixels.fitted(image.shape[1], image.shape[0], 16, 16)
        assert out[path]["thumbnail_path"] == str(folder / f"{digest(path.encode())[:16]}.png") and out[path]["bytes"] == os.path.getsize(out[path]["thumbnail_path"])
        with open(out[path]["thumbnail_path"], "rb") as f:
            assert (decoded(f.read()) == pixels.whole(pixels.resampled(image, w, h, "lanczos3"))).all()
    assert out["/d/none.jpg"]["message"] == "no image" and out["/d/bad.jpg"]["thumbnail_path"] is None and out[None]["message"] == "no path"
    uri = {r["path"]: r for r in write_thumbnails(df.limit(1), f"file://{folder}", 8).collect()}["/d/0.jpg"]
    assert uri["message"] is None and decoded((folder / os.path.basename(uri["thumbnail_path"])).read_bytes()).shape == (4, 8, 3)


def test_a_folder_that_cant_be_written(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    df = spark.createDataFrame([("/d/a.jpg", 1, 1, b"abc")], "path string, width int, height int, pixels binary")
    row = write_thumbnails(df, str(tmp_path / "file" / "thumbs")).first()
    assert row["thumbnail_path"] is None and row["message"] and os.listdir(tmp_path) == ["file"]
    assert write_thumbnails(df.limit(0), str(tmp_path / "t")).count() == 0
