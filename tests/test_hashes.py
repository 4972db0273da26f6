import io
import os

import pytest
from pyspark.sql import functions as F
from test_store import change, frame

from vesper.functions import blake3
from vesper.operators import freshness
from vesper.schemas import LISTING
from vesper.sources import hashes

# Published test vectors: the bytes 0, 1, ..., 250 over and over.
PUBLISHED = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def content(n):
    return bytes(i % 251 for i in range(n))


@pytest.mark.parametrize("n", PUBLISHED)
def test_published_vectors(n):
    assert blake3.digest(content(n)) == PUBLISHED[n]


def test_another_published_value():
    assert blake3.digest(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


@pytest.mark.parametrize(("segment", "fan", "read"), [(1 << 26, 1024, 1 << 20), (1024, 2, 1024), (2048, 4, 1024), (4096, 2, 2048)])
def test_files_in_segments(spark, tmp_path, monkeypatch, segment, fan, read):
    monkeypatch.setattr(hashes, "READ", read)
    sizes = [*PUBLISHED, 5 * 1024, 4096, 4097, 40_000]
    for n in sizes:
        (tmp_path / f"{n}.bin").write_bytes(content(n))
    rows = [(str(tmp_path / f"{n}.bin"), n) for n in sizes] + [(str(tmp_path / "gone"), 10), (str(tmp_path / "1024.bin"), 1024), (str(tmp_path / "x"), None)]
    (tmp_path / "short").write_bytes(b"abc")
    found = {os.path.basename(r["path"]): r for r in hashes.content_hashes(spark.createDataFrame([*rows, (str(tmp_path / "short"), 90_000)], "path string, file_size long"), segment=segment, fan=fan).collect()}
    assert len(found) == len(sizes) + 3
    for n in sizes:
        assert found[f"{n}.bin"]["content_hash"] == blake3.digest(content(n)) and found[f"{n}.bin"]["message"] is None
    assert found["gone"]["content_hash"] is None and "No such file" in found["gone"]["message"] and found["short"]["message"] == "shorter than listed" and found["x"]["message"] == "no size"


def test_only_files_that_differ_are_read(spark, tmp_path):
    log = tmp_path / "log"

    def read(path):
        with open(log, "a") as f:
            f.write(path + "\n")
        return io.BytesIO(b"abc")

    same, other = blake3.digest(b"abc"), blake3.digest(b"abd")
    store = frame(spark, change("/d/fresh.jpg", 3), change("/d/touched.jpg", 3, 1), change("/d/edited.jpg", 3, 1)).withColumn("content_hash", F.when(F.col("path") == "/d/edited.jpg", other).otherwise(same))
    listed = spark.createDataFrame([("/d/fresh.jpg", "/d", 3, 1, 0), ("/d/touched.jpg", "/d", 3, 9, 1), ("/d/edited.jpg", "/d", 3, 9, 2), ("/d/new.jpg", "/d", 3, 1, 3)], LISTING)
    found = freshness.lookup(hashes.with_hashes(listed, store, "image", read), store, "image")
    assert [r["status"] for r in found.orderBy("ordinal").collect()] == ["hit", "hit", "invalidated", "miss"]
    assert sorted(log.read_text().split()) == ["/d/edited.jpg", "/d/touched.jpg"]


@pytest.mark.parametrize("read", [1024, 2048, 8192])
def test_a_segment_in_several_reads(monkeypatch, read):
    monkeypatch.setattr(hashes, "READ", read)
    for n in (*PUBLISHED, 40_000):
        assert hashes._segment(io.BytesIO(content(n)), n, 0, True).hex() == blake3.digest(content(n))
