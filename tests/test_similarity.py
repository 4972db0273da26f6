import contextlib
import math
import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesper.functions import vectors
from vesper.operators import similarity

ROWS = "ordinal long, path string, clip array<float>"
VIDEO = "ordinal long, path string, clip array<float>, audio array<float>"


def pairs(df):
    return [(r["left_path"], r["right_path"], round(r["similarity"], 6)) for r in df.collect()]


def test_threshold_is_inclusive(spark):
    rows = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.5, 0.75]), (2, "c", [0.0, 1.0])], ROWS)
    assert pairs(similarity.image_pairs(rows, 0.5)) == [("b", "c", 0.75), ("a", "b", 0.5)]


@pytest.mark.parametrize("block", [1, 2, 100])
def test_ties_go_by_path_and_orientation_by_ordinal(spark, block):
    rows = spark.createDataFrame([(0, "b", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "c", [1.0, 0.0]), (3, "d", [0.0, 1.0])], ROWS)
    assert pairs(similarity.image_pairs(rows, 0.0, 3, block=block)) == [("a", "c", 1.0), ("b", "a", 1.0), ("b", "c", 1.0)]


def test_invalid_vectors_make_no_pair(spark):
    rows = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0]), (2, "c", [math.nan, 0.0]), (3, "d", None), (4, "e", []), (5, "f", [math.inf, 0.0])], ROWS)
    assert pairs(similarity.image_pairs(rows, -1.0)) == []


def test_no_rows_and_no_pairs_wanted(spark):
    assert pairs(similarity.image_pairs(spark.createDataFrame([], ROWS), 0.0)) == []
    assert pairs(similarity.image_pairs(spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0])], ROWS), 0.0, 0)) == []


def test_video_modalities(spark):
    rows = spark.createDataFrame(
        [(0, "both1", [1.0, 0.0], [0.0, 1.0]), (1, "both2", [0.5, 0.0], [0.0, 0.25]), (2, "image", [1.0, 0.0], None), (3, "audio", None, [0.0, 1.0]), (4, "zero", [0.0, 0.0], [0.0, 1.0]), (5, "none", None, None), (6, "empty", [], [])],
        VIDEO,
    )
    found = {(a, b): s for a, b, s in pairs(similarity.video_pairs(rows, -1.0))}
    assert found[("both1", "both2")] == 0.4
    assert found[("both1", "image")] == 1.0 and found[("both1", "audio")] == 1.0 and found[("both2", "zero")] == 0.25
    assert ("image", "audio") not in found and not any("none" in k or "empty" in k for k in found)


def test_block_pairs_equal_one_block(spark):
    import random

    rng = random.Random(1)
    rows = [(i, f"p{i:03d}", [rng.uniform(-1, 1) for _ in range(6)], [rng.uniform(-1, 1) for _ in range(4)] if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, VIDEO)
    assert sorted(pairs(similarity.video_pairs(df, 0.1))) == sorted(pairs(similarity.video_pairs(df, 0.1, block=7)))
    assert pairs(similarity.image_pairs(df, 0.1)) == pairs(similarity.image_pairs(df, 0.1, block=7))


def test_two_dot_products(spark):
    r = spark.range(1).select(vectors.dot(F.lit([1.0, 2.0]), F.lit([3.0])).alias("loose"), vectors.strict_dot(F.lit([1.0, 2.0]), F.lit([3.0])).alias("strict"), vectors.strict_dot(F.lit([1.0, 2.0]), F.lit([3.0, 4.0])).alias("sum"), vectors.has_signal(F.lit([0.0, math.nan])).alias("nan"), vectors.has_signal(F.lit([0.0])).alias("zero")).first()
    assert (r["loose"], r["strict"], r["sum"], r["nan"], r["zero"]) == (3.0, None, 11.0, True, False)


def test_cross_max_floor_and_average(spark):
    df = spark.createDataFrame([("A", "B", 1, 1, 1.0), ("A", "B", 1, 2, 0.0)], "left_key string, right_key string, left_id long, right_id long, s double")
    assert similarity.cross_max(df, 0.5).first()["similarity"] == pytest.approx(2 / 3)
    one = spark.createDataFrame([("A", "B", 1, 1, 0.8)], df.schema)
    assert similarity.cross_max(one, 0.9).first()["similarity"] == 0.0
    assert similarity.cross_max(one, 0.8).first()["similarity"] == pytest.approx(0.8)


def test_focus_scopes_and_nan(spark):
    rows = [("image", "/a/b/t.jpg", "/a/b", [1.0, 0.0]), ("image", "/a/b/same.jpg", "/a/b", [1.0, 0.0]), ("image", "/a/b/c/sub.jpg", "/a/b/c", [0.9, 0.1]), ("image", "/a/bc/other.jpg", "/a/bc", [1.0, 0.0]), ("image", "/a/b/nan.jpg", "/a/b", [math.nan, 0.0]), ("image", "/a/b/far.jpg", "/a/b", [0.0, 1.0]), ("image", "/a/b/null.jpg", "/a/b", None)]
    store = spark.createDataFrame(rows, "namespace string, path string, dir string, clip array<float>").withColumn("audio", F.lit(None).cast("array<float>"))
    names = lambda scope: [r["path"].rsplit("/", 1)[1] for r in similarity.focus(store, "/a/b/t.jpg", 0.5, scope).collect()]
    assert names("everywhere") == ["same.jpg", "other.jpg", "sub.jpg"]
    assert names("dir") == ["same.jpg"]
    assert names("subtree") == ["same.jpg", "sub.jpg"]
    assert similarity.focus(store, "/none", 0.5).count() == 0
    status = similarity.focus_status(store, "/a/b/null.jpg", similarity.focus(store, "/a/b/null.jpg", 0.5)).first()
    assert (status["n_items"], status["nothing_indexed"]) == (0, True)


def _workers():
    """Memory of Spark's Python processes: pid, peak MB."""
    parent = {}
    for p in Path("/proc").glob("[0-9]*/stat"):
        with contextlib.suppress(OSError):
            parent[int(p.parent.name)] = int(p.read_text().rsplit(")", 1)[1].split()[1])
    found = {}
    for p in parent:
        q = p
        while q in parent and q != os.getpid():
            q = parent[q]
        with contextlib.suppress(OSError):
            if q == os.getpid() != p and b"pyspark" in (line := Path(f"/proc/{p}/cmdline").read_bytes()) and b"java" not in line:
                found[p] = int(re.search(r"VmHWM:\s*(\d+)", Path(f"/proc/{p}/status").read_text())[1]) / 1024
    return found


@pytest.fixture(scope="module")
def many(spark):
    """Videos of which a block has more pairs than are scored at once: as arrays, and as rows."""
    rng = np.random.default_rng(8)
    clip, audio = rng.normal(size=(3000, 8)).astype(np.float32), rng.normal(size=(3000, 6)).astype(np.float32)
    clip[5], clip[2900, 2], audio[::3] = 0, np.inf, 0
    rows = [(i, f"p{i * 7 % 3000:04d}", a.tolist(), b.tolist() if i % 4 else None) for i, (a, b) in enumerate(zip(clip, audio, strict=True))]
    return clip.astype(float), np.where(np.arange(3000)[:, None] % 4 == 0, 0, audio.astype(float)), spark.createDataFrame(rows, VIDEO).repartition(4).cache()


@pytest.mark.parametrize("block", [3000, 900])
def test_pairs_of_large_blocks_are_all_found(many, block):
    clip, audio, df = many
    with np.errstate(invalid="ignore"):
        image, sound = clip @ clip.T, audio @ audio.T
    seen, heard = (clip != 0).any(axis=1), (audio != 0).any(axis=1)
    seen, heard = seen[:, None] & seen, heard[:, None] & heard
    with np.errstate(invalid="ignore"):
        s = np.where(seen & heard, 0.6 * image + 0.4 * sound, np.where(seen, image, np.where(heard, sound, np.nan)))
        i, j = np.nonzero(np.triu(s >= 12, 1))
    expected = sorted((f"p{a * 7 % 3000:04d}", f"p{b * 7 % 3000:04d}", round(float(s[a, b]), 6)) for a, b in zip(i, j, strict=True))
    found = sorted(pairs(similarity.video_pairs(df, 12.0, block=block)))
    assert [p[:2] for p in found] == [p[:2] for p in expected] and len(found) > 1000
    assert [p[2] for p in found] == pytest.approx([p[2] for p in expected], abs=2e-6)
    best = sorted(((round(float(x), 6), a, b) for a, b, x in zip(*np.nonzero(np.triu(np.isfinite(image), 1)), image[np.triu(np.isfinite(image), 1)], strict=True) if x >= 12), key=lambda r: -r[0])
    top = pairs(similarity.image_pairs(df, 12.0, 40, block=block))
    assert [p[2] for p in top] == pytest.approx([b[0] for b in best[:40]], abs=2e-6) and len(top) == 40


def test_a_worker_holds_a_strip_of_scores(spark, many):
    df = many[2].select((F.col("ordinal") * 2).alias("ordinal"), "path", "clip", "audio").unionByName(many[2].select((F.col("ordinal") * 2 + 1).alias("ordinal"), "path", "clip", "audio")).cache()
    df.count()
    df.mapInArrow(lambda batches: batches, df.schema).count()
    for p in _workers():
        Path(f"/proc/{p}/clear_refs").write_text("5")  # the peak is measured from now on
    before = max(_workers().values())
    assert similarity.video_pairs(df, 60.0, block=6000).count() > 0
    assert max(_workers().values()) - before < 400  # the square of 6000 scores alone has 288 MB, and several were held


@pytest.mark.parametrize("block", [3000, 900])
def test_cross_max_of_large_blocks(many, block):
    clip, _, df = many
    rows = df.where("ordinal <> 2900").select((F.col("ordinal") % 5).cast("int").alias("k"), "ordinal", "clip")
    key, v = np.delete(np.arange(3000) % 5, 2900), np.delete(clip, 2900, axis=0)
    s = v @ v.T
    expected = {}
    for a in range(5):
        for b in range(a + 1, 5):
            part = s[key == a][:, key == b]
            ends = np.concatenate([part.max(axis=1), part.max(axis=0)])
            expected[a, b] = np.where(ends < 9.0, 0, ends).mean()
    found = {(r["left_key"], r["right_key"]): r["similarity"] for r in similarity.cross_max_of(rows, "k", "ordinal", "clip", 9.0, block=block).collect()}
    assert found == pytest.approx(expected)
