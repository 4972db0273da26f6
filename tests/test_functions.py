import math

from pyspark.sql import functions as F

from vesper.config import Similarity
from vesper.functions import formats, paths, sampling


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sample_counts(spark):
    expected = {3600.0: 13, 90.0: 6, 30.0: 6, 10.0: 3, 0.0: 0, -5.0: 0, math.nan: 0, math.inf: 0, None: 0}
    for d, n in expected.items():
        assert len(one(spark, sampling.sample_timestamps(F.lit(d).cast("double")))) == n, d


def test_repeated_anchors_stay(spark):
    assert [round(x, 6) for x in one(spark, sampling.sample_timestamps(F.lit(30.0)))] == [3.0, 9.0, 9.0, 15.0, 15.0, 15.0]


def test_gap_filter_and_uniform(spark):
    assert one(spark, sampling.gap_filter(F.lit([5.0, 10.0, 30.0, 35.0, 60.0]), 20.0)) == [5.0, 30.0, 60.0]
    assert one(spark, sampling.gap_filter(F.array().cast("array<double>"), 20.0)) == []
    points = one(spark, sampling.uniform_points(6, F.lit(120.0)))
    assert len(points) == 6 and abs(points[0] - 120 / 7) < 1e-9
    assert one(spark, sampling.uniform_points(0, F.lit(120.0))) == [] and one(spark, sampling.uniform_points(3, F.lit(0.0))) == []


def test_sizes_times_and_scores(spark):
    size = lambda n: one(spark, formats.human_size(F.lit(n).cast("long")))
    assert [size(n) for n in (0, 1023, 1024, 1536, 1 << 20, 1 << 50)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "1024.0 TB"]
    ago = lambda s: one(spark, formats.relative_time(F.lit(10_000_000 - s), 10_000_000))
    assert [ago(s) for s in (10_000_000, -5, 59, 60, 7200, 86400 * 45)] == ["—", "just now", "just now", "1 minute ago", "2 hours ago", "1 month ago"]
    mib = lambda s: one(spark, formats.parse_mib(F.lit(s)))
    assert [mib(s) for s in (" 1.5 ", "0", "-1", "x", "NaN", "Infinity", "")] == [1572864, None, None, None, None, None, None]
    assert one(spark, formats.badge(F.lit(0.913))) == "91.3 %"
    assert Similarity.rounded(0.864) == 0.86 and Similarity.rounded(0.1) == 0.5


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/IMG.JPG",), ("/a/b/x.jpg",), ("/a/b/c/v.mp4",), ("/a/bc/50%_off.png",), ("/a/none",), ("/a/.png",)], "path string")
    got = {r["path"]: r for r in df.select("path", paths.dir_of("path").alias("dir"), paths.extension("path").alias("ext"), paths.is_image("path").alias("image"), paths.indexed_as("path").alias("as"), paths.media_type("path").alias("type"), paths.depth_below("path", "/a/").alias("depth"), paths.in_dir(paths.dir_of("path"), "/a/b", True).alias("below"), paths.name_matches("path", "img").alias("match")).collect()}
    assert got["/a/b/IMG.JPG"]["image"] is False and got["/a/b/IMG.JPG"]["as"] == "image" and got["/a/b/IMG.JPG"]["type"] == "other" and got["/a/b/IMG.JPG"]["match"]
    assert got["/a/b/x.jpg"]["image"] and got["/a/b/c/v.mp4"]["type"] == "video" and got["/a/b/c/v.mp4"]["depth"] == 2
    assert [got[p]["below"] for p in ("/a/b/x.jpg", "/a/b/c/v.mp4", "/a/bc/50%_off.png")] == [True, True, False]
    assert got["/a/none"]["ext"] == "" and got["/a/.png"]["ext"] == "" and got["/a/bc/50%_off.png"]["image"]
