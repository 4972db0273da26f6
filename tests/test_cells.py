import math
import random

import numpy as np
import pytest

from vesper.operators import similarity
from vesper.plans import cells as c

VIDEO = "ordinal long, path string, clip array<float>, audio array<float>"


def cones(seed, n, dims, axes, spread):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread) + (3.0 if k == i % axes else 0.0) for k in range(dims)] for i in range(n)]


def rows_of(df):
    return sorted((r["left_path"], r["right_path"], round(r["similarity"], 6)) for r in df.collect())


@pytest.mark.parametrize("threshold", [6.0, 0.5, -1.0])
def test_cells_give_the_same_pairs(spark, threshold):
    rows = [(i, f"p{i:04d}", v, None) for i, v in enumerate(cones(1, 400, 8, 8, 0.3))]
    rows += [(1000, "zero", [0.0] * 8, None), (1001, "nan", [math.nan] * 8, None), (1002, "inf", [math.inf] + [0.0] * 7, None), (1003, "null", None, None), (1004, "short", [3.0], None), (1005, "empty", [], None)]
    df, seen = spark.createDataFrame(rows, VIDEO), []
    for top in (50, None) if threshold > 1 else (50,):
        found = similarity.image_pairs(df, threshold, top, block=25, report=lambda *x: seen.append(x))
        assert rows_of(found) == rows_of(similarity.image_pairs(df, threshold, top))
    assert all(0 < skipped < pairs for pairs, skipped in seen) and seen
    if threshold > 1:
        assert seen[0][1] > 0.5 * seen[0][0]


@pytest.mark.parametrize("threshold", [5.0, 0.1])
def test_cells_of_videos_with_missing_parts(spark, threshold):
    rng = random.Random(2)
    clips, sounds = cones(3, 300, 6, 6, 0.4), cones(4, 300, 4, 4, 0.4)
    rows = [(i, f"v{i:03d}", None if rng.random() < 0.2 else a[: rng.choice([6, 6, 3])], None if rng.random() < 0.2 else [x * rng.choice([0, 1, 1]) for x in b]) for i, (a, b) in enumerate(zip(clips, sounds, strict=True))]
    rows += [(900, "inf", [math.inf, 1.0], None), (901, "big", [1e30] * 6, [1e30] * 4)]
    df = spark.createDataFrame(rows, VIDEO)
    assert rows_of(similarity.video_pairs(df, threshold, block=20)) == rows_of(similarity.video_pairs(df, threshold))


def test_vectors_in_all_directions_go_by_blocks(spark):
    rng = random.Random(5)
    df, seen = spark.createDataFrame([(i, f"p{i}", [rng.gauss(0, 1) for _ in range(32)], None) for i in range(300)], VIDEO), []
    found = similarity.image_pairs(df, 0.2, 40, block=50, report=lambda *x: seen.append(x))
    assert rows_of(found) == rows_of(similarity.image_pairs(df, 0.2, 40)) and "_cell" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_no_cells_meet(spark):
    df = spark.createDataFrame([(i, f"p{i}", v, None) for i, v in enumerate(cones(6, 60, 4, 4, 0.01))], VIDEO)
    assert rows_of(similarity.image_pairs(df, 1e6, block=10)) == []


def test_copies_of_one_vector(spark):
    df = spark.createDataFrame([(i, f"p{i:03d}", [1.0, 0.0] if i < 120 else [0.0, 1.0], None) for i in range(200)], VIDEO)
    assert rows_of(similarity.image_pairs(df, 0.9, 30, block=16)) == rows_of(similarity.image_pairs(df, 0.9, 30))
    assert similarity.image_pairs(df, 0.9, None, block=16).count() == 120 * 119 // 2 + 80 * 79 // 2


def test_bounds_hold(spark):
    vectors = cones(7, 250, 5, 3, 1.0)
    found = c.cells(spark.createDataFrame([(i, v, None if i % 4 else [1.0, float(i)]) for i, v in enumerate(vectors)], "ordinal long, clip array<float>, audio array<float>"), ["clip", "audio"], 12)
    rows, bounds = found.rows.collect(), found.bounds()
    assert found.size.sum() == 250 and np.isfinite(bounds[:, :-1, :-1]).all()
    for a in rows[:60]:
        for b in rows:
            assert np.dot(a["clip"], b["clip"]) <= bounds[0, a["_cell"], b["_cell"]]
            if a["audio"] and b["audio"]:
                assert np.dot(a["audio"], b["audio"]) <= bounds[1, a["_cell"], b["_cell"]]
