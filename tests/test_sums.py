import math
import random

from vesper.operators.similarity import mean_vector, mean_vectors
from vesper.plans import sums


def plain(rows):
    keys = {}
    for k, v in rows:
        if k is not None and v:
            keys.setdefault(k, []).append(v)
    out = {}
    for k, vs in keys.items():
        columns = [[v[i] for v in vs if len(v) > i and v[i] is not None] for i in range(max(map(len, vs)))]
        mean = [sum(c) / len(c) if c else None for c in columns]
        n = math.sqrt(sum(m * m for m in mean if m is not None))
        out[k] = [m if m is None or not n > 0 else m / n for m in mean]
    return out


def test_means_equal_plain(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b", "c", None]), None if rng.random() < 0.1 else [None if rng.random() < 0.1 else rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 3, 5]))]) for _ in range(500)]
    rows += [("zero", [0.0, 0.0]), ("nulls", [None, None]), ("none", []), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(7)
    expected = plain(rows)
    expected["nulls"] = [None, None]
    for held in (1 << 21, 8):
        monkeypatch.setattr(sums, "HELD", held)
        found = {r["k"]: r["v"] for r in mean_vectors(df, "k", "v").collect()}
        assert set(found) == set(expected)
        for k, v in found.items():
            assert len(v) == len(expected[k]) and all(a is b is None or math.isclose(a, b, abs_tol=1e-9) for a, b in zip(v, expected[k], strict=True))
    assert {(r["k"], r["pos"]) for r in mean_vector(df, "k", "v").collect()} == {(k, i) for k, v in expected.items() for i in range(len(v))}
    assert mean_vectors(df.limit(0), "k", "v").count() == 0


def test_nan_spreads_and_keys_of_any_kind(spark):
    df = spark.createDataFrame([(1, [1.0, math.nan]), (1, [3.0, 1.0]), (2, [4.0])], "k int, v array<float>")
    found = {r["k"]: r["v"] for r in mean_vectors(df, "k", "v").collect()}
    assert math.isnan(found[1][1]) and found[2] == [1.0]


def test_a_task_sends_a_row_a_key(spark):
    df = spark.range(20_000).selectExpr("id % 3 AS k", "array(float(id), 1f) AS v").repartition(5)
    plan = sums.vector_sums(df, "k", "v")
    plan.collect()
    sent = []

    def visit(p):
        if p.nodeName() == "MapInArrow":
            sent.append(p.metrics().get("pythonNumRowsReceived").get().value())
        if p.nodeName() == "AdaptiveSparkPlan":
            visit(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            visit(p.plan())
        for i in range(p.children().size()):
            visit(p.children().apply(i))

    visit(plan._jdf.queryExecution().executedPlan())
    assert sent == [3, 15]
