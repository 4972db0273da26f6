"""Components of long chains, and near-duplicates in large families, with null and repeated ids."""

import collections
import random

from test_operators import docs, neardup_brute

from vesper.llm import components, neardup


def test_long_chains_take_few_steps(spark):
    rng = random.Random(3)
    shuffled = rng.sample(range(2001), 2001)
    for edges in ([(i, i + 1) for i in range(2000)], list(zip(shuffled, shuffled[1:], strict=False))):
        steps = []
        out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), rounds=steps).collect()}
        assert out == dict.fromkeys(range(2001), 0) and len(steps) <= 20


def test_large_families_meet_once_they_are_connected(spark, monkeypatch):
    """A family of copies of one text, cut into many blocks, with outsiders, and a chain of revisions."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(w)))
    half = base[:60] + rng.choices(words, k=70)  # collides with the copies, but isn't linked
    rows += [(200 + i, " ".join(half[: 128 + i])) for i in range(3)]
    revision = rng.choices(words, k=100)
    for i in range(60):
        revision[(7 * i) % 100] = rng.choice(words)
        rows.append((300 + i, " ".join(revision)))
    rng.shuffle(rows)
    expected = neardup_brute(rows)

    for block in (4, 16):
        monkeypatch.setattr(neardup, "SIGN_BLOCK", block)
        monkeypatch.setattr(neardup, "SET_BLOCK", block)
        out = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, rows)).collect()}
        assert {d: (r["n_shingles"], r["component_id"]) for d, r in out.items()} == expected
    monkeypatch.setattr(neardup, "SET_BYTES", 4000)  # some sets to a block
    out = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in out.items()} == expected


def test_pairs_of_a_connected_key_are_not_met_again(spark):
    """Rows of one key that all match: the groups hold about twice the rows, not the square."""
    import numpy as np
    from pyspark.sql import functions as F

    keys = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("rep"), F.lit(1 / 20).alias("weight"))
    asked = []

    def rows_of(some):
        asked.append(some)
        return some.withColumn("x", F.lit(1))

    def work(group, rep, payload):
        i = np.flatnonzero(group[1:] == group[:-1])
        return i, i + 1

    edges = neardup.in_blocks(keys, rows_of, "k", ["x"], work)
    assert {r["component"] for r in components.components(edges).collect()} == {0}
    assert len(asked) == 2 and asked[1].count() == 0


def test_null_and_repeated_ids(spark):
    text, other, third = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    near = text + " more"
    rows = [(None, text), (7, near), (9, text), (None, other), (None, other), (3, third), (3, near), (None, None), (4, "")]
    out = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows)).collect())
    assert out == {(None, 38, 3, False): 1, (7, 39, 3, False): 1, (9, 38, 3, False): 1, (None, 38, None, True): 2, (3, 38, 3, True): 1, (3, 39, 3, True): 1, (None, 0, None, True): 1, (4, 0, 4, True): 1}
