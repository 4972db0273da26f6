"""Anchors with many different passages, and texts that are hashed in pieces."""

import random

import numpy as np
import pytest
from test_operators import docs, substring_brute

from vesper.llm import substring


def compare(spark, rows, **options):
    found = {r["doc_id"]: r for r in substring.deduplicate(docs(spark, rows), **options).collect()}
    for d, e in substring_brute({i: (t or "").encode() for i, t in rows}, 200).items():
        r = found[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == e, d


@pytest.mark.parametrize("block", [2, 8])
def test_numbered_boilerplate(spark, block):
    """A line that all documents have, but for a number in it: its anchor has as many different passages as there are documents."""
    rng = random.Random(4)
    line = "".join(rng.choices("abcdefgh ", k=420))
    rows = [(i, f"{i:05d} " + line[: 120 + i % 7] + f" no. {i:06d} " + line[120:400] + f" {i * 7919}") for i in range(60)]
    rows += [(100 + i, line[i:] + str(i)) for i in range(20)] + [(200, "x" * 199), (201, "")]
    compare(spark, rows, block=block)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(substring, "BATCH", 500)
    base = "".join(rng.choices("abcdefgh", k=3000))
    compare(spark, [(1, base), (2, "y" + base[1200:2700] + "z"), (3, base[:199]), (4, base[700:905]), (5, "q" * 1700)])


def test_groups_are_kept_apart():
    rng = random.Random(6)
    passage = [bytes(rng.choices(b"ab", k=30)) for _ in range(5)]
    both = substring.repeated_windows([*passage, *passage], np.full(10, 4), 12, np.repeat([0, 1], 5))
    one = substring.repeated_windows(passage, np.full(5, 4), 12)
    assert (both == np.concatenate([one, one])).all() and not both.all()


def test_rows_repeated_many_times(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdef", k=500))
    out = substring.deduplicate(docs(spark, [(1, text)] * 40 + [(2, "x" + text[:300] + "y")])).collect()
    assert sorted(r["n_removed"] for r in out) == [300] + [500] * 40
